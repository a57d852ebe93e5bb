"""Conversation repair against exhaustive search over edits, in one task and cut into pieces."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from terrapace.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece int"


def cheapest(rows):
    """(cost, audit, lines) by uniform-cost search over whole label strings. rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, list(lines)
        if (at, roles[-1:]) in seen:  # what may follow depends on the last initial alone
            continue
        seen.add((at, roles[-1:]))
        ahead = [("I", 3, at, "user", ""), ("I", 3, at, "assistant", "")]
        if at < len(rows):
            role, text, fault = rows[at]
            more = 3 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                ahead += [("K", more, at + 1, role, text), ("R", 3 + more, at + 1, "user", text), ("R", 3 + more, at + 1, "assistant", text)]
        for label, price, to, role, text in ahead:
            if role and re.fullmatch(r"s?(ua)*u?", roles + role[:1]):
                heapq.heappush(heap, (cost + price, audit + label, to, roles + role[:1], (*lines, f"{role}:{text}")))


def brute(table, damage=True):
    out, groups = {}, {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        rows += [] if what == 0 else [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[1][:1] for r in rows]
        cost, audit, lines = cheapest([(role, text, fault) for (_, role, text), fault in zip(rows, faults)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, table, damage=True, parts=None):
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA)
    rows = (c.damaged if damage else c.undamaged)(frame.repartition(parts) if parts else frame)
    return {r[0]: tuple(r)[1:] for r in c.repair(rows).collect()}


def some(rng, convs, most):
    texts = ["Yes.", "no", "Why?", " ", "", "Well then!", "It is so \n", None, "ß?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(conv, rng.choice([None, *range(most)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for conv in range(convs) for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_the_cheapest(spark, seed):
    rng = random.Random(seed)
    table = some(rng, 60, 9) + [(None, t, "user", "Hm.") for t in range(4)] + [(999, 1, "user", "A."), (999, 1, "user", "A.")]
    assert got(spark, table, parts=3) == brute(table)
    assert got(spark, table, damage=False) == brute(table, False)


def test_long_conversations_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(3)
    table = some(rng, 3, 60) + some(rng, 12, 12)
    want = brute(table)
    monkeypatch.setattr(c, "PIECE_ROWS", 2)
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA)
    # Cut as the tasks would, without Spark's workers, which don't see the patch.
    rows = sorted(c.damaged(frame).collect(), key=lambda r: (r.conv, r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    for size in (1, 2, 5):
        for conv in want:
            mine = [r for r in rows if r.conv == conv and not r.gone]
            pieces, before = [], set()
            for k in range(0, max(1, len(mine)), size):
                part = mine[k : k + size]
                row = {"conv": conv, "piece": k, "turns": [r.turn for r in part], "roles": [r.role for r in part], "texts": [r.text for r in part]}
                summary = c._summary(row | {"before": list(before)})[0]
                before |= {d["digest"] for d in c._digests(row)}
                pieces.append(row | {"first": None, "last": None, "low": None, "high": None} | summary)
            folded = {f["piece"]: f for f in c.fold(pieces)}
            done = [c._finish(p | folded[p["piece"]])[0] for p in pieces]
            sha = hashlib.sha256(b"\n".join(d["written"] for d in done if d["n_lines"])).hexdigest()
            assert (*(done[0][t] for t in c.TOTALS), "".join(d["audit"] for d in done), sha) == want[conv]


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    table = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Aha.", f"Number {t}.", "open end"])) for t in range(3000)] + [(7, 5000, "user", "Same.")] * 400
    assert got(spark, table, parts=4) == brute(table)


def test_lines_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Again?"), (2, 0, "tool", "")], "conv_id long, turn long, role string, text string")
    rows = c.repair(c.undamaged(frame), lines=True).orderBy("conv", "piece", "place").collect()
    assert [(r.conv, r.edit, r.role, r.text) for r in rows] == [(1, "K", "user", "Hello."), (1, "R", "assistant", "Again?")]
    assert c.repair(c.damaged(frame.limit(0))).count() == 0
    long = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_500_000 + "!"), (2, 0, "user", "Hi."), (3, None, None, None)]
    assert got(spark, long, damage=False) == brute(long, False)

"""Conversation structure repair by weighted finite-state composition.

Three machines meet: an acceptor of the conversation's rows, an edit transducer (keep, rerole, delete, insert) and an
acceptor of the role grammar. Their composition is never built: arcs of a state (row, grammar state) are made when
the shortest path asks for them. Weights are (cost, labels) in lexicographic order; the path is found in topological order from
the end, and as all arcs out of a state bear unlike labels, the first label settles a tie.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is cut over many tasks. Conversations that lie wholly inside
a task and are short are repaired there and then. The others become pieces of bounded size: each piece is summed up by what it costs to go through it from
each grammar state to each other, one fold over these summaries tells where the path enters and leaves each piece, and pieces are then
repaired on their own. Only their digest, which is sequential by nature, streams through a task in order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, stored

#: The edit transducer: what each edit costs, and what keeping a truncated row costs besides.
COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
#: The role grammar (s?(ua)+)?: next states by initial, from the start, after s, after u and after a. INSERTED is the one of user and assistant that a state accepts.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = ("u", "u", "a", "u")
FINAL = (True, False, False, True)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Rows and characters of a piece, at most (one longer text is a piece of its own).
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 20

BLANKS = " \t\n\x0b\x0c\r"
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# -- the machines ---------------------------------------------------------------


def symbol(initial: str, fault: str) -> str:
    """One letter for what matters of a row: its initial if the grammar knows it, and whether it must go (-) or is truncated (upper case)."""
    known = initial if initial in ("s", "u", "a") else "x"
    return "-" if fault in ("blank", "duplicate") else known.upper() if fault == "truncated" else known


def row_arcs(row: str, state: int) -> list[tuple[str, int, int]]:
    """(label, cost, next grammar state) of the composed arcs that consume a row, in the order of their labels."""
    out = [("D", COSTS["D"], state)]
    if row != "-":
        more = TRUNCATED if row.isupper() else 0
        kept = GRAMMAR[state].get(row.lower())
        if kept is not None:
            out.append(("K", COSTS["K"] + more, kept))
        out.append(("R", COSTS["R"] + more, GRAMMAR[state][INSERTED[state]]))
    return out


_ARCS = {(row, state): row_arcs(row, state) for row in "-suaxSUAX" for state in range(4)}
#: Where inserting leads.
_AHEAD = tuple(GRAMMAR[state][INSERTED[state]] for state in range(4))


def _with_inserts(base: list[tuple[int, str]]) -> tuple[list, list]:
    """Best (cost, label) with one insertion at most, and with two, before what base holds; a third would only lead back to a state at a cost."""
    one = [min(base[q], (COSTS["I"] + base[_AHEAD[q]][0], "I")) for q in range(4)]
    return one, [min(base[q], (COSTS["I"] + one[_AHEAD[q]][0], "I")) for q in range(4)]


def ways(rows: str, end: list[int], inserts_last: bool) -> list[tuple[list, list, list]]:
    """For each place of the rows, and the end: the best (cost, first label) from each grammar state with 0, 1 and 2 insertions to come. end: costs from there on."""
    base = [(cost, "") for cost in end]
    out = [(base, *_with_inserts(base)) if inserts_last else (base, base, base)]
    for row in reversed(rows):
        after = out[-1][2]
        base = [min((cost + after[to][0], label) for label, cost, to in _ARCS[row, q]) for q in range(4)]
        out.append((base, *_with_inserts(base)))
    return out[::-1]


def walk(rows: str, found: list, state: int) -> tuple[str, int]:
    """(labels, last grammar state) of the best path from a state over what ways() found."""
    labels = []
    for place, best in enumerate(found):
        left = 2
        while True:
            label = best[left][state][1]
            if label != "I":
                break
            labels.append(label)
            state, left = _AHEAD[state], left - 1
        if place < len(rows):
            labels.append(label)
            if label == "K":
                state = GRAMMAR[state][rows[place].lower()]
            elif label == "R":
                state = _AHEAD[state]
    return "".join(labels), state


@lru_cache(maxsize=1 << 14)
def _short_audit(rows: str) -> tuple[int, str]:
    found = ways(rows, [0 if f else NEVER for f in FINAL], True)
    return found[0][2][0][0], walk(rows, found, 0)[0]


def audit(rows: str) -> tuple[int, str]:
    """(cost, labels) of a whole conversation's cheapest edits."""
    return _short_audit(rows) if len(rows) <= 64 else _short_audit.__wrapped__(rows)


def passage(rows: str) -> list[list[tuple[int, int]]]:
    """(cost, rank) of the best way through a piece from each grammar state to each other; rank orders the ways of one entry by their labels.

    Insertions come before the row that follows them, so those at the end belong to the next piece, and no way's labels begin another's.
    """
    labels, costs = [[""] * 4 for _ in range(4)], [[NEVER] * 4 for _ in range(4)]
    for to in range(4):
        found = ways(rows, [0 if q == to else NEVER for q in range(4)], False)
        for q in range(4):
            costs[q][to] = min(NEVER, found[0][2][q][0])
            if costs[q][to] < NEVER:
                labels[q][to] = walk(rows, found, q)[0]
    ranks = [sorted(range(4), key=lambda to, q=q: labels[q][to]) for q in range(4)]
    return [[(costs[q][to], ranks[q].index(to)) for to in range(4)] for q in range(4)]


def through(rows: str, entry: int, leave: int) -> str:
    """Labels of the best way through a piece between two grammar states."""
    return walk(rows, ways(rows, [0 if q == leave else NEVER for q in range(4)], False), entry)[0]


def edited(labels: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that are left or new."""
    out, at = [], 0
    for label in labels:
        if label == "I":
            out.append((label, NAMES[INSERTED[state]], ""))
            state = _AHEAD[state]
            continue
        if label == "K":
            out.append((label, roles[at], texts[at]))
            state = GRAMMAR[state][roles[at][:1]]
        elif label == "R":
            out.append((label, NAMES[INSERTED[state]], texts[at]))
            state = _AHEAD[state]
        at += 1
    return out


# -- rows ---------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows broken by crc32 of "conversation:turn" modulo 20; nulls count as one space in the sum and in role and text.

    0 drops the row (it stays as a mark, `gone`, so that its conversation is known), 1 empties its text, 2 takes its sentence ends out,
    3 repeats it, 4 makes it the user's.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spelt(conv_col), F.lit(":"), spelt(turn_col)).cast("binary")) % 20
    slim = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spelt(role_col).alias("role"), spelt(text_col).alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    here = lambda c: F.when(F.col("what") != 0, c)
    return slim.select("conv", here(F.col("turn")).alias("turn"), here(F.when(F.col("what") == 4, "user").otherwise(F.col("role"))).alias("role"), here(text).alias("text"), (F.col("what") == 0).alias("gone"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as repair() takes them; null roles and texts are one space."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spelt(role_col).alias("role"), spelt(text_col).alias("text"), F.lit(False).alias("gone"))


def digest(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(8, "big") + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def judged(roles: list[str], texts: list[str], before: set = frozenset()) -> tuple[str, list[int]]:
    """(symbols, [blank, duplicate, truncated, illegal]) of consecutive rows; before: digests of rows that earlier pieces hold."""
    seen, symbols, counts = set(), [], [0, 0, 0, 0]
    for role, text in zip(roles, texts):
        core = text.strip(BLANKS)
        key, fault = (role, text), ""
        if not core:
            fault, counts[0] = "blank", counts[0] + 1
        elif key in seen or before and digest(role, text) in before:
            fault, counts[1] = "duplicate", counts[1] + 1
        elif core[-1] not in ".!?":
            fault, counts[2] = "truncated", counts[2] + 1
        seen.add(key)
        symbols.append(symbol(role[:1], fault))
    counts[3] = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    return "".join(symbols), counts


def gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def sha256(lines: list[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode("utf-8", "surrogatepass")).hexdigest()


# -- the tasks ----------------------------------------------------------------


def _schema(conv: T.DataType, lines: bool) -> T.StructType:
    fields = ["piece long", *(f"{c} long" for c in TOTALS), "audit string", "repaired_sha256 string", "turns array<long>", "roles array<string>", "texts array<string>"]
    line = ["lines array<struct<edit: string, role: string, text: string>>"] if lines else []
    return T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(", ".join(fields + line)).fields])


def _repairs(schema: T.StructType, lines: bool):
    """Repairs what lies wholly inside the task; hands on the rest as pieces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def done(conv, turns, roles, texts):
        symbols, counts = judged(roles, texts)
        cost, labels = audit(symbols)
        left = edited(labels, 0, roles, texts)
        row = {"conv": conv, "audit": labels, "repaired_sha256": sha256(left), "cost": cost, "gaps": gaps(turns)} | dict(zip(TOTALS[1:5], counts))
        return row | {"lines": [dict(zip(("edit", "role", "text"), x)) for x in left]} if lines else row

    def run(batches):
        piece = TaskContext.get().partitionId() << 32
        out, out_size, held, size = [], 0, [], 0
        conv, begun, whole = None, False, False

        def close(whole):
            nonlocal held, size, piece, out_size
            turns, roles, texts = ([x[k] for x in held] for k in range(3))
            if whole:
                out.append(done(conv, turns, roles, texts))
            else:
                out.append({"conv": conv, "piece": piece, "turns": turns, "roles": roles, "texts": texts})
                piece += 1
            out_size += size + 64 * len(held)
            held, size = [], 0

        for batch in batches:
            for own, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone"))):
                if begun and own != conv:
                    close(whole)
                    whole = True  # it begins inside the task
                conv, begun = own, True
                if gone:
                    continue
                if held and (len(held) >= PIECE_ROWS or size + len(text) > PIECE_CHARS):
                    close(False)
                    whole = False
                held.append((turn, role, text))
                size += len(text)
                if out_size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
                    out_size = 0
        if begun:
            close(False)  # it may go on in the next task
        yield pa.RecordBatch.from_pylist(out, schema=arrow)
        give_back()

    return run


def _summaries(batches):
    """What each piece costs to go through, and its counts."""
    for batch in batches:
        out = []
        for row in batch.select(["conv", "piece", "turns", "roles", "texts", "before"]).to_pylist():
            symbols, counts = judged(row["roles"], row["texts"], set(row["before"] or ()))
            matrix = passage(symbols)
            known = [t for t in row["turns"] if t is not None]
            out.append({"conv": row["conv"], "piece": row["piece"], "symbols": symbols, "costs": [c for q in matrix for c, _ in q], "ranks": [r for q in matrix for _, r in q], "counts": counts, "rows": len(symbols),
                        "first": row["roles"][0][:1] if row["roles"] else None, "last": row["roles"][-1][:1] if row["roles"] else None, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field("conv"), *_SUMMARY_FIELDS]))


SUMMARY = "piece long, symbols string, costs array<long>, ranks array<long>, counts array<long>, first string, last string, low long, high long, turns long"
FOLDED = "piece long, entry int, tail string, " + ", ".join(f"{c} long" for c in TOTALS)
FINISHED = "piece long, audit string, written binary, n_lines long, " + ", ".join(f"{c} long" for c in TOTALS)


def _with_conv(conv: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(fields).fields])


def _mapped(rows_of, schema: T.StructType):
    """rows_of(row) for each row of the batches, as batches of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for row in batch.to_pylist() for x in rows_of(row)], schema=arrow)

    return run


def _digests(row: dict) -> list[dict]:
    return [{"conv": row["conv"], "piece": row["piece"], "digest": d} for d in {digest(r, t) for r, t in zip(row["roles"], row["texts"]) if t.strip(BLANKS)}]


def _summary(row: dict) -> list[dict]:
    """What a piece costs to go through, and its counts."""
    roles, turns = row["roles"], [t for t in row["turns"] if t is not None]
    symbols, counts = judged(roles, row["texts"], set(row["before"] or ()))
    ways_through = [w for q in passage(symbols) for w in q]
    ends = {"first": roles[0][:1], "last": roles[-1][:1]} if roles else {}
    spread = {"low": min(turns), "high": max(turns)} if turns else {}
    return [{"conv": row["conv"], "piece": row["piece"], "symbols": symbols, "costs": [c for c, _ in ways_through], "ranks": [r for _, r in ways_through], "counts": counts, "turns": len(set(turns))} | ends | spread]


def fold(pieces: list[dict]) -> list[dict]:
    """Where the best path enters each of a conversation's pieces, what it inserts at the end (tail), and the conversation's totals, in each row."""
    pieces = sorted(pieces, key=lambda p: p["piece"])
    end = ways("", [0 if f else NEVER for f in FINAL], True)
    ahead, chosen = [cost for cost, _ in end[0][2]], []
    for p in reversed(pieces):
        best = [min((p["costs"][4 * q + to] + ahead[to], p["ranks"][4 * q + to], to) for to in range(4)) for q in range(4)]
        chosen.append([to for _, _, to in best])
        ahead = [min(NEVER, cost) for cost, _, _ in best]
    out, state = [], 0
    for p, leads in zip(pieces, reversed(chosen)):
        out.append({"piece": p["piece"], "entry": 4 * state + leads[state], "tail": ""})
        state = leads[state]
    out[-1]["tail"] = walk("", end, state)[0]
    totals = dict(zip(TOTALS[1:5], (sum(p["counts"][k] for p in pieces) for k in range(4)))) | {"cost": ahead[0]}
    own, known = [p for p in pieces if p["first"] is not None], [p for p in pieces if p["low"] is not None]
    totals["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:]))
    if known:  # turns rise, so only a piece's last and the next one's first can be the same
        distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        totals["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct
    else:
        totals["gaps"] = 0
    return [x | totals for x in out]


def _folded(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return lambda table: pa.Table.from_pylist(fold(table.to_pylist()), schema=arrow)


def _finish(row: dict) -> list[dict]:
    """A piece's labels and what is left of it."""
    state, leave = divmod(row["entry"], 4)
    labels = through(row["symbols"], state, leave) + row["tail"]
    left = edited(labels, state, row["roles"], row["texts"])
    lines = [dict(zip(("edit", "role", "text"), x)) for x in left]
    written = "\n".join(f"{role}:{text}" for _, role, text in left).encode("utf-8", "surrogatepass")
    return [{k: row[k] for k in ("conv", "piece", *TOTALS)} | {"audit": labels, "written": written, "n_lines": len(left), "lines": lines}]


def _joined(schema: T.StructType):
    """Joins the pieces of a conversation, which come in order: labels are kept (a letter a row), texts only pass through the digest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        row, labels, sha, written = None, [], None, False
        whole = lambda: pa.RecordBatch.from_pylist([{k: row[k] for k in ("conv", *TOTALS)} | {"audit": "".join(labels), "repaired_sha256": sha.hexdigest()}], schema=arrow)
        for batch in batches:
            for found in batch.to_pylist():
                if row is None or found["conv"] != row["conv"]:
                    if row is not None:
                        yield whole()
                    row, labels, sha, written = found, [], hashlib.sha256(), False
                labels.append(found["audit"])
                if found["n_lines"]:
                    sha.update((b"\n" if written else b"") + found["written"])
                    written = True
        if row is not None:
            yield whole()

    return run


# -- the operator -------------------------------------------------------------


def repair(rows: DataFrame, lines: bool = False) -> DataFrame:
    """Repairs rows(conv, turn, role, text, gone) as damaged() and undamaged() give them.

    One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with `lines` instead
    (conv, piece, place, edit, role, text) for each row of the repaired conversations, in the order of piece and place.

    A conversation's rows are taken by turn (nulls first), then by role and text, of each the first 64 characters and then a hash of both. Rows of a null
    conversation are one conversation. Initials that the grammar doesn't know can be deleted or become user or assistant. A conversation whose
    rows are all gone has zeros, an empty audit and the digest of nothing. An empty table gives an empty result; other columns are ignored.

    Rows shuffle once, by ranges; a group of equal rows may be cut anywhere, and so may a conversation.
    """
    spark = rows.sparkSession
    small_batches(spark)
    conv = rows.schema["conv"].dataType
    order = {"__r": F.substring("role", 1, 64), "__t": F.substring("text", 1, 64), "__h": F.xxhash64("role", "text"), "__s": F.rand(11)}
    keyed = rows.withColumns(order)
    dealt = keyed.repartitionByRange("conv", "turn", "__r", "__t", "__h", "__s").sortWithinPartitions("conv", "turn", "__r", "__t", "__h")
    schema = _schema(conv, lines)
    found = stored(dealt.select("conv", "turn", "role", "text", "gone").mapInArrow(_repairs(schema, lines), schema), "conversations")
    whole, open_ = found.where("piece is null"), found.where("piece is not null").select("conv", "piece", "turns", "roles", "texts")

    digests = open_.mapInArrow(_mapped(_digests, s := _with_conv(conv, "piece long, digest binary")), s)
    first = digests.groupBy("conv", "digest").agg(F.min("piece").alias("at"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "at")
    later = digests.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("piece > at")
    before = later.groupBy("piece").agg(F.collect_list("digest").alias("before")).withColumnRenamed("piece", "p")
    known = open_.join(before, F.col("piece") == F.col("p"), "left").drop("p")
    summaries = stored(known.mapInArrow(_mapped(_summary, s := _with_conv(conv, SUMMARY)), s), "pieces")
    folded = summaries.drop("symbols").groupBy("conv").applyInArrow(_folded(s := T._parse_datatype_string(FOLDED)), s)
    joined = open_.join(summaries.select("piece", "symbols"), "piece").join(folded, "piece")
    line = "lines array<struct<edit: string, role: string, text: string>>"
    finished = joined.mapInArrow(_mapped(_finish, s := _with_conv(conv, f"{FINISHED}, {line}" if lines else FINISHED)), s)
    if lines:
        both = whole.select("conv", F.lit(-1).cast("long").alias("piece"), "lines").union(finished.select("conv", "piece", "lines"))
        return both.select("conv", "piece", F.posexplode("lines").alias("place", "line")).select("conv", "piece", "place", "line.*")
    result = _with_conv(conv, ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string")
    rest = finished.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_joined(result), result)
    return whole.select(*result.names).union(rest)

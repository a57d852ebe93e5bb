"""Secret scans with a recursive decoding worklist.

Every text is a layer on a worklist. A layer is scanned, then unwrapped in each way that applies: percent escapes, Unicode
escapes, base64 runs and compressed streams, each giving a further layer that knows which part of its parent every
character came from. Layers that were seen before at the same place of the text are not taken again, so the list ends at a fixpoint, also
where a stream decompresses to itself. Spans found in a layer are carried back to the text.

All of it is a function of one text, so nothing shuffles. Decoded layers are bytes (one character each): what is searched for and what is
unwrapped are ASCII.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html.entities
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_VALUE = 6
# A run of AKIA[A-Z0-9]+ or [0-9a-f]+ is matched from its start to its end, so its least length can stand in the pattern; assign's values can't, as a short one hides what follows.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&(amp|lt|gt|quot|apos|equals|colon|num|percnt|bsol);")
_NAMED = {n: ord(html.entities.html5[n + ";"]) for n in ("amp", "lt", "gt", "quot", "apos", "equals", "colon", "num", "percnt", "bsol")}
#: Runs of at least this many characters are tried as base64; line ends may part them.
LEAST_BASE64 = 16
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*")
_URLSAFE = str.maketrans("-_", "+/")
#: What decoded bytes must hold to be a layer: a stretch that can be read, or the start of a compressed stream.
_READABLE = re.compile(r"[\t\n\r\x20-\x7e]{12,}")
_PACKED = re.compile(r"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: Decoded characters of a text, at most: this many and MORE_DECODED for each of its own, so that a decompression bomb ends. Layers that are left are counted.
MOST_DECODED = 32 << 20
MORE_DECODED = 16


def matches(text: str):
    """(kind, start, end) of the matches in one layer, by kind."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield 0, m.start(), m.end()
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


class Layer:
    """A decoded text and where its characters stand in the text it was decoded from.

    Stretches of it begin at `at`; the character k places into a stretch stands at first + k * width / 8, in eighths of a
    character of the parent (base64's bytes take 8/6 of a character); stretches of width 0 stand for the whole of first .. last.
    """

    __slots__ = ("text", "parent", "at", "first", "last", "width", "root")

    def __init__(self, text: str, parent: Layer | None, at=(0,), first=(0,), last=(0,), width=(1,)):
        self.text, self.parent, self.at, self.first, self.last, self.width = text, parent, at, first, last, width
        self.root = (0, len(text)) if parent is None else self.origin(0, len(text)) if text else (0, 0)

    def up(self, start: int, end: int) -> tuple[int, int]:
        """A span of this layer as one of its parent."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.first[i] if self.width[i] == 0 else self.first[i] + (start - self.at[i]) * (8 if self.width[i] == 8 else 1) // (6 if self.width[i] == 8 else 1)
        k = end - self.at[j]
        b = self.last[j] if self.width[j] == 0 else self.first[j] + (-(-k * 8 // 6) if self.width[j] == 8 else k)
        return a, b

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """A span of this layer as one of the whole text."""
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


def _unescaped(layer: Layer, pattern: re.Pattern, value) -> Layer | None:
    """The layer with every escape replaced by what it stands for; value(match) is a code point, or None to leave it."""
    parts, at, first, last, width = [], [], [], [], []
    text, done, size = layer.text, 0, 0

    def plain(stop):
        nonlocal size
        if stop > done:
            parts.append(text[done:stop])
            at.append(size)
            first.append(done)
            last.append(stop)
            width.append(1)
            size += stop - done

    for m in pattern.finditer(text):
        code = value(m)
        if code is None:
            continue
        plain(m.start())
        parts.append(chr(code))
        at.append(size)
        first.append(m.start())
        last.append(m.end())
        width.append(0)
        size += 1
        done = m.end()
    if not done:
        return None
    plain(len(text))
    return Layer("".join(parts), layer, at, first, last, width)


def _code(m: re.Match) -> int | None:
    for group, base in zip(m.groups(), (16, 16, 16, 16, 10, 16, 0)):
        if group is not None:
            code = int(group, base) if base else _NAMED[group]
            return code if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    return None


def _base64_layers(layer: Layer):
    text = layer.text
    for m in _BASE64.finditer(text):
        run, begin = m.group(), m.start()
        lines = [(run, begin)] if "\n" not in run else [(run, begin), *((x.group(), begin + x.start()) for x in re.finditer(r"[^\r\n]{16,}", run))]
        for piece, start in lines:
            keep = [k for k, c in enumerate(piece) if c not in "\r\n"] if "\n" in piece else None
            digits = (piece if keep is None else "".join(piece[k] for k in keep)).translate(_URLSAFE)
            for shift in range(4):  # the run may begin with letters that aren't the blob's
                body = digits[shift:]
                if len(body) < LEAST_BASE64:
                    break
                body = body[: len(body) - 1] if len(body) % 4 == 1 else body
                data = base64.b64decode(body + "=" * (-len(body) % 4)).decode("latin-1")
                if _PACKED.match(data) or _READABLE.search(data):
                    if keep is None:
                        yield Layer(data, layer, (0,), (start + shift,), (start + shift + len(body),), (8,))
                    else:  # each byte stands for the digits that hold it
                        spots = [keep[shift + k] + start for k in range(len(body))]
                        yield Layer(data, layer, range(len(data)), [spots[k * 8 // 6] for k in range(len(data))], [spots[-(-(k + 1) * 8 // 6) - 1] + 1 for k in range(len(data))], [0] * len(data))


def _decompressor(head: str):
    if head.startswith("\x1f"):
        return zlib.decompressobj(31)
    if head.startswith("\x28"):
        return zstandard.ZstdDecompressor().decompressobj()
    if head.startswith("B"):
        return bz2.BZ2Decompressor()
    if head.startswith("\xfd"):
        return lzma.LZMADecompressor()
    return zlib.decompressobj()


def _opened(data: bytes, head: str, most: int) -> tuple[bytes, int, bool]:
    """(what a stream at the start of data holds, bytes it takes, whether it is more than `most`); broken streams give what came before the break."""
    stream, out, size, at = _decompressor(head), [], 0, 0
    step = 1 << 12  # of input: what it becomes is bounded
    try:
        while at < len(data) and not getattr(stream, "eof", False):
            got = stream.decompress(data[at : at + step])
            at += step
            out.append(got)
            size += len(got)
            if size > most:
                return b"", 0, True
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError):
        pass
    return b"".join(out), min(len(data), at) - len(getattr(stream, "unused_data", b"") or b""), False


def _streams(layer: Layer, most: int):
    """Layers of the compressed streams in decoded bytes; None for one that is too large."""
    if layer.parent is None:
        return
    text, done = layer.text, 0
    while m := _PACKED.search(text, done):
        done = m.start() + 1
        try:
            data = text[m.start() :].encode("latin-1")
        except UnicodeEncodeError:
            data = text[m.start() :].encode("latin-1", "replace")
        plain, taken, over = _opened(data, m.group(), most)
        if over:
            yield None
        elif plain:
            done = m.start() + max(1, taken)
            yield Layer(plain.decode("latin-1"), layer, (0,), (m.start(),), (done,), (0,))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, all spans, layers decoded, layers left out) of a text; spans are (start, kind, end), in order."""
    base = sorted({(a, kind, b) for kind, a, b in matches(text)})
    spans, layers, left_out = set(base), 0, 0
    if "%" in text or "\\" in text or "&" in text or _BASE64.search(text):
        budget = MOST_DECODED + MORE_DECODED * len(text)
        seen, work = set(), deque([Layer(text, None)])
        while work:
            layer = work.popleft()
            found = [_unescaped(layer, _PERCENT, lambda m: int(m[1], 16)) if "%" in layer.text else None, _unescaped(layer, _UNICODE, _code) if "\\" in layer.text or "&" in layer.text else None]
            for new in (*filter(None, found), *_base64_layers(layer), *_streams(layer, max(0, budget))):
                if new is None or len(new.text) > budget:
                    left_out += 1
                    continue
                if not new.text:
                    continue
                key = hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), new.root
                if key in seen:
                    continue
                seen.add(key)
                budget -= len(new.text)
                layers += 1
                for kind, a, b in matches(new.text):
                    start, end = new.origin(a, b)
                    spans.add((start, kind, end))
                work.append(new)
    return base, sorted(spans), layers, left_out


def spelt(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: long, stop: long, decoded: boolean>>, n_layers long, unopened long"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (spans of the text as it is), base_sha256, spans, found, n_layers, unopened.

    Spans are offsets of code points in the text, the end exclusive; found tells which came out of a decoded layer, and stands for what
    encodes the secret: just its digits in base64, the whole stream where it is compressed. A match that also stands in the text as it is counts once.
    Null and empty texts have none. Repeated rows and rows with a null id have rows of their own. An empty table gives an
    empty result; other columns are ignored. A text's decoded layers end at MOST_DECODED + MORE_DECODED * its length characters, which
    takes a decompression bomb; layers beyond are counted in unopened, and the text itself is always scanned whole.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [pa.field(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")] + [pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    fields.append(pa.field("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("decoded", pa.bool_())]))))
    fields += [pa.field("n_layers", pa.int64()), pa.field("unopened", pa.int64())]

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, spans, layers, left_out = scan(text.as_py() or "")
                counts, own = [sum(kind == k for _, kind, _ in base) for k in range(3)], set(base)
                found = [{"kind": KINDS[kind], "start": a, "stop": b, "decoded": (a, kind, b) not in own} for a, kind, b in spans]
                out.append((*counts, hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(spans), found, layers, left_out))
            columns = [pa.array([row[k] for row in out], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=pa.schema([batch.schema.field("doc_id"), *fields]))
        give_back()

    from pyspark.sql import types as T

    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])
    return slim.mapInArrow(run, schema)

"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every task trains a dictionary on its first records and writes archives of bounded size to
a shared folder, under names of its attempt, which it lists in a table that Spark commits. Reading: the archives
that are listed there (those of a lost or repeated attempt are not) are handed to tasks, which load the
dictionary from the skippable frame, walk the frames by their headers, decode one at a time and validate versions, headers,
lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, Keyed, fresh_path, partitions

#: The skippable frame that carries a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: Uncompressed bytes of one archive; and records, and their first bytes, that a dictionary is trained on.
ARCHIVE_BYTES = 16 << 20
TRAIN_RECORDS = 400
TRAIN_BYTES = 4096
DICTIONARY_BYTES = 32 << 10
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000

WRITTEN = "archive string, records long, bytes long"
RECORDS = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, error string"


class WarcError(ValueError):
    """An archive or record that breaks its format."""


def record_uri(key: int) -> str:
    return f"urn:page:{key}"


def build_record(key: int, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """A response or, with refers_to, a revisit without payload. X-Payload-Length is the full payload's length."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_uri(key)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_uri(refers_to)}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields and payload of one record of any type; WarcError when version, headers, lengths or digests don't hold.

    The payload of an HTTP message is what follows its header. Digests may be absent: then the payload's SHA-1 is given. A revisit has no payload, and
    no payload_bytes unless X-Payload-Length tells.
    """
    end = data.find(b"\r\n\r\n")
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError("no WARC version line")
    if end < 0:
        raise WarcError("the header has no end")
    fields: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError("a header line has no name")
        fields[name.strip().decode("utf-8", "surrogatepass").lower()] = value.strip().decode("utf-8", "surrogatepass")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise WarcError(f"{need} is missing")
    if not fields["content-length"].isdigit():
        raise WarcError("content-length is no number")
    length = int(fields["content-length"])
    if len(data) != end + 4 + length + 4 or not data.endswith(b"\r\n\r\n"):
        raise WarcError("content-length does not fit the record")
    block, kind = data[end + 4 : end + 4 + length], fields["warc-type"]
    payload = _http_body(block) if fields.get("content-type", "").lower().startswith("application/http") else block
    holds = kind not in ("revisit", "continuation")
    if "warc-block-digest" in fields and not _agrees(fields["warc-block-digest"], block):
        raise WarcError("the block's digest differs")
    digest = fields.get("warc-payload-digest", "")
    if holds and digest and not _agrees(digest, payload) and not _agrees(digest, _unchunked(payload)):
        raise WarcError("the payload's digest differs")
    if kind == "revisit" and "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields:
        raise WarcError("a revisit refers to nothing")
    whole = fields.get("x-payload-length", str(len(payload)) if holds else "")
    if (whole and not whole.isdigit()) or (holds and int(whole) != len(payload)):
        raise WarcError("the payload's length does not hold")
    algorithm, value = _digest(digest) if digest else ("sha1", hashlib.sha1(payload).hexdigest() if holds else None)
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": kind,
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None if kind == "revisit" else None,
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": value if algorithm == "sha1" else f"{algorithm}:{value}",
        "payload_bytes": int(whole) if whole else None,
        "payload": payload if holds else None,
        "error": None,
    }


#: Bytes of the digests that are checked; others are taken as they stand.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def _digest(text: str) -> tuple[str, str]:
    """(algorithm, value) of a labelled digest, the value in hex where the algorithm is known; base 32 and hex are read."""
    algorithm, _, value = text.partition(":")
    algorithm, size = algorithm.strip().lower().replace("-", ""), DIGESTS.get(algorithm.strip().lower().replace("-", ""))
    if size is None:
        return algorithm, value
    try:
        return algorithm, (bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper())).hex()
    except ValueError:
        raise WarcError("a digest can't be read") from None


def _agrees(digest: str, data: bytes) -> bool:
    algorithm, value = _digest(digest)
    return algorithm not in DIGESTS or hashlib.new(algorithm, data).hexdigest() == value


def _http_body(block: bytes) -> bytes:
    """The payload of an HTTP message: what follows its header."""
    _, blank, body = block.partition(b"\r\n\r\n")
    return body if blank else b""


def _unchunked(body: bytes) -> bytes:
    """A body without its transfer chunks, as some writers digest it; as it is if it has none."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
    return body


def train(samples: list[bytes]) -> bytes:
    """A dictionary from the records' first bytes; raw content where there is too little to train on."""
    samples = [s[:TRAIN_BYTES] for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:DICTIONARY_BYTES]).ljust(8, b"\0")


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    """The dictionary's skippable frame, then a frame for each record."""
    made = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return b"".join(chain((struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed), map(made.compress, records)))


def frame_end(view: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by the sizes in its block headers."""
    start = bytes(view[at : at + 18])
    end = at + zstandard.frame_header_size(start)
    checksum = 4 if zstandard.get_frame_parameters(start).has_checksum else 0
    last = False
    while not last:
        if end + 3 > len(view):
            raise WarcError("a frame is cut off")
        block = int.from_bytes(view[end : end + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
    if end + checksum > len(view):
        raise WarcError("a frame is cut off")
    return end + checksum


def read_archive(data: bytes) -> Iterator[dict]:
    """A dict for each record's frame; a broken record gives its error, a broken frame ends the archive with an error."""
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            yield _error("the dictionary's frame is cut off")
            return
        raw, at = bytes(view[8 : 8 + size]), 8 + size
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    frames = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
            one = frames.decompressobj()
            record = one.decompress(view[at:end])
            if not one.eof:
                raise WarcError("a frame is cut off")
            at = end
        except (zstandard.ZstdError, WarcError) as e:
            yield _error(str(e))
            return
        try:
            yield parse_record(record)
        except (WarcError, ValueError) as e:
            yield _error(str(e))


def _error(what: str) -> dict:
    return dict.fromkeys(x.split()[0] for x in RECORDS.split(", ")) | {"error": what}


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _put(folder: str, name: str, data: bytes) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:  # else .zst would be compressed again
        out.write(data)


def _writer(folder: str, most: int):
    def run(frames):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = number = 0
        dictionary = None

        def put():
            nonlocal dictionary
            if dictionary is None:
                dictionary = train(held[:TRAIN_RECORDS])
            name = f"part-{part:06d}-{number:05d}-{TaskContext.get().taskAttemptId()}.warc.zst"
            _put(folder, name, data := write_archive(held, dictionary))
            return pd.DataFrame({"archive": [name], "records": [len(held)], "bytes": [len(data)]})

        for frame in frames:
            for key, url, html, digest, to in zip(frame[KEY].tolist(), frame["__url"], frame["__html"], frame["__sha1"], frame["__to"].tolist()):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                held.append(build_record(key, url if isinstance(url, str) else None, payload, digest, int(to) if to == to and to is not None and to >= 0 else None))
                size += len(payload)
                if size >= most:
                    yield put()
                    held, size, number = [], 0, number + 1
        if held:
            yield put()

    return run


def write_archives(keyed: DataFrame, folder: str, least: int = LEAST_REVISIT, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of (KEY, __url, __html) to folder; what was written, one row per archive.

    Of equal payloads of at least `least` bytes the row with the largest key is the response. Only
    digests are grouped; payloads shuffle once, to meet their group's key, by a join that Spark can split.
    """
    html = F.coalesce("__html", F.lit("")).cast("binary")
    rows = keyed.select(KEY, "__url", "__html", F.sha1(html).alias("__sha1"), F.octet_length(html).alias("__bytes"))
    # Payloads that can't be revisits meet nothing; keys of their own spread them.
    rows = rows.withColumn("__payload", F.when(F.col("__bytes") >= least, F.col("__sha1")).otherwise(F.col(KEY).cast("string")))
    groups = rows.where(F.col("__bytes") >= least).groupBy("__sha1").agg(F.max(KEY).alias("__last"), F.count("*").alias("__n")).where("__n > 1").select(F.col("__sha1").alias("__payload"), "__last")
    to = F.when(F.col("__last") != F.col(KEY), F.col("__last"))
    rows = rows.join(groups, "__payload", "left").select(KEY, "__url", "__html", "__sha1", F.coalesce(to, F.lit(-(2**62))).alias("__to"))
    done = rows.mapInPandas(_writer(folder, most), WRITTEN)
    done.write.mode("overwrite").parquet(f"{folder}-written")
    return keyed.sparkSession.read.schema(WRITTEN).parquet(f"{folder}-written")


def _rows(archives):
    for data in archives:
        rows, size = [], 0
        for row in read_archive(data):
            rows.append(row)
            size += len(row["payload"] or b"")
            if size > 8 << 20:
                yield pd.DataFrame(rows)[[x.split()[0] for x in RECORDS.split(", ")]]
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows)[[x.split()[0] for x in RECORDS.split(", ")]]


def _fetch(folder: str):
    def run(frames):
        store, path = _store(folder)
        names = (name for frame in frames for name in frame["archive"])
        return _rows(store.open_input_file(f"{path}/{name}").readall() for name in names)

    return run


def read_archives(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """A row for each record (see RECORDS) of the archives of `written`, or else of the folder's *.warc.zst files; error is set for what can't be read."""
    if written is not None:
        return written.select("archive").repartition(partitions(written)).mapInPandas(_fetch(folder), RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInPandas(lambda frames: _rows(data for frame in frames for data in frame["content"]), RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty target. Repeated rows and rows with a null id are
    records of their own (the last of equal ones in the order of ids, then url and html, is the response).
    An html larger than `most` is an archive of its own. An empty table gives no archives and no rows. Other columns are ignored.
    A record that can't be read fails the query.
    """
    spark = pages.sparkSession
    keyed = Keyed(pages, id_col, [F.col(url_col).alias("__url"), F.col(html_col).alias("__html")], ["__url", "__html"])
    folder = folder or fresh_path(spark, "warc")
    return keyed.restore(_pages(read_archives(spark, folder, write_archives(keyed.df, folder, most=most))), {"__page": "page_id", "__refers": "refers_to"}).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _pages(records: DataFrame) -> DataFrame:
    key = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as long)")
    broken = F.raise_error(F.concat(F.lit("an archive can't be read: "), F.coalesce("error", F.lit("no page's record")))).cast("long")
    page = F.when(F.col("error").isNull() & key("record_id").isNotNull(), key("record_id")).otherwise(broken)
    return records.select(page.alias("__page"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("__refers"))

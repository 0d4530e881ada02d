"""WARC archives: pages as records of whole-file gzip, rewritten with a member for each record and a sidecar index of offsets.

All files are read and written by Spark, so that they can lie in any store that it reaches, and a task that is tried again leaves no part of a file.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written

#: What every record begins with and ends in.
START, END = "WARC/1.1\r\n", "\r\n\r\n"
#: A gzip member without content. It closes each stretch of a rewritten archive, as block gzip closes a file, and is the separator of Spark's text reader and writer.
EMPTY = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
#: Bytes of members in one stretch: what a task holds of an archive at a time. A single larger record is a stretch of its own.
STRETCH = 4 << 20
#: Digests that occur twice or more are broadcast up to this number (under 20 MB); beyond it only those of a thousandth of the records or more are, at most a thousand.
BROADCAST_DIGESTS = 100_000
#: Standard profile of a record that repeats another one's payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SEPARATED = {"encoding": "ISO-8859-1", "lineSep": EMPTY.decode("latin-1")}
RECORDS = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, intact boolean, payload binary"
INDEX = "archive string, offset long, length long, record_type string, record_id string, target_uri string, payload_digest string"


def with_revisits(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, body, size, digest, refers_to): of equal bodies of at least `least` bytes, those without the largest key refer to it.

    A null body is empty; null keys refer to the largest key, if there is one; repeated rows that share the largest key are all first-hand, and so are all shorter bodies.
    Only digests are grouped, with partial maxima. Bodies move only if more digests repeat than can be broadcast; very common ones are broadcast even then.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    facts = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text.alias("body"), F.octet_length(text).cast("long").alias("size"), F.sha1(text.cast("binary")).alias("digest"))
    groups = facts.filter(F.col("size") >= least).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("n"))
    repeats = written(groups.filter("n > 1"), "repeats")
    seen = repeats.agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).first()
    if seen["digests"] <= BROADCAST_DIGESTS:
        joined = facts.join(F.broadcast(repeats.drop("n")), "digest", "left")
    else:
        common = F.col("n") * 1000 >= seen["rows"]
        some = F.broadcast(repeats.filter(common).select("digest", F.col("top").alias("common_top")))
        # bodies that need no further look keep to keys of their own, so that a common one isn't gathered
        rest = repeats.filter(~common).select(F.col("digest").alias("at"), "top")
        spread = F.when(F.col("common_top").isNull() & (F.col("size") >= least), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string")))
        joined = facts.join(some, "digest", "left").withColumn("at", spread).join(rest.hint("merge"), "at", "left").withColumn("top", F.coalesce("common_top", "top")).drop("common_top", "at")
    again = (F.col("size") >= least) & F.col("top").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("top")))
    return joined.select("key", "url", "body", "size", "digest", F.when(again, F.col("top")).alias("refers_to"))


def record_text(date: str = "2024-01-05T00:00:00Z") -> Column:
    """The record, without its end, of a with_revisits() row. Line breaks in a url are percent-encoded; a null url has no header."""
    again, line = F.col("refers_to").isNotNull(), "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        line, F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), urn("key")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(START), head, F.lit(END), block)


def write_monolithic(records: DataFrame, path: str) -> None:
    """with_revisits() rows as archives of whole-file gzip, one for each task."""
    records.select(record_text().alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line, without a colon, is left out."""
    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def _needs(record: bytes) -> int | None:
    """Bytes that a record has by its own Content-Length, without the start line, with its end; None if it doesn't say."""
    at = record.find(END.encode())
    found = re.search(rb"(?i)(?:^|\n)content-length:\s*([0-9]{1,15})\s*(?:\r|$)", record[: max(at, 0)])
    return at + len(END) + int(found[1]) + len(END) if found else None


def whole_records(fragments: Iterable[bytes], start: bytes = START.encode()) -> Iterator[tuple[bool, bytes]]:
    """(whole, record) of what lies between start lines: a payload that holds a start line itself is joined again by its length.

    A fragment that no number of following ones completes is yielded as it is, not whole, and the next one is tried as a record.
    """
    held, size, want = [], 0, None

    def settle(last: bool) -> Iterator[tuple[bool, bytes]]:
        nonlocal held, size, want
        while held:
            want = _needs(held[0]) if want is None else want
            if want == size:
                yield True, start + start.join(held)
                held, size, want = [], 0, None
            elif want is not None and want > size and not last:
                return
            else:  # not by its length: the first fragment stands alone
                yield False, start + held[0]
                rest, held, size, want = held[1:], [], 0, None
                for f in rest:
                    size += len(f) + (len(start) if held else 0)
                    held.append(f)
                    yield from settle(False)

    for f in fragments:
        size += len(f) + (len(start) if held else 0)
        held.append(f)
        yield from settle(False)
    yield from settle(True)


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _entry(record: bytes, whole: bool, offset: int, length: int) -> bytes:
    h = headers(record[: record.find(END.encode())]) if whole else {}
    line = {"offset": offset, "length": length, "record_type": h.get("warc-type", "unknown") if whole else "broken", "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest")}
    return json.dumps(line).encode() + b"\n"


def _rewrite(batches: Iterator[pa.RecordBatch], start: bytes) -> Iterator[pa.RecordBatch]:
    """(archive, fragment) in file order -> (archive, kind, stretch, value): stretches of members, and of index lines as members."""

    def by_archive():
        for b in batches:
            for name, f in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield name, f.as_py()

    rows = by_archive()
    head = next(rows, None)
    while head is not None:
        archive, rest = head[0], []

        def own(first: bytes, archive: str = archive, rest: list = rest) -> Iterator[bytes]:
            if first:  # what comes before the first start line, if anything
                yield first
            for name, f in rows:
                if name != archive:
                    rest.append((name, f))
                    return
                yield f

        def out(kind: str, stretch: int, value: bytes, archive: str = archive) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([kind]), pa.array([stretch], pa.int32()), pa.array([value], pa.binary())], ["archive", "kind", "stretch", "value"])

        members, lines, held, offset, stretch = [], [], 0, 0, 0
        for whole, record in whole_records(own(head[1]), start):
            made = _member(record)
            if held and held + len(made) > STRETCH:
                yield out("warc", stretch, b"".join(members))
                yield out("cdx", stretch, _member(b"".join(lines)))
                members, lines, held, stretch, offset = [], [], 0, stretch + 1, offset + len(EMPTY)
            members.append(made)
            lines.append(_entry(record, whole, offset, len(made)))
            held, offset = held + len(made), offset + len(made)
        if members:
            yield out("warc", stretch, b"".join(members))
            yield out("cdx", stretch, _member(b"".join(lines)))
        head = rest[0] if rest else None


def normalise(spark: SparkSession, source: str, target: str, start: str = START) -> None:
    """Archives *.gz below source -> target/archive=<name>/kind=warc, a member for each record, and kind=cdx, their index.

    Each archive is inflated once, as a stream, by Spark's reader: gzip can't be split, so a task has whole archives, in order, and holds a record and a
    stretch of members at a time; of a broken record, what follows it up to its declared length. `start` is the line that the archives' records begin with. Archive and index are committed together. A record that its own length doesn't fit is kept as a member of type
    "broken". Names are those of the files and eight digits of their path's hash, so that equal names in two folders stay apart. No archives give an empty folder.
    """
    path = F.col("_metadata.file_path")
    name = F.concat(F.regexp_extract(path, r"([^/]+?)(?:\.txt)?(?:\.warc)?\.gz$", 1), F.lit("-"), F.substring(F.md5(path), 1, 8))
    fragments = spark.read.option("lineSep", start).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(source)
    rows = fragments.select(name.alias("archive"), F.col("value").cast("binary").alias("fragment")).mapInArrow(lambda batches: _rewrite(batches, start.encode()), "archive string, kind string, stretch int, value binary")
    ordered = rows.sortWithinPartitions("archive", "kind", "stretch").select("archive", "kind", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("archive", "kind").options(**_SEPARATED).text(target)


def _stretches(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if "archive" not in spark.read.text(path).columns:  # no archive was written
        return spark.createDataFrame([], "archive string, value binary")
    rows = spark.read.schema("value string, archive string, kind string").options(**_SEPARATED).text(path)
    return rows.filter(F.col("kind") == kind).select("archive", F.col("value").cast("binary").alias("value"))


def members(stretches: Iterable[bytes]) -> Iterator[bytes]:
    """What the members of successive stretches hold. A member whose own bytes hold the separator was cut there, and is joined again."""
    window, left = 1 << 16, b""
    for stretch in stretches:
        data, at = left + stretch, 0
        left = b""
        while at < len(data):
            d, parts, to = zlib.decompressobj(31), [], at
            while not d.eof and to < len(data):
                parts.append(d.decompress(data[to : to + window]))
                to += window
            if not d.eof:
                left = data[at:] + EMPTY
                break
            at = min(to, len(data)) - len(d.unused_data)
            yield b"".join(parts)


def parse_record(record: bytes, payload: bool = False) -> dict:
    """Fields of a record: digest and size are of the payload itself where the record holds it, else what its headers say; intact is false where the two differ."""
    head, _, block = record.partition(END.encode())
    h, (http, _, body) = headers(head), block.removesuffix(END.encode()).partition(END.encode())
    kind, said = h.get("warc-type"), (h.get("warc-payload-digest") or "").removeprefix("sha1:")
    found, size = (said, int(headers(http).get("content-length", 0))) if kind == "revisit" else (hashlib.sha1(body).hexdigest(), len(body))
    return {
        "record_type": kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "payload_digest": found, "payload_bytes": size,
        "refers_to": h.get("warc-refers-to"), "intact": found == said, "payload": body if payload else None,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """RECORDS of all archives that normalise() wrote, read stretch by stretch; payload is null unless it is asked for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for record in members(v.as_py() for b in batches for v in b.column(1)):
            rows.append(parse_record(record, payloads))
            size += len(record)
            if len(rows) >= 10_000 or size > STRETCH:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)

    return _stretches(spark, path, "warc").mapInArrow(parse, RECORDS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX: where each record's member lies in its archive."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, v in zip(b.column(0), b.column(1), strict=True):
                for found in members([v.as_py()]):
                    rows = [{"archive": name.as_py()} | json.loads(x) for x in found.splitlines()]
                    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "payload_digest"))]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return _stretches(spark, path, "cdx").mapInArrow(lines, INDEX)


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """RECORDS, with payloads, of some rows of read_index(): only their archives are opened, and only their members inflated.

    An opened archive is one value of a row, so archives must be under 2 GB.
    """

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([parse_record(zlib.decompress(v.as_py(), 31), True) for v in b.column(0)])

    files = spark.read.format("binaryFile").load(path).filter("kind = 'warc'").select("archive", "content")
    cut = F.expr("substring(content, cast(offset + 1 as int), cast(length as int))")
    return files.join(wanted.select("archive", "offset", "length"), "archive").select(cut.alias("member")).mapInArrow(inflate, RECORDS)


def urn_key(c: Column | str) -> Column:
    """The page key of a record id; null for none."""
    found = F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    return F.when(found != "", found)

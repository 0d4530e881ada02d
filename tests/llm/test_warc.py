import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog_jobs.llm import queries, warc
from tests.llm.data import clashing, rows

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(3)
    big = ["x" * 1000, "é" * 700, "".join(rng.choice("abc<>\r\n é") for _ in range(5000)), "y" * 999]
    tricky = [f"a{warc.START}b" * 3, warc.START, f"z{warc.END}{warc.START}WARC-Type: response{warc.END}" * 40, warc.END, "\r\n" * 600, "tail" + warc.END, "\u0000\u001f" * 600]
    made = [(i, f"http://h/{i}", big[i % 4]) for i in range(40)] + [(100 + i, None if i % 2 else f"u\r\nX: {i}", t) for i, t in enumerate(tricky)]
    made += [(200, "http://h/", None), (201, "http://h/", ""), (202, "é", "q" * 200_000), (203, "é", "q" * 200_000), (203, "é", "q" * 200_000), (None, "n", big[0]), (None, "n", "only null" * 300)]
    rng.shuffle(made)
    return made


def expected(made):
    top = {}
    for key, _, html in made:
        if key is not None and len((html or "").encode()) >= 1000:
            top[html] = max(key, top.get(html, key))
    out = []
    for key, _, html in made:
        body = (html or "").encode()
        t = top.get(html) if len(body) >= 1000 else None
        again = t is not None and (key is None or key < t)
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", t if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [warc.BROADCAST_DIGESTS, 0])
def test_pages_survive_the_round_trip(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)  # 0: the way for many repeated digests
    monkeypatch.setattr(warc, "STRETCH", 3000)
    made = pages()
    path = str(tmp_path / "pages.parquet")
    clashing(spark.createDataFrame(made, SCHEMA)).repartition(3).write.parquet(path)
    got = rows(queries.op11_warc_normaliser(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == expected(made)


def written_archives(spark, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    warc.write_monolithic(warc.with_revisits(spark.createDataFrame(pages(), SCHEMA).repartition(3)), whole)
    warc.normalise(spark, whole, cut)
    return Path(whole), Path(cut)


def test_members_index_and_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 3000)
    whole, cut = written_archives(spark, tmp_path)
    sources = sorted(gzip.decompress(p.read_bytes()) for p in whole.glob("*.gz"))
    archives = {p.parts[-3].removeprefix("archive="): p.read_bytes() for p in cut.glob("archive=*/kind=warc/part-*")}
    assert sorted(gzip.decompress(a) for a in archives.values()) == sources  # nothing is lost or changed
    index = warc.read_index(spark, str(cut)).collect()
    assert len(index) == len(pages())
    covered = {name: [] for name in archives}
    for r in index:
        d = zlib.decompressobj(31)
        record = d.decompress(archives[r.archive][r.offset : r.offset + r.length])
        assert d.eof and not d.unused_data and record.startswith(warc.START.encode()) and record.endswith(warc.END.encode())
        assert f"WARC-Record-ID: {r.record_id}".encode() in record
        covered[r.archive].append((r.offset, r.offset + r.length))
    for name, spans in covered.items():  # between members lie closing members only
        spans.sort()
        edges = [0, *(x for s in spans for x in s), len(archives[name])]
        gaps = [archives[name][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        assert set(gaps) <= {b"", warc.EMPTY} and gaps[-1] == warc.EMPTY


def test_records_are_fetched_by_offset(spark, tmp_path):
    _, cut = written_archives(spark, tmp_path)
    index = warc.read_index(spark, str(cut))
    some = index.filter(F.col("record_id").isin("<urn:page:202>", "<urn:page:203>"))
    got = warc.fetch_records(spark, str(cut), some).collect()
    assert {(r.record_type, r.payload_bytes, bytes(r.payload)) for r in got} == {("revisit", 200_000, b""), ("response", 200_000, b"q" * 200_000)} and all(r.intact for r in got)


def test_broken_and_foreign_records(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"hi").hexdigest().encode() + b"\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\nhi\r\n\r\n".replace(b"\r\n\r\n\r\nhi", b"\r\n\r\nhi").replace(b"23", b"21")
    short = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"
    nameless = b"WARC/1.1\r\nnothing\r\n\r\n"
    changed = good.replace(b"\r\n\r\nhi", b"\r\n\r\nho")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(good + short + nameless + good + changed))
    (tmp_path / "in" / "two.gz").write_bytes(gzip.compress(good) + gzip.compress(good))  # already in members
    (tmp_path / "in" / "empty.gz").write_bytes(gzip.compress(b""))
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    index = warc.read_index(spark, str(tmp_path / "out"))
    assert [r[0] for r in rows(index, "record_type")] == ["broken"] * 2 + ["response"] * 5
    assert [r.intact for r in warc.read_archives(spark, str(tmp_path / "out"), True).filter("record_id is not null").orderBy("intact").collect()] == [False, True, True, True, True]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.gz").write_bytes(gzip.compress(good.replace(b"WARC/1.1", b"WARC/1.0") * 3))
    warc.normalise(spark, str(tmp_path / "old"), str(tmp_path / "older"), "WARC/1.0\r\n")
    assert [r.intact for r in warc.read_archives(spark, str(tmp_path / "older")).collect()] == [True] * 3
    both = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("archive=a-*/kind=warc/part-*"))
    assert both == good + short + nameless + good + changed


def test_a_payload_with_the_separator_in_it():
    """Stored bytes of a member may hold the closing member: the stretches are then joined again."""
    record = b"head" + warc.EMPTY + b"tail"
    made = zlib.compressobj(0, zlib.DEFLATED, 31)
    member = made.compress(record) + made.flush()
    assert warc.EMPTY in member
    assert list(warc.members((member + warc._member(b"next")).split(warc.EMPTY))) == [record, b"next"]


def test_a_declared_length_is_tried_once(spark):
    """Records without their length don't swallow what follows."""
    f = [b"Content-Length: 50\r\n\r\nabc\r\n\r\n", b"Content-Length: 3\r\n\r\nabc\r\n\r\n", b"", b"Content-Length: 0\r\n\r\n\r\n\r\n"]
    start = warc.START.encode()
    assert list(warc.whole_records(f)) == [(False, start + f[0]), (True, start + f[1]), (False, start), (True, start + f[3])]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op11_warc_normaliser(spark, str(tmp_path)).count() == 0


def test_no_python_before_the_archives(spark):
    plan = warc.with_revisits(spark.createDataFrame(pages(), SCHEMA)).select(warc.record_text())._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_index_lines_are_json():
    line = json.loads(warc._entry(b'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "q" \xc3\xa9\r\n\r\n', True, 5, 6))
    assert (line["target_uri"], line["offset"], line["length"]) == ('"q" é', 5, 6)

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_jobs.llm import decontaminate, line_dedup, near_dedup, packing, quality, queries, repeats, secret_scan, sharding, substring_dedup, suffix_dedup, url_filter, winnow
from catalog_jobs.llm.common import lower_ascii, written
from catalog_jobs.llm.components import components
from catalog_jobs.llm.repeats import WORDS20
from tests.llm import brute
from tests.llm.data import BENCH, clashing, documents, empty, frame, junk, rows, sentence

DOCS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(frame(spark, DOCS)).cache()


def items():
    rng = random.Random(5)
    texts = [" ".join(DOCS[i][1].split()[3:30]).upper() for i in (0, 2, 5, 12)] + [DOCS[7][1].split()[0], "one", sentence(rng, 40), None, "", "!!", DOCS[0][1][:80]]
    return [*enumerate(texts), (3, texts[3]), (50, texts[0])]


def test_lower_ascii(spark):
    df = spark.createDataFrame([("ABC É İ ΣΑΣ ß Ⅷ",), ("Plain Text é.",), (None,)], "t string").select("t", lower_ascii(F.col("t")).alias("l"))
    assert all(r.l == (r.t and r.t.translate(brute.LOWER)) for r in df.collect())


@pytest.mark.parametrize("limit", [None, 0])
def test_contamination(spark, docs, monkeypatch, limit):
    if limit is not None:  # the way beyond the broadcast bound
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    bench = clashing(spark.createDataFrame(items(), BENCH))
    got = rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(DOCS, items())


def test_contamination_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    bench = clashing(spark.createDataFrame(items(), BENCH))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that only what the operator asks for is broadcast
    try:
        found = decontaminate.contamination(docs, bench)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(DOCS, items())
        left = decontaminate.clean_documents(docs, bench)
        assert left.count() == sum(not c for *_, c in brute.contamination(DOCS, items()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contamination_without_rows(spark, docs):
    none = spark.createDataFrame([], BENCH)
    assert rows(decontaminate.contamination(docs, none), "doc_id", "n_hit", "contaminated") == sorted(((d, 0, False) for d, _ in DOCS), key=repr)
    assert decontaminate.contamination(empty(spark), spark.createDataFrame(items(), BENCH)).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == len(DOCS)


def test_secrets(spark, docs):
    paths = secret_scan.blob_paths(docs)
    ledger = written(secret_scan.scan_unseen(paths), "ledger")
    got = rows(secret_scan.secret_report(secret_scan.findings_by_path(paths, ledger)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == brute.secrets(DOCS)
    assert secret_scan.scan_unseen(paths, ledger=ledger).count() == 0  # nothing is scanned twice
    newer = secret_scan.RuleSet("3", secret_scan.RULES.rules)
    assert secret_scan.scan_unseen(paths, newer, ledger).count() == ledger.count()  # but for another version of the rules
    more = secret_scan.blob_paths(frame(spark, [(1, DOCS[0][1]), (2, "token = abcdefghijklmnopq")]))
    assert secret_scan.scan_unseen(more, ledger=ledger).count() == 1
    assert secret_scan.scan_unseen(secret_scan.blob_paths(empty(spark))).count() == 0


def test_secret_query_scans_a_second_version_for_unseen_blobs_only(spark, tmp_path, monkeypatch):
    twice = [*DOCS, *((1000 + i, t) for i, (_, t) in enumerate(DOCS))]
    frame(spark, twice).write.parquet(str(tmp_path / "documents.parquet"))
    scan, new = secret_scan.scan_unseen, []

    def watched(paths, rules, ledger):
        out = scan(paths, rules, ledger)
        new.append({bytes(r.blob) for r in out.collect()})
        return out

    monkeypatch.setattr(secret_scan, "scan_unseen", watched)
    got = rows(queries.op2_secret_scan(spark, str(tmp_path)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == brute.secrets(twice)
    assert len(new) == 2 and not new[0] & new[1]
    assert len(new[0]) + len(new[1]) == len({t or "" for _, t in DOCS})


def test_urls(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q#f", "http://example.com/de/", "http://www.example.com/de", "http://x.org/fr/a", "http://net", "http://net/", "net/x", None, "", "a://b://c.net/", "http://u:1@s.net:80/", "http://.net/y", "http://x.org/fr", "http://example.net/en/"]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2)})
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string").withColumn("key", F.lit("x"))

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
            host, _, path = rest.partition("/")
            host, path = host.translate(brute.LOWER), ("/" + path if "/" in rest else "")
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    got = rows(url_filter.filter_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *plain(u)) for i, u in [*enumerate(urls), (0, urls[0])]], key=repr)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "net/x"), (2, "http://" + "." * 100_000 + "/y")], "page_id long, url string")
    assert rows(url_filter.filter_urls(pages, rules), "page_id", "rule", "verdict") == [(1, "net/", "block"), (2, None, "allow")]


def test_bloom_lets_no_listed_key_go(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    hosts = [f"h{i}.test" for i in range(300)]
    rules = spark.createDataFrame([(h, "/", "block") for h in hosts[:200]], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    assert sorted(r.page_id for r in url_filter.filter_urls(pages, rules).filter("verdict = 'block'").collect()) == list(range(200))


def test_quality_stats(spark, docs):
    got = rows(quality.text_stats(docs), "doc_id", *quality.STATS)
    assert got == brute.stats(DOCS)
    assert quality.text_stats(empty(spark)).count() == 0


def prunes(spark, ids):
    return {r.d: r.p for r in spark.createDataFrame([(i,) for i in ids], "d long").select("d", (F.pmod(F.xxhash64("d"), F.lit(3)) == 0).alias("p")).collect()}


def test_decision_list(spark):
    """Against a plain learner, with the labelled rows in one partition and in fifty."""
    rng = random.Random(2)
    texts = [(i, sentence(rng, rng.randint(30, 90))) for i in range(210)] + junk(rng, range(210, 280)) + [(None, sentence(rng, 30))]
    some = [(i, int(i < 210) if i % 13 else 1) for i in range(280) if i % 4] + [(1, None), (9999, 0)]
    want, plain = brute.quality_kept(texts, some, prunes(spark, [d for d, _ in texts]))
    assert plain
    labels = clashing(spark.createDataFrame([(*x, 0) for x in some], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")))
    for n in (1, 50):
        stats, rules = quality.judged(frame(spark, texts).repartition(n), labels)
        assert [[(t.feature, t.above, t.bound) for t in r] for r in rules.rules] == plain
        assert rows(stats, "doc_id", "kept") == sorted(((d, k) for (d, _), k in zip(texts, want, strict=True)), key=repr)
    assert "reject" in str(rules)
    assert len(quality.judged(frame(spark, texts), labels.limit(0))[1].rules) == 0
    assert quality.kept_documents(empty(spark), labels).count() == 0
    kept = quality.kept_documents(clashing(frame(spark, DOCS)), labels.limit(0))
    assert kept.count() == sum(n >= 10 and 5 * r <= n for _, n, *_, r in brute.stats(DOCS))


@pytest.mark.parametrize(("k", "small"), [(2, 16), (5, 4)])
def test_near_duplicates(spark, docs, k, small):
    join = near_dedup.Join(words=k, small=small, block=4)
    order = sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0))
    root, sets = brute.components(order, k)
    got = rows(near_dedup.component_report(docs, join), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(((d, len(s), order[r][0], order[r][0] == d) for (d, _), r, s in zip(order, root, sets, strict=True)), key=repr)
    assert near_dedup.component_report(empty(spark), join).count() == 0
    left = near_dedup.one_of_each_group(docs, join)
    assert left.columns == docs.columns
    assert left.count() == sum(1 for i, (r, s) in enumerate(zip(root, sets, strict=True)) if r == i or not s)


def test_near_duplicates_in_large_groups(spark):
    """Two bases with many copies of each: nodes stay large, and some copies are linked only through others."""
    rng = random.Random(3)
    bases, docs = [sentence(rng, 60).split() for _ in range(2)], []
    for i in range(160):
        w = list(bases[i % 2])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        docs.append((i, " ".join(w)))
    root, _ = brute.components(docs, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.component_report(frame(spark, docs), near_dedup.Join(words=2, small=6, block=8)).collect()}
    assert got == {d: docs[r][0] for (d, _), r in zip(docs, root, strict=True)}


def test_pairs_at_the_threshold_are_seldom_missed():
    join, p = near_dedup.Join(), 0.8 + 0.2 / 16  # a place of the sketch agrees, or its 4 bits do
    sketch = sum(math.comb(near_dedup.PERMS, k) * p**k * (1 - p) ** (near_dedup.PERMS - k) for k in range(join.agree))
    assert 0.09**join.trees + sketch < 1e-6


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, docs):
    plain = brute.line_report(DOCS)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_lines_removed"]
    assert rows(got, "doc_id", "text") == sorted(((d, plain[d, t]) for d, t in DOCS), key=repr)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("n_batches", [1, 2])
def test_substring_dedup(spark, docs, n_batches):
    got = substring_dedup.dedup_in_batches(docs, n_batches)
    assert rows(got, "doc_id", "n_units", "n_removed", "kept_sha256") == brute.substring_report(DOCS)
    if n_batches == 1:
        assert substring_dedup.dedup_in_batches(empty(spark), 2).count() == 0


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_anchors_of_documents_with_one_doc_id_stay_apart(spark, monkeypatch, operator):
    """A third of the rows under null and a third under one doc_id, with differing texts: each is given anchors of its own text only."""
    rng = random.Random(12)
    passages = [sentence(rng, 40) for _ in range(40)]
    docs = [(None if i < 20 else 7, sentence(rng, 6) + " " + p) for i, p in enumerate(passages)] + [(100 + i, sentence(rng, 6) + " " + p) for i, p in enumerate(passages[::2])]
    given, suspects = [], repeats.suspects

    def watched(documents, chosen):
        given.append((table := suspects(documents, chosen)).select("ord", "tie", "t", "ms").collect())
        return table

    monkeypatch.setattr(repeats, "suspects", watched)
    df = frame(spark, docs)
    if operator == "words":
        got = rows(substring_dedup.dedup_in_batches(df, 2), "doc_id", "n_units", "n_removed", "kept_sha256")
        assert got == brute.substring_report(docs)
    else:
        got = rows(suffix_dedup.dedup_bytes(df), "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.byte_report(docs)
        own = {(r.ord, r.tie): set(r.ms) for r in repeats.fingerprints(repeats.keyed(df), repeats.BYTES100).collect()}
        assert any(given)
        assert all(r.ms and set(r.ms) <= own[r.ord, r.tie] for table in given for r in table)


def test_null_comes_before_the_least_doc_id(spark):
    """A null doc_id and the least number of its type are two documents."""
    rng, least = random.Random(6), -(1 << 63)
    text, other = sentence(rng, 60), sentence(rng, 70)
    docs = [(least, text), (None, text), (5, text), (least, other), (6, other)]
    df = frame(spark, docs)
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == {(None, 0), (least, len(text.encode())), (least, 0), (5, len(text.encode())), (6, len(other.encode()))}
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.dedup_in_batches(df, 1).collect()}
    assert got == {(None, 0), (least, 60), (least, 0), (5, 60), (6, 70)}
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.component_report(df, near_dedup.Join()).collect()}
    assert got == {(None, None, True), (least, None, False), (5, None, False), (least, least, True), (6, least, False)}


def test_substring_query_compacts_its_index(spark, tmp_path, monkeypatch):
    frame(spark, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    compact, seen = substring_dedup.FingerprintIndex.compact, []

    def watched(index):
        before = [level for level, *_ in index.runs]
        compact(index)
        seen.append((before, [level for level, *_ in index.runs], index.rows().count()))

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", watched)
    got = rows(queries.op7_substring_dedup(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_report(DOCS)
    assert [(b, a) for b, a, _ in seen] == [([0], [0]), ([0, 0], [1]), ([1, 0], [1, 0])]  # a merged run is met by the last batch
    assert seen[0][2] < seen[1][2] < seen[2][2]  # and every batch is indexed


def test_index_runs_meet_a_batch_without_a_shuffle(spark):
    job = substring_dedup.SubstringDedup(spark, WORDS20, fan_in=9)
    for i in (0, 30):
        job.add(frame(spark, DOCS[i : i + 30]))
    held = job.index.rows().count()
    assert held == job.index.rows().select("m", "rh").distinct().count()  # a content is held once, under its first place
    batch = spark.table(job.index.bucketed(job.index.tables()[0], "batch")[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with substring_dedup._joined_by_bucket(spark):
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in (job.index.near(batch), job.index.meet(batch))]
        assert all("SortMergeJoin" in p and "Exchange" not in p for p in plans)
        assert plans[0].count("Bucketed: true") == 2 * len(job.index.runs)  # each run is read once for a batch, with the batch's anchors
        holders = substring_dedup.bucketed(repeats.runs_by_document(batch), "holders", ["ord", "tie"], job.index.n_buckets)[0]
        plan = repeats.run_contents(spark.table(job.texts[0][0]), spark.table(holders), WORDS20)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan  # nor are texts shuffled again
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fingerprint_index_is_compacted(spark):
    job = substring_dedup.SubstringDedup(spark, WORDS20, fan_in=2)
    parts = [job.add(frame(spark, DOCS[i : i + 15])).select("doc_id", "n_removed") for i in range(0, 60, 15)]
    assert [level for level, *_ in job.index.runs] == [2]  # four runs became two, then one
    got = sorted(tuple(r) for p in parts for r in p.collect())
    assert got == [(d, n) for d, _, n, _ in sorted(brute.substring_report(DOCS[:60]))]


@pytest.mark.parametrize("bucket_bytes", [500_000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, bucket_bytes):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", bucket_bytes)  # with 1, runs are cut down to single windows
    got = suffix_dedup.dedup_bytes(docs)
    assert rows(got, "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256") == brute.byte_report(DOCS)
    if bucket_bytes == 1:
        assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


def watched_buckets(monkeypatch):
    """What goes into suffix_dedup.merged_buckets and comes out of it, from now on: ([bytes of a bucket], [rows that go])."""
    merge, dealt, gone = suffix_dedup.merged_buckets, [], []

    def watched(pieces, unit):
        dealt.extend(r.b for r in pieces.groupBy("bucket").agg(F.sum(F.length("seg")).alias("b")).collect())
        gone.extend((merged := merge(pieces, unit)).collect())
        return merged

    monkeypatch.setattr(suffix_dedup, "merged_buckets", watched)
    return dealt, gone


def test_runs_in_a_bucket_are_of_bounded_size(spark, monkeypatch):
    """Periodic texts, and one passage with other words around it in each of many documents: no anchor gives a bucket much more than its bytes, and transforms find what goes there too."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 3000)
    dealt, gone = watched_buckets(monkeypatch)
    rng = random.Random(5)
    passage = sentence(rng, 40)
    docs = [(i, "x" * n) for i, n in enumerate((4000, 5000, 2500))] + [(9, "one line\n" * 600), (10, "start " + "one line\n" * 500)]
    docs += [(20 + i, f"{sentence(rng, 8)} {passage} {sentence(rng, 8)}") for i in range(120)]
    got = rows(suffix_dedup.dedup_bytes(frame(spark, docs)), "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_report(docs)
    assert 0 < max(dealt) <= 12_000
    assert any(r.ord >= 20 for r in gone)


def test_windows_of_differing_runs_go_by_merged_transforms(spark, monkeypatch):
    """Equal runs are one content from the start; of windows that repeat in runs that differ, none is settled by a digest of a piece while its anchor's runs fit a bucket."""
    dealt, gone = watched_buckets(monkeypatch)
    steps = []
    monkeypatch.setattr(repeats, "settle", lambda *a: steps.append(a))
    rng = random.Random(8)
    passages = [sentence(rng, 30) for _ in range(10)]
    docs = [(i, f"{sentence(rng, 5)} {passages[i % 10]} {sentence(rng, 5)}") for i in range(100)]
    got = rows(suffix_dedup.dedup_bytes(frame(spark, docs)), "doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_report(docs) and not steps
    windows = sum(r[2] - 100 * r[3] + r[3] for r in got)
    share = sum(r.n for r in gone) / windows
    print(f"share of the removed windows that merged transforms find: {share:.2f}")
    assert share > 0.3


def test_merged_transforms_are_in_suffix_order():
    rng = random.Random(4)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(20)] for _ in range(3)]
    made = [suffix_dedup.shard_transform(s) for s in shards]
    suffixes = []
    for s, (_, at) in zip(shards, made, strict=True):
        text = b"".join(x + b"\0" for x in s)
        own = [text[p:].split(b"\0")[0] for p in at]
        assert own == sorted(own)
        suffixes += own
    for size in (1, 2, 3, 4, 7, 8, 12, 16, 20):
        block = suffix_dedup.merge_transforms([t for t, _ in made], size).tolist()
        prefixes = [x[:size] for x in suffixes]
        least = {p: i for i, p in reversed([*enumerate(sorted(prefixes))])}
        assert block == [least[p] for p in prefixes], size


def test_windows_of_one_content_share_their_anchor():
    rng = np.random.default_rng(0)
    part = rng.integers(1, 1 << 60, 200, np.uint64)
    units = np.concatenate([rng.integers(1, 1 << 60, 70, np.uint64), part, rng.integers(1, 1 << 60, 30, np.uint64), part])
    w, grams = winnow.windows(units, np.array([0, 300, len(units)]), 20, 6)
    whole = winnow.span_hashes(units, [20])[20][w.start]
    least = defaultdict(set)
    for h, m in zip(whole, w.least, strict=True):
        least[h].add(m)
    assert all(len(m) == 1 for m in least.values())
    assert max(Counter(whole.tolist()).values()) == 2
    assert set(w.least.tolist()) <= set(grams[winnow.anchors(w, grams, 15)].tolist())


def test_shards(spark, docs):
    keys = written(sharding.sort_keys(docs), "keys")
    got = sharding.shard_by_bytes(keys, 5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in DOCS)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(written(sharding.sort_keys(empty(spark)), "keys"), 5).count() == 0


def test_shards_are_even_with_a_group_of_a_third(spark):
    rng = random.Random(8)
    texts = [(i, "the same text" if i % 3 == 0 else sentence(rng, rng.randint(1, 60))) for i in range(6000)]
    got = sharding.shard_by_bytes(written(sharding.sort_keys(frame(spark, texts)), "keys"), 24).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) <= 6  # equal texts are neighbours


def test_shards_cut_a_group_of_one_repeated_row(spark):
    rng = random.Random(4)
    texts = [(7, "the same row")] * 3000 + [(100 + i, sentence(rng, 3)) for i in range(3000)]
    keys = written(sharding.sort_keys(frame(spark, texts)), "keys")
    assert max(c.n_rows for c in sharding.find_splitters(keys, 24)) <= 1000
    got = sharding.shard_by_bytes(keys, 24).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 24
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s in range(24) for i in range(sum(r.shard == s for r in got)))


def tokens(text):
    from tokenizers import Tokenizer

    tokens.it = getattr(tokens, "it", None) or Tokenizer.from_file(queries.tokenizer_path())
    return [*tokens.it.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_tokenizer():
    rng = random.Random(9)
    strange = ["", " ", "it's we'll 'd", "a1b22 ½", "É́ e\u0301 ﬁ", "x<|endoftext|>y <|startoftext|>", "...!? ,a a, A,B", "\x1c a\x85b\u2003c", "日本語 text", "Straße,ÀÉÖ! ÿ;", "a\u200db", "ǅ İ Σς", "\x00 a\x00b"]
    texts = strange + [sentence(rng, 50) + "." for _ in range(20)] + [" ".join(rng.choice(strange) for _ in range(9)) for _ in range(30)]
    ids, bounds = packing.WordTokenizer(queries.tokenizer_path()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert [*ids[bounds[i] : bounds[i + 1]], 1] == tokens(t), t


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, docs, capacity):
    got = packing.packed_documents(docs, queries.tokenizer_path(), capacity).collect()
    want = []
    for d, t in DOCS:
        ids = tokens(t)
        want += [(d, p, s, min(capacity, len(ids) - s), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for pieces in rooms.values():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])
        assert sum(n for _, n in pieces) <= capacity
    assert len(rooms) <= -(-sum(w[3] for w in want) // capacity) + 2
    assert packing.packed_documents(empty(spark), queries.tokenizer_path()).count() == 0


def test_common_lengths_are_ranked_in_parts(spark, monkeypatch):
    """One repeated row, and one length, hold most pieces: they are ranked in parts of bounded size, and sequences stay whole."""
    monkeypatch.setattr(packing, "RANKED", 50)
    sizes = [(7, 0, 0, 64, 1)] * 600 + [(i, 0, 0, 40, 2) for i in range(300)] + [(i, 0, 0, 1 + i % 63, 3) for i in range(200)]
    pieces = spark.createDataFrame(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("place", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    packed = packing.pack(pieces, 64)
    got = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.length) for r in got) == sorted((s[0], s[3]) for s in sizes)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for held in rooms.values():
        assert [o for o, _ in sorted(held)] == list(np.cumsum([0] + [n for _, n in sorted(held)])[:-1])
        assert sum(n for _, n in held) <= 64
    assert len(rooms) <= -(-sum(s[3] for s in sizes) // 64) * 1.02 + 300 * 24 // 64  # a piece of 40 leaves 24 empty where no smaller one is left
    parts = np.append(0, -(-np.bincount([s[3] for s in sizes], minlength=65)[1:] // 50))
    assert packing.in_parts(pieces, parts).groupBy("length", "salt").count().agg(F.max("count")).first()[0] <= 100


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(3)
    for n in (1, 7, 500, 20000):
        lengths = np.minimum(100, rng.geometric(0.03, n))
        histogram = np.bincount(lengths, minlength=101)[1:]
        made = packing.round_configurations(packing.solve_configurations(histogram, 100), histogram, 100)
        total = Counter()
        for config, times in made:
            assert sum(config) <= 100
            for k in config:
                total[k] += times
        assert total == Counter(lengths.tolist())
        assert sum(t for _, t in made) <= -(-int(lengths.sum()) // 100) * 1.02 + 1



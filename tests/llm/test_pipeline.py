import random
import zlib

import numpy as np

import corpus_pipeline
from catalog_jobs.llm.common import written
from tests.llm import brute
from tests.llm.data import BENCH, clashing, documents, frame, junk, sentence
from tests.llm.test_operators import prunes, tokens

_rng = random.Random(7)
#: With junk that only the learned list rejects.
DOCS = documents(seed=6) + junk(_rng, range(200, 260)) + [(i, sentence(_rng, 30)) for i in range(260, 320)]
LABELS = [(d, int(not 200 <= d < 260)) for d, _ in DOCS if d is not None and d % 5]
ITEMS = [(0, " ".join(DOCS[4][1].split()[5:40])), (1, None), (2, DOCS[3][1].split("\n")[1])]


def tables(spark, path, docs):
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, BENCH).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in LABELS], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain(docs, prune):
    kept, rules = brute.quality_kept(docs, LABELS, prune)
    assert rules  # the learned list acts
    docs = [x for x, keep in zip(docs, kept, strict=True) if keep]
    cut = brute.line_report(docs)
    docs = [(d, cut[d, t]) for d, t in docs if cut[d, t] == t or brute.words(cut[d, t])]
    docs = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    root, sets = brute.components(docs, 5)
    docs = [x for i, x in enumerate(docs) if root[i] == i or not sets[i]]
    dirty = {r[0] for r in brute.contamination(docs, ITEMS) if r[5]}
    out = []
    for d, t in docs:
        if d not in dirty:
            ids = tokens(t)
            out += [(d, p, s, min(4096, len(ids) - s), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out, key=repr)


def test_pipeline(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, DOCS)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == plain(DOCS, prunes(spark, [d for d, _ in DOCS]))


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path, DOCS)
    for docs in (clashing(frame(spark, DOCS)), frame(spark, DOCS).limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, path), name)
            assert docs.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, path).count()

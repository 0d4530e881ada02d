import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog_jobs.llm import fim, queries
from tests.llm.data import clashing, documents, empty, frame, rows


def brute(docs):
    out = []
    for key, text in docs:
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((key, len(units), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(output), sha(text)))
    return sorted(out, key=repr)


TRICKY = [(500, "<P>x"), (501, "a<S"), (502, "S><P"), (503, "<<SM>>"), (504, "a" * 20_000 + "é" * 9_000 + " b" * 5_000), (505, "😀a😀bb\u0000[`{@" * 3_000), (506, "x<M>y"), (507, "Zz[\\]^_`az{|}~" * 700), (508, "\n")]


def test_documents_are_cut_as_by_brute_force(spark, tmp_path):
    docs = documents() + TRICKY
    clashing(frame(spark, docs)).withColumn("output", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    assert rows(got, *names) == brute(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_other_columns_stay_and_all_texts_come_back(spark):
    docs = clashing(frame(spark, documents() + TRICKY)).withColumn("form", F.lit("clash"))
    made = fim.fim_documents(docs, seed=7, spm_percent=50)
    assert made.columns == [*(c for c in docs.columns if c != "form"), *fim.NEW.names] and {"psm", "spm", "plain"} == {r[0] for r in made.select("form").distinct().collect()}
    assert rows(made.select("doc_id", fim.restored().alias("t")), "doc_id", "t") == rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id", "t")
    assert rows(made, "k", "lang") == rows(docs, "k", "lang")


def test_empty_table(spark):
    assert fim.fim_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 8, 4096])
def test_every_cut_of_every_block_size(block):
    rng = random.Random(block)
    for n in (0, 1, 2, 7, 40):
        text = "".join(rng.choice("ab cé😀\n{@") for _ in range(n))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        tree = fim.BlockTree(text.encode(), block)
        assert tree.units == len(units) and tree.points == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aZ<>PSM é\U0001f600\n0"), max_size=30), st.text("0123456789abcdef", min_size=32, max_size=32))
def test_round_trip_of_any_draw(text, draw):
    n, form, p, m, output = fim.transform(text.encode(), draw, 100, 50)
    out = output.decode()
    if form == "plain":
        assert out == text
        return
    first, second = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
    a, _, rest = out.removeprefix(first).partition(second)
    b, _, middle = rest.partition("<M>")
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    assert prefix + middle + suffix == text and (len(prefix), len(middle)) == (p, m)


def test_a_very_long_text():
    text = ("word " * 200_000 + "é" * 300_000 + "z" * 600_000).encode()
    tree = fim.BlockTree(text)
    assert tree.units == 400_000 + 300_000 + 1
    assert tree.cut(400_000) == (1_000_000, 1_000_000) and tree.cut(400_001) == (1_000_002, 1_000_001) and tree.cut(700_000) == (1_600_000, 1_300_000) and tree.cut(700_001) == (2_200_000, 1_900_000)

"""Operators where ids or texts repeat, and where numbers are large."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalframe.llm import bpe, dedup, langid, quality, topk
from signalframe.llm.words import Hasher

A, B, C = "a b c d e f g h", "p q r s t u v w", "i j k l m n o x"


def test_dedup_stage_drops_by_id_and_text(spark):
    rows = [(1, A), (2, A), (2, B), (3, C), (3, C), (4, ""), (4, ""), (5, None), (None, A), (6, "z1 z2 z3"), (6, "z1 z2 z3 "), (6, "y1 y2 y3")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert len(got) == len(set(got))
    six = [t for i, t in got if i == 6]
    assert sorted({" ".join(t.split()) for t in six}) == ["y1 y2 y3", "z1 z2 z3"] and len(six) == 2
    assert {x for x in got if x[0] != 6} == {(1, A), (2, B), (3, C), (4, ""), (5, None), (None, A)}


def test_shingle_length():
    texts = pa.array(["a b c d e f", "a", "a b", "", None])
    sizes = lambda n: [len(s) for s in dedup.shingle_sets(texts, Hasher(), n)]
    assert sizes(1) == [6, 1, 2, 0, 0] and sizes(2) == [5, 1, 1, 0, 0] and sizes(5) == [2, 1, 1, 0, 0]


def test_top_k_of_large_components(spark):
    data = [(0, [1.0, 1.0]), (1, [70_000.0, 1.0]), (2, [80_000.0, 0.0]), (3, [-1e9, 3.0]), (100, [2000.0, 1.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()}
    whole = {i: [int(1024 * x) for x in v] for i, v in data}
    assert got == {(q, i): sum(x * y for x, y in zip(whole[q], whole[i], strict=True)) for q in (0, 100) for i in whole if i != q}


def test_equal_scores_of_one_id_and_clashing_columns(spark):
    data = [(0, [1.0, 1.0], 1, 2, 3), (5, [1.0, 0.0], 1, 2, 3), (5, [0.0, 1.0], 1, 2, 3), (6, [0.5, 0.5], 1, 2, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int, rank int, q int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1024 * 1024), (0, 2, 5, 1024 * 1024), (0, 3, 6, 1024 * 1024)]


@pytest.mark.parametrize("size", [1e5, 1e6, 1e8, 1e12])
def test_top_k_of_sizes(spark, size):
    data = [(k, [size * (k % 7 - 3), float(k), -1.5 * k]) for k in range(30)] + [(100, [1.0 if size > 1e7 else size, 2.0, 3.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).orderBy("rank").collect()]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in data}
    best = sorted((-sum(x * y for x, y in zip(whole[100], whole[i], strict=True)), i) for i in whole if i != 100)[:10]
    assert got == [(100, r + 1, i, -s) for r, (s, i) in enumerate(best)]


def test_scores_that_do_not_fit():
    q, t, other = np.array([[2**40, 3]]), np.array([[2**40, 1]]), np.array([[False]])
    with pytest.raises(OverflowError):
        topk.exact_scores(q, t, other)
    assert topk.exact_scores(q, t, ~other).tolist() == [[0]]
    assert topk.exact_scores(np.array([[2**40, -(2**40)]]), np.array([[2**40, 2**40 - 1]]), other).tolist() == [[2**40]]


def test_language_sample_of_copies(spark):
    rows = [("xx", f"qu{k} zorp") for k in range(3) for _ in range(3000)]
    rows += [("yy", f"mel{k} dran lo{k}") for k in range(400)] + [("zz", "123")] * 50
    docs = spark.createDataFrame(rows, "lang string, text string")
    seen = {}
    fit = langid.fit
    try:
        langid.fit = lambda bits, languages: seen.update(n={x: languages.count(x) for x in languages}) or fit(bits, languages)
        model = langid.learn(docs, F.lit(True), 64)
    finally:
        langid.fit = fit
    assert seen["n"] == {"xx": 3, "yy": 32} and model.languages == ["xx", "yy"]


ODD = [(1, "Some plain words of a clean text that goes on for a while.", "en"), (1, "Some plain words of a clean text that goes on for a while.", "en"), (2, None, None), (3, "", "fr"), (4, " \t\n", "de"), (None, "a text without an id, quite long enough to be judged by itself", "en"), (None, None, None), (5, "x" * 70_000 + " und " * 9000, "de"), (6, "password = ABCDEFGHIJKL0123 and more words", "en"), (6, "another text of the same id, with other words in it", "es"), (7, "Some plain words of a clean text that goes on for a while.", "en")]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), 1, "y", 0.5, [1]) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, blob string, score double, keys array<int>")


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def table_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, odd_docs, odd_folder, name, stage):
    out = stage(spark, odd_docs, odd_folder)
    none = stage(spark, odd_docs.where("false"), odd_folder)
    assert none.count() == 0
    if name == "bpe":
        assert out.count() == len(ODD) and none.columns == out.columns
        return
    assert out.columns == none.columns == corpus_pipeline.COLUMNS
    rows, every = table_of(out), table_of(odd_docs)
    if name == "quality classifier":
        # Rows go whole or stay, and rows that are alike share their fate.
        assert all(rows.count(r) in (0, every.count(r)) for r in every) and set(rows) <= set(every)
    if name == "near-dedup":
        assert rows == sorted({(i, t) for i, t in every if (i, t) != (7, every[0][1])}, key=repr)
    if name == "secret scan":
        assert len(rows) == len(every) and (6, "[REDACTED] and more words") in rows and (2, None) in rows
    if name == "mixing":
        assert set(rows) == set(every) and all(rows.count(r) >= every.count(r) for r in every)


def test_pipeline_against_single_steps(spark, tmp_path):
    """The pipeline's rows, from the quality model's own decisions on, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scored = quality.classify(docs, labels, bpe.doc_hash() % 5 != 0, keep=("doc_id", "text")).collect()
    kept = sorted((r["doc_id"], r["text"] or "") for r in scored if r["score"] >= quality.THRESHOLD)
    sets = [frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w) for w in ((t.translate({i: i + 32 for i in range(65, 91)})).split() for _, t in kept)]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    left = {kept[k][0]: kept[k][1] for k in range(len(kept)) if root[k] == k}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in out} == set(left)
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in out:
        text = bpe.decode(np.frombuffer(r["token_ids"], "<u4"), enc).decode()
        assert text == left[r["doc_id"]] or "[REDACTED]" in text
    # What only scarce languages have more than once is whole documents.
    assert len(out) >= len(left)

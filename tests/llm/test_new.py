"""Forced-boundary encoding, importance resampling and periodic runs, against brute force and over odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalframe.llm import forced, periods, queries, resample

from ..conftest import DATA
from .test_ops import ODD, SCHEMA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    more = [(20, "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "en", 0.5), (21, "la la la " * 9 + "ends", "en", 0.5), (22, "x " * 40_000, "en", 0.5), (23, "a b c " * 5 + "d e f " * 5, "en", 0.5)]
    rows = spark.createDataFrame(ODD + more, SCHEMA)
    return rows.withColumns({"__key": F.lit(1), "__text": F.lit(1), "pack": F.lit(2), "word": F.lit("w"), "row": F.lit(3), "c": F.lit(4)}).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_no_token_spans_a_certain_cut(library):
    own = forced.coder(PATH)
    assert own.certain.sum() > 30_000
    alphabet = forced.byte_alphabet()
    for token in list(library.get_vocab())[::7]:
        data = np.frombuffer(bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode(), np.uint8)
        assert not own.cuts(data).any()


def test_fragments_join_to_whole_encodings(library):
    own, rng = forced.coder(PATH), random.Random(5)
    signs = list(" \n\t'sdrevml!?.,-ab1é中  　\x1c\x85😀\x00\x7fß") + ["<|endoftext|>", "  ", "'re", "'ve", "\r\n", "the ", " and"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text
        assert own.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False) == text
    any_ids = np.random.default_rng(3).integers(0, 50_400, (1000, 9))
    assert all(own.decode(x.astype("<u4")) == library.decode(x.tolist(), skip_special_tokens=False) for x in any_ids)


@pytest.mark.parametrize("sign", [" ", "\n", "\t", "-", "a", "'", "é"])
def test_texts_without_a_cut(library, sign):
    text = sign * 300_000
    assert forced.coder(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgetting_fragments_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(forced, "REMEMBERED", 5)
    own = forced.Coder(PATH)
    for k in range(4):
        text = " ".join(f"w{j} the cat{k}" for j in range(50))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 5


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        forced.Coder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_forced_query_against_the_library(request, spark, library, which):
    docs = request.getfixturevalue("odd") if which == "odd" else spark.read.parquet(f"{DATA}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    got = forced.encode_documents(docs, PATH, keep=["doc_id"], digests=True) if which == "odd" else queries.op11_forced_bpe(spark, DATA)
    assert Counter(map(tuple, got.collect())) == want
    if which == "odd":
        coded = forced.encode_documents(docs, PATH)
        back = forced.decode_documents(coded, PATH, text="again")
        assert Counter((r["doc_id"], r["again"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        assert forced.encode_documents(docs.where("false"), PATH).count() == 0
        with pytest.raises(ValueError, match="clash"):
            forced.encode_documents(docs.withColumn("n_tokens", F.lit(1)), PATH)
        with pytest.raises(ValueError, match="already"):
            forced.decode_documents(coded.withColumn("decoded", F.lit(1)), PATH)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_resample(docs, aims, n, buckets, least, percent):
    features = lambda t: [" ".join(w[i : i + k]) for w in [words_of(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in aims for f in features(x))
    raw, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (raw + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        weight = sum(gain[bucket(f)] for f in features(x))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("which, n, least, percent", [("odd", 1, 5, 60), ("odd", 3, 5, 40), ("documents", 1, 20, 10), ("documents", 2, 20, 30)])
def test_resampling_against_brute_force(request, spark, which, n, least, percent):
    docs = request.getfixturevalue("odd") if which == "odd" else spark.read.parquet(f"{DATA}/documents.parquet")
    aims = spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",), ("the cat sat",)], "text string"))
    aims = aims.withColumns({"doc_id": F.lit("x"), "pack": F.lit("y")})
    got = resample.resample(docs, aims, n=n, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_resample(rows, [r["text"] for r in aims.collect()], n, resample.BUCKETS, least, percent)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == want


def test_resampling_empty_tables(spark, odd):
    aims = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert resample.resample(odd.where("false"), aims).count() == 0
    none = resample.resample(odd, aims.where("false")).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in none) == brute_resample(rows, [], 1, resample.BUCKETS, 20, 10)


def test_resampling_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = con.execute(queries.ORACLES["op12_resample"]).fetchall()
    names = [d[0] for d in con.description]
    assert Counter(map(tuple, queries.op12_resample(spark, DATA).select(*names).collect())) == Counter(want)


def brute_runs(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, 2 * q) and not any(w[start : end - p] == w[start + p : end] for p in range(1, q)):
                out.add((start, end - start, q))
            i = j
    return sorted(out)


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        k, w, size = rng.choice([1, 2, 3, 5, 50]), [], rng.choice([5, 20, 60, 200, 500])
        while len(w) < size:
            base = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 70, 100, 130]))]
            w += (base * rng.randint(1, 5))[: rng.randint(1, 400)]
        assert periods.find_runs(np.array(w)) == brute_runs(w), w


def test_runs_of_long_texts():
    rng = np.random.default_rng(0)
    assert periods.find_runs(np.full(1_000_000, 7)) == [(0, 1_000_000, 1)]
    assert periods.find_runs(np.tile(rng.integers(0, 50_000, 3000), 100)) == [(0, 300_000, 3000)]
    assert periods.find_runs(rng.integers(0, 50_000, 500_000)) == []
    blocks = periods.find_runs(np.array(([1] * 100 + [2]) * 200))
    assert blocks == sorted([(101 * k, 100, 1) for k in range(200)] + [(0, 20_200, 101)])


def brute_periods(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_periods_query_against_brute_force(request, spark, which):
    docs = request.getfixturevalue("odd").where("doc_id IS NULL OR doc_id NOT IN (5, 22)") if which == "odd" else spark.read.parquet(f"{DATA}/documents.parquet")
    got = periods.periodic_runs(docs, keep=["doc_id"], order=periods.repeated_order, digests=True) if which == "odd" else queries.op13_periods(spark, DATA)
    want = Counter(brute_periods(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, got.collect())) == want
    assert which == "odd" or sum(x[1] > 0 for x in want) > 5


def test_runs_and_collapsed_texts(odd):
    got = {r["doc_id"]: r for r in periods.periodic_runs(odd).collect() if r["doc_id"] is not None}
    assert got[21]["collapsed"] == "la ends" and [tuple(x) for x in got[21]["runs"]] == [(0, 27, 1)]
    assert got[23]["collapsed"] == "a b c d e f" and got[22]["n_words"] == 40_000 and got[22]["collapsed"] == "x"
    assert got[2]["n_words"] == 0 and got[2]["collapsed"] == "" and got[2]["runs"] == []
    assert periods.periodic_runs(odd).count() == odd.count() and periods.periodic_runs(odd.where("false")).count() == 0
    with pytest.raises(ValueError, match="clash"):
        periods.periodic_runs(odd.withColumn("runs", F.lit(1)))

"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import Hasher, chunks, split_words

FEATURES = ("upper", "symbol", "bar", "digit", "word_length", "line", "repeat", "distinct", "wide", "tail")
SHRINK_TO_POOLED = 0.2
SHRINK_TO_DIAGONAL = 0.1
FLOOR = 1e-3
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    kinds = np.zeros((5, 256), bool)
    kinds[0, 65:91] = True  # upper case
    kinds[1, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'|"]] = True
    kinds[2, ord("|")] = True
    kinds[3, 48:58] = True
    kinds[4, 10] = True
    return kinds


def statistics(texts: pa.Array, hasher: Hasher) -> np.ndarray:
    """One row of transformed statistics (FEATURES) a text, over the whole text; null is empty."""
    kinds, out = _kinds(), []
    for first, last, data, offsets in chunks(texts):
        words = split_words(data, offsets, hasher)
        n = last - first
        size = np.diff(offsets).astype(float)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)  # noqa: E731,B023
        letters = count(((data | 32) >= 97) & ((data | 32) <= 122))
        n_words = np.bincount(words.doc, minlength=n).astype(float)
        same = np.zeros(len(words.doc))
        same[1:] = (words.doc[1:] == words.doc[:-1]) & (words.hash[1:] == words.hash[:-1])
        order = np.lexsort((words.hash, words.doc))
        new = np.ones(len(order))
        new[1:] = (words.doc[order][1:] != words.doc[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
        distinct = np.bincount(words.doc[order], weights=new, minlength=n)
        # Words that end in two like marks.
        tail = (words.end - words.start >= 3) & (data[words.end - 1] == data[np.maximum(words.end - 2, 0)]) & kinds[1][data[words.end - 1]] if len(words.end) else np.zeros(0, bool)
        # Roots of shares steady their variance; the counts added draw short texts to plain ones.
        share = lambda x, of: np.sqrt(x / (of + 10))
        out.append(np.stack([
            share(count(kinds[0][data]), letters),
            share(count(kinds[1][data]), n_words),
            share(count(kinds[2][data]), n_words),
            share(count(kinds[3][data]), size),
            np.log((size + 62) / (n_words + 10)),
            share(count(kinds[4][data]), n_words),
            share(np.bincount(words.doc, weights=same, minlength=n), n_words),
            np.log((distinct + 10) / (n_words + 10)) / np.log(n_words + 30),
            share(count(data >= 128), size),
            share(np.bincount(words.doc, weights=tail, minlength=n), n_words),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def statistics_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """docs[keep] with a column f of FEATURES (array<double>)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = statistics(part.column(len(keep)), hasher)
                flat = pa.array(rows.ravel(), pa.float64())
                at = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(at, flat)], [*batch.schema.names[:-1], "f"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "f array<double>"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the precision and log determinant."""

    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1; 0.5 for every row where nothing was learned."""
        if not self.classes:
            return np.full(len(x), 0.5)
        logs = []
        for prior, mean, factor, log_det in self.classes:
            z = (x - mean) @ factor
            logs.append(prior - 0.5 * ((z * z).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From {class: (rows, sums, sums of products)}; one class alone decides every row."""
    d = len(FEATURES)
    total = sum(n for n, _, _ in moments.values())
    if not total:
        return Discriminant([])
    means, scatters = {}, {}
    for c, (n, sums, products) in moments.items():
        means[c] = sums / n
        scatters[c] = products - np.outer(sums, sums) / n
    pooled = sum(scatters.values()) / total + FLOOR * np.eye(d)
    classes = []
    for c in (0, 1):
        n = moments[c][0] if c in moments else 0
        cov = (scatters[c] + SHRINK_TO_POOLED * len(moments) * d * pooled) / (n + SHRINK_TO_POOLED * len(moments) * d) if n else pooled
        cov = (1 - SHRINK_TO_DIAGONAL) * cov + SHRINK_TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(cov)
        prior = np.log((n + 0.5) / (total + 1))
        classes.append((prior, means.get(c, np.zeros(d) if not means else sum(means.values()) / len(means)), np.linalg.inv(lower).T, 2 * np.log(np.diag(lower)).sum()))
    return Discriminant(classes)


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of stats (doc_id, f) joined with labels (doc_id, quality), by class moments.

    Only sums leave the executors. Labels other than 0 and 1, and null ids, aren't used; a label that
    repeats counts once.
    """
    d = len(FEATURES)
    rows = stats.join(labels.where("quality IN (0, 1)").select("doc_id", "quality").distinct(), "doc_id")
    f = [F.col("f")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x) for x in f] + [F.sum(f[i] * f[j]) for i, j in pairs]
    moments = {}
    for row in rows.groupBy("quality").agg(F.count(F.lit(1)), *sums).collect():
        c, n, *values = row
        products = np.zeros((d, d))
        for (i, j), v in zip(pairs, values[d:], strict=True):
            products[i, j] = products[j, i] = v
        moments[int(c)] = (float(n), np.array(values[:d]), products)
    return fit(moments)


def score_table(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats without f, with score (double, 0 to 1; higher: class 1 likelier)."""
    keep = [c for c in stats.columns if c != "f"]

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], [*batch.schema.names[:-1], "score"])

    kinds = dict(stats.dtypes)
    return stats.select(*[F.col(f"`{c}`") for c in keep], "f").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def classify(docs: DataFrame, labels: DataFrame, learn_from, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs[keep] with score of quality class 1.

    learn_from: a Column over doc_id of rows whose labels may be learned. Null and empty texts
    are scored by their statistics (all counts 0). Repeated rows are scored each. Without any
    usable label the score is 0.5. keep must hold doc_id and no column named score or f.
    """
    stats = written(statistics_table(docs, list(keep)), "quality-stats")
    model = learn(stats.select("doc_id", "f").where(learn_from), labels)
    return score_table(stats, model)


def keep_good(docs: DataFrame, labels: DataFrame, learn_from, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more, all columns unchanged.

    Texts are read twice, once to learn and once to judge, so that none is shuffled. Null and
    empty texts are judged by their statistics; without any usable label all rows stay.
    """
    model = learn(written(statistics_table(docs.select("doc_id", "text"), ["doc_id"]), "quality-stats").where(learn_from), labels)
    at = docs.columns.index("text")

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part.filter(pa.array(model.score(statistics(part.column(at), hasher)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by blended-spectrum string kernels, Nystroem landmarks and kernel ridge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

LENGTHS = (1, 2, 3)
SLOTS = 1 << 14
LANDMARKS = 128
#: Upper bound of labelled rows that a model is fitted on, dealt evenly over the languages.
SAMPLE_ROWS = 2048
RIDGE = 1.0
SHARPNESS = 4.0
UNKNOWN = "und"
#: Texts whose bitmaps, and characters whose codes, are held at once.
TILE_DOCS = 256
TILE_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def _tiles(texts: list[str | None]):
    """(number of the text, piece) lists of about TILE_CHARS characters; pieces of a long text share two characters."""
    held, chars = [], 0
    for k, t in enumerate(texts):
        t = " " + (t or "").lower() + "  "
        for lo in range(0, len(t) - 2, TILE_CHARS):
            held.append((k, t[lo : lo + TILE_CHARS + 2]))
            chars += len(held[-1][1])
            if chars >= TILE_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix: text by hashed character n-gram of the lengths 1 to 3, has a letter).

    The whole text counts, in lower case; what isn't a letter counts as a space.
    """
    table = _letters()
    out, has = np.zeros((len(texts), SLOTS), bool), np.zeros(len(texts), bool)
    for tile in _tiles(texts):
        size = np.array([len(t) for _, t in tile])
        code = np.frombuffer("".join(t for _, t in tile).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[np.minimum(code, 0xFFFF)]
        for c in np.unique(code[code > 0xFFFF]):
            letter[code == c] = chr(c).isalpha()
        doc = np.repeat(np.array([k for k, _ in tile]), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from each place to its piece's end
        code = np.where(letter, code, np.uint32(32)).astype(np.uint32)
        has[doc[letter]] = True
        grown = np.zeros(len(code), np.uint32)
        for n in LENGTHS:
            # grown[i] covers the n codes from i on; those that would leave a piece don't count.
            grown = (grown[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x9E3779B1))
            slot = ((grown ^ (grown >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(18)
            inside = left[: len(slot)] >= n
            out[doc[: len(slot)][inside], slot[inside]] = True
    return out, has


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # SLOTS by landmark, each column divided by the root of its size
    weights: np.ndarray  # landmark by language

    def margins(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        return (x @ self.landmarks / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores (0 to 1); 'und' and 0 without a letter or without a model."""
        rows, has = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = SHARPNESS * self.margins(rows)
        odds = np.exp(margins - margins.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, odds.max(axis=1), 0.0)


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """rows: presence vectors, in an order that is random but for dealing out the languages."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)))
    turn = {x: 0 for x in names}
    order = []
    for i, x in enumerate(languages):
        order.append((turn[x], i))
        turn[x] += 1
    chosen = [i for _, i in sorted(order)[:landmarks]]
    unit = rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    unit = unit.astype(np.float32)
    marks = unit[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    z = (unit @ marks.T) @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.bincount([names.index(x) for x in languages])
    w = (1 / share)[[names.index(x) for x in languages]] * len(languages) / len(names)
    solved = np.linalg.solve(z.T @ (z * w[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (y * w[:, None]))
    return LanguageModel(names, np.ascontiguousarray(marks.T), root @ solved)


def learn(docs: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most sample_rows distinct texts with a language and a letter, chosen by a hash.

    Only n-gram bitmaps (2 KB a text) reach the driver. Each language has an equal share of the
    sample, those of its distinct texts with the smallest hashes, or all of them. Without a labelled row the model knows no language.
    """
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text", F.lit(11)).alias("h"), "text")
    texts = written(known.groupBy("lang", "h").agg(F.pmod("h", F.lit(1 << 30)).alias("draw")), "texts")
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not counts:
        return fit(np.zeros((0, SLOTS)), [])
    quota = max(1, sample_rows // len(counts))
    # Fewer draws than the quota lie below this with odds of 1e-10; the rest needn't be ordered.
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (1 << 30) * min(1.0, (2.0 * quota + 30) / n))])
    few = texts.where(F.col("draw") < F.coalesce(below[F.col("lang")], F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy("draw", "h")
    chosen = written(few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= quota).select("lang", "h", "draw"), "chosen")
    some = known.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "draw", "text", "h")

    def run(batches):
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(lo, TILE_DOCS)
                names = list(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True))
                new = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
                if not new:
                    continue
                part = part.take(pa.array(new, pa.int64()))
                rows, has = presence(part.column(2).to_pylist())
                bits = np.packbits(rows, axis=1)
                at = np.flatnonzero(has)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(3).take(take), part.column(1).take(take), pa.array([bits[i].tobytes() for i in at], pa.binary())], ["lang", "h", "draw", "bits"])

    drawn = some.mapInArrow(run, "lang string, h long, draw long, bits binary").dropDuplicates(["lang", "h"]).collect()
    drawn.sort(key=lambda r: (r["draw"], r["lang"], r["h"]))
    languages = [r["lang"] for r in drawn]
    bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in drawn]
    return fit(np.array(bits, np.float32).reshape(len(bits), SLOTS), languages)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs[keep] with lang_pred and score.

    Every whole text is judged by itself; null texts and texts without a letter are 'und' with
    score 0. Repeated rows are judged each; keep must not name lang_pred or score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(lo, TILE_DOCS)
                names, score = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(run, schema)

"""Signals as tables of blocks: one row holds the samples of all channels of a short stretch.

A task works on a chunk of neighbouring blocks with copies of the blocks beside it, so a signal of
any length uses many tasks of bounded memory. What depends on a whole signal comes in as facts:
filter states from a scan over the chunks' maps, order statistics from counts, sums by signal.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recursive
from .grouped import grouped_map, numbers

#: Samples of a block: a multiple of hops, of crackle windows and of the filters' own blocks.
BLOCK = 30_720
#: Blocks that a task works on at a time.
CHUNK = 16


class Chunk(NamedTuple):
    """x: (channel, sample) with copies beside the chunk's own part lo..hi; at: place of the first sample in the signal; last: whether the signal ends here."""

    x: np.ndarray
    at: int
    lo: int
    hi: int
    last: bool
    facts: dict


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<f8").tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", "<f8")


def to_blocks(samples: DataFrame, key: str = "signal_id") -> DataFrame:
    """key, block, channels, x (packed doubles, channel after channel) of samples (key, ch, n, x).

    n counts from 0 without gaps; all channels have the same places. No samples, no blocks.
    """
    rows = samples.select(key, F.floor(F.col("n") / BLOCK).cast("long").alias("block"), "ch", "n", F.col("x").cast("double").alias("x"))

    def run(group):
        return {"channels": [len(np.unique(group["ch"].to_numpy()))], "x": [packed(numbers(group, "x"))]}

    return grouped_map(rows, [key, "block"], ["ch", "n"], ["x"], run, "channels int, x binary")


def from_blocks(blocks: DataFrame, key: str = "signal_id") -> DataFrame:
    """key, ch, n, x: a row a sample and channel."""

    def run(group):
        parts = [(int(b), unpacked(x).reshape(c, -1)) for b, c, x in zip(*(group[k].to_pylist() for k in ("block", "channels", "x")), strict=True)]
        sizes = [(b, *x.shape) for b, x in parts]
        return {
            "ch": np.concatenate([np.repeat(np.arange(c), n) for _, c, n in sizes]),
            "n": np.concatenate([np.tile(b * BLOCK + np.arange(n), c) for b, c, n in sizes]),
            "x": np.concatenate([x.reshape(-1) for _, x in parts]),
        }

    return grouped_map(blocks, [key, "block"], [], ["channels", "x"], run, "ch int, n long, x double").drop("block")


def over_chunks(blocks: DataFrame, run: Callable[[Chunk], dict | None], schema: str, key: str = "signal_id", facts: DataFrame | None = None, own: DataFrame | None = None, left: int = 0, right: int = 0, size: int = CHUNK) -> DataFrame:
    """key, chunk and the columns of schema that run makes of each chunk, with `left` blocks before it and `right` after it.

    facts: rows by key; own: rows by key and chunk. Both arrive as Chunk.facts. One shuffle, by key
    and chunk.
    """
    first, last = F.floor((F.col("block") - right) / size), F.floor((F.col("block") + left) / size)
    rows = blocks.select(key, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("chunk"), "block", "channels", "x")
    ends = blocks.groupBy(key).agg(F.max("block").alias("end"))
    told = ends.select(key, "end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / size))).alias("chunk"))
    names = []
    for table, on in ((facts, [key]), (own, [key, "chunk"])):
        if table is not None:
            more = [c for c in table.columns if c not in on]
            renamed = table.select(*[F.col(c).alias(f"__{c}") for c in on], *more)
            same = [told[c].eqNullSafe(renamed[f"__{c}"]) for c in on]
            told = told.join(renamed, same, "left").drop(*[f"__{c}" for c in on])
            names += more
    told = told.select(key, "chunk", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("channels"), F.lit(None).cast("binary").alias("x"), F.struct(F.col("end").alias("__end"), *names).alias("facts"))
    rows = told.unionByName(rows, allowMissingColumns=True)

    def apply(group):
        block = group["block"].to_numpy()[1:]
        chunk = int(group["chunk"][0].as_py())
        core = block // size == chunk
        if not core.any():
            return None
        found = group["facts"][0].as_py()
        channels = group["channels"][1].as_py()
        parts = [unpacked(b).reshape(channels, -1) for b in group["x"].to_pylist()[1:]]
        lo = int(np.argmax(core)) * BLOCK
        hi = lo + sum(p.shape[1] for p, c in zip(parts, core, strict=True) if c)
        end = found.pop("__end")
        return run(Chunk(np.concatenate(parts, axis=1), int(block[0]) * BLOCK, lo, hi, int(block[core][-1]) == end, found))

    return grouped_map(rows, [key, "chunk"], ["block"], ["channels", "x", "facts"], apply, schema)


def block_rows(y: np.ndarray, at: int) -> dict:
    """y, whose first sample stands at a block's begin, as rows of blocks."""
    parts = [y[:, k : k + BLOCK] for k in range(0, y.shape[1], BLOCK)]
    return {"block": [at // BLOCK + i for i in range(len(parts))], "channels": [len(y)] * len(parts), "x": [packed(p) for p in parts]}


BLOCKS = "block long, channels int, x binary"


def mapped(blocks: DataFrame, run: Callable[[Chunk], np.ndarray], key: str = "signal_id", **beside) -> DataFrame:
    """The blocks of what run makes of each chunk's samples, copies included; those are cut off."""

    def apply(chunk: Chunk):
        return block_rows(run(chunk)[:, chunk.lo : chunk.hi], chunk.at + chunk.lo)

    return over_chunks(blocks, apply, BLOCKS, key, **beside).drop("chunk")


def by_signal(rows: DataFrame, columns: list[str], fold: Callable, schema: str, key: str = "signal_id") -> DataFrame:
    """key and the columns of schema that fold makes of a signal's rows in order of chunk; for rows that are few and small a chunk."""
    return grouped_map(rows, [key], ["chunk"], columns, fold, schema)


# Filters: a chunk of a cascade is an affine map of its state.


def cascade_step(chain: list[tuple[float, ...]]) -> np.ndarray:
    """The matrix that takes the states of biquads in a row one sample on, without input."""
    m = np.zeros((2 * len(chain), 2 * len(chain)))
    for k, (b0, b1, b2, a1, a2) in enumerate(chain):
        m[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = [[-a1, 1.0], [-a2, 0.0]]
        into, through = np.array([b1 - a1 * b0, b2 - a2 * b0]), 1.0
        # The first state of an earlier filter is its output, which those between pass on by their b0.
        for j in range(k - 1, -1, -1):
            m[2 * k : 2 * k + 2, 2 * j] = into * through
            through *= chain[j][0]
    return m


def run_cascade(x: np.ndarray, chain: list[tuple[float, ...]], state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(output of each filter in turn, states at the end) of one channel, from given states."""
    outputs, ends = [], []
    for k, c in enumerate(chain):
        x, end = recursive.run_filter_on(x, c, tuple(state[2 * k : 2 * k + 2]))
        outputs.append(x)
        ends += end
    return outputs, np.array(ends)


def entry_states(blocks: DataFrame, chain_of: Callable[[dict], list], front: Callable[[Chunk], np.ndarray], key: str = "signal_id", facts: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """key, chunk, states: each chunk's entry states of the cascade chain_of(facts), by a scan.

    Chunks run from rest side by side and give their end states; since a chunk maps its entry state
    affinely, a fold over these few numbers gives every entry state. front makes a chunk's input.
    """

    def ends(chunk: Chunk):
        chain = chain_of(chunk.facts)
        x = front(chunk)
        rest = np.zeros(2 * len(chain))
        made = np.array([run_cascade(c, chain, rest)[1] for c in x]) if chain else np.zeros((len(x), 0))
        step = np.linalg.matrix_power(cascade_step(chain), x.shape[1]) if chain else np.zeros((0, 0))
        return {"channels": [len(x)], "ends": [packed(made)], "step": [packed(step)]}

    def fold(group):
        state, out = None, []
        for channels, made, step in zip(*(group[c].to_pylist() for c in ("channels", "ends", "step")), strict=True):
            made = unpacked(made).reshape(channels, -1)
            state = np.zeros_like(made) if state is None else state
            out.append(packed(state))
            state = state @ unpacked(step).reshape(made.shape[1], made.shape[1]).T + made
        return {"chunk": group["chunk"].to_numpy(), "states": out}

    told = over_chunks(blocks, ends, "channels int, ends binary, step binary", key, facts=facts, size=size)
    return by_signal(told, ["channels", "ends", "step"], fold, "chunk long, states binary", key).select(key, "chunk", "states")


def filtered(blocks: DataFrame, chain_of: Callable[[dict], list], key: str = "signal_id", facts: DataFrame | None = None, front: Callable[[Chunk], np.ndarray] = lambda c: c.x, mix: Callable | None = None, size: int = CHUNK) -> DataFrame:
    """blocks through the cascade of biquads chain_of(facts), as if each signal ran in one piece.

    front makes the input of a chunk (its samples by default); mix(outputs of the filters in turn,
    facts) makes the output of a channel (that of the last filter by default).
    """

    def run(chunk: Chunk):
        chain = chain_of(chunk.facts)
        x = front(chunk)
        states = unpacked(chunk.facts["states"]).reshape(len(x), -1)
        rows = []
        for c, s in zip(x, states, strict=True):
            outputs = run_cascade(c, chain, s)[0]
            rows.append(mix(outputs, chunk.facts) if mix else outputs[-1] if outputs else c)
        return np.stack(rows)

    states = entry_states(blocks, chain_of, front, key, facts, size)
    return mapped(blocks, run, key, facts=facts, own=states, size=size)


# Order statistics of all values of a signal.


def upper_median(blocks: DataFrame, values: Callable[[Chunk], np.ndarray], name: str, key: str = "signal_id", **beside) -> DataFrame:
    """key and name: the value at place n // 2 in order of the magnitudes that values() gives; no row without any.

    Magnitudes are counted by their leading bits first; of the one group that holds the place, each
    value is counted then.
    """
    shift = 40  # leaves sign, exponent and 12 bits

    def groups(chunk: Chunk):
        bins, counts = np.unique(np.abs(values(chunk)).view(np.int64) >> shift, return_counts=True)
        return {"bin": bins, "c": counts}

    counted = over_chunks(blocks, groups, "bin long, c long", key, **beside).groupBy(key, "bin").agg(F.sum("c").alias("c"))

    def locate(group):
        ends = np.cumsum(group["c"].to_numpy())
        k = int(np.searchsorted(ends, ends[-1] // 2, "right"))
        return {"found": [group["bin"][k].as_py()], "place": [int(ends[-1] // 2 - (ends[k - 1] if k else 0))]}

    held = grouped_map(counted, [key], ["bin"], ["c"], locate, "found long, place long")

    def inside(chunk: Chunk):
        v = np.abs(values(chunk))
        v, counts = np.unique(v[v.view(np.int64) >> shift == chunk.facts["found"]], return_counts=True)
        return {"v": v, "c": counts} if len(v) else None

    beside = beside | {"facts": held.select(key, "found")}
    exact = over_chunks(blocks, inside, "v double, c long", key, **beside).groupBy(key, "v").agg(F.sum("c").alias("c")).join(held.select(F.col(key).alias("__key"), "place"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")

    def take(group):
        k = int(np.searchsorted(np.cumsum(group["c"].to_numpy()), group["place"][0].as_py(), "right"))
        return {name: [group["v"][k].as_py()]}

    return grouped_map(exact, [key], ["v"], ["c", "place"], take, f"{name} double")


# Long kernels and other rates.


def convolved(blocks: DataFrame, kernel: np.ndarray, key: str = "signal_id", size: int = CHUNK) -> DataFrame:
    """blocks through a kernel of any length, as many samples as before: each chunk by one transform with what the kernel reaches back to."""
    kernel = np.asarray(kernel, float)
    back = -(-(len(kernel) - 1) // BLOCK)

    def run(chunk: Chunk):
        n = 1 << (chunk.x.shape[1] + len(kernel) - 2).bit_length()
        spectrum = np.fft.rfft(kernel, n)
        return np.stack([np.fft.irfft(np.fft.rfft(c, n) * spectrum, n)[: len(c)] for c in chunk.x])

    return mapped(blocks, run, key, left=back, size=max(size, 2 * back))


def resampled(blocks: DataFrame, source: int, target: int, key: str = "signal_id", size: int = CHUNK) -> DataFrame:
    """blocks at another rate by readers.resample()'s kernel; a signal's samples are those of the whole resampled at once."""
    from ..sources.readers import resample_at

    if source == target:
        return blocks

    def pieces(chunk: Chunk):
        """New samples whose places lie in the chunk's own part, cut at the new blocks' bounds."""
        begin, end = chunk.at + chunk.lo, chunk.at + chunk.hi
        first = -(-begin * target // source)
        last = int(np.floor(end * target / source + 0.5)) if chunk.last else -(-end * target // source)
        if last <= first:
            return None
        y = np.stack([resample_at(c, source, target, first, last, chunk.at) for c in chunk.x])
        cuts = [first, *range((first // BLOCK + 1) * BLOCK, last, BLOCK), last]
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        return {"block": [a // BLOCK for a, _ in parts], "from": [a for a, _ in parts], "channels": [len(y)] * len(parts), "x": [packed(y[:, a - first : b - first]) for a, b in parts]}

    def joined(group):
        channels = group["channels"][0].as_py()
        return {"channels": [channels], "x": [packed(np.concatenate([unpacked(x).reshape(channels, -1) for x in group["x"].to_pylist()], axis=1))]}

    made = over_chunks(blocks, pieces, "block long, from long, channels int, x binary", key, left=1, right=1, size=size)
    return grouped_map(made, [key, "block"], ["from"], ["channels", "x"], joined, "channels int, x binary")

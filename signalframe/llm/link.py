"""Linking of items that share a band key: candidate stars, estimates, checks and components.

A bucket's members first meet one pivot; what is then in one component needs no further pair.
Buckets that still hold several components are searched for links between them: their members are
dealt to parts of bounded bytes, and each pair of parts that can hold a link is a group of its
own, with members near many others first. A group tells one link for each two components that it
joins, so the result grows with the items and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_written, written

#: Bytes of a part of a bucket; a group holds two parts, or one longer member beside a part.
PART_BYTES = 1 << 20
PROBES = 64
#: Edges that a file of a step of components() holds.
PART_EDGES = 250_000
#: Members of a group whose pairs are all estimated at once.
SMALL = 128


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of edges (a, b).

    Alternating large and small stars; each step is written, so a lost executor costs one step. Steps
    come in as many files as their rows ask for, so that small graphs take few tasks.
    """
    first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = written(first, "cc")
    before = _tally(current)
    parts = 1 + int(before[0]) // PART_EDGES
    step = lambda df, tag: written(df.coalesce(parts), tag)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "cc-min")
        large = step(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        drop_written(current)
        drop_written(least)
        least = step(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        current = step(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_written(large)
        drop_written(least)
        now = _tally(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def more_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges that gave labels and of some more: what is joined already is a star."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))


def matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _star_links(pairs: DataFrame, likeness: Callable, least: float) -> DataFrame:
    """pairs (a, b, sig_a, sig_b) that reach the least likeness, with it as near."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = likeness(matrix(batch.column(2)), matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], ["a", "b", "near"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, near double").where(F.col("near") >= least)


def _confirmed(exact: Callable) -> Callable:
    """Of a group of members and their pivot (side 1): the pairs that exact keeps."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        pivot = np.flatnonzero(side)[:1]
        others = np.flatnonzero(side == 0)
        order = np.concatenate([pivot, others])
        payload = rows["payload"].take(pa.array(order)).to_pylist()
        node = rows["node"].to_numpy()[order]
        kept = 1 + np.flatnonzero(exact(payload)(0, np.arange(1, len(order)))) if len(pivot) and len(others) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(node[kept], pa.int64()), "b": pa.array(np.full(len(kept), node[0] if len(node) else 0), pa.int64())})

    return run


def _confirm(best: DataFrame, full: DataFrame, weight: DataFrame, exact: Callable) -> DataFrame:
    """The pairs (a, b) of best that exact keeps. A pivot's members come in groups of bounded bytes, its payload once a group."""
    weighed = best.join(weight.withColumnRenamed("node", "a"), "a")
    groups = weighed.groupBy("b").agg(F.ceil(F.sum("bytes") / PART_BYTES).alias("parts"))
    dealt = written(best.join(groups, "b").select("b", F.pmod(F.xxhash64("a", F.lit(3)), F.col("parts")).alias("part"), F.col("a").alias("node")), "dealt")
    pivots = dealt.select("b", "part").distinct().select("b", "part", F.col("b").alias("node"), F.lit(1).alias("side"))
    rows = dealt.withColumn("side", F.lit(0)).unionByName(pivots).join(full.select("node", "payload"), "node")
    return rows.groupBy("b", "part").applyInArrow(_confirmed(exact), "a long, b long")


def _part_links(likeness: Callable, least: float, exact: Callable | None) -> Callable:
    """Links between components of two parts of a bucket (side 0 and 1, or one part: side 2).

    exact(payloads) gives a test of one row against others.
    """

    def run(rows: pa.Table) -> list[tuple[int, int]]:
        node, label = rows["node"].to_numpy(), np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        side = rows["side"].to_numpy()
        sigs = matrix(rows["sig"])
        if len(node) <= SMALL:
            first, second = np.triu_indices(len(node), 1)
            fine = (label[first] != label[second]) & ((side[first] != side[second]) | (side[first] == 2))
            first, second = first[fine], second[fine]
            if not len(first) or not (likeness(sigs[first], sigs[second]) >= least).any():
                return []
        test = exact(rows["payload"].to_pylist()) if exact else None
        probes = np.random.default_rng(1).choice(len(node), min(PROBES, len(node)), replace=False)
        central = sum(likeness(sigs, sigs[p][None, :]) for p in probes)
        links = []
        for i in np.argsort(-central, kind="stable"):
            # Members of one part meet in that part's own group.
            other = (label != label[i]) & ((side != side[i]) | (side == 2))
            at = np.flatnonzero(other)
            if len(at):
                at = at[likeness(sigs[at], sigs[i][None, :]) >= least]
            if len(at) and test:
                at = at[test(i, at)]
            if len(at):
                met, first = np.unique(label[at], return_index=True)
                links += [(node[i], node[at[k]]) for k in first]
                label[np.isin(label, met)] = label[i]
        return links

    return run


def _part_candidates(likeness: Callable, least: float) -> Callable:
    """Of two parts of a bucket: the members that are as like as least to one of another component."""

    def run(rows: pa.Table) -> list[tuple[int, int]]:
        node, label, side, sigs = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy(), matrix(rows["sig"])
        key, hit = rows["key"][0].as_py(), np.zeros(len(node), bool)
        for i in range(len(node) - 1):
            at = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2)))
            at = at[likeness(sigs[at], sigs[i][None, :]) >= least] if len(at) else at
            if len(at):
                hit[at] = hit[i] = True
        return [(key, k) for k in node[hit].tolist()]

    return run


def _each_group(batches, keys: int, run: Callable[[pa.Table], list[tuple[int, int]]]):
    """Links of each group of rows that agree in their first columns; groups come one after another, many a batch."""
    held: list[pa.RecordBatch] = []
    last = None

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        found = []
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            name = tuple(c[lo] for c in columns)
            if held and name != last:
                found += run(pa.Table.from_batches(held))
                held = []
            last = name
            held.append(batch.slice(lo, hi - lo))
        yield told(found)
    if held:
        yield told(run(pa.Table.from_batches(held)))


def part_pairs(rows: DataFrame, weight: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, x, y, node, component, side: a row for each pair of parts (x, y) that a member has to be in.

    rows: key, node, component, big (the bucket's largest component); weight: node, bytes. Members
    beside the largest component ("odd" ones) are dealt to parts 0, 1, ... and meet each other and
    the parts -1, -2, ... of the largest one, which don't meet each other.
    """
    rows = rows.join(weight, "node").withColumn("odd", F.col("component") != F.col("big"))
    parts = rows.groupBy("key").agg(*[F.greatest(F.ceil(F.sum(F.when(F.col("odd") == odd, F.col("bytes")).otherwise(0)) / part_bytes), F.lit(1)).alias(name) for name, odd in (("odds", True), ("bigs", False))])
    rows = rows.join(written(parts, "parts"), "key")
    own = F.when(F.col("odd"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("odds"))).otherwise(-1 - F.pmod(F.xxhash64("node", F.lit(3)), F.col("bigs")))
    rows = rows.withColumn("own", own)
    odd_parts = F.sequence(F.lit(0).cast("long"), F.col("odds") - 1)
    big_parts = F.sequence(-F.col("bigs"), F.lit(-1).cast("long"))
    mates = F.when(F.col("odd"), F.concat(big_parts, odd_parts)).otherwise(odd_parts)
    rows = rows.select("key", "node", "component", "own", F.explode(mates).alias("mate"))
    side = F.when(F.col("own") == F.col("mate"), 2).otherwise((F.col("own") > F.col("mate")).cast("int"))
    return rows.select("key", F.least("own", "mate").alias("x"), F.greatest("own", "mate").alias("y"), "node", "component", side.alias("side"))


def linked(nodes: DataFrame, likeness: Callable, least: float, payloads: Callable[[DataFrame], DataFrame] | None = None, exact: Callable | None = None, search: bool = True) -> DataFrame:
    """(node, component) of the nodes (node long, keys array<long>, sig binary) that have links.

    Two nodes link if they share a key, likeness(sigs, sigs) is at least `least`, and exact, given
    the payloads (node, payload binary) of nodes that share keys, keeps them. nodes must be a
    written table with unique, non-null nodes. Nodes without a link may be missing.

    search: also look for links between a bucket's members beside its pivot. Without it, two nodes
    link only by way of the pivots of their buckets, which is what an approximate search needs: a
    pair that alone shares a bucket is found, and groups hang together by several buckets.
    """
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    member = written(exploded.join(shared, "key").select("node", "key", "pivot", "n"), "members")
    drop_written(shared)
    sigs = nodes.select("node", "sig")
    named = lambda labels, c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))

    # Each member against its buckets' pivots: first the likeliest one, then those that are still apart.
    stars = written(member.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    side = lambda c: sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = written(_star_links(stars.join(side("a"), "a").join(side("b"), "b"), likeness, least), "near")
    drop_written(stars)
    if not exact:
        labels = written(components(near.select("a", "b")), "labels")
    else:
        # Whole sets are made and moved for nodes with a likely partner only.
        full = _with_payloads(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), sigs, payloads)
        weight = _weight(full)
        confirm = lambda pairs: _confirm(written(pairs, "best"), full, weight, exact)
        best = near.groupBy("a").agg(F.max(F.struct("near", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        labels = written(components(written(confirm(best), "links")), "labels")
        apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        rest = written(near.join(named(labels, "a"), "a", "left").join(named(labels, "b"), "b", "left").where(apart).select("a", "b"), "apart")
        if not rest.isEmpty():
            labels = written(more_components(labels, written(confirm(rest), "links")), "labels")
        drop_written(full)
        drop_written(rest)
    drop_written(near)
    if not search:
        return labels

    # Buckets of two members are done; larger ones may hold links beside their pivot.
    placed = written(member.where("n > 2").join(labels, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component")), "placed")
    drop_written(member)
    rows = _of_several(placed)
    if rows.isEmpty():
        return labels
    # Members that no estimate brings near another component drop out before whole sets are made.
    small = sigs.select("node", (F.octet_length("sig") + 64).alias("bytes"))
    pairs = _dealt(part_pairs(rows, small), sigs.withColumn("payload", F.lit(None).cast("binary")))
    candidates = _part_candidates(likeness, least)
    hit = written(pairs.mapInArrow(lambda batches: _each_group(batches, 3, candidates), "a long, b long").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct(), "hits")
    rows = _of_several(placed.join(hit, ["key", "node"]))
    if rows.isEmpty():
        return labels
    full = _with_payloads(hit.select("node").distinct(), sigs, payloads)
    pairs = _dealt(part_pairs(rows, _weight(full)), full)
    links = _part_links(likeness, least, exact)
    found = written(pairs.mapInArrow(lambda batches: _each_group(batches, 3, links), "a long, b long").distinct(), "links")
    drop_written(full)
    return labels if found.isEmpty() else written(more_components(labels, found), "labels")


def _with_payloads(nodes: DataFrame, sigs: DataFrame, payloads: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """node, sig and payload of nodes."""
    if payloads is None:
        return written(nodes.join(sigs, "node").withColumn("payload", F.lit(None).cast("binary")), "payloads")
    return written(payloads(nodes).join(sigs, "node").select("node", "sig", "payload"), "payloads")


def _weight(full: DataFrame) -> DataFrame:
    return full.select("node", (F.coalesce(F.octet_length("payload"), F.lit(0)) + F.octet_length("sig") + 64).alias("bytes"))


def _of_several(members: DataFrame) -> DataFrame:
    """members (key, node, component) of buckets that still hold several components, with the largest one of these as big."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("big"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("big.component").alias("big"))
    return written(members.join(several, "key"), "several-rows")


def _dealt(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The rows of part_pairs() with sig and payload, a pair of parts in one task."""
    rows = written(pairs, "part-pairs").join(full, "node").select("key", "x", "y", "node", "component", "side", "sig", "payload")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

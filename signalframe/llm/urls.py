"""URL filters: rules first, then a blocked Bloom filter of listed URLs and an exact join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import spare

#: (verdict, host, path) of the rules that the registered query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS_PER_URL = 16
PROBES = 6
WORDS = 4  # 64-bit words a block
#: Blocks of a filter that is sent to every task: 40 bytes each, 40 MB in all.
BROADCAST_BLOCKS = 1_000_000
#: Parts of a block's rows where the filter is joined by shuffling.
SALTS = 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between '://' and the first of / ? #, A-Z lower-cased, and path up to ? or #.

    A null URL, or one without '://', has both empty.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, UPPER.lower()), path


def canonical(host: Column, path: Column) -> Column:
    """host + path without a final '.html' or '/'; scheme, query and fragment don't count."""
    return F.concat(host, F.regexp_replace(path, r"(\.html|/)$", ""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; both null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), list(zip(fits, values))[1:], F.when(fits[0], F.lit(values[0]))) if ordered else F.lit(None).cast("string")
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def _bits(url: Column, word: int) -> Column:
    """The bits of one 64-bit word of the block that a URL's probes set; 0 if none."""
    h = F.xxhash64(url, F.lit(1))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.pmod(F.shiftrightunsigned(h, 9 * k), F.lit(64 * WORDS))
        flag = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
        out = out.bitwiseOR(F.when(F.floor(bit / 64) == word, flag).otherwise(F.lit(0).cast("long")))
    return out


def blocked_bloom(listed: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """A blocked Bloom filter of listed[url] as rows (block, w0..w3), and its number of blocks.

    Null URLs and repeats add nothing; an empty list has an empty table, and then no URL is a
    possible hit.
    """
    keys = listed.select(F.col(url).alias("u")).where("u IS NOT NULL")
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    rows = keys.select(F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("block"), *[_bits(F.col("u"), w).alias(f"w{w}") for w in range(WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def possible_hits(rows: DataFrame, bloom: DataFrame, blocks: int, u: str = "u", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """rows with maybe: whether the filter holds all bits of rows[u]; false for a null u. A column named maybe is replaced.

    Up to broadcast_blocks blocks, of 40 bytes each, the filter goes to every task and no row
    moves. Beyond, rows meet it by block; blocks are dealt by a hash, and rows are salted by their
    place in the task that reads them, so that a URL with a third of all rows is split too.
    """
    names = {c: spare(c, rows.columns) for c in ("block", "salt", *(f"w{w}" for w in range(WORDS)))}
    block, salt = names["block"], names["salt"]
    bloom = bloom.select(*[F.col(c).alias(names[c]) for c in names if c != "salt"])
    bits = [_bits(F.col(f"`{u}`"), w) for w in range(WORDS)]
    held = [F.col(names[f"w{w}"]).bitwiseAND(bits[w]) == bits[w] for w in range(WORDS)]
    maybe = F.coalesce(reduce(lambda a, b: a & b, held), F.lit(False))
    rows = rows.withColumn(block, F.pmod(F.xxhash64(F.col(f"`{u}`")), F.lit(blocks)))
    if blocks <= broadcast_blocks:
        return rows.join(F.broadcast(bloom), block, "left").withColumn("maybe", maybe).drop(*names.values())
    salted = bloom.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [block, salt], "left").withColumn("maybe", maybe).drop(*names.values())


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """pages (page_id, url) with host, path, rule, listed (boolean) and verdict.

    listed: canonical URLs in column url. A rule's verdict stands; without one, listed URLs are
    blocked and others allowed. Null or odd URLs have empty host and path, fit no rule and are
    never listed, so they are allowed. Repeated rows are judged alike; other columns are left out;
    an empty table gives no rows.

    Only possible hits of the Bloom filter enter the exact join; the others are unlisted at once.
    """
    names = written(listed.select("url").where("url IS NOT NULL").distinct(), "listed")
    bloom, blocks = blocked_bloom(names)
    bloom = written(bloom, "bloom")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "u": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path")))})
    tried = written(possible_hits(rows, bloom, blocks, "u", broadcast_blocks), "tried")
    out = tried.where("NOT maybe").withColumn("listed", F.lit(False))
    hits = names.select(F.col("url").alias("u"), F.lit(True).alias("found"))
    # The possible hits are counted by URL before the join, so that it sees each URL once.
    sure = tried.where("maybe").select("u").distinct().join(hits, "u").select("u", F.lit(True).alias("listed"))
    inside = tried.where("maybe").join(sure, "u", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    judged = out.unionByName(inside)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")

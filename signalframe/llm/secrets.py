"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text. The ledger has a row for
each scanned (blob, rule version); a scan reads only blobs that lack one, and findings are joined
back to every document that holds the blob.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_path, written


class Rule(NamedTuple):
    """A kind of secret: its pattern, and the group whose length must reach least (0: the match)."""

    kind: str
    pattern: str
    group: int
    least: int


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
#: The base kinds, in the order in which spans of one start are listed. Runs of a class that are
#: bound to be maximal carry their least length in the pattern.
BASE = (
    Rule("assign", "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Further kinds.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
RULES = BASE + ADDED
SPAN = "struct<start:bigint,kind:int,end:bigint>"
#: Code points of a piece in which places are cut from a text.
PIECE = 1024


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _steps(text: Column, rule: Rule, number: int) -> Column:
    """The matches of a rule in order: lengths (code points) of the gap before and of the match, and whether it counts."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = [F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit")]
    if rule.group:
        parts.append(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("kept"))

    def step(x, i):
        fields = F.lit(number).alias("kind"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit")
        return F.struct(*fields, (F.length(x["kept" if rule.group else "hit"]) >= rule.least).alias("counts"))

    steps = F.transform(F.filter(F.arrays_zip(*parts), lambda x: x["hit"].isNotNull()), step)
    return F.when(text.rlike(rule.pattern), steps).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,hit:int,counts:boolean>>"))


def spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found (its SPANs, by start and then by the order of the rules) for each blob of texts (blob, text).

    Places are running sums over the matches of a blob, as rows, so the work is linear in a text's
    matches (but for sorting); texts themselves aren't moved. Repeated rows give one.
    """
    steps = texts.select("blob", F.explode_outer(F.concat(*[_steps(F.col("text"), rule, i) for i, rule in enumerate(rules)])).alias("step"))
    steps = steps.select("blob", "step.*").repartition("blob").groupBy("blob", "kind", "pos").agg(*[F.any_value(c).alias(c) for c in ("gap", "hit", "counts")])
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "kind").orderBy("pos"))
    placed = steps.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), "kind", "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), span))).cast(f"array<{SPAN}>").alias("found"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def update_ledger(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs of docs (doc_id, text) that the ledger lacks under these rules; add their rows.

    Returns paths (doc_id, blob), one row a row of docs. Only the smallest id's copy of a blob is
    scanned, and only addresses are grouped, so many copies of one text cost one scan and no task
    gets them together. The ledger at ledger_path is a table (blob, version, found); it is created
    if missing and appended to otherwise.
    """
    spark = docs.sparkSession
    version = rule_version(rules)
    paths = written(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        blobs = blobs.join(read_ledger(docs, ledger_path, rules).select("blob"), "blob", "left_anti")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = texts.join(blobs, texts["doc_id"].eqNullSafe(blobs["rep"]), "inner").where(blob_of(F.col("text")) == F.col("blob"))
    scanned = spans(new.select("blob", "text"), rules).select("blob", F.lit(version).alias("version"), "found")
    scanned.write.mode("append").parquet(ledger_path)
    return paths


def read_ledger(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows of these rules, one a blob, even if two writers have scanned it."""
    schema = f"blob string, version string, found array<{SPAN}>"
    rows = docs.sparkSession.read.schema(schema).parquet(ledger_path).where(F.col("version") == rule_version(rules))
    return rows.dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and found (array of start, kind number, end; code points) of every row of docs.

    Null and empty texts share the blob of the empty text and have no spans. Repeated rows and
    copies each get a row. Without ledger_path the ledger is new. An empty table gives no rows.
    """
    ledger_path = ledger_path or new_path(docs.sparkSession, "ledger")
    paths = update_ledger(docs, ledger_path, rules)
    # Written, so that the join meets plain shuffles on both sides and Spark can split a blob of many copies.
    return paths.join(written(read_ledger(docs, ledger_path, rules), "found"), "blob").select("doc_id", "blob", "found")


def pieces_of(found: DataFrame, size: int = PIECE) -> DataFrame:
    """blob, marks for each blob of found (blob, found) with spans: what to cut from its text, piece by piece.

    The text is seen as pieces of size code points; marks lists for each piece, up to the last that
    a span touches, the places (first, last, opens) to cut, where opens tells whether the mark stands
    there. Overlapping spans are one place; touching ones are two.
    """
    order = Window.partitionBy("blob").orderBy("start", "kind")
    rows = found.select("blob", F.explode("found").alias("span")).select("blob", "span.*")
    rows = rows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum((F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int")).over(order))
    runs = rows.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = runs.withColumn("piece", F.explode(F.expr(f"sequence(start div {size}, (end - 1) div {size})")))
    first = F.greatest(F.col("start") - F.col("piece") * size, F.lit(0)).cast("int")
    last = F.least(F.col("end") - F.col("piece") * size, F.lit(size)).cast("int")
    place = F.struct(first.alias("first"), last.alias("last"), (F.col("start") >= F.col("piece") * size).alias("opens"))
    cut = cut.groupBy("blob", "piece").agg(F.sort_array(F.collect_list(place)).alias("places"))
    # Pieces without a place since the last one with any get an empty list each.
    skipped = (F.col("piece") - F.coalesce(F.lag("piece").over(Window.partitionBy("blob").orderBy("piece")), F.lit(-1)) - 1).cast("int")
    filled = cut.withColumn("lists", F.concat(F.array_repeat(F.filter("places", lambda _: F.lit(False)), skipped), F.array("places")))
    listed = filled.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("piece", "lists"))).alias("lists"))
    return listed.select("blob", F.flatten(F.transform("lists", lambda x: x["lists"])).alias("marks"))


def redacted(text: Column, marks: Column, mark: str = "[REDACTED]", size: int = PIECE) -> Column:
    """The text with each place of marks (see pieces_of) replaced by mark; linear in text and places."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def piece(part, i):
        def step(acc, p):
            between = part.substr(acc["at"] + 1, p["first"] - acc["at"])
            return F.struct(p["last"].alias("at"), F.concat(acc["out"], between, F.when(p["opens"], F.lit(mark)).otherwise("")).alias("out"))

        cut = F.aggregate(F.get(marks, i), start, step, lambda acc: F.concat(acc["out"], part.substr(acc["at"] + 1, F.lit(size))))
        return F.when(F.size(F.get(marks, i)) > 0, cut).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.array_join(F.transform(parts, piece), "")


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the secrets of text redacted and n_chars, if there, set to the new length.

    Texts without findings stay as they are, nulls too. Only blobs with findings are joined.
    """
    ledger_path = ledger_path or new_path(docs.sparkSession, "ledger")
    update_ledger(docs, ledger_path, rules)
    hits = pieces_of(read_ledger(docs, ledger_path, rules).where(F.size("found") > 0)).toDF("__blob", "__marks")
    hits = written(hits, "marks")  # as in scan()
    rows = docs.join(hits, blob_of(docs["text"]) == hits["__blob"], "left")
    hit, changed = hits["__marks"].isNotNull(), "_" * (1 + max(map(len, docs.columns)))
    columns = {c: docs[f"`{c}`"] for c in docs.columns} | {"text": F.when(hit, redacted(docs["text"], hits["__marks"])).otherwise(docs["text"])}
    rows = rows.select(*[v.alias(c) for c, v in columns.items()], hit.alias(changed))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.drop(changed)

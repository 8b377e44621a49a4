"""Order statistics with exact ranks, and sums that describe pairs of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a doubling of magnitude.
BUCKETS = 4096
# Exponents of doubles lie above this.
LEAST_EXPONENT = 1080


def round_half_up(x: Column) -> Column:
    """Rounds halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def nearest_rank(p: float):
    """0-based place round((n - 1) * p), halves up."""
    return lambda n: F.floor((n - 1) * F.lit(p) + 0.5)


def upper_middle(n: Column) -> Column:
    """0-based place n // 2: the upper median."""
    return F.floor(n / 2)


def floor_rank(p: float):
    """0-based place floor(n * p)."""
    return lambda n: F.floor(n * F.lit(p))


def magnitude_bucket(v: Column) -> Column:
    """A number that never falls as v rises: BUCKETS steps a doubling of |v|, with v's sign."""
    size = F.abs(v)
    e = F.floor(F.log2(size))
    # Right below a power of two, a logarithm that is rounded up gives step -1: the last one of the doubling below.
    step = (e + LEAST_EXPONENT) * BUCKETS + F.floor((size / F.pow(F.lit(2.0), e) - 1) * BUCKETS) + 1
    b = F.when(size == 0, 0).when(size < 1e-300, F.signum(v)).when(size < float("inf"), F.when(v < 0, -step).otherwise(step))
    top = 4 * LEAST_EXPONENT * BUCKETS
    return F.when(F.isnan(v), top + 1).otherwise(F.coalesce(b, F.when(v < 0, -top).otherwise(top))).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict) -> DataFrame:
    """keys and, by name, the value at the 0-based place(n) of each group's sorted values.

    Nulls don't count; groups without a value are missing. Values are counted in buckets by
    magnitude first, so that outliers don't crowd the others into one, and only the distinct
    values of buckets that hold a place are put in order: a group may be of any size.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL").withColumn("__b", magnitude_bucket(F.col("__v")))
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__n": F.sum("__c").over(whole), "__before": F.coalesce(F.sum("__c").over(up_to), F.lit(0))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("__n")).cast("long").alias("at")) for name, place in places.items()])
    held = F.filter(wanted, lambda w: (w["at"] >= F.col("__before")) & (w["at"] < F.col("__before") + F.col("__c")))
    target = counts.select(*keys, "__b", "__before", held.alias("__held")).where(F.size("__held") > 0)
    inside = rows.join(target, [*keys, "__b"]).groupBy(*keys, "__b", "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__before").alias("__before"), F.first("__held").alias("__held"))
    below = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__c").over(below), F.lit(0)))
    here = lambda name: F.exists("__held", lambda w: (w["name"] == name) & (w["at"] >= F.col("__before")) & (w["at"] < F.col("__before") + F.col("__c")))
    return inside.groupBy(*keys).agg(*[F.max(F.when(here(name), F.col("__v"))).alias(name) for name in places])


def order_statistic(df: DataFrame, keys: list[str], value: str, place, name: str) -> DataFrame:
    """order_statistics() of one place."""
    return order_statistics(df, keys, value, {name: place})


def averaging_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the mean of the two middle values, or the middle one."""
    both = order_statistics(df, keys, value, {"__lo": lambda n: F.floor((n - 1) / 2), "__hi": upper_middle})
    return both.select(*keys, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))


def robust_sigma(df: DataFrame, keys: list[str], value: str, name: str = "sigma") -> DataFrame:
    """1.4826 times the upper median of absolute values, at least 1e-6."""
    found = order_statistic(df.withColumn("__a", F.abs(value)), keys, "__a", upper_middle, name)
    return found.withColumn(name, F.greatest(F.col(name) * 1.4826, F.lit(1e-6)))


def masked_mean(value: Column, mask: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(default))


def stereo(left: Column, right: Column) -> list[Column]:
    """correlation (not centred), imbalance_db and dual_mono of two channels."""
    ll, rr, lr = F.sum(left * left), F.sum(right * right), F.sum(left * right)
    r = F.when(ll * rr > 0, lr / F.sqrt(ll * rr)).otherwise(0.0)
    imbalance = F.when((ll > 0) & (rr > 0), 10 * F.log10(ll / rr)).otherwise(0.0)
    same = F.max(F.abs(left - right)) <= 1e-6
    return [r.alias("correlation"), imbalance.alias("imbalance_db"), (same | ((r > 0.9999) & (F.abs(imbalance) < 0.1))).alias("dual_mono")]


def weighted_line(x: Column, y: Column, w: Column) -> list[Column]:
    """offset and slope of a weighted least-squares line, from sums; null without spread in x."""
    s, sx, sy, sxx, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)
    det = s * sxx - sx * sx
    slope = F.when(F.abs(det) > 1e-12, (s * sxy - sx * sy) / det)
    return [((sy - slope * sx) / s).alias("offset"), slope.alias("slope")]

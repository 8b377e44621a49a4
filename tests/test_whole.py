"""Queries over whole inputs, against DuckDB SQL without cuts."""

import pytest
from pyspark.sql import functions as F

from signalframe.functions import scalars
from signalframe.queries import ORACLES, QUERIES

from .conftest import DATA
from .test_queries import duck, rows  # noqa: F401


def same(spark, duck, name, query):  # noqa: F811
    """The rows of a query, which must be those of the SQL."""
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(query)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, cur.fetchall())
    assert len(got) == len(want)
    assert all(g == w or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(g, w, strict=True)) for g, w in zip(got, want, strict=True))
    return df


def test_text_escapes_whole_texts(spark, duck):  # noqa: F811
    df = same(spark, duck, "text_escapes", ORACLES["text_escapes"])
    assert df.agg({"tokens": "max"}).first()[0] > 86


def test_bleed_source_all_frames(spark, duck):  # noqa: F811
    df = same(spark, duck, "bleed_source", ORACLES["bleed_source"])
    assert {r["frame"] for r in df.select("frame").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("name", ["auto_configure", "health_findings", "module_report", "compliance_pass", "acx_checks", "acx_conform"])
def test_reports_of_all_lines(spark, duck, name):  # noqa: F811
    df = same(spark, duck, name, ORACLES[name])
    n = duck.execute(f"SELECT count(*) FROM '{DATA}/lineitem.parquet'").fetchone()[0]
    if name == "module_report":
        assert {r["files"] for r in df.collect()} == {n}
    elif name not in ("health_findings", "acx_checks"):
        assert df.count() == n


def test_rubric_score_whole_turns(spark, duck):  # noqa: F811
    query = ORACLES["rubric_score"]
    df = same(spark, duck, "rubric_score", query)
    cut = {r[0]: r[1:] for r in duck.execute("SELECT conv_id, score, failed FROM (" + query.replace("string_agg(text,", "string_agg(text[:60],") + ")").fetchall()}
    assert any(cut[r["conv_id"]] != (r["score"], r["failed"]) for r in df.collect())


@pytest.mark.parametrize("name", ["linear_resample", "slice_padded"])
def test_places_of_odd_vectors(spark, duck, tmp_path, name):  # noqa: F811
    """Repeated ids, null and short vectors have their rows, and no table of places is broadcast or moved."""
    odd = [(1, [float(i * i % 11) for i in range(64)]), (1, [1.0] * 64), (2, None), (3, [0.5, 2.5])]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    query = ORACLES[name].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'")
    cur = duck.execute(query)
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_fixed_as_formatted(spark):
    """Fast decimals tell what format_string tells, and reports are not made by it."""
    values = [0.0, -0.0, 0.005, -0.005, -0.004, 0.125, -0.125, 2.675, 1.005, -1.005, 99.995, -30.0, 123456789.985, 1e15, -3e18, float("nan"), float("inf"), float("-inf"), None, 0.1 + 0.2, 1e-9]
    values += [k / 1000 - 3 for k in range(6001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2):
        told = df.select("x", scalars.fixed(F.col("x"), digits).alias("got"), F.format_string(f"%.{digits}f", "x").alias("want"))
        assert told.where("NOT got <=> want").collect() == []
    seconds = [0.0, 59.4, 59.5, 61.0, 3599.5, 3600.0, 86_399.0, 400_000.0, -3.0, None]
    clock = [r[0] for r in spark.createDataFrame([(v,) for v in seconds], "x double").select(scalars.timecode(F.col("x"))).collect()]
    assert clock == ["0:00", "0:59", "1:00", "1:01", "1:00:00", "1:00:00", "23:59:59", "111:06:40", "0:00", "0:00"]
    plan = QUERIES["html_reports"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("format_string(%.2f") == plan.count("format_string(") - plan.count("format_string(%.1f")


def test_module_report_explodes_names_only(spark):
    """A count of modules makes no settings."""
    plan = QUERIES["module_report"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "map_from_entries" not in plan and "fundamental_hz" not in plan

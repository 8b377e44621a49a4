"""Compliance reports as HTML, one document a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_html, fixed, timecode
from .compliance import AUDIOBOOK, FLOOR_HIGH, PEAK_HIGH, RMS_HIGH, RMS_LOW, TOLERANCE_LU

HEAD = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Compliance report</title>
<style>body{font:15px/1.5 sans-serif;max-width:48em;margin:2em auto}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:.4em .6em;border-bottom:1px solid #ccc}.pass{color:#147a31}.fail{color:#a02020}</style>
</head><body>
"""
FOOT = "</body></html>\n"


def _badge(ok: Column) -> Column:
    return F.when(ok, '<span class="pass">PASS</span>').otherwise('<span class="fail">FAIL</span>')


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr><td>"), *[p for c in cells for p in (c, F.lit("</td><td>"))][:-1], F.lit("</td></tr>\n"))


def _table(head: list[str], rows: Column) -> Column:
    top = "".join(f"<th>{h}</th>" for h in head)
    return F.concat(F.lit(f"<table><thead><tr>{top}</tr></thead><tbody>\n"), rows, F.lit("</tbody></table>\n"))


def html(checked: DataFrame, key: str) -> DataFrame:
    """key, html of rows of compliance.checks() with output_file, source_file, preset_name, tier,
    duration_secs, sample_rate, channels, chain_version, before_lufs, before_peak_dbtp,
    before_range_lu, after_range_lu and modules (array of module, applied, detail).

    Texts are escaped; missing measurements read n/a, and null names are empty.
    """
    c = F.col
    text = lambda x: escape_html(F.coalesce(x, F.lit("")))
    num = lambda x, unit, digits=2: F.when(x.isNull(), "n/a").otherwise(F.concat(fixed(x.cast("double"), digits), F.lit(f" {unit}")))
    whole = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    facts = F.concat(*[p for label, value in (
        ("Source", text(c("source_file"))), ("Output", text(c("output_file"))), ("Preset", F.concat(text(c("preset_name")), F.lit(" ("), F.initcap("tier"), F.lit(")"))),
        ("Duration", timecode(c("duration_secs"))), ("Sample rate", F.concat(whole(c("sample_rate")), F.lit(" Hz, "), whole(c("channels")), F.lit(" ch"))), ("Chain version", c("chain_version").cast("string")),
    ) for p in (F.lit(f"<p><b>{label}</b> "), F.coalesce(value, F.lit("n/a")), F.lit("</p>\n"))])
    loudness = _table(["Metric", "Before", "After", "Target", "Result"], F.concat(
        _row(F.lit("Integrated loudness"), num(c("before_lufs"), "LUFS"), num(c("integrated_lufs"), "LUFS"), F.concat(fixed(c("target_lufs"), 1), F.lit(f" LUFS (±{TOLERANCE_LU})")), _badge(c("loudness_pass"))),
        _row(F.lit("True peak"), num(c("before_peak_dbtp"), "dBTP"), num(c("true_peak_dbtp"), "dBTP"), F.concat(F.lit("≤ "), fixed(c("ceiling_dbtp"), 1), F.lit(" dBTP")), _badge(c("peak_pass"))),
        _row(F.lit("Loudness range"), num(c("before_range_lu"), "LU"), num(c("after_range_lu"), "LU"), F.lit("—"), F.lit("—"))))
    book = _table(["Check", "Measured", "Requirement", "Result"], F.concat(
        _row(F.lit("RMS"), num(c("rms_dbfs"), "dBFS"), F.lit(f"{RMS_LOW:.0f} to {RMS_HIGH:.0f} dBFS"), _badge(c("book_rms"))),
        _row(F.lit("Peak"), num(c("true_peak_dbtp"), "dBFS"), F.lit(f"≤ {PEAK_HIGH:.0f} dBFS"), _badge(c("book_peak"))),
        _row(F.lit("Noise floor"), num(c("floor_dbfs"), "dBFS"), F.lit(f"≤ {FLOOR_HIGH:.0f} dBFS"), _badge(c("book_floor")))))
    each = F.array_join(F.transform("modules", lambda m: _row(text(m["module"]), F.when(m["applied"], "Applied").otherwise("Bypassed"), text(m["detail"]))), "")
    modules = _table(["Module", "Status", "Detail"], F.coalesce(each, F.lit("")))
    body = F.concat(
        F.lit(HEAD + "<h1>Compliance report</h1>\n"), facts, F.lit("<h2>Loudness</h2>\n"), loudness,
        F.when(c("preset_id") == AUDIOBOOK, F.concat(F.lit("<h2>Audiobook checklist</h2>\n"), book)).otherwise(""),
        F.lit("<h2>Modules</h2>\n"), modules, F.lit(FOOT))
    return checked.select(key, body.alias("html"))


def write_html(reports: DataFrame, path: str) -> None:
    """One text file a partition, a report a row; the committer renames files whole."""
    reports.select("html").write.mode("errorifexists").text(path)

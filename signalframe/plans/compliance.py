"""Compliance checks of rendered files, and what gain would make them pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of the loudness and audiobook checks.
TOLERANCE_LU = 0.5
RMS_LOW, RMS_HIGH, PEAK_HIGH, FLOOR_HIGH = -23.0, -18.0, -3.0, -60.0
AUDIOBOOK = "audiobook_acx"


def checks(files: DataFrame) -> DataFrame:
    """files with loudness_pass, peak_pass, the audiobook checks and overall_pass.

    files: preset_id, integrated_lufs, true_peak_dbtp, target_lufs, ceiling_dbtp, rms_dbfs,
    floor_dbfs. A missing audiobook measurement fails; other presets have null audiobook checks.
    """
    c = F.col
    book = F.coalesce(c("preset_id") == AUDIOBOOK, F.lit(False))
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = files.withColumns({
        "loudness_pass": F.abs(c("integrated_lufs") - c("target_lufs")) <= TOLERANCE_LU,
        "peak_pass": c("true_peak_dbtp") <= c("ceiling_dbtp"),
        "book_rms": F.when(book, no(c("rms_dbfs").between(RMS_LOW, RMS_HIGH))),
        "book_peak": F.when(book, no(c("true_peak_dbtp") <= PEAK_HIGH)),
        "book_floor": F.when(book, no(c("floor_dbfs") <= FLOOR_HIGH)),
    })
    every = F.coalesce(c("book_rms") & c("book_peak") & c("book_floor"), F.lit(True))
    return rows.withColumn("overall_pass", (book | c("loudness_pass")) & c("peak_pass") & every)


def conform(rms: Column, peak: Column, floor: Column) -> Column:
    """struct(gain_db, will_pass, blockers): the gain towards the RMS window that the peak allows."""
    fine = rms.between(RMS_LOW, RMS_HIGH) & (peak <= PEAK_HIGH)
    gain = F.when(fine, 0.0).otherwise(F.least((RMS_LOW + RMS_HIGH) / 2 - rms, PEAK_HIGH - peak))
    rms_ok, peak_ok, noisy = (rms + gain).between(RMS_LOW, RMS_HIGH), peak + gain <= PEAK_HIGH, floor > FLOOR_HIGH
    blockers = F.filter(F.array(F.when(noisy, "noise_floor"), F.when(~rms_ok, "crest_factor")), lambda x: x.isNotNull())
    return F.struct(gain.alias("gain_db"), (rms_ok & peak_ok & ~noisy).alias("will_pass"), blockers.alias("blockers"))

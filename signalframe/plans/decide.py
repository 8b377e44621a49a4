"""From measurements to a stage configuration, findings and reports: one projection, no joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, denoise_limit_db, snr_to_strength


def stages(report: DataFrame) -> DataFrame:
    """report with which stages run and their settings; a null setting is a bypassed stage.

    report: snr_db, noise_floor_dbfs, music_ratio, speech_ratio, clipping_regions, correlation,
    dual_mono, dc, hum_hz, integrated_lufs, sibilance_ratio, target_lufs, ceiling_dbtp, diarized.
    """
    majority, speech = F.col("music_ratio") > 0.6, F.col("speech_ratio") > 0
    snr = F.col("snr_db")
    base = F.when(snr < 35, snr_to_strength(snr)).otherwise(0.2)
    voice = speech & ~majority
    return report.withColumns({
        "downmix": F.coalesce("dual_mono", F.lit(False)),
        "cutoff_hz": F.when(F.col("music_ratio") > 0.3, 40.0).otherwise(80.0),
        "denoise_strength": F.when(snr < 45, F.when(majority, base * 0.6).otherwise(base)),
        "dehum_hz": F.col("hum_hz"),
        "declip": (F.col("clipping_regions") > 3) & ~majority,
        "declick_gate": F.when(~majority, F.col("noise_floor_dbfs") + 6),
        "decrackle_ratio": F.when(~majority, F.when(snr >= 35, 7.0).otherwise(6.0)),
        "breath": voice,
        "deess_threshold": F.when(voice, clamp(F.col("sibilance_ratio") * 2.5, 0.12, 0.6)),
        "autoeq": voice,
        "speaker_leveling": F.col("diarized") & ~majority,
        "noise_gate_lufs": F.col("noise_floor_dbfs") + 8,
        "warm_start_db": F.when(F.col("diarized") & ~majority, 0.0).otherwise(clamp(F.col("target_lufs") - F.col("integrated_lufs"), -12.0, 12.0)),
        "music_mode": majority,
    })


def config_hash(columns: list[str]) -> Column:
    """A 64-bit hash of the settings in columns with their names, whatever order they are given in; null settings don't count."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])))


def findings(configured: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ord, level, title: the findings of each row of stages(), in order."""
    c = F.col
    clipped = c("clipping_regions") > 3
    # Levels and titles.
    rules: list[tuple[str, str, Column]] = [
        ("info", "Dual-mono source", c("downmix")),
        ("warn", "Out-of-phase stereo", ~c("downmix") & (c("correlation") < -0.5)),
        ("info", "DC offset removed", F.abs("dc") > 0.001),
        ("info", "High-pass filter", F.lit(True)),
        ("info", "Clean source", c("denoise_strength").isNull()),
        ("info", "Denoise engaged", c("denoise_strength").isNotNull()),
        ("info", "De-hum engaged", c("dehum_hz").isNotNull()),
        ("info", "De-clip engaged", c("declip")),
        ("warn", "Clipping detected", clipped & ~c("declip")),
        ("warn", "Heavily clipped source", c("worst_clip_secs") > 0.05),
        ("info", "Breath control", c("breath")),
        ("info", "De-esser engaged", c("deess_threshold").isNotNull()),
        ("info", "AutoEQ", c("autoeq")),
        ("info", "Per-speaker leveling", c("speaker_leveling")),
        ("info", "Music-aware leveling", c("music_mode")),
        ("info", "Loudness normalized", F.lit(True)),
        ("info", "Limited bandwidth", (c("bandwidth_hz") > 0) & (c("bandwidth_hz") < 12000)),
        ("warn", "Room reverb", c("reverb_bucket").isin("noticeable", "bad")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"), F.lit(title).alias("title"))) for i, (level, title, on) in enumerate(rules)]), lambda x: x.isNotNull())
    return configured.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


# The modules of a report, in chain order.
MODULES = ("dc_hpf", "dehum", "declip", "declick", "decrackle", "denoise", "breath", "deess", "autoeq", "speaker", "leveler", "loudness", "limiter", "dither")


def module_report(configured: DataFrame, keep: list[str], dither_bits: int | None = None) -> DataFrame:
    """keep, ord, module, applied, reason, settings (name to number) and detail of every stage in chain order.

    configured: rows of stages(); with before_lufs and after_lufs the loudness row tells both.
    reason is a code: set, music, no_hum, no_clipping, clean, no_sibilance, no_speech,
    no_speakers or float_output. detail tells reason and settings as text.
    """
    c = F.col
    has = lambda name: c(name) if name in configured.columns else F.lit(None)
    off = dither_bits is None or dither_bits >= 32
    set_ = F.lit(True)
    # Of each module: whether it runs, why not, and its numbers.
    rows: dict[str, tuple[Column, Column | str, dict[str, Column | float]]] = {
        "dc_hpf": (set_, "set", {"cutoff_hz": c("cutoff_hz")}),
        "dehum": (c("dehum_hz").isNotNull(), "no_hum", {"fundamental_hz": c("dehum_hz")}),
        "declip": (c("declip"), F.when(c("clipping_regions") > 3, "music").otherwise("no_clipping"), {"regions": c("clipping_regions"), "peak_dbfs": -1.0}),
        "declick": (c("declick_gate").isNotNull(), "music", {"gate_dbfs": c("declick_gate"), "longest_ms": 2.0}),
        "decrackle": (c("decrackle_ratio").isNotNull(), "music", {"ratio": c("decrackle_ratio"), "longest_ms": 1.0}),
        "denoise": (c("denoise_strength").isNotNull(), "clean", {"strength": c("denoise_strength"), "limit_db": denoise_limit_db(c("denoise_strength"), c("music_mode"))}),
        "breath": (c("breath"), "music", {"reduction_db": 6.0}),
        "deess": (c("deess_threshold").isNotNull(), "no_sibilance", {"share": c("deess_threshold"), "ratio": 3.0}),
        "autoeq": (c("autoeq"), "no_speech", {"amount": 0.5, "most_db": 6.0}),
        "speaker": (c("speaker_leveling"), "no_speakers", {"target_lufs": c("target_lufs")}),
        "leveler": (set_, "set", {"target_lufs": c("target_lufs"), "music": c("music_mode").cast("double")}),
        "loudness": (set_, "set", {"before_lufs": has("before_lufs"), "after_lufs": has("after_lufs"), "target_lufs": c("target_lufs")}),
        "limiter": (set_, "set", {"ceiling_dbtp": c("ceiling_dbtp")}),
        "dither": (F.lit(not off), "float_output", {"bits": F.lit(None) if off else float(dither_bits)}),
    }

    # Only what tells rows apart goes through the explode; the rest is made of each row's own module where it is read.
    on = {m: F.coalesce(rows[m][0], F.lit(False)) for m in MODULES}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("module"), on[m].alias("applied")) for i, m in enumerate(MODULES)]))
    name, applied = F.col("_m.module"), F.col("_m.applied")
    reason = F.when(applied, "set")
    settings = F.when(~applied, F.create_map().cast("map<string,double>"))
    for m, (_, why, values) in rows.items():
        told = [F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).cast("double").alias("value")) for k, v in values.items()]
        reason = reason.when(name == m, why if isinstance(why, Column) else F.lit(why))
        settings = settings.when(name == m, F.map_from_entries(F.filter(F.array(*told), lambda e: e["value"].isNotNull())))
    found = configured.withColumn("_m", each).select(*keep, "_m.*", reason.alias("reason"), settings.alias("settings"))
    numbers = F.array_join(F.transform(F.map_entries("settings"), lambda e: F.format_string("%s %.2f", e["key"], e["value"])), ", ")
    return found.withColumn("detail", F.when(F.col("applied"), numbers).otherwise(F.concat(F.lit("bypassed: "), "reason")))


def off_target(mastered: DataFrame, keep: list[str], tolerance: float = 0.5) -> DataFrame:
    """keep, level, title, measured_lufs, target_lufs, off_lu and detail: a warning for each render (after_lufs, target_lufs) further than tolerance from its target."""
    far = F.abs(F.col("after_lufs") - F.col("target_lufs"))
    detail = F.format_string("measured %.1f LUFS, aim %.1f LUFS", F.col("after_lufs"), F.col("target_lufs"))
    # Fixed value: the title.
    return mastered.where(far > tolerance).select(*keep, F.lit("warn").alias("level"), F.lit("Loudness off target").alias("title"), F.col("after_lufs").alias("measured_lufs"), F.col("target_lufs"), far.alias("off_lu"), detail.alias("detail"))


def speaker_gains(speakers: DataFrame, session: str, target: float, most: float = 12.0) -> DataFrame:
    """speakers with source and gain_db: measured, else remembered, else unknown medians to the target.

    speakers: session, speaker, measured, remembered, trim. A session's gains move together into
    +-most; a wider spread is centred and clamped. Unknown speakers get 0.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(session)
    source = F.when(F.col("measured").isNotNull(), "measured").when(F.col("remembered").isNotNull(), "remembered").otherwise("unknown")
    raw = F.lit(target) - F.coalesce("measured", "remembered") + F.coalesce("trim", F.lit(0.0))
    rows = speakers.withColumns({"source": source, "raw": raw})
    rows = rows.withColumns({"lo": F.min("raw").over(w), "hi": F.max("raw").over(w)})
    fits = F.col("hi") - F.col("lo") <= 2 * most
    shift = F.when(fits, F.least(F.greatest(F.lit(0.0), -most - F.col("lo")), most - F.col("hi"))).otherwise(-0.5 * (F.col("lo") + F.col("hi")))
    return rows.withColumn("gain_db", F.coalesce(clamp(F.col("raw") + shift, -most, most), F.lit(0.0))).drop("raw", "lo", "hi")

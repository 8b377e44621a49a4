"""Queries over rules, reports, compliance, stores, jobs and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from ..plans import catalog, compliance, decide, gates, jobs, presets, report
from ..sources.tables import segments, table, turns
from . import sql


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _reports(spark, d):
    """A measured report a line item (id and line), with a preset by order."""
    li = table(spark, d, "lineitem")
    p = presets.presets(spark).withColumn("k", F.monotonically_increasing_id()).select("preset_id", "target_lufs", "ceiling_dbtp")
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    rows = li.select(k.alias("id"), F.col("l_linenumber").alias("line"), (q + 4).alias("snr_db"), (-q - 20).alias("noise_floor_dbfs"), (k % 10 / 10).alias("music_ratio"), (k % 4 / 4).alias("speech_ratio"), (k % 7).alias("clipping_regions"), ((k % 21 - 10) / 10).alias("correlation"), (k % 6 == 0).alias("dual_mono"), (F.col("l_discount") / 50).alias("dc"), F.when(k % 5 == 0, 50.0).when(k % 5 == 1, 60.0).alias("hum_hz"), (-q / 2 - 5).alias("integrated_lufs"), F.col("l_tax").alias("sibilance_ratio"), F.col("l_discount").alias("worst_clip_secs"), (q * 400).alias("bandwidth_hz"), F.when(F.col("l_tax") > 0.05, "bad").otherwise("ok").alias("reverb_bucket"), (k % 3 == 0).alias("diarized"), F.element_at(F.array(*[F.lit(x[0]) for x in presets.PRESETS]), (k % 7 + 1).cast("int")).alias("preset_id"))
    return rows.join(F.broadcast(p), "preset_id")


def auto_configure(spark, d):
    keep = ["id", "line", "downmix", "cutoff_hz", "denoise_strength", "dehum_hz", "declip", "declick_gate", "decrackle_ratio", "breath", "deess_threshold", "autoeq", "speaker_leveling", "noise_gate_lufs", "warm_start_db", "music_mode"]
    return _r(decide.stages(_reports(spark, d)).select(*keep), "denoise_strength", "deess_threshold", "warm_start_db", "declick_gate", "noise_gate_lufs")


def health_findings(spark, d):
    return decide.findings(decide.stages(_reports(spark, d)), ["id", "line"])


def module_report(spark, d):
    return decide.module_report(decide.stages(_reports(spark, d)), ["id", "line"]).groupBy("module").agg(F.count_if("applied").alias("applied"), F.count(F.lit(1)).alias("files"))


def preset_table(spark, d):
    return presets.presets(spark)


def reverb_bucket(spark, d):
    from ..functions.scalars import reverb_bucket as bucket

    return table(spark, d, "lineitem").groupBy(bucket(F.col("l_tax") * 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _files(spark, d):
    li = table(spark, d, "lineitem")
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    p = presets.presets(spark).select("preset_id", "target_lufs", "ceiling_dbtp")
    rows = li.select(k.alias("id"), F.col("l_linenumber").alias("line"), F.element_at(F.array(*[F.lit(x[0]) for x in presets.PRESETS]), (k % 7 + 1).cast("int")).alias("preset_id"), (-14 - q / 10).alias("integrated_lufs"), (F.col("l_discount") * 20 - 4).alias("true_peak_dbtp"), F.when(k % 5 > 0, -18 - q / 10).alias("rms_dbfs"), F.when(k % 11 > 0, -40 - q).alias("floor_dbfs"))
    return rows.join(F.broadcast(p), "preset_id")


def compliance_pass(spark, d):
    return compliance.checks(_files(spark, d)).select("id", "line", "loudness_pass", "peak_pass", "overall_pass")


def acx_checks(spark, d):
    return compliance.checks(_files(spark, d)).where("book_rms IS NOT NULL").select("id", "line", "book_rms", "book_peak", "book_floor")


def acx_conform(spark, d):
    c = compliance.conform(F.coalesce("rms_dbfs", F.lit(-30.0)), F.col("true_peak_dbtp"), F.coalesce("floor_dbfs", F.lit(-50.0)))
    rows = _files(spark, d).select("id", "line", c.alias("c"))
    return _r(rows.select("id", "line", "c.gain_db", "c.will_pass", F.array_join("c.blockers", ",").alias("blockers")), "gain_db")


def voice_memory_merge(spark, d):
    """Profiles by customer from their orders: every tenth order replaces, others are averaged in."""
    o = table(spark, d, "orders")
    history = o.select(F.col("o_custkey").alias("label"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 10 == 0, "upsert").otherwise("merge").alias("op"), F.col("o_totalprice").alias("median"), (F.col("o_orderkey") % 100).alias("gain"))
    return _r(folds.running_profiles(history, "label", "at", ["median", "gain"]), "median", "gain")


def speaker_gain_solve(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("speaker")).agg(F.avg("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"))
    rows = o.select("session", "speaker", F.when(F.col("n") > 1, -10 - F.col("p") / 10000).alias("measured"), F.when(F.col("session") % 3 > 0, F.lit(-20.0)).alias("remembered"), F.when(F.col("session") % 2 > 0, F.lit(1.5)).alias("trim"))
    return _r(decide.speaker_gains(rows, "session", -16.0).select("session", "speaker", "source", "gain_db"), "gain_db", digits=4)


def _jobs(spark, d):
    state = F.create_map(*map(F.lit, ("F", "done", "O", "queued", "P", "running")))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.coalesce(state[F.col("o_orderstatus")], F.lit("queued")).alias("state"), (F.col("o_orderkey") % 100 / 80).alias("progress"))


def batch_progress(spark, d):
    return _r(jobs.progress(_jobs(spark, d), "batch"), "progress")


def job_states(spark, d):
    """Job states after the events of users: a replayed state machine."""
    names = F.create_map(*map(F.lit, ("click", "start", "purchase", "finish", "view", "fail", "signup", "retry", "logout", "cancel")))
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.coalesce(names[F.col("event_type")], F.lit("start")).alias("event"))
    return jobs.replay(rows, "user_id", "at")


def folder_targets(spark, d):
    ends = (".WAV", ".txt", ".mp3", ".pdf", ".m4b", ".wave", ".oga", ".opus", ".webm", ".AIF", "")
    ext = F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % len(ends) + 1).cast("int"))
    return jobs.targets(table(spark, d, "part").select(F.concat(F.lit("/x/"), F.col("p_partkey"), ext).alias("path")))


def unseen_files(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("/x/"), F.col("p_partkey")).alias("path"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("mtime_ms"))
    log = p.where("mtime_ms % 3 > 0").withColumn("size", F.col("size") + (F.col("mtime_ms") % 5 == 0).cast("long"))
    return jobs.unseen(p, log)


CLASSES = ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9", "src98", "src99"]


def _clips(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select((i - F.when(i % 50 == 1, 1).otherwise(0)).alias("id"), F.col("source").alias("class"), F.when(i % 9 > 0, F.col("lang")).alias("license"))


def manifest_validate(spark, d):
    return gates.manifest_errors(_clips(spark, d), CLASSES, ["license"])


def class_coverage(spark, d):
    return gates.class_coverage(_clips(spark, d), spark.createDataFrame([(c,) for c in CLASSES], "class string"))


def _metrics(spark, d, shift):
    li = table(spark, d, "lineitem").where(f"l_linenumber = {1 + shift}")
    return li.select(F.col("l_orderkey").alias("clip"), F.round(F.col("l_discount") * 4, 4).alias("lufs"), F.round(F.col("l_tax") * 2, 4).alias("true_peak"))


def regression_bands(spark, d):
    return _r(gates.regressions(_metrics(spark, d, 0), _metrics(spark, d, 1), "clip"), "delta", digits=4)


def delta_gate(spark, d):
    return _r(gates.delta_gate(_metrics(spark, d, 0), _metrics(spark, d, 1), "clip", "lufs", -0.05), "delta", digits=4)


def gate_verdict(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("pass", "pass", "skip", "report", "fail"))), (F.floor(F.col("l_quantity")) % 5 + 1).cast("int"))
    return gates.verdict(table(spark, d, "lineitem").select("l_orderkey", status.alias("status")), "l_orderkey")


def der(spark, d):
    """Diarization error of turns moved by 2 s and with speakers 0 and 2 swapped."""
    t = turns(spark, d)
    found = t.select("conv_id", (2 - F.col("speaker")).alias("speaker"), (F.col("t_start") + 2).alias("t_start"), (F.col("t_end") + 2).alias("t_end"))
    return _r(gates.diarization_error(t, found, "conv_id", 0.5, 1.0), "der")


def rubric_score(spark, d):
    s = segments(spark, d)
    notes = s.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), " ").alias("summary"), F.count(F.lit(1)).cast("int").alias("n"))
    n = F.col("n")
    notes = notes.select("conv_id", "summary", F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("point "), i)).alias("bullets"), F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * 50.0).alias("start"), F.lit("part").alias("title"))).alias("chapters"), F.array(F.lit("A title")).alias("titles"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("k"), i)).alias("keywords"))
    return _r(gates.rubric(notes, "conv_id", F.lit(380.0), chapters_after=300.0, least_keywords=4).select("conv_id", "score", "usable", F.array_join("failed", ",").alias("failed")), "score")


def html_reports(spark, d):
    """Digests of HTML reports of files, whole documents hashed."""
    facts = {"source_file": F.concat(F.lit("/in/<"), "id", F.lit(">.wav")), "output_file": F.concat(F.lit("/out/"), "id", F.lit(".wav")), "duration_secs": F.col("id") * 60.0, "preset_name": F.col("preset_id"), "tier": F.lit("standard"), "sample_rate": F.lit(48_000), "channels": F.lit(2), "chain_version": F.lit(5), "before_lufs": F.lit(-30.0), "before_peak_dbtp": F.lit(-9.0), "before_range_lu": F.lit(8.0), "after_range_lu": F.lit(5.0)}
    modules = F.array(F.struct(F.lit("leveler").alias("module"), F.lit(True).alias("applied"), F.lit("to 'target'").alias("detail")))
    rows = compliance.checks(_files(spark, d)).withColumns({**facts, "modules": modules}).withColumn("key", F.struct("id", "line"))
    made = report.html(rows, "key")
    return made.select("key.id", "key.line", F.instr("html", "&lt;").alias("escaped"), F.contains(F.col("html"), F.lit("Audiobook checklist")).alias("book"), (F.regexp_count("html", F.lit("PASS")) + 1).alias("passes"))


def model_states(spark, d):
    """States of known model files among those found."""
    p = table(spark, d, "part")
    name, size = F.concat(F.lit("m"), F.col("p_partkey"), F.lit(".bin")), F.col("p_size").cast("long")
    models = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("asr").alias("kind"), name.alias("file"), size.alias("bytes"), F.when(F.col("p_partkey") % 4 > 0, F.sha2(name, 256)).alias("sha256"))
    files = p.where("p_partkey % 3 > 0").select(name.alias("file"), F.concat(F.lit("/m/"), name).alias("path"), (size + (F.col("p_partkey") % 5 == 0).cast("long")).alias("bytes"), F.sha2(F.concat(name, F.when(F.col("p_partkey") % 7 == 0, "!").otherwise("")), 256).alias("found_sha256"))
    return catalog.located(models, files).select("id", "path", "state")


def preset_names(spark, d):
    """Presets by ids, in any case, and short names."""
    names = F.element_at(F.array(*map(F.lit, ("ACX", "podcast-Stereo", "Voice_Memo", "none", "r128", "MUSIC_HEAVY_SHOW"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return presets.resolved(table(spark, d, "part").select("p_partkey", names.alias("name"))).select("p_partkey", "name", "preset_id")


def gate_rows(spark, d):
    """Gates of clips with measurements from line items."""
    li = table(spark, d, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    clips = li.select(F.struct(k, "l_linenumber").alias("clip"), (-16 + F.col("l_discount") * 8).alias("lufs"), F.lit(-16.0).alias("target_lufs"), (F.col("l_tax") * 20 - 2).alias("true_peak"), F.lit(-1.0).alias("ceiling"), (k % 2 == 0).alias("real_speech"), (k % 3 == 0).alias("noisy"), (q / 20).alias("bak"), (q / 50).alias("ovrl"), (q / 50 - 0.2).alias("sig"), F.when(k % 5 > 0, q / 40).alias("pesq"), F.lit(0.9).alias("stoi"), q.alias("spread_before"), F.lit(12.0).alias("spread_after"), F.when(k % 7 == 0, q / 10).alias("music_delta"))
    return gates.clip_gates(clips, "clip").groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (html_reports, model_states, preset_names, gate_rows, auto_configure, health_findings, module_report, preset_table, reverb_bucket, compliance_pass, acx_checks, acx_conform, voice_memory_merge, speaker_gain_solve, batch_progress, job_states, folder_targets, unseen_files, manifest_validate, class_coverage, regression_bands, delta_gate, gate_verdict, der, rubric_score)}

_PRESETS = "presets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p[0]}', '{p[1]}', '{p[2]}', {p[3]}::DOUBLE, {p[4]}::DOUBLE)" for i, p in enumerate(presets.PRESETS)) + ") t(k, preset_id, preset_name, tier, target_lufs, ceiling_dbtp))"
_REPORTS = _PRESETS + """, reports AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity + 4 AS snr, -l_quantity - 20 AS nf, l_orderkey % 10 / 10 AS mr, l_orderkey % 4 / 4 AS sr, l_orderkey % 7 AS clips, (l_orderkey % 21 - 10) / 10 AS corr, l_orderkey % 6 = 0 AS dual, l_discount / 50 AS dc,
CASE l_orderkey % 5 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 60.0::DOUBLE END AS hum, -l_quantity / 2 - 5 AS il, l_tax AS sib, l_discount AS worst, l_quantity * 400 AS bw, l_tax > 0.05 AS bad, l_orderkey % 3 = 0 AS diar, target_lufs AS target FROM lineitem JOIN presets ON k = l_orderkey % 7),
conf AS (SELECT *, mr > 0.6 AS major, sr > 0 AND NOT mr > 0.6 AS voice, CASE WHEN snr < 45 THEN CASE WHEN snr < 35 THEN least(greatest(0.3 + (35 - snr) / 25 * 0.7, 0.3), 1) ELSE 0.2 END * CASE WHEN mr > 0.6 THEN 0.6 ELSE 1 END END AS strength FROM reports)"""
_FINDINGS = [("info", "Dual-mono source", "dual"), ("warn", "Out-of-phase stereo", "NOT dual AND corr < -0.5"), ("info", "DC offset removed", "abs(dc) > 0.001"), ("info", "High-pass filter", "true"), ("info", "Clean source", "strength IS NULL"), ("info", "Denoise engaged", "strength IS NOT NULL"), ("info", "De-hum engaged", "hum IS NOT NULL"), ("info", "De-clip engaged", "clips > 3 AND NOT major"), ("warn", "Clipping detected", "clips > 3 AND major"), ("warn", "Heavily clipped source", "worst > 0.05"), ("info", "Breath control", "voice"), ("info", "De-esser engaged", "voice"), ("info", "AutoEQ", "voice"), ("info", "Per-speaker leveling", "diar AND NOT major"), ("info", "Music-aware leveling", "major"), ("info", "Loudness normalized", "true"), ("info", "Limited bandwidth", "bw > 0 AND bw < 12000"), ("warn", "Room reverb", "bad")]
_MODULES = {"dc_hpf": "true", "dehum": "hum IS NOT NULL", "declip": "clips > 3 AND NOT major", "declick": "NOT major", "decrackle": "NOT major", "denoise": "strength IS NOT NULL", "breath": "voice", "deess": "voice", "autoeq": "voice", "speaker": "diar AND NOT major", "leveler": "true", "loudness": "true", "limiter": "true", "dither": "false"}
_FILES = _PRESETS + """, files AS (SELECT l_orderkey AS id, l_linenumber AS line, preset_id, target_lufs, ceiling_dbtp, -14 - l_quantity / 10 AS il, l_discount * 20 - 4 AS tp, CASE WHEN l_orderkey % 5 > 0 THEN -18 - l_quantity / 10 END AS rms, CASE WHEN l_orderkey % 11 > 0 THEN -40 - l_quantity END AS floor FROM lineitem JOIN presets ON k = l_orderkey % 7),
checked AS (SELECT *, preset_id = 'audiobook_acx' AS book, abs(il - target_lufs) <= 0.5 AS lp, tp <= ceiling_dbtp AS pp, coalesce(rms BETWEEN -23 AND -18, false) AS br, tp <= -3 AS bp, coalesce(floor <= -60, false) AS bf FROM files)"""
_METRICS = lambda n: f"SELECT l_orderkey AS clip, round(l_discount * 4, 4) AS lufs, round(l_tax * 2, 4) AS true_peak FROM lineitem WHERE l_linenumber = {n}"
_CLIPS = "clips AS (SELECT doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS id, source AS class, CASE WHEN doc_id % 9 > 0 THEN lang END AS license FROM documents)"
_CLASSES = "(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
_MOVES = " ".join(f"WHEN state = '{s}' AND event = '{e}' THEN '{to}'" for (s, e), to in jobs.MOVES.items())

ORACLES = {
    "model_states": """WITH m AS (SELECT p_partkey AS k, 'm' || p_partkey || '.bin' AS f FROM part) SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 > 0 THEN '/m/' || f END AS path,
        CASE WHEN k % 3 = 0 THEN 'missing' WHEN k % 5 = 0 THEN 'wrong size' WHEN k % 4 = 0 THEN 'unverified' WHEN k % 7 = 0 THEN 'wrong hash' ELSE 'ok' END AS state FROM m""",
    "preset_names": """SELECT p_partkey, list_extract(['ACX', 'podcast-Stereo', 'Voice_Memo', 'none', 'r128', 'MUSIC_HEAVY_SHOW'], CAST(p_partkey % 6 + 1 AS INT)) AS name,
        list_extract(['audiobook_acx', 'podcast_stereo', 'voice_memo_cleanup', NULL, 'broadcast_ebu', 'music_heavy_show'], CAST(p_partkey % 6 + 1 AS INT)) AS preset_id FROM part""",
    "html_reports": f"""WITH {_FILES} SELECT id, line, CAST(strpos(h, '&lt;') AS INT) AS escaped, book, CAST(1 + CAST(lp AS INT) + CAST(pp AS INT) + CASE WHEN book THEN CAST(br AS INT) + CAST(bp AS INT) + CAST(bf AS INT) ELSE 0 END AS INT) AS passes
        FROM (SELECT *, {chr(39)}{report.HEAD.replace(chr(39), chr(39) * 2)}<h1>Compliance report</h1>
<p><b>Source</b> /in/&lt;{chr(39)} AS h FROM checked)""",
    "gate_rows": """WITH c AS (SELECT l_orderkey AS k, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem), g AS (
        SELECT 'loudness' AS gate, CASE WHEN abs(-16 + d * 8 + 16) <= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM c
        UNION ALL SELECT 'true_peak', CASE WHEN t * 20 - 2 <= -1 THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'background', CASE WHEN k % 6 <> 0 THEN 'skip' WHEN q / 20 >= 1 THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'overall', CASE WHEN k % 2 <> 0 THEN 'skip' WHEN q / 50 >= CASE WHEN k % 3 = 0 THEN 0.4::DOUBLE ELSE -0.05::DOUBLE END THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'signal', CASE WHEN k % 2 <> 0 THEN 'skip' WHEN q / 50 - 0.2::DOUBLE >= -0.1::DOUBLE THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'pesq', CASE WHEN k % 6 <> 0 OR k % 5 = 0 THEN 'skip' WHEN q / 40 >= 0.4::DOUBLE THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'leveler', CASE WHEN 1 - 12 / q >= 0.5 THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'music', CASE WHEN k % 7 <> 0 THEN 'skip' WHEN q / 10 <= 2 THEN 'pass' ELSE 'fail' END FROM c
        UNION ALL SELECT 'stoi', CASE WHEN k % 2 <> 0 THEN 'skip' ELSE 'report' END FROM c) SELECT gate, status, count(*) AS n FROM g GROUP BY 1, 2""",
    "auto_configure": f"""WITH {_REPORTS} SELECT id, line, dual AS downmix, CASE WHEN mr > 0.3 THEN 40.0::DOUBLE ELSE 80.0::DOUBLE END AS cutoff_hz, round(strength, 6) AS denoise_strength, hum AS dehum_hz, clips > 3 AND NOT major AS declip, CASE WHEN NOT major THEN round(nf + 6, 6) END AS declick_gate,
        CASE WHEN NOT major THEN CASE WHEN snr >= 35 THEN 7.0::DOUBLE ELSE 6.0::DOUBLE END END AS decrackle_ratio, voice AS breath, CASE WHEN voice THEN round(least(greatest(sib * 2.5, 0.12), 0.6), 6) END AS deess_threshold, voice AS autoeq, diar AND NOT major AS speaker_leveling, round(nf + 8, 6) AS noise_gate_lufs,
        CASE WHEN diar AND NOT major THEN 0 ELSE round(least(greatest(target - il, -12), 12), 6) END AS warm_start_db, major AS music_mode FROM conf""",
    "health_findings": f"WITH {_REPORTS} " + " UNION ALL ".join(f"SELECT id, line, {i} AS ord, '{level}' AS level, '{title}' AS title FROM conf WHERE {on}" for i, (level, title, on) in enumerate(_FINDINGS)),
    "module_report": f"WITH {_REPORTS} " + " UNION ALL ".join(f"SELECT '{m}' AS module, count(*) FILTER ({on}) AS applied, count(*) AS files FROM conf" for m, on in _MODULES.items()),
    "preset_table": f"WITH {_PRESETS} SELECT 1 AS schema_version, preset_id, preset_name, tier, target_lufs, ceiling_dbtp FROM presets",
    "reverb_bucket": "SELECT CASE WHEN l_tax * 10 < 0.3 THEN 'dry' WHEN l_tax * 10 < 0.5 THEN 'ok' WHEN l_tax * 10 < 0.8 THEN 'noticeable' ELSE 'bad' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "compliance_pass": f"WITH {_FILES} SELECT id, line, lp AS loudness_pass, pp AS peak_pass, (book OR lp) AND pp AND (NOT book OR (br AND bp AND bf)) AS overall_pass FROM checked",
    "acx_checks": f"WITH {_FILES} SELECT id, line, br AS book_rms, bp AS book_peak, bf AS book_floor FROM checked WHERE book",
    "acx_conform": f"""WITH {_FILES}, m AS (SELECT id, line, coalesce(rms, -30) AS rms, tp, coalesce(floor, -50) AS fl FROM files), g AS (SELECT *, CASE WHEN rms BETWEEN -23 AND -18 AND tp <= -3 THEN 0 ELSE least(-20.5 - rms, -3 - tp) END AS gain FROM m)
        SELECT id, line, round(gain, 6) AS gain_db, rms + gain BETWEEN -23 AND -18 AND tp + gain <= -3 AND fl <= -60 AS will_pass, array_to_string(list_filter([CASE WHEN fl > -60 THEN 'noise_floor' END, CASE WHEN NOT rms + gain BETWEEN -23 AND -18 THEN 'crest_factor' END], lambda x: x IS NOT NULL), ',') AS blockers FROM g""",
    "voice_memory_merge": """WITH h AS (SELECT o_custkey AS label, o_orderkey % 10 = 0 AS up, o_totalprice AS m, o_orderkey % 100 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
        l AS (SELECT *, coalesce(max(i) FILTER (up) OVER (PARTITION BY label), 1) AS base FROM h) SELECT label, CAST(count(*) AS INT) AS n, round(avg(m), 6) AS median, round(avg(g), 6) AS gain FROM l WHERE i >= base GROUP BY 1""",
    "speaker_gain_solve": """WITH o AS (SELECT o_custkey AS session, o_orderpriority AS speaker, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT session, speaker, CASE WHEN n > 1 THEN 'measured' WHEN session % 3 > 0 THEN 'remembered' ELSE 'unknown' END AS source,
        -16 - CASE WHEN n > 1 THEN -10 - p / 10000 WHEN session % 3 > 0 THEN -20 END + CASE WHEN session % 2 > 0 THEN 1.5 ELSE 0 END AS raw FROM o), w AS (SELECT *, min(raw) OVER (PARTITION BY session) AS lo, max(raw) OVER (PARTITION BY session) AS hi FROM s)
        SELECT session, speaker, source, round(CASE WHEN raw IS NULL THEN 0 ELSE least(greatest(raw + CASE WHEN hi - lo <= 24 THEN least(greatest(0, -12 - lo), 12 - hi) ELSE -0.5 * (lo + hi) END, -12), 12) END, 4) AS gain_db FROM w""",
    "batch_progress": "SELECT o_custkey AS batch, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE least(greatest(o_orderkey % 100 / 80, 0), 1) END), 6) AS progress FROM orders GROUP BY 1",
    "job_states": f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'view' THEN 'fail' WHEN 'signup' THEN 'retry' WHEN 'logout' THEN 'cancel' ELSE 'start' END AS event FROM events),
        f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'queued' AS state, 0 AS attempts FROM events UNION ALL SELECT e.user_id, e.i, CASE {_MOVES} ELSE state END, attempts + CAST((CASE {_MOVES} ELSE state END) = 'running' AND state <> 'running' AS INT) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
        SELECT user_id, arg_max(state, i) AS state, arg_max(attempts, i) AS attempts FROM f GROUP BY 1""",
    "folder_targets": """SELECT path FROM (SELECT '/x/' || p_partkey || list_extract(['.WAV', '.txt', '.mp3', '.pdf', '.m4b', '.wave', '.oga', '.opus', '.webm', '.AIF', ''], CAST(p_partkey % 11 + 1 AS INT)) AS path FROM part)
        WHERE lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN ('wav', 'wave', 'mp3', 'm4a', 'm4b', 'flac', 'ogg', 'oga', 'aac', 'wma', 'aiff', 'aif', 'mp4', 'mov', 'mkv')""",
    "unseen_files": "SELECT '/x/' || p_partkey AS path, CAST(p_size AS BIGINT) AS size, p_partkey AS mtime_ms FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0",
    "manifest_validate": f"WITH {_CLIPS} SELECT id AS clip, 'missing license' AS error FROM clips WHERE license IS NULL UNION ALL SELECT id, 'unknown class' FROM clips WHERE class NOT IN {_CLASSES} UNION ALL SELECT id, 'repeated id' FROM clips GROUP BY id HAVING count(*) > 1",
    "class_coverage": f"WITH {_CLIPS} SELECT c.class, count(id) AS clips FROM (SELECT unnest([{', '.join(repr(c) for c in CLASSES)}]) AS class) c LEFT JOIN clips USING (class) GROUP BY 1",
    "regression_bands": f"""WITH a AS (SELECT clip, unnest(['lufs', 'true_peak']) AS metric, unnest([lufs, true_peak]) AS v FROM ({_METRICS(1)})), b AS (SELECT clip, unnest(['lufs', 'true_peak']) AS metric, unnest([lufs, true_peak]) AS v FROM ({_METRICS(2)}))
        SELECT clip, metric, round(a.v - b.v, 4) AS delta, CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' WHEN abs(a.v - b.v) > CASE metric WHEN 'lufs' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END THEN 'changed' ELSE 'ok' END AS verdict FROM a FULL JOIN b USING (clip, metric)""",
    "delta_gate": f"SELECT clip, round(a.lufs - b.lufs, 4) AS delta, a.lufs - b.lufs >= -0.05::DOUBLE AS passed FROM ({_METRICS(2)}) a JOIN ({_METRICS(1)}) b USING (clip)",
    "gate_verdict": "SELECT l_orderkey, coalesce(bool_and(CASE CAST(floor(l_quantity) AS INT) % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN false ELSE true END), true) AS passed FROM lineitem GROUP BY 1",
    "der": f"""WITH {sql.TURNS}, t AS (SELECT * FROM turns), lens AS (SELECT conv_id, CAST(floor((min(t_start) - 4) / 0.5) AS BIGINT) AS j, CAST(ceil((max(t_end) + 4) / 0.5) AS BIGINT) AS k FROM t GROUP BY 1), g AS (SELECT conv_id, unnest(range(j, k)) AS i FROM lens),
        cells AS (SELECT g.conv_id, i, list_distinct(coalesce(list(t.speaker) FILTER (t_start <= (i + 0.5) * 0.5 AND (i + 0.5) * 0.5 < t_end), [])) AS r, list_distinct(coalesce(list(2 - t.speaker) FILTER (t_start + 2 <= (i + 0.5) * 0.5 AND (i + 0.5) * 0.5 < t_end + 2), [])) AS h,
            bool_or((i + 0.5) * 0.5 BETWEEN t_start - 1 AND t_start + 1 OR (i + 0.5) * 0.5 BETWEEN t_end - 1 AND t_end + 1) AS near FROM g JOIN t USING (conv_id) GROUP BY 1, 2),
        maps AS (SELECT unnest([[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS p),
        sums AS (SELECT conv_id, p, sum(greatest(len(r), len(h)) - len(list_intersect(r, list_transform(h, lambda s: p[s + 1])))) AS w, sum(len(r)) AS t FROM cells, maps WHERE NOT near GROUP BY 1, 2)
        SELECT conv_id, round(min(CASE WHEN t > 0 THEN w / t ELSE 0 END), 6) AS der FROM sums GROUP BY 1""",
    "rubric_score": f"""WITH {sql.SEGMENTS}, m AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY seg) AS summary FROM segments GROUP BY 1),
        c AS (SELECT conv_id, len(list_filter(regexp_split_to_array(summary, '\\s+'), lambda w: w <> '')) BETWEEN 20 AND 250 AS a, n BETWEEN 3 AND 10 AS b, n * 50 <= 380 AS r, n >= 4 AS k FROM m)
        SELECT conv_id, round((2 * CAST(a AS INT) + 1.5 * CAST(b AS INT) + 1.5 + 2 + 2 * CAST(r AS INT) + 1 + 1 + 1 + CAST(k AS INT)) / 13, 6) AS score, a AND b AND r AND (2 * CAST(a AS INT) + 1.5 * CAST(b AS INT) + 1.5 + 2 + 2 * CAST(r AS INT) + 1 + 1 + 1 + CAST(k AS INT)) / 13 >= 0.8 AS usable,
        array_to_string(list_filter([CASE WHEN NOT a THEN 'summary_length' END, CASE WHEN NOT b THEN 'bullets_count' END, CASE WHEN NOT r THEN 'chapters_in_range' END, CASE WHEN NOT k THEN 'keywords_present' END], lambda x: x IS NOT NULL), ',') AS failed FROM c""",
}

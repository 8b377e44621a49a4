"""Element-wise expressions: levels, ramps, clocks, colours, names and escapes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import round_half_up

SILENCE_DB = -120.0


def gain(x: Column, db: Column) -> Column:
    return x * F.pow(F.lit(10.0), db / 20)


def dbfs(rms: Column) -> Column:
    """20 log10 of an RMS above 1e-9, else -120."""
    return F.when(rms > 1e-9, 20 * F.log10(rms)).otherwise(SILENCE_DB)


def lufs(mean_square: Column) -> Column:
    """-0.691 + 10 log10 of a mean square above 1e-12, else -120."""
    return F.when(mean_square > 1e-12, -0.691 + 10 * F.log10(mean_square)).otherwise(SILENCE_DB)


def meter_db(v: Column) -> Column:
    return 20 * F.log10(F.greatest(v, F.lit(1e-7)))


def level_db(mean_square: Column) -> Column:
    return 10 * F.log10(mean_square + 1e-12)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within lo..hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def snr_to_strength(snr: Column) -> Column:
    """35 dB and more give 0.3, 10 dB and less 1."""
    return clamp(0.3 + (35 - snr) / 25 * 0.7, 0.3, 1.0)


def denoise_limit_db(strength: Column, music: Column) -> Column:
    """Most attenuation in dB: 6 + 94 s, for music half of that and 12 at most."""
    full = 6 + clamp(strength, 0.0, 1.0) * 94
    return F.when(music, F.least(full * 0.5, F.lit(12.0))).otherwise(full)


def wet_share(limit_db: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -limit_db / 20)


def equal_power(i: Column, length: Column) -> tuple[Column, Column]:
    """(fade-out, fade-in) weights at the i-th of length steps."""
    angle = F.lit(math.pi / 2) * (i + 0.5) / length
    return F.cos(angle), F.sin(angle)


def hermite(p0: Column, p1: Column, m0: Column, m1: Column, t: Column) -> Column:
    """Cubic from p0 to p1 with end slopes m0 and m1 at t in 0..1."""
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * p0 + (t3 - 2 * t2 + t) * m0 + (3 * t2 - 2 * t3) * p1 + (t3 - t2) * m1


def pcm16(x: Column) -> Column:
    """Sample clamped to -1..1 times 32767, halves away from zero, as a 16-bit integer."""
    return round_half_up(clamp(x, -1.0, 1.0) * 32767).cast("smallint")


def quantise(x: Column, bits: int) -> Column:
    lsb = 2.0 ** (1 - bits)
    return round_half_up(x / lsb) * lsb


def srt_time(seconds: Column, mark: str = ",") -> Column:
    """hh:mm:ss,mmm; milliseconds rounded, negatives as 0."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5).cast("long")
    whole = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000)


def ass_time(seconds: Column) -> Column:
    """h:mm:ss.cc; centiseconds rounded."""
    cs = F.floor(F.greatest(seconds, F.lit(0.0)) * 100 + 0.5).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def timecode(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss; whole seconds rounded."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60)))


def fixed(x: Column, digits: int) -> Column:
    """x (double) as format_string's %.nf tells it; common numbers go by decimals, which take a fraction of its time."""
    common = ((x > 0) | (x <= -(10.0**-digits))) & (F.abs(x) < 1e12)
    return F.when(common, x.cast(f"decimal({13 + digits},{digits})").cast("string")).otherwise(F.format_string(f"%.{digits}f", x))


def parse_clock(text: Column) -> Column:
    """Seconds of '93.5', '93.5s', '1:33' or '1:02:03,5'; null for anything else."""
    t = F.trim(F.regexp_replace(F.trim(text), "s+$", ""))
    plain = t.try_cast("double")
    parts = F.transform(F.split(t, ":"), lambda p: F.replace(F.trim(p), F.lit(","), F.lit(".")).try_cast("double"))
    fine = F.forall(parts, lambda v: v.isNotNull() & (v >= 0) & (v < float("inf")))
    clock = F.aggregate(parts, F.lit(0.0), lambda a, v: a * 60 + v)
    return F.when(plain.isNotNull(), F.when(F.abs(plain) < float("inf"), plain)).when(F.size(parts).between(2, 3) & fine, clock)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def caption_text(text: Column) -> Column:
    """Braces and backslashes made harmless, control characters and runs of space collapsed."""
    swapped = F.regexp_replace(F.translate(text, "{}\\", "()/"), r"[\x00-\x1f\x7f-\x9f]", " ")
    return F.trim(F.regexp_replace(swapped, r"\s+", " "))


def file_stem(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "_")


def is_hex_colour(text: Column) -> Column:
    return text.rlike("^#[0-9A-Fa-f]{6}$")


def ass_colour(text: Column, alpha: int = 0) -> Column:
    """'#RRGGBB' as '&HAABBGGRR'; null for anything else."""
    up = F.upper(text)
    return F.when(is_hex_colour(text), F.concat(F.lit(f"&H{alpha:02X}"), up.substr(6, 2), up.substr(4, 2), up.substr(2, 2)))


def rgb(text: Column) -> Column:
    """'#RRGGBB' as an integer; null for anything else."""
    return F.when(is_hex_colour(text), F.conv(text.substr(2, 6), 16, 10).cast("int"))


# Image types by extension; anything else counts as the first.
MIME = {"jpg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def mime(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[extension(path)], F.lit("image/jpeg"))


def data_url(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def canonical_id(text: Column) -> Column:
    """Lower case, with - for _: the form in which preset names are compared."""
    return F.replace(F.lower(text), F.lit("_"), F.lit("-"))


def output_name(path: Column, pattern: Column, suffix: str) -> Column:
    """{name} in a pattern replaced by the path's stem, with a new extension."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.replace(pattern, F.lit("{name}"), stem), F.lit(f".{suffix}"))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5).cast("long")


def chunk_budget_chars(context: Column, output: Column) -> Column:
    return F.floor(F.greatest(context - 2400 - output, F.lit(256)) * 3.5).cast("long")


def reverb_bucket(rt60: Column) -> Column:
    return F.when(rt60.isNull(), "ok").when(rt60 < 0.3, "dry").when(rt60 < 0.5, "ok").when(rt60 < 0.8, "noticeable").otherwise("bad")


def headroom_bucket(peak_db: Column) -> Column:
    return F.when(peak_db > -9, "hot").when(peak_db > -24, "good").when(peak_db > -50, "quiet").otherwise("silent")


def noise_bucket(floor_db: Column) -> Column:
    return F.when(floor_db < -55, "quiet").when(floor_db < -40, "some_hiss").otherwise("noisy")


def engaged_dither(bits: Column) -> Column:
    """Whether a depth in bits calls for dither: below 32; null doesn't."""
    return F.coalesce(bits < 32, F.lit(False))


def lanczos(x: Column, a: int = 8) -> Column:
    """The Lanczos kernel of a lobes: 1 at 0, 0 from a on."""
    px = F.lit(math.pi) * x
    return F.when(F.abs(x) < 1e-12, 1.0).when(F.abs(x) >= a, 0.0).otherwise(a * F.sin(px) * F.sin(px / a) / (px * px))

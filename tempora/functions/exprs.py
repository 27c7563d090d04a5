"""Column functions: text cleaning, similarity, vectors, hashes, labels, formats and guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and patterns as they stand.
CUES = ["重点", "注意", "关键", "总结", "important", "remember", "note", "key point", "summary", "pay attention"]
LOOP = r"(?d)(.{1,4})\1{2,}"
LATIN_NOISE = r"^[A-Za-z\s'?,.!]{2,60}$"
TOKEN_PIXELS = 750

WHITE = r"(?U)\s+"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` and the functions inside it use it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_loops(c: Column) -> Column:
    """Outer white space goes; then a unit of one to four signs that comes three times or more in a row is there once."""
    return F.regexp_replace(strip(c), LOOP, "$1")


def is_hallucination(c: Column) -> Column:
    """Short Latin text, mostly upper case or of two words at most."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(c, "[^A-Z]", ""))
    tokens = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.coalesce(c.rlike(LATIN_NOISE) & (letters > 0) & ((upper / F.nullif(letters, F.lit(0)) > 0.8) | (tokens <= 2)), F.lit(False))


def first_cue(c: Column, cues: list[str]) -> Column:
    """The first cue, in list order, that the text contains, whatever its case; null if none."""
    lists = F.array(*[F.lit(x) for x in cues])
    return F.get(F.filter(lists, lambda q: F.contains(F.lower(c), F.lower(q))), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), F.lower(w))), F.lit(False))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring signs without white space; shorter text is its own gram, empty has none."""
    def pairs(x: Column) -> Column:
        n = F.length(x)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return bound(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, ""), pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.lit(1.0) - dot(a, b) / norm)


def mean_abs_percent(a: Column, b: Column, full: float = 255.0) -> Column:
    """Mean absolute difference of two thumbnails in percent of full scale."""
    diff = F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(diff / F.size(a) / full * 100)


def blended(pixel_percent: Column, semantic: Column, pixel_weight: float) -> Column:
    return F.lit(pixel_weight) * pixel_percent / 100 + F.lit(1 - pixel_weight) * semantic


def _centred(v: Column, mean: Column) -> Column:
    return bound(mean, lambda m: F.transform(_d(v), lambda x: x - m))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 where a side does not vary."""
    mean = lambda v: F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)
    ca, cb = (_centred(v, mean(v)) for v in (a, b))
    norm = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(norm == 0, F.lit(1.0)).otherwise(dot(ca, cb) / norm)


def sign_hash(v: Column) -> Column:
    """64 bits, one for each component above the mean of all."""
    bits = lambda m: F.transform(_d(v), lambda x: F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    marks = bound(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x) / F.size(v), bits)
    return F.aggregate(marks, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def motion_label(ratio: Column) -> Column:
    """(label, score) by the share of the picture that moves."""
    one = lambda name, s: F.struct(F.lit(name).alias("label"), F.lit(s).alias("score"))
    return F.when(ratio >= 0.01, one("strong_motion", 0.9)).when(ratio > 0, one("weak_motion", 0.6)).otherwise(one("static", 0.7))


def image_tokens(w: Column, h: Column) -> Column:
    return (F.floor(w * h / F.lit(TOKEN_PIXELS)) + 1).cast("long")


def fitted_size(w: Column, h: Column, most: int = 640) -> Column:
    """(w, h) scaled down to ``most`` wide, keeping the aspect; never up."""
    return F.when(w > most, F.struct(F.lit(most).cast("long").alias("w"), F.bround(h * F.lit(float(most)) / w).cast("long").alias("h"))).otherwise(
        F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))
    )


def padded_box(box: Column, scale: Column, width: Column, height: Column, pad: float = 0.25) -> Column:
    """A box (x, y, w, h) at full scale, padded, clamped to the picture; null under 2 pixels."""
    x, y, w, h = (box[k] / scale for k in range(4))
    left, top = F.greatest(F.floor(x - w * pad), F.lit(0)), F.greatest(F.floor(y - h * pad), F.lit(0))
    right, bottom = F.least(F.ceil(x + w * (1 + pad)), width), F.least(F.ceil(y + h * (1 + pad)), height)
    return F.when((right - left >= 2) & (bottom - top >= 2), F.array(left, top, right - left, bottom - top).cast("array<int>"))


def frame_time(clock: Column, frame: Column, fps: Column, fallback: float = 0.02) -> Column:
    """A live clock if there is one, else frame / fps, else frame times a fixed step."""
    return F.coalesce(clock, F.when(fps > 0, frame / fps), frame * F.lit(fallback))


def fixed(t: Column, digits: int) -> Column:
    """A double to ``digits`` digits (1 to 6), rounded by its exact binary value, ties to even.

    Formatters here round the shortest decimal form instead. The sign of 2 |t| 10^digits - (2 k + 1) decides, taken
    exactly: |t| is split into halves of 26 bits, whose products with the power are exact.
    """
    one = 10**digits
    a = F.abs(t)
    k = F.floor(a * one)
    big = a * F.lit(134217729.0)
    high = big - (big - a)
    above = (high * (2 * one) - (2 * k + 1)) + (a - high) * (2 * one)
    n = k + F.when((above > 0) | ((above == 0) & (k % 2 == 1)), 1).otherwise(0)
    sign = F.when(t < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(n / one).cast("string"), F.lit("."), F.lpad((n % one).cast("string"), digits, "0"))


def fixed3(t: Column) -> Column:
    return fixed(t, 3)


def keyframe_name(k: Column, t: Column) -> Column:
    return F.concat(F.lit("kf_"), padded(k), F.lit("_t"), fixed(t, 1), F.lit("s.jpg"))


def representative_name(k: Column, t: Column) -> Column:
    return F.concat(F.lit("rep_"), padded(k, 2), F.lit("_t"), padded(F.floor(t).cast("long")), F.lit("s.jpg"))


def padded(k: Column, width: int = 4) -> Column:
    """A number that is not negative with leading zeros; longer ones stay whole."""
    return F.format_string(f"%0{width}d", k.cast("long"))


def motion_verdict(matches: Column, translation: Column, inliers: Column, residual: Column, least: int = 8) -> Column:
    """``camera`` if one shift of the whole picture explains the motion, ``foreground`` if not, ``unknown`` with too few matches.

    The measures come from a plug-in: matched points, shift in pixels, share of points that follow it, what is left after it.
    """
    moved = (translation >= 2.0) & (inliers >= 0.7) & (residual < 4.0)
    known = (matches >= least) & translation.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown")).when(F.coalesce(moved, F.lit(False)), F.lit("camera")).otherwise(F.lit("foreground"))


def provenance(t: Column, types: Column) -> Column:
    """The first 12 hex digits of a digest over the time to three digits and the sorted distinct types."""
    parts = F.concat(F.array(fixed3(t)), F.array_sort(F.array_distinct(types)))
    return F.substring(F.sha2(F.array_join(parts, chr(124)), 256), 1, 12)


def file_time(path: Column) -> Column:
    """Seconds that a keyframe's file name states."""
    found = F.regexp_extract(path, r"_t([0-9.]+)s\.jpg", 1)
    return F.when(found != "", found.try_cast("double"))


def first_object(c: Column) -> Column:
    """The widest stretch in braces, if it is a JSON object; null otherwise."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def url_allowed(url: Column, hosts: list[str] | None = None) -> Column:
    """https to any host (or to ``hosts`` and their subdomains), http to this machine only."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    named = F.lit(True) if hosts is None else F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    near = F.lit(False) if hosts is not None else host.isin("localhost", "127.0.0.1")
    return F.coalesce(((scheme == "https") & host.isNotNull() & named) | ((scheme == "http") & near), F.lit(False))


def path_safe(path: Column) -> Column:
    """No component of the path is two dots."""
    return ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def backoff(streak: Column, first: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), streak - 1))


def tolerant_time(v: Column) -> Column:
    """Seconds from a VARIANT: a bare number, or the first of the known fields, or 0 if it has none; null if not numeric."""
    names = ("timestamp_sec", "t", "timestamp", "time")
    first = F.coalesce(*[F.try_variant_get(v, f"$.{name}", "variant") for name in names])
    bare = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(first, F.parse_json(F.lit("0")))).otherwise(v)
    kind = F.schema_of_variant(bare)
    return F.when((kind != "STRING") & (kind != "BOOLEAN"), F.try_variant_get(bare, "$", "double"))


def scenes_of_reply(c: Column) -> Column:
    """Scenes of a model's reply: an array of (start_s, end_s, desc), null unless there is at least one."""
    found = F.from_json(first_object(c), "scenes array<struct<start_s:double,end_s:double,desc:string>>")["scenes"]
    return F.when(F.size(found) > 0, found)


def required_scenes(c: Column) -> Column:
    """The scenes of a reply; an error where there is none."""
    found = scenes_of_reply(c)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("the reply has no scenes")))


def prompt(header: str, speech: Column, motion_n: Column, keyframes: Column, most: int = 800) -> Column:
    """The prompt of an understanding window: header, the tail of the speech, counts, keyframe times."""
    times = F.transform(keyframes, lambda t: F.format_string("%.1f", t))
    return F.concat_ws("\n", F.lit(header), F.concat(F.lit("speech: "), tail(F.array_join(speech, " "), most)),
                       F.concat(F.lit("motion: "), motion_n.cast("string")), F.concat(F.lit("keyframes: "), F.array_join(times, ", ")))


def entities_merged(old: Column, new: Column) -> Column:
    """Entities with the newer value of each key."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def keyframe_union(a: Column, b: Column, most: int = 10) -> Column:
    """The newest ``most`` of two sets of keyframe times, in order."""
    both = F.array_sort(F.array_union(a, b))
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)


def token_segment_time(token: Column, start: Column, end: Column) -> Column:
    """The first token's time if it lies in its chunk (within a millionth), else the chunk's start."""
    return F.when(token.between(start - 1e-6, end + 1e-6), token).otherwise(start)


def chunk_of(sample: Column, seconds: float, rate: int = 16_000) -> Column:
    return F.floor(sample / F.lit(int(seconds * rate))).cast("long")

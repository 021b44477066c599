"""Column functions: predicates and parsers (P), musical scalars (M). All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = 8  # 64ths in an eighth
# 64ths of a duration -> notation name and dots.
NOTATION = {
    1: ("64th", 0), 2: ("32nd", 0), 3: ("32nd", 1), 4: ("16th", 0), 6: ("16th", 1), 7: ("16th", 2), 8: ("eighth", 0), 12: ("eighth", 1),
    14: ("eighth", 2), 16: ("quarter", 0), 24: ("quarter", 1), 28: ("quarter", 2), 32: ("half", 0), 48: ("half", 1), 56: ("half", 2), 64: ("whole", 0),
}
# Rests that a gap is split into, in 64ths, longest first.
RESTS = (64, 56, 48, 32, 28, 24, 16, 14, 12, 8, 7, 6, 4, 3, 2, 1)
# Standard tuning, strings 1 to 6, as MIDI numbers; pitch names with their alteration.
TUNING = (64, 59, 55, 50, 45, 40)
PITCHES = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
TECHNIQUES = ("hammer_on", "pull_off", "slide", "bend", "palm_mute", "let_ring", "harmonic", "dead_note")
DENOMINATORS = (1, 2, 4, 8, 16, 32)


def _pick(key: Column, table: dict) -> Column:
    """Value of a small literal table, null if the key is not there."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# -- P: predicates and parsers ---------------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    """Host of a URL in small letters; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_allowed(url: Column, suffixes: Sequence[str]) -> Column:
    """The host is one of ``suffixes`` or ends in a dot and one of them; false without a host."""
    host = url_host(url)
    out = F.lit(False)
    for s in suffixes:
        out = out | (host == s) | host.endswith(f".{s}")
    return F.coalesce(out, F.lit(False))


def parse_source_ref(ref: Column, hosts: Sequence[str], prefix: str = "BV", length: int = 10, numeric: str = "av", base: str = "") -> Column:
    """struct<kind, source_id, url>. A reference with a scheme must have an http(s) scheme and one of ``hosts``;
    then the first id with ``prefix`` counts (the prefix in capitals), else the first numeric one, else null."""
    value = F.trim(ref)
    has_scheme = value.contains("://")
    good = ~has_scheme | (F.lower(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https") & F.coalesce(url_host(value).isin(list(hosts)), F.lit(False)))
    edge = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
    long_id = F.regexp_extract(value, f"(?i){edge[0]}{prefix}([0-9A-Za-z]{{{length}}}){edge[1]}", 1)
    number = F.regexp_extract(value, f"(?i){edge[0]}{numeric}(\\d+){edge[1]}", 1)
    made = lambda kind, sid: F.struct(F.lit(kind).alias("kind"), sid.alias("source_id"), F.concat(F.lit(base), sid).alias("url"))
    return F.when(good & (long_id != ""), made(prefix.lower(), F.concat(F.lit(prefix), long_id))).when(good & (number != ""), made(numeric, F.concat(F.lit(numeric), number)))


def safe_stem(name: Column, fallback: str) -> Column:
    """Reserved characters become underscores, dots and spaces at the ends go, 100 characters, else the fallback."""
    clean = F.substring(F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" .")), 1, 100)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def parse_rate(rate: Column) -> Column:
    """P5: ``a/b`` or a number as a double; 0 where it can't be read or b is 0."""
    parts = F.split(rate, "/", 2)
    top, low = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(top, low), F.lit(0.0))


def normalise_probe(width: Column, height: Column, rates: Sequence[Column], durations: Sequence[Column]) -> Column:
    """struct<width, height, fps, duration, reason>; the first non-zero rate and duration count, 0 as if absent."""
    fps = F.coalesce(*[F.nullif(parse_rate(r), F.lit(0.0)) for r in rates], F.lit(0.0))
    duration = F.coalesce(*[F.nullif(d.try_cast("double"), F.lit(0.0)) for d in durations], F.lit(0.0))
    w, h = width.try_cast("int"), height.try_cast("int")
    reason = F.when(w.isNull() | h.isNull(), "missing").when((w < 2) | (h < 2) | (fps <= 0) | (duration <= 0), "invalid")
    return F.struct(w.alias("width"), h.alias("height"), fps.alias("fps"), duration.alias("duration"), reason.alias("reason"))


def estimate_frames(start: Column, end: Column, fps: Column, step: Column) -> Column:
    """Frames of a slice; 0 if it is empty or rate or step are not positive."""
    n = F.floor((end - start) * fps / F.nullif(step, F.lit(0))) + 1
    return F.when((end <= start) | (fps <= 0) | (step <= 0), F.lit(0)).otherwise(n).cast("long")


def crop_to_pixels(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x, y, width, height> in pixels, null for a box that is not finite, not positive or outside."""
    left = F.least(width - 2, F.greatest(F.lit(0), F.bround(x * width).cast("int")))
    top = F.least(height - 2, F.greatest(F.lit(0), F.bround(y * height).cast("int")))
    box = F.struct(left.alias("x"), top.alias("y"), F.least(width - left, F.greatest(F.lit(2), F.bround(w * width).cast("int"))).alias("width"), F.least(height - top, F.greatest(F.lit(2), F.bround(h * height).cast("int"))).alias("height"))
    inf = F.lit(float("inf"))
    finite = F.lit(True)
    for c in (x, y, w, h):
        finite = finite & ~F.isnan(c) & (F.abs(c) < inf)
    return F.when(finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1.000001) & (y + h <= 1.000001), box)


def frame_table(start: Column, end: Column, fps: Column, step: Column, frames: Column) -> Column:
    """P10: array<struct<i, t, source_frame>> of so many frames of a slice, ``step`` source frames apart; no time is
    past the end."""
    first = F.bround(start * fps).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), frames.cast("long") - 1), lambda i: F.struct(i.alias("i"), F.least(end, start + i * step / fps).alias("t"), (first + i * step).cast("long").alias("source_frame")))


def slice_rule(start: Column, end: Column, duration: Column, fps: Column, step: Column, least: float = 0.25, most: float = 1200.0, frames: int = 180) -> Column:
    """The first rule that a requested slice breaks, null if none."""
    return (
        F.when(step < 1, "step").when(start < 0, "start").when(end > duration + 0.1, "end").when(F.least(end, duration) - start < least, "short")
        .when(F.least(end, duration) - start > most, "long").when(estimate_frames(start, F.least(end, duration), fps, step) > frames, "frames")
    )


def clip_range(start: Column, end: Column, duration: Column) -> Column:
    """struct<start, end> with the end within the duration."""
    return F.struct(start.alias("start"), F.least(end, duration).alias("end"))


# The three forms in which a tempo is printed.
_TEMPOS = (r"(?:B\s*P\s*M|TEMPO)\s*[:=]?\s*(\d{2,3}(?:\.\d+)?)", r"(\d{2,3}(?:\.\d+)?)\s*(?:B\s*P\s*M)", r"(?:[♩♪]|\b(?:Q|J)\b)\s*=\s*(\d{2,3}(?:\.\d+)?)")


def tempo_from_text(text: Column) -> Column:
    """An explicit tempo between 30 and 300; three forms in order, the first match of each."""
    up = F.translate(F.upper(text), ",", ".")
    found = [F.regexp_extract(up, p, 1).try_cast("double") for p in _TEMPOS]
    return F.coalesce(*[F.when(v.between(30, 300), v) for v in found])


# What is printed for a technique, in capital letters only; the first that fits counts.
PRINTED = {
    "PM": "palm_mute", "NH|AH|PH|HARM": "harmonic", "FULL|BEND": "bend", "^(?:SL|SLIDE)$": "slide", "^(?:LR|LETRING)$": "let_ring", "^H$": "hammer_on", "^P$": "pull_off",
}


def technique_from_text(text: Column) -> Column:
    """A playing technique printed over a staff, the first of the table that applies."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    return F.coalesce(*[F.when(letters.rlike(pattern), name) for pattern, name in PRINTED.items()])


def parse_fret(text: Column, most: int = 36) -> Column:
    """struct<fret, dead> of a token, with brackets around it or not; null if it is neither X nor 0 to ``most``."""
    inner = F.regexp_extract(F.trim(text), r"^[(\[<]?\s*([xX]|\d{1,2})\s*[)\]>]?$", 1)
    n = inner.try_cast("int")
    return F.when(F.lower(inner) == "x", F.struct(F.lit(0).alias("fret"), F.lit(True).alias("dead"))).when(n.between(0, most), F.struct(n.alias("fret"), F.lit(False).alias("dead")))


def fret_class(text: Column) -> Column:
    """P16, corpus form: the class name 0 to 22 or dead_note."""
    f = parse_fret(text, 22)
    return F.when(f["dead"], "dead_note").otherwise(f["fret"].cast("string"))


def rest_duration(glyph: Column, table: dict[str, float]) -> Column:
    """Duration of a rest glyph by a table of glyphs."""
    return _pick(glyph, table).cast("double")


def is_measure_label(text: Column, y: Column, top: Column, spacing: Column, most: int = 1000) -> Column:
    """Digits up to ``most`` in the band of three spacings above the top line."""
    return F.coalesce(F.when(text.rlike(r"^\d{1,4}$"), text.try_cast("int") <= most), F.lit(False)) & (y < top) & (y >= top - 3 * spacing)


def normalise_token(fret_text: Column, technique: Column) -> Column:
    """struct<fret, technique>; X is fret 0 with dead_note."""
    dead = F.lower(F.trim(fret_text)) == "x"
    return F.struct(F.when(dead, 0).otherwise(fret_text.try_cast("int")).alias("fret"), F.when(dead, "dead_note").otherwise(technique).alias("technique"))


def is_plain_fret(stringed: Column, fret: Column, dead: Column, ghost: Column, tied: Column, harmonic: Column) -> Column:
    """P20: a stringed note with a fret that is not dead, ghost, a tie's target or a harmonic; null counts as not."""
    off = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    return off(stringed) & F.coalesce(fret >= 0, F.lit(False)) & ~off(dead) & ~off(ghost) & ~off(tied) & (F.coalesce(harmonic.cast("int"), F.lit(0)) == 0)


def clip_box(x: Column, y: Column, w: Column, h: Column, left: Column, top: Column, right: Column, bottom: Column, digits: int = 3, least: float = 2.0) -> Column:
    """struct<x, y, w, h> of a box within a crop, from the crop's corner; null if a side is under ``least``."""
    x1, y1, x2, y2 = F.greatest(x, left), F.greatest(y, top), F.least(x + w, right), F.least(y + h, bottom)
    box = F.struct(F.round(x1 - left, digits).alias("x"), F.round(y1 - top, digits).alias("y"), F.round(x2 - x1, digits).alias("w"), F.round(y2 - y1, digits).alias("h"))
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), box)


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """P21, whole pixels: struct<x1, y1, x2, y2>, grown by ``pad`` and kept in the image."""
    return F.struct(F.greatest(F.lit(0), F.floor(x1) - pad).cast("int").alias("x1"), F.greatest(F.lit(0), F.floor(y1) - pad).cast("int").alias("y1"), F.least(width, F.ceil(x2) + pad).cast("int").alias("x2"), F.least(height, F.ceil(y2) + pad).cast("int").alias("y2"))


def hash_id(parts: Sequence[Column], n: int = 16) -> Column:
    """The first ``n`` hexadecimal digits of the SHA-256 of the parts joined by slashes."""
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, n)


def _hash_mod(source: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(source, 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def hash_split(source: Column) -> Column:
    """Test, val or train (10, 10, 80 of 100) by the hash of the source."""
    m = _hash_mod(source, 100)
    return F.when(m < 10, "test").when(m < 20, "val").otherwise("train")


def hash_split_holdout(source: Column, patterns: Sequence[str]) -> Column:
    """As P23 by tenths, but a source whose name contains one of ``patterns`` is always test."""
    named = F.lit(False)
    for p in patterns:
        named = named | F.lower(source).contains(p.lower())
    m = _hash_mod(source, 10)
    return F.when(named, "test").when(m == 0, "test").when(m == 1, "val").otherwise("train")


def active(expires: Column, now: Column) -> Column:
    """P25: a session that has not run out."""
    return F.coalesce(expires > now, F.lit(False))


def owned_path(path: Column, root: str) -> Column:
    """A path under ``root`` without a step upwards."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def merge_key(old: Column, new: Column, key: str) -> Column:
    """The map ``new`` with ``old``'s value of ``key`` where new has none."""
    kept = F.map_filter(old, lambda k, _: k == key)
    return F.when(F.coalesce(new[key].isNotNull(), F.lit(False)), new).otherwise(F.map_concat(F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.coalesce(kept, F.create_map().cast("map<string,string>"))))


def rhythm_row(duration: Column, dots: Column, durations: Sequence[int] = (1, 2, 4, 8, 16, 32, 64)) -> Column:
    """Written durations of the set with 0 to 2 dots."""
    return duration.isin(list(durations)) & dots.between(0, 2)


# -- M: musical scalars ----------------------------------------------------------------------------------------

def written_to_units(value: Column, dots: Column) -> Column:
    """M1: eighths of a written value (4 = quarter) with dots."""
    return F.lit(8.0) / value * F.when(dots == 1, 1.5).when(dots == 2, 1.75).otherwise(1.0)


def grid(units: Column, k: int = UNITS) -> Column:
    """Whole steps of 1/k eighth, half to even."""
    return F.bround(units * k).cast("int")


def notation_of(units64: Column) -> Column:
    """M2: struct<name, dots> of a duration in 64ths; an eighth for lengths without a sign of their own."""
    name = F.coalesce(_pick(units64, {k: v[0] for k, v in NOTATION.items()}), F.lit("eighth"))
    return F.struct(name.alias("name"), F.coalesce(_pick(units64, {k: v[1] for k, v in NOTATION.items()}), F.lit(0)).alias("dots"))


def duration_shape(units64: Column) -> Column:
    """M3: struct<base, dots> in 64ths if the length is a power of two, or that with one or two dots; else null."""
    out = F.lit(None).cast("struct<base:int,dots:int>")
    for base in (64, 32, 16, 8, 4, 2, 1):
        for dots, n in ((0, base * 4), (1, base * 6), (2, base * 7)):
            out = F.when(units64 * 4 == n, F.struct(F.lit(base).alias("base"), F.lit(dots).alias("dots"))).otherwise(out)
    return out


def beat_label(slot: Column) -> Column:
    """M4: beat of a 16th slot as 1, 1e, 1&, 1a, 2, ..."""
    return F.concat((F.floor(slot / 4) + 1).cast("string"), F.element_at(F.array(*map(F.lit, ("", "e", "&", "a"))), (F.pmod(slot, F.lit(4)) + 1).cast("int")))


def midi_of(string: Column, fret: Column, tuning: Sequence[int] = TUNING) -> Column:
    """M5: MIDI number of a fret; null for a string that the tuning lacks."""
    return F.get(F.array(*map(F.lit, tuning)), string.cast("int") - 1) + fret


def spell_pitch(midi: Column) -> Column:
    """M5: struct<step, alter, octave>."""
    at = F.pmod(midi, F.lit(12)).cast("int") + 1
    return F.struct(F.element_at(F.array(*[F.lit(p[0]) for p in PITCHES]), at).alias("step"), F.element_at(F.array(*[F.lit(p[1]) for p in PITCHES]), at).alias("alter"), (F.floor(midi / 12) - 1).cast("int").alias("octave"))


def pitch_class(frequency: Column) -> Column:
    """M6: pitch class of a frequency (C = 0); null if it is not positive."""
    return F.when(frequency > 0, F.pmod(F.bround(F.lit(69) + F.log2(frequency / 440.0) * 12).cast("int"), F.lit(12)))


def capacity64(num: Column, den: Column) -> Column:
    """M7: 64ths of a measure; null for a signature that is not allowed."""
    return F.when((num >= 1) & den.isin(list(DENOMINATORS)), (num * 64 / den).cast("int"))


def rests_under(limit: int = RESTS[0]) -> list[list[int]]:
    """M8: the rests of each gap under the limit, longest first."""
    out = []
    for left in range(limit):
        rests = []
        while left:
            rests.append(next(d for d in RESTS if d <= left))
            left -= rests[-1]
        out.append(rests)
    return out


def split_rest(units64: Column) -> Column:
    """M8: a gap as rests, longest first: array of 64ths."""
    whole = F.lit(RESTS[0])
    gap = units64.cast("int")
    table = F.array(*[F.array(*map(F.lit, rests)).cast("array<int>") for rests in rests_under()])
    return F.concat(F.array_repeat(whole, F.floor(gap / whole).cast("int")), F.get(table, F.pmod(gap, whole)))


def rests_of(start: Column, gap64: Column) -> Column:
    """M8: the rests of a gap with their places: array of structs (onset64, duration64)."""
    whole, gap = F.lit(RESTS[0]), gap64.cast("int")
    n = F.floor(gap / whole).cast("int")
    item = lambda at, d: F.struct((start + at).cast("int").alias("onset64"), d.alias("duration64"))
    table = F.array(*[F.array(*[F.struct(F.lit(sum(rests[:i])).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(rests)]).cast("array<struct<at:int,d:int>>") for rests in rests_under()])
    return F.concat(F.transform(F.array_repeat(whole, n), lambda d, i: item(i * whole, d)), F.transform(F.get(table, F.pmod(gap, whole)), lambda r: item(n * whole + r["at"], r["d"])))


def on_grid(x: Column, k: int) -> Column:
    """M9: whether x is a whole number of 1/k."""
    return F.abs(x * k - F.bround(x * k)) <= 1e-9


def duration_label(duration: Column, dots: Column, rest: Column) -> Column:
    """Label of a written duration for corpus rows."""
    return F.concat(F.when(rest, "rest_").otherwise("note_"), duration.cast("string"), F.repeat(F.lit("."), dots.cast("int")))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(F.try_divide(w * h, a[2] * a[3] + b[2] * b[3] - w * h), F.lit(0.0))


# Nodes of natural harmonics by fret; all other frets have that of the octave.
NODES = {2: 2.4, 3: 3.2, 4: 4.0, 5: 5.0, 7: 7.0, 8: 8.2, 9: 9.0, 10: 9.6, 12: 12.0, 14: 14.7, 15: 14.7, 16: 16.0, 17: 17.0, 19: 19.0, 21: 21.7, 22: 21.7, 24: 24.0}


def harmonic_node(fret: Column) -> Column:
    """Node of a natural harmonic over a fret."""
    return F.coalesce(_pick(fret, NODES), F.lit(12.0))


def section_label(i: Column) -> Column:
    """A to Z, then S27 and on, of a section number from 0."""
    return F.when(i < 26, F.char((F.lit(65) + i).cast("int"))).otherwise(F.concat(F.lit("S"), (i + 1).cast("string")))


def fmt_time(seconds: Column) -> Column:
    """Mm:ss.f; negative times count as 0."""
    tenths = F.floor(F.greatest(seconds, F.lit(0.0)) * 10).cast("long")
    return F.concat(F.lpad(F.floor(tenths / 600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(tenths % 600 / 10).cast("string"), 2, "0"), F.lit("."), (tenths % 10).cast("string"))


def hamming(a: Column, b: Column) -> Column:
    """Share of unequal cells of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0))


def token_feature(glyphs: Column, cells: int) -> Column:
    """At most two glyph arrays side by side on a canvas of two; an absent glyph is blank."""
    blank = F.array_repeat(F.lit(0).cast("tinyint"), cells)
    return F.concat(F.coalesce(F.get(glyphs, F.lit(0)), blank), F.coalesce(F.get(glyphs, F.lit(1)), blank))


def mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def ctc_decode(logits: Column, characters: str) -> Column:
    """struct<text, confidence>: best class of each step, blanks (0) and repeats dropped, mean of what is kept."""
    best = F.transform(logits, lambda row: F.struct((F.array_position(row, F.array_max(row)) - 1).cast("int").alias("i"), F.array_max(row).cast("double").alias("p")))
    kept = F.transform(F.array(best), lambda b: F.filter(b, lambda x, j: (x["i"] != 0) & (x["i"] != F.coalesce(F.get(b, j - 1)["i"], F.lit(-1))) & (x["i"] <= len(characters))))[0]
    text = F.array_join(F.transform(kept, lambda x: F.substring(F.lit(characters), x["i"], F.lit(1))), "")
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["p"])
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0).alias("confidence"))


def parse_object(text: Column, schema: str | T.DataType) -> Column:
    """A JSON object as a struct; null for invalid JSON and for anything but an object."""
    return F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), F.from_json(text, schema))

"""Table mutations (U) as operators from tables to tables, and constraint checks (C). Lengths are in 64ths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TECHNIQUES, TUNING, capacity64, midi_of
from .aggs import missing_measures

MEASURES = 128  # of one score at most
EVENT = "struct<onset64:int,duration64:int,rest:boolean,notes:array<struct<string:int,fret:int,technique:string>>>"


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each row and rule that it breaks (a rule is what must hold; null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def note_rules() -> dict[str, Column]:
    """Domains of a note: string 1 to 6, fret 0 to 36, known technique, times on their grids."""
    c = F.col
    return {
        "string": c("string").between(1, 6), "fret": c("fret").between(0, 36), "technique": c("technique").isNull() | c("technique").isin(*TECHNIQUES),
        "onset": (c("onset64") >= 0) & (c("onset64") % 4 == 0), "duration": c("duration64").between(1, 64),
    }


def validate_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, expected: Sequence[str], least: int = 8) -> DataFrame:
    """C4: (check, id) of what is wrong with a detection set."""
    a = annotations
    names = categories.sparkSession.createDataFrame([(n,) for n in expected], "name string")
    out = [
        names.join(categories, "name", "left_anti").select(F.lit("missing_category").alias("check"), F.col("name").alias("ref")),
        categories.join(names, "name", "left_anti").select(F.lit("extra_category"), "name"),
        a.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti").select(F.lit("unknown_image"), F.col("id").cast("string")),
        a.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti").select(F.lit("unknown_category"), F.col("id").cast("string")),
        a.filter(F.exists(F.slice("bbox", 3, 2), lambda x: x <= 0)).select(F.lit("empty_box"), F.col("id").cast("string")),
        images.filter((F.col("width") < least) | (F.col("height") < least)).select(F.lit("small_image"), F.col("id").cast("string")),
    ]
    r = out[0]
    for t in out[1:]:
        r = r.union(t)
    return r


def apply_measure_edits(measures: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measures (score_id, number, events, ts_num, ts_den, human_verified) with the edits that keep the rules, and
    the edits that don't with the first rule that they break. The events before the first edit stay as ``baseline``."""
    ev = F.col("events")
    cap = capacity64(F.coalesce("ts_num", F.lit(4)), F.coalesce("ts_den", F.lit(4)))
    bad = (
        F.when(cap.isNull(), "signature").when(F.size(ev) > 32, "events").when(F.exists(ev, lambda e: (e["onset64"] < 0) | (e["duration64"] < 1) | (e["onset64"] + e["duration64"] > cap)), "range")
        .when(F.exists(ev, lambda e: e["rest"] & (F.size(e["notes"]) > 0)), "rest_with_notes").when(F.exists(ev, lambda e: F.size(F.array_distinct(F.transform(e["notes"], lambda n: n["string"]))) < F.size(e["notes"])), "duplicate_string")
        .when(F.exists(ev, lambda e: F.exists(e["notes"], lambda n: ~n["string"].between(1, 6) | ~n["fret"].between(0, 36))), "note")
    )
    checked = edits.withColumn("error", bad)
    keys = ["score_id", "number"]
    unknown = checked.filter("error is null").join(measures.select(*keys), keys, "left_anti").withColumn("error", F.lit("unknown_measure"))
    good = checked.filter("error is null").select(*keys, *[F.col(c).alias(f"_{c}") for c in ("events", "ts_num", "ts_den", "human_verified")])
    j = measures.join(good, keys, "left")
    base = F.col("baseline") if "baseline" in measures.columns else F.lit(None).cast(measures.schema["events"].dataType)
    out = j.withColumn("baseline", F.when(F.col("_events").isNotNull(), F.coalesce(base, F.col("events"))).otherwise(base))
    for c in ("events", "ts_num", "ts_den", "human_verified"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out, checked.filter("error is not null").select(*keys, "error").union(unknown.select(*keys, "error"))


def insert_measure(rows: DataFrame, inserts: DataFrame, column: str = "number") -> DataFrame:
    """Numbers after the insertion point of a score (``after``) move on by one; also for frames and sync points."""
    return rows.join(inserts.select("score_id", "after"), "score_id", "left").withColumn(column, F.when(F.col(column) > F.col("after"), F.col(column) + 1).otherwise(F.col(column))).drop("after")


def insert_measures(measures: DataFrame, inserts: DataFrame, most: int = MEASURES) -> DataFrame:
    """An empty measure after ``after`` in each score that has room for one."""
    room = measures.groupBy("score_id").agg(F.count("*").alias("_n")).filter(F.col("_n") < most)
    ok = inserts.join(room, "score_id", "left_semi")
    new = ok.select("score_id", (F.col("after") + 1).cast(measures.schema["number"].dataType).alias("number"))
    return insert_measure(measures, ok).unionByName(new, allowMissingColumns=True)


def blank_score(scores: DataFrame, n: Column) -> DataFrame:
    """Measures 1 to n of 4/4 without events."""
    return scores.withColumn("number", F.explode(F.sequence(F.lit(1), n.cast("int")))).withColumn("ts_num", F.lit(4)).withColumn("ts_den", F.lit(4)).withColumn("events", F.array().cast(f"array<{EVENT}>"))


def resolve_tempo(projects: DataFrame, candidates: DataFrame) -> DataFrame:
    """U4: tempo and its source. A locked one stays; else of the candidates (score_id, source, tempo) a visual one, then
    video timing, then audio where the present source may be replaced by audio; else what is there, else 120."""
    c = candidates.filter("tempo is not null").groupBy("score_id").pivot("source", ["visual", "video_timing", "audio_analysis"]).agg(F.first("tempo"))
    j = projects.join(c, "score_id", "left")
    audio_ok = F.coalesce(F.col("tempo_source").isin("default", "video_timing", "audio_analysis"), F.lit(True))
    locked = F.coalesce("tempo_locked", F.lit(False))
    options = [(locked, F.col("tempo_bpm"), F.col("tempo_source")), (F.col("visual").isNotNull(), F.col("visual"), F.lit("visual")), (F.col("video_timing").isNotNull(), F.col("video_timing"), F.lit("video_timing")), (audio_ok & F.col("audio_analysis").isNotNull(), F.col("audio_analysis"), F.lit("audio_analysis"))]
    tempo, source = F.coalesce("tempo_bpm", F.lit(120.0)), F.coalesce("tempo_source", F.lit("default"))
    for when, t, s in reversed(options):
        tempo, source = F.when(when, t).otherwise(tempo), F.when(when, s).otherwise(source)
    return j.withColumns({"tempo_bpm": tempo, "tempo_source": source}).drop("visual", "video_timing", "audio_analysis")


def lock_tempo(projects: DataFrame, locks: DataFrame, xml: str = "xml") -> DataFrame:
    """Set and lock a tempo, clear the audio analysis, and write the tempo into the score's text."""
    j = projects.join(locks.select("score_id", F.col("tempo_bpm").alias("_t")), "score_id", "left")
    on = F.col("_t").isNotNull()
    text = F.regexp_replace(F.col(xml), F.lit(r'tempo="[^"]*"'), F.concat(F.lit('tempo="'), F.format_string("%.1f", F.col("_t").cast("double")), F.lit('"')))
    cols = {"tempo_bpm": F.coalesce("_t", "tempo_bpm"), "tempo_source": F.when(on, "user").otherwise(F.col("tempo_source")), "tempo_locked": F.when(on, True).otherwise(F.col("tempo_locked")), xml: F.when(on, text).otherwise(F.col(xml))}
    if "audio_analysis" in projects.columns:
        cols["audio_analysis"] = F.when(on, None).otherwise(F.col("audio_analysis"))
    return j.withColumns(cols).drop("_t")


def next_status(status: Column, event: Column) -> Column:
    """Status after an event; an event that does not fit leaves it."""
    return (
        F.when((event == "start") & ~status.isin("processing"), "processing").when((event == "finish") & (status == "processing"), "ready")
        .when((event == "fail") & (status == "processing"), "failed").when((event == "cancel") & (status == "processing"), "draft").otherwise(status)
    )


def accept_results(results: DataFrame, projects: DataFrame) -> DataFrame:
    """Results of the run that a project waits for; late ones of older runs go."""
    return results.join(projects.select("score_id", "analysis_id"), ["score_id", "analysis_id"])


def update_when(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """U8: set columns where a condition holds (null counts as not)."""
    ok = F.coalesce(when, F.lit(False))
    return df.withColumns({k: F.when(ok, v).otherwise(F.col(k)) for k, v in values.items()})


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def subtract_interval(rests: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rests (start, end) without the interval [cut_start, cut_end) of their group; what is left on either side."""
    j = rests.join(cuts, list(keys), "left")
    whole = F.col("cut_start").isNull() | (F.col("cut_end") <= F.col("start")) | (F.col("cut_start") >= F.col("end"))
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    left, right = part(F.col("start"), F.least("cut_start", "end")), part(F.greatest("cut_end", "start"), F.col("end"))
    pieces = F.when(whole, F.array(part(F.col("start"), F.col("end")))).otherwise(F.filter(F.array(left, right), lambda p: p["start"] < p["end"]))
    return j.withColumn("_p", F.explode(pieces)).drop("start", "end", "cut_start", "cut_end").select("*", "_p.start", "_p.end").drop("_p")


def insert_notes(events: DataFrame, inserts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes (at64, string, fret, length64) put into measures one after the other, by place and string: into the
    chord at that place; else the event that covers the place is cut there, and the new event ends at the next onset
    at the latest. A measure has at most some dozen events and inserts, which are folded as arrays."""
    made = "array<struct<onset64:int,duration64:int,rest:boolean,notes:array<struct<string:int,fret:int,technique:string>>>>"
    own = events.groupBy(*keys).agg(F.collect_list(F.struct("onset64", "duration64", "rest", "notes")).cast(made).alias("_e"))
    new = inserts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(x).cast("int").alias(x) for x in ("at64", "string", "fret", "length64")]))).alias("_i"))

    def event(onset: Column, duration: Column, rest: Column, notes: Column) -> Column:
        return F.struct(onset.alias("onset64"), duration.alias("duration64"), rest.alias("rest"), notes.alias("notes"))

    def step(es: Column, i: Column) -> Column:
        at = i["at64"]
        note = F.array(F.struct(i["string"].alias("string"), i["fret"].alias("fret"), F.lit(None).cast("string").alias("technique")))
        chord = F.transform(es, lambda e: F.when(e["onset64"] == at, event(at, e["duration64"], F.lit(False), F.concat(F.filter(e["notes"], lambda n: n["string"] != i["string"]), note))).otherwise(e))
        cut = F.transform(es, lambda e: F.when((e["onset64"] < at) & (e["onset64"] + e["duration64"] > at), event(e["onset64"], at - e["onset64"], e["rest"], e["notes"])).otherwise(e))
        following = F.array_min(F.filter(F.transform(es, lambda e: e["onset64"]), lambda o: o > at))
        alone = event(at, F.least(i["length64"], F.coalesce(following - at, i["length64"])), F.lit(False), note)
        return F.when(F.exists(es, lambda e: e["onset64"] == at), chord).otherwise(F.concat(cut, F.array(alone))).cast(made)

    both = own.join(new, list(keys), "full_outer")
    empty = F.array().cast(made)
    folded = F.aggregate(F.coalesce("_i", F.array().cast("array<struct<at64:int,string:int,fret:int,length64:int>>")), F.coalesce("_e", empty), step)
    return both.select(*keys, F.inline(folded))


def delete_notes(events: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events without the deleted strings (``strings`` of keys and onset64); an event without notes is a rest."""
    j = events.join(deletes, [*keys, "onset64"], "left").withColumn("notes", F.when(F.col("strings").isNotNull(), F.filter("notes", lambda n: ~F.array_contains("strings", n["string"]))).otherwise(F.col("notes")))
    return j.withColumn("rest", F.col("rest") | (F.size("notes") == 0)).drop("strings")


def toggle_technique(notes: DataFrame, keys: Sequence[str], selected: Column, technique: str) -> DataFrame:
    """Take the technique off the selection if all of it has it, else put it on all."""
    has = F.coalesce(F.col("technique") == technique, F.lit(False))
    everyone = F.min(F.when(selected, has.cast("int"))).over(Window.partitionBy(*keys))
    return notes.withColumn("_a", everyone).withColumn("technique", F.when(selected & (F.col("_a") == 1), None).when(selected, technique).otherwise(F.col("technique"))).drop("_a")


def set_duration(events: DataFrame, keys: Sequence[str], selected: Column, duration: Column) -> DataFrame:
    """New lengths of the selection where they end before the next onset; others stay, with ``rejected`` true."""
    w = Window.partitionBy(*keys).orderBy("onset64")
    fits = F.coalesce(F.col("onset64") + duration <= F.lead("onset64").over(w), F.lit(True))
    e = events.withColumn("_f", fits).withColumn("_d", duration)
    return e.withColumn("rejected", selected & ~F.col("_f")).withColumn("duration64", F.when(selected & F.col("_f"), F.col("_d")).otherwise(F.col("duration64"))).drop("_f", "_d")


def refinger(notes: DataFrame, keys: Sequence[str], step: int, tuning: Sequence[int] = TUNING) -> DataFrame:
    """Selected notes (``selected``) moved by ``step`` strings at the same pitch, where the fret is 0 to 36 and the
    string free. A string counts as free if no note that stays is on it; what stays is found in at most as many rounds
    as there are strings, since each round can only hold back notes whose target one more note keeps."""
    target = F.col("string") + step
    fret = midi_of(F.col("string"), F.col("fret"), tuning) - F.get(F.array(*map(F.lit, tuning)), target.cast("int") - 1)
    n = notes.withColumn("_s", target).withColumn("_f", fret).withColumn("_go", F.col("selected") & F.col("_s").between(1, len(tuning)) & F.coalesce(F.col("_f").between(0, 36), F.lit(False)))
    beat = Window.partitionBy(*keys)
    for _ in tuning:
        taken = F.collect_set(F.when(~F.col("_go"), F.col("string"))).over(beat)
        n = n.withColumn("_t", taken).withColumn("_go", F.col("_go") & ~F.array_contains("_t", F.col("_s"))).drop("_t")
    return n.withColumn("string", F.when(F.col("_go"), F.col("_s")).otherwise(F.col("string"))).withColumn("fret", F.when(F.col("_go"), F.col("_f")).otherwise(F.col("fret"))).withColumn("moved", F.col("_go")).drop("_s", "_f", "_go")


def move_notes(notes: DataFrame, keys: Sequence[str], selected: Column, strings: int = 0, slots64: int = 0) -> DataFrame:
    """U16: selected notes moved by strings (fret kept) and time; a measure in which one leaves its range or meets
    another note at its place is left as it was."""
    n = notes.withColumn("_sel", selected)
    s, o = F.col("string") + F.when(F.col("_sel"), strings).otherwise(0), F.col("onset64") + F.when(F.col("_sel"), slots64).otherwise(0)
    n = n.withColumn("_s", s).withColumn("_o", o)
    same = F.count("*").over(Window.partitionBy(*keys, "_o", "_s"))
    n = n.withColumn("_bad", ((same > 1) | ~F.col("_s").between(1, 6) | (F.col("_o") < 0)).cast("int"))
    n = n.withColumn("_any", F.max("_bad").over(Window.partitionBy(*keys)))
    return n.withColumn("string", F.when(F.col("_any") == 0, F.col("_s")).otherwise(F.col("string"))).withColumn("onset64", F.when(F.col("_any") == 0, F.col("_o")).otherwise(F.col("onset64"))).drop("_sel", "_s", "_o", "_bad", "_any")


def prune_links(notes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A link (technique, link_to = id of its target) stays only if the target is still the next on the string."""
    w = Window.partitionBy(*keys, "string").orderBy(*order)
    ok = F.coalesce(F.lead("note_id").over(w) == F.col("link_to"), F.lit(False))
    return notes.withColumn("_ok", ok).withColumn("technique", F.when(F.col("link_to").isNull() | F.col("_ok"), F.col("technique"))).withColumn("link_to", F.when(F.col("_ok"), F.col("link_to"))).drop("_ok")


def fill_missing(measures: DataFrame) -> DataFrame:
    """Empty measures for the numbers that a score lacks."""
    return measures.unionByName(missing_measures(measures, ["score_id"]), allowMissingColumns=True)


def propose_measure(frames: DataFrame, candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted (score_id, number) the best candidate of the frames that cover the number, with a reason where
    there is none; nothing is written."""
    c = F.col
    cover = wanted.join(frames, "score_id").filter((c("number") >= c("start_measure")) & (c("number") < c("start_measure") + c("measures"))).select("score_id", "number", "frame_id")
    best = cover.join(candidates, ["score_id", "number", "frame_id"]).groupBy("score_id", "number").agg(F.max(F.struct("quality", "signature", "frame_id")).alias("b"))
    has = cover.select("score_id", "number").distinct().withColumn("_c", F.lit(True))
    j = wanted.join(best, ["score_id", "number"], "left").join(has, ["score_id", "number"], "left")
    return j.select("score_id", "number", c("b.frame_id").alias("frame_id"), c("b.signature").alias("signature"), F.when(c("_c").isNull(), "not_covered").when(c("b").isNull(), "no_candidate").alias("reason"))


def new_projects(requests: DataFrame, now: Column) -> DataFrame:
    """Project rows with defaults; a blank title is derived from the source id."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Score "), F.col("source_id")))
    return requests.withColumns({"title": title, "status": F.lit("draft"), "tempo_bpm": F.lit(120.0), "tempo_source": F.lit("default"), "tempo_locked": F.lit(False), "created_at": now, "updated_at": now})


def replace_audio(projects: DataFrame, uploads: DataFrame, allowed: Sequence[str] = ("mp3", "wav", "m4a", "ogg", "flac")) -> DataFrame:
    """A new audio path clears what was found in the old one; sync points are another table and stay."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ok = uploads.filter(ext.isin(*allowed)).select("score_id", F.col("path").alias("_p"))
    j = projects.join(ok, "score_id", "left")
    return j.withColumns({"audio_path": F.coalesce("_p", "audio_path"), "audio_analysis": F.when(F.col("_p").isNull(), F.col("audio_analysis"))}).drop("_p")


def add_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Sync points with rounded times (3 places) and positions (5)."""
    r = new.withColumn("time_seconds", F.round("time_seconds", 3)).withColumn("score_position", F.round("score_position", 5))
    return points.unionByName(r, allowMissingColumns=True)


def delete_points(points: DataFrame, deletes: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points without those that their owner deletes, and the deletes that meet none."""
    mine = deletes.join(owners, ["score_id", "user_id"], "left_semi")
    keys = ["score_id", "point_id"]
    return points.join(mine, keys, "left_anti"), deletes.join(points.join(mine, keys, "left_semi"), keys, "left_anti")


def commit_summary(projects: DataFrame, summaries: DataFrame) -> DataFrame:
    """New summary and message on the rows that have one."""
    j = projects.join(summaries.select("score_id", F.col("recognition_summary").alias("_s"), F.col("status_message").alias("_m")), "score_id", "left")
    return j.withColumns({"recognition_summary": F.coalesce("_s", "recognition_summary"), "status_message": F.coalesce("_m", "status_message")}).drop("_s", "_m")

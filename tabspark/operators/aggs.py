"""Aggregations and votes (A), set operations (X), orderings (K). Argmax is ``max(struct)``: the first of equals in the
order that the struct says, never an arbitrary row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tempo_from_text


def words_to_rows(words: DataFrame, keys: Sequence[str], height: Column) -> DataFrame:
    """A1: words (left, top, text, conf) binned by row; texts joined from left to right, least confidence."""
    b = words.withColumn("row", F.floor(F.col("top") / height).cast("int"))
    return b.groupBy(*keys, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), "").alias("text"), F.min("conf").alias("conf"))


def line_tempos(words: DataFrame, keys: Sequence[str], order: str = "left") -> DataFrame:
    """A2: lines of words with joined text, mean confidence and the tempo that they state."""
    g = words.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("conf"))
    return g.withColumn("tempo", tempo_from_text(F.col("text")))


def best_readings(readings: DataFrame, keys: Sequence[str], conf: str = "conf") -> DataFrame:
    """A3: greatest confidence of each reading."""
    return readings.groupBy(*keys).agg(F.max(conf).alias(conf))


def start_votes(labels: DataFrame, keys: Sequence[str], most: int = 100_000) -> DataFrame:
    """A5: labels (index, value, conf) of a frame vote for start = value - index with weight max(10, conf); the start
    with most votes, then most weight, wins if it has two; its confidence is the mean weight, 100 at most."""
    v = labels.withColumn("start", F.col("value") - F.col("index")).filter(F.col("start").between(0, most))
    g = v.groupBy(*keys, "start").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(10.0), F.col("conf"))).alias("w"))
    best = g.groupBy(*keys).agg(F.max(F.struct("n", "w", (-F.col("start")).alias("s"))).alias("b")).filter("b.n >= 2")
    return best.select(*keys, (-F.col("b.s")).alias("start_measure"), F.least(F.lit(100.0), F.col("b.w") / F.col("b.n")).alias("confidence"))


def repair_labels(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A4: where a frame's labels agree on a start (two different indices at least), only those that fit it stay; in
    other frames each index keeps its best reading."""
    v = labels.withColumn("start", F.col("value") - F.col("index"))
    g = v.groupBy(*keys, "start").agg(F.countDistinct("index").alias("n"), F.sum(F.greatest(F.lit(10.0), F.col("conf"))).alias("w"))
    best = g.groupBy(*keys).agg(F.max(F.struct("n", "w", (-F.col("start")).alias("s"))).alias("b"))
    j = v.join(best, list(keys)).filter((F.col("b.n") < 2) | (F.col("start") == -F.col("b.s")))
    one = j.groupBy(*keys, "index").agg(F.max(F.struct("conf", (-F.col("value")).alias("v"))).alias("r"))
    return one.select(*keys, "index", (-F.col("r.v")).alias("value"), F.col("r.conf").alias("conf"))


def vote_labels(glyphs: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """Members (raw_label, raw_confidence, ord) get their cluster's label: winner by the sum of max(10, conf) (the
    first of equals), its share as confidence; a member's own different label yields to 65 per cent of 3 members."""
    c = F.col
    voted = glyphs.filter(c("raw_label").rlike(r"^\d+$")).groupBy(*cluster, "raw_label").agg(F.sum(F.greatest(F.lit(10.0), c("raw_confidence"))).alias("w"), F.min("ord").alias("o"))
    best = voted.groupBy(*cluster).agg(F.max(F.struct("w", (-c("o")).alias("o"), "raw_label")).alias("b"), F.sum("w").alias("total"))
    sizes = glyphs.groupBy(*cluster).agg(F.count("*").alias("members"))
    j = glyphs.join(best, list(cluster), "left").join(sizes, list(cluster))
    conf = 100 * c("b.w") / c("total")
    own = F.coalesce(c("raw_label"), F.lit("")) != ""
    label = F.when(c("b").isNull(), None).when(~own | (c("raw_label") == c("b.raw_label")) | ((conf >= 65) & (c("members") >= 3)), c("b.raw_label")).otherwise(c("raw_label"))
    score = F.when(c("b").isNull(), None).when(own & (c("raw_label") == c("b.raw_label")), F.greatest(c("raw_confidence"), conf)).when(~own | ((conf >= 65) & (c("members") >= 3)), conf).otherwise(F.greatest(F.lit(10.0), c("raw_confidence")))
    return j.select(*glyphs.columns, label.alias("label"), score.alias("confidence"))


def propagate_labels(unlabelled: DataFrame, labelled: DataFrame, keys: Sequence[str], distance: Column, most: float = 0.15) -> DataFrame:
    """Clusters without a label (cluster_id) take that of the nearest labelled one of their run (other_id, label,
    confidence) within ``most``; the confidence falls with the distance. A run has a few clusters."""
    j = unlabelled.join(labelled, list(keys)).withColumn("_d", distance)
    best = j.groupBy(*keys, "cluster_id").agg(F.min(F.struct("_d", "other_id", "label", "confidence")).alias("b")).filter(F.col("b._d") <= most)
    return best.select(*keys, "cluster_id", F.col("b.label").alias("label"), F.greatest(F.lit(0.0), F.col("b.confidence") * (1 - F.col("b._d") / most)).alias("confidence"))


def vote_measures(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates (signature, quality, ord): the signature with most of them, then the best mean quality, then the
    first; of its candidates the best one, the first of equals."""
    g = candidates.groupBy(*keys, "signature").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.min("ord").alias("o"), F.max(F.struct("quality", (-F.col("ord")).alias("o"))).alias("top"))
    b = g.groupBy(*keys).agg(F.max(F.struct("n", "q", (-F.col("o")).alias("o"), "signature", "top")).alias("b"))
    return b.select(*keys, F.col("b.signature").alias("signature"), F.col("b.n").alias("votes"), (-F.col("b.top.o")).alias("ord"), F.col("b.top.quality").alias("quality"))


def validate_measures(events: DataFrame, keys: Sequence[str], capacity: Column) -> DataFrame:
    """One row for each measure of events (onset64, duration64, ord), all lengths in 64ths: capacity, committed,
    missing, overflow, has_gaps, complete. One window (running end) and one aggregation on the same keys."""
    w = Window.partitionBy(*keys).orderBy("onset64", "ord").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_end", F.col("onset64") + F.col("duration64")).withColumn("_before", F.coalesce(F.max("_end").over(w), F.lit(0)))
    g = e.groupBy(*keys).agg(F.sum("duration64").alias("committed"), F.max("_end").alias("_last"), F.max(F.col("_before") - F.col("onset64")).alias("_over"), F.bool_or(F.col("onset64") > F.col("_before")).alias("_gap"), F.max(capacity).alias("capacity"))
    g = g.withColumn("missing", F.greatest(F.lit(0), F.col("capacity") - F.col("committed"))).withColumn("overflow", F.greatest(F.lit(0), F.col("_over"), F.col("_last") - F.col("capacity"), F.col("committed") - F.col("capacity")))
    g = g.withColumn("has_gaps", F.col("_gap") | (F.col("_last") < F.col("capacity")))
    g = g.withColumn("complete", ~F.col("has_gaps") & (F.col("overflow") == 0) & (F.col("committed") == F.col("capacity")))
    return g.select(*keys, "capacity", "committed", "missing", "overflow", "has_gaps", "complete")


def sync_suggestions(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: earliest time at which a measure is highlighted, to a thousandth."""
    known = frames.filter("start_measure is not null and highlighted_index is not null")
    return known.groupBy(*keys, (F.col("start_measure") + F.col("highlighted_index")).alias("measure_number")).agg(F.round(F.min("time_seconds"), 3).alias("time_seconds"))


def tempo_from_sync(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """240 / median seconds a measure, of gaps of 1 to 8 measures with 0.3 to 8 seconds each; 30 to 300."""
    w = Window.partitionBy(*keys).orderBy("measure_number")
    d = points.select(*keys, (F.lead("measure_number").over(w) - F.col("measure_number")).alias("dm"), (F.lead("time_seconds").over(w) - F.col("time_seconds")).alias("dt"))
    per = d.filter("dm between 1 and 8 and dt > 0").withColumn("s", F.col("dt") / F.col("dm")).filter("s between 0.3 and 8")
    return per.groupBy(*keys).agg(F.least(F.lit(300.0), F.greatest(F.lit(30.0), 240 / F.median("s"))).alias("tempo"))


def median_of_first(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], n: int = 8) -> DataFrame:
    """Median, to a tenth (that is, ten times it to a whole number), of the values that the first ``n`` rows have;
    keys whose first rows have none are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).filter(F.col(value).isNotNull()).groupBy(*keys).agg((F.round(F.median(value) * 10) / 10).alias(value))


def recognition_summary(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of all glyphs (label, confidence) how many have a label, their share, the mean confidence of those over 100
    times that share (both to a thousandth), and how many of them are under 60."""
    known = F.col("label").isNotNull() & (F.col("label") != "")
    g = glyphs.groupBy(*keys).agg(F.count("*").alias("total_glyphs"), F.count(F.when(known, 1)).alias("recognized_glyphs"), F.avg(F.when(known, F.col("confidence"))).alias("_m"), F.count(F.when(known & (F.col("confidence") < 60), 1)).alias("low_confidence_glyphs"))
    share = F.col("recognized_glyphs") / F.col("total_glyphs")
    return g.select(*keys, "total_glyphs", "recognized_glyphs", "low_confidence_glyphs", F.bround(share, 3).alias("glyph_coverage"), F.bround(F.coalesce("_m", F.lit(0.0)) / 100 * share, 3).alias("confidence"))


def summary_counts(marks: DataFrame, frames: DataFrame, measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, name, n): marks by technique, parsed frames by layout and polarity, frames that failed
    (``status`` error) or have no start measure, and measures with the first, the last and how many are missing."""
    tall = lambda df, kind, name: df.groupBy(*keys, F.lit(kind).alias("kind"), name.cast("string").alias("name")).agg(F.count("*").alias("n"))
    parsed = frames.filter("status <> 'error'")
    span = measures.groupBy(*keys).agg(F.countDistinct("number").alias("count"), F.min("number").cast("long").alias("start"), F.max("number").cast("long").alias("end"))
    span = span.select(*keys, F.lit("measures").alias("kind"), F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("n")) for k, v in (("count", F.col("count")), ("start", F.col("start")), ("end", F.col("end")), ("missing", F.col("end") - F.col("start") + 1 - F.col("count")))))))
    parts = [tall(marks, "technique", F.col("technique")), tall(parsed, "layout", F.col("layout")), tall(parsed, "polarity", F.col("polarity")), tall(frames.filter("status = 'error'"), "frames", F.lit("failed")), tall(parsed, "frames", F.lit("parsed")), tall(parsed.filter("start_measure is null"), "frames", F.lit("unresolved")), span]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows for each value."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def missing_measures(measures: DataFrame, keys: Sequence[str], number: str = "number") -> DataFrame:
    """Numbers between the least and the greatest that are not there."""
    span = measures.groupBy(*keys).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(number))
    return every.join(measures.select(*keys, number), [*keys, number], "left_anti")


def truth_events(notes: DataFrame, keys: Sequence[str], ticks: str = "ticks") -> DataFrame:
    """Chords at one tick: greatest duration, sorted set of notes ``string:fret`` with strings counted from the top."""
    real = notes.filter("fret is not null and string is not null")
    note = F.concat_ws(":", (7 - F.col("string")).cast("int").cast("string"), F.col("fret").cast("int").cast("string"))
    return real.groupBy(*keys, ticks).agg(F.max("duration").alias("duration"), F.array_join(F.array_sort(F.collect_set(note)), ",").alias("notes"))


def predicted_events(measures: DataFrame) -> DataFrame:
    """One row for each event with notes, from ``ocr_events`` or, if there are none, ``events``."""
    chosen = F.when(F.coalesce(F.size("ocr_events"), F.lit(0)) > 0, F.col("ocr_events")).otherwise(F.col("events"))
    return measures.select("score_id", "number", F.posexplode(chosen).alias("ord", "event")).filter("size(event.notes) > 0").select("score_id", "number", "ord", "event.*")


def prf(tp: Column, pred: Column, truth: Column) -> list[Column]:
    """Precision, recall, f1 with the usual guards."""
    p, r = tp / F.greatest(F.lit(1), pred), tp / F.greatest(F.lit(1), truth)
    return [p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("f1")]


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and the mean F1 of the classes that occur in the truth; one pass to a confusion table."""
    m = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    t = m.groupBy("t").agg(F.sum(hit).alias("tp"), F.sum("n").alias("nt"))
    p = m.groupBy(F.col("p").alias("t")).agg(F.sum("n").alias("np"))
    f1 = 2 * F.col("tp") / (F.col("nt") + F.coalesce("np", F.lit(0)))
    return t.join(p, "t", "left").agg((F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.count("*").alias("classes"))


def class_weights(df: DataFrame, label: str, classes: Sequence, low: float = 1.0, high: float = 12.0) -> DataFrame:
    """sqrt(max / count) of each class (a missing one counts 1), clipped, over the mean."""
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], [label])
    n = dim.join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    top = n.agg(F.max("n").alias("top"))
    w = n.crossJoin(F.broadcast(top)).withColumn("w", F.least(F.lit(high), F.greatest(F.lit(low), F.sqrt(F.col("top") / F.col("n")))))
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("m")))).select(label, (F.col("w") / F.col("m")).alias("weight"))


def covered_length(segments: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", join: float = 1.0) -> DataFrame:
    """Length of the union of segments; those that are at most ``join`` apart count as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    s = segments.withColumn("_m", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_i", F.sum(F.when(F.col("_m").isNull() | (F.col(start) > F.col("_m") + join), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_i").agg((F.max(end) - F.min(start)).alias("l")).groupBy(*keys).agg(F.sum("l").alias("covered"))


def staff_rows(lines: DataFrame, keys: Sequence[str], least: float = 70.0) -> DataFrame:
    """Rows of lines (x1, y1, x2, y2) that are level within 0.3 and 2 long or more, by quarter points of their height,
    that cover enough."""
    flat = lines.filter((F.abs(F.col("y1") - F.col("y2")) <= 0.3) & (F.abs(F.col("x1") - F.col("x2")) >= 2)).withColumn("y", F.bround((F.col("y1") + F.col("y2")) * 2) / 4).withColumn("start", F.least("x1", "x2")).withColumn("end", F.greatest("x1", "x2"))
    cov = covered_length(flat, [*keys, "y"])
    ext = flat.groupBy(*keys, "y").agg(F.min("start").alias("left"), F.max("end").alias("right"))
    return cov.join(ext, [*keys, "y"]).filter(F.col("covered") >= least)


def cluster_rollup(members: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """Members (member_id, prediction, confidence, area): winner by summed confidence, share of members that
    agree, representative by (confidence, area), mean confidence of the winners, members in order."""
    v = members.groupBy(*cluster, "prediction").agg(F.sum("confidence").alias("w"), F.count("*").alias("n"), F.avg("confidence").alias("m"))
    best = v.groupBy(*cluster).agg(F.max(F.struct("w", "n", "m", "prediction")).alias("b"))
    rest = members.groupBy(*cluster).agg(F.count("*").alias("member_count"), F.max(F.struct("confidence", "area", "member_id")).alias("r"), F.sort_array(F.collect_list("member_id")).alias("member_ids"))
    return best.join(rest, list(cluster)).select(*cluster, F.col("b.prediction").alias("prediction"), F.col("b.m").alias("confidence"), (F.col("b.n") / F.col("member_count")).alias("agreement"), "member_count", F.col("r.member_id").alias("representative"), "member_ids")


def corpus_summary(clusters: DataFrame, top: int = 100, sure: float = 0.985) -> DataFrame:
    """Clusters, members, reduction, share of the largest ``top`` clusters and of sure ones, mean confidence."""
    c = F.col
    largest = clusters.orderBy(F.desc("member_count")).limit(top).agg(F.sum("member_count").alias("in_top"))
    g = clusters.agg(F.count("*").alias("clusters"), F.sum("member_count").alias("members"), F.avg(F.when(c("confidence") >= sure, 1.0).otherwise(0.0)).alias("sure"), F.avg("confidence").alias("mean_confidence"))
    return g.crossJoin(F.broadcast(largest)).select("clusters", "members", (c("members") / c("clusters")).alias("reduction"), (c("in_top") / c("members")).alias("top_share"), "sure", "mean_confidence")


def split_counts(df: DataFrame, split: str, label: str, source: str) -> DataFrame:
    """Rows and distinct sources by split and label, with totals (rollup)."""
    return df.rollup(split, label).agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"))


def event_conflicts(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events in which a string is played twice, or that are rests with notes."""
    g = notes.groupBy(*keys).agg(F.count("string").alias("n"), F.countDistinct("string").alias("d"), F.bool_or("rest").alias("rest"))
    return g.filter((F.col("d") < F.col("n")) | (F.col("rest") & (F.col("n") > 0))).select(*keys, (F.col("d") < F.col("n")).alias("duplicate_string"), (F.col("rest") & (F.col("n") > 0)).alias("rest_with_notes"))


def signatures(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted (onset, string, fret) of a measure as text."""
    note = F.concat_ws(":", F.lpad(F.col("onset64").cast("string"), 6, "0"), F.col("string").cast("string"), F.lpad(F.col("fret").cast("string"), 2, "0"))
    return notes.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(note)), ",").alias("signature"))


def outcome_counts(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Successes and failures."""
    return df.groupBy(*keys).agg(F.sum(F.when(ok, 1).otherwise(0)).alias("succeeded"), F.sum(F.when(ok, 0).otherwise(1)).alias("failed"))


# -- K: orderings ----------------------------------------------------------------------------------------------

def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """K1, K5, K6: the first ``n`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def _placed(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordered_assets(assets: DataFrame) -> DataFrame:
    """K2: assets (score_id, asset_id, sort_order, created_at) with their position in the score: by sort order, then
    age, then id, so that equal ones have one order."""
    return _placed(assets, ["score_id"], F.col("sort_order"), F.col("created_at"), F.col("asset_id"))


def rank_clusters(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K3: clusters (member_count, source_id, project_id, analysis_id, cluster_id) with their position in a group: most
    members first, equal ones by the four ids."""
    return _placed(clusters, keys, F.desc("member_count"), *[F.col(k) for k in ("source_id", "project_id", "analysis_id", "cluster_id")])


def order_notes(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K8: notes (measure, start, string) with their position in a score, as they are read."""
    return _placed(notes, keys, F.col("measure"), F.col("start"), F.col("string"))


def rank_tracks(tracks: DataFrame, pattern: str) -> DataFrame:
    """K4: tracks by name pattern (100000), tablature flag (10000) and note count; those over 0, best first."""
    score = F.when(F.col("name").rlike(pattern), 100_000).otherwise(0) + F.when(F.col("has_tab"), 10_000).otherwise(0) + F.col("note_count")
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "track_index")
    return tracks.withColumn("score", score).filter("score > 0").withColumn("rank", F.row_number().over(w))


def balanced_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """K7: n rows of each class in the order of a hash with a seed; the same rows at every run."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return head_per_group(df, [label], [h, *map(F.col, key)], n).drop("rank")


# -- X: sets ---------------------------------------------------------------------------------------------------

def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def all_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either table."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def distinct_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The last row of each key."""
    return head_per_group(df, keys, [F.desc(ordinal)], 1).drop("rank")


def new_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose key b lacks."""
    return a.join(b, list(keys), "left_anti")


def replace_slice(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of all slices that ``new`` does not have, and the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def split_leaks(df: DataFrame, source: str, split: str) -> DataFrame:
    """Sources that are in more than one split."""
    return df.groupBy(source).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


# -- tempo by document order, and one small relabelling ----------------------------------------------------------

def tempo_from_pages(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first tempo mark (name or note = number) of a document's pages, in page order, that is 30 to 300."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)(?:[A-Za-z♩♪]+)\s*=\s*(\d{2,3}(?:\.\d+)?)"), F.lit(1))
    m = pages.select(*keys, "page", F.posexplode(found).alias("ix", "v")).withColumn("tempo", F.col("v").try_cast("double")).filter("tempo between 30 and 300")
    return m.groupBy(*keys).agg(F.min(F.struct("page", "ix", "tempo")).alias("f")).select(*keys, F.col("f.tempo").alias("tempo"))


def tempo_from_score(marks: DataFrame, keys: Sequence[str] = ("score_id",)) -> DataFrame:
    """The first tempo (text) of 30 to 300 in document order (ord), to a tenth."""
    m = marks.withColumn("_t", F.trim("tempo").try_cast("double")).filter("_t between 30 and 300")
    return m.groupBy(*keys).agg(F.min(F.struct("ord", "_t")).alias("f")).select(*keys, F.round("f._t", 1).alias("tempo"))


def collapse_categories(annotations: DataFrame, category: int = 1) -> DataFrame:
    """All boxes of one class."""
    return annotations.withColumn("category_id", F.lit(category))

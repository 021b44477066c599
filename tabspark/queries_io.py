"""Registered queries of sources and sinks (written to a shared folder and read again), streams and orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import models as M, scalars as S, tables as TF
from .operators import aggs as A, edits as U, joins as J, seq as W, signal
from .queries import NOTES, ORACLE_SQL, POINTS, c, notes, points, query, table
from .queries_more import ID, IDS, text
from .sources import io as IO
from .sources.scratch import put_files, scratch
from .streaming import forms as Z


# -- sources and sinks -----------------------------------------------------------------------------------------

@query("SELECT CAST(o_orderkey AS VARCHAR) AS score_id, o_custkey AS user_id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS tempo_bpm FROM orders")
def s1_load_store(spark, d):
    folder = scratch(spark)
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("score_id"), c("o_custkey").alias("user_id"), c("o_orderstatus").alias("status"), c("o_totalprice").cast("double").alias("tempo_bpm"), F.lit("not declared").alias("other"))
    o.write.parquet(f"{folder}/projects")
    for name in set(IO.STORE) - {"projects"}:
        spark.createDataFrame([], IO.STORE[name]).write.parquet(f"{folder}/{name}")
    return IO.load_store(spark, folder)["projects"].select("score_id", "user_id", "status", "tempo_bpm")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_id, o_clerk AS source_path FROM (SELECT o_orderkey, 'file-' || o_custkey AS o_clerk FROM orders WHERE o_orderkey % 3 <> 0)")
def s4_manifest(spark, d):
    folder = scratch(spark)
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("source_id"), text("file-", c("o_custkey")).alias("source_path"), F.when(c("o_orderkey") % 3 == 0, "error").otherwise("ok").alias("status"))
    o.write.json(folder)
    return IO.read_manifest(spark, folder).select("source_id", "source_path")


@query(f"WITH {NOTES} SELECT CAST(measure AS VARCHAR) AS source_id, CAST(ix AS INT) AS number, duration64 AS duration, fret, string FROM notes")
def s5_flatten_labels(spark, d):
    note = "struct<fret:int,string:int,is_stringed:boolean,is_dead:boolean,is_ghost:boolean,is_tie_destination:boolean,harmonic_type:int>"
    f, t = F.lit(False), F.lit(True)
    own = F.array(F.struct("fret", "string", t, f, f, f, F.lit(0)).cast(note))
    beat = F.struct(c("duration64").alias("duration"), F.lit(0).alias("dots"), f.alias("is_rest"), F.lit(0).cast("long").alias("display_start_ticks"), F.lit(0.0).alias("on_notes_x"), own.alias("notes"))
    bar = F.struct(c("ix").alias("number"), F.array(F.struct(F.array(beat).alias("beats"))).alias("bars"))
    tree = notes(spark, d).groupBy(c("measure").cast("string").alias("source_id")).agg(F.array(F.struct(F.collect_list(bar).alias("master_bars"))).alias("systems")).withColumn("track_index", F.lit(0))
    return IO.flatten_labels(tree).select("source_id", "number", "duration", "fret", "string")


@query(f"WITH {NOTES} SELECT q AS \"left\", string AS top, CAST(q - 5 AS DOUBLE) AS conf, 'w' || fret AS text FROM notes WHERE q % 9 <> 0 AND q >= 5 AND fret % 4 <> 0")
def s7_ocr_words(spark, d):
    folder = scratch(spark)
    n = notes(spark, d)
    one = [F.lit(1).alias(x) for x in ("page_num", "block_num", "par_num", "line_num")]
    words = n.select(*one, F.when(c("q") % 9 == 0, "x").otherwise(c("q").cast("string")).alias("left"), c("string").alias("top"), F.lit(9).alias("width"), F.lit(9).alias("height"), (c("q") - 5).alias("conf"), F.when(c("fret") % 4 == 0, " ").otherwise(text("w", c("fret"))).alias("text"))
    words.write.csv(folder, sep="\t", header=True, emptyValue="")
    return IO.read_ocr_words(spark, folder).select("left", "top", "conf", "text")


@query(f"WITH {NOTES} SELECT 'crop-' || measure || '-' || ix AS path, fret AS label FROM notes WHERE fret <= 22 AND q % 5 <> 0")
def s8_label_list(spark, d):
    folder = scratch(spark)
    n = notes(spark, d)
    n.select(text("crop-", c("measure"), "-", c("ix")).alias("path"), F.when(c("q") % 5 == 0, "x").otherwise(c("fret").cast("string")).alias("label")).write.csv(folder, sep="\t")
    return IO.read_label_list(spark, folder)


@query(f"WITH {NOTES} SELECT CAST(measure AS INT) AS number, CAST(row_number() OVER (PARTITION BY measure ORDER BY onset64) AS INT) AS place, string, fret FROM notes")
def s9_s14_score_xml(spark, d):
    folder = scratch(spark)
    one = F.array(F.struct("string", "fret", F.lit(None).cast("string").alias("technique")))
    n = notes(spark, d)
    events = n.select(c("measure").alias("score_id"), c("measure").alias("number"), ((c("ix") - 1) * 8).alias("onset64"), F.lit(8).alias("duration64"), one.alias("notes"), F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"), F.lit(True).alias("changed"))
    IO.render_score_xml(events).select(F.regexp_replace("xml", "</?part>", "")).write.text(folder)
    back = IO.read_score_xml(spark, folder, lines=True).filter("not rest")
    return back.select("number", F.expr("row_number() OVER (PARTITION BY number ORDER BY ix)").alias("place"), "string", "fret")


@query(f"WITH {NOTES} SELECT {IDS}, flag AS split FROM notes")
def s12_write_split(spark, d):
    folder = scratch(spark)
    IO.write_split(notes(spark, d).select(*ID, c("flag").alias("split")), folder)
    return spark.read.schema("score_id long, measure long, ix int, split string").json(folder)


@query(f"WITH {NOTES} SELECT CAST(measure AS VARCHAR) AS measure, CAST(ix AS VARCHAR) AS ix, printf('%.2f', discount + q) AS size FROM notes")
def s13_write_tsv(spark, d):
    folder = scratch(spark)
    IO.write_tsv(notes(spark, d).select("measure", "ix", (c("discount") + c("q")).cast("double").alias("size")), folder, 2, ["measure", "ix"])
    return spark.read.csv(folder, sep="\t", schema="measure string, ix string, size string")


@query("SELECT o_custkey AS score_id, o_orderkey, 2 AS version FROM orders")
def s15_publish(spark, d):
    folder = scratch(spark)
    o = table(spark, d, "orders").select(c("o_custkey").alias("score_id"), "o_orderkey")
    for version in (1, 2):
        IO.publish(o.withColumn("version", F.lit(version)), folder)
    return IO.read_published(spark, folder)


@query(f"WITH {NOTES} SELECT count(*) AS notes, count(DISTINCT measure) AS measures, max(fret) AS highest FROM notes")
def s16_write_summary(spark, d):
    folder = scratch(spark)
    IO.write_summary(notes(spark, d), folder, notes=F.count("*"), measures=F.countDistinct("measure"), highest=F.max("fret"))
    return spark.read.text(folder).select(F.from_json("value", "notes long, measures long, highest int").alias("s")).select("s.*")


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN q % 10 = 0 THEN 'cannot read ' || fret || 'x' END AS error FROM notes")
def s17_with_errors(spark, d):
    n = notes(spark, d).withColumn("raw", F.when(c("q") % 10 == 0, text(c("fret"), "x")).otherwise(c("fret").cast("string")))
    good, bad = IO.with_errors(n, c("raw").try_cast("int"), ID, F.concat(F.lit("cannot read "), "raw"), 20)
    return good.select(*ID, F.lit(None).cast("string").alias("error")).unionByName(bad)


# -- parsers, models, checks -----------------------------------------------------------------------------------

@query(f"""WITH {POINTS} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bv' WHEN 1 THEN 'av' WHEN 3 THEN 'bv' END AS kind, CASE event_id % 5 WHEN 0 THEN 'BV' || lpad(CAST(event_id AS VARCHAR), 10, 'x') WHEN 1 THEN 'av' || event_id WHEN 3 THEN 'BV' || lpad(CAST(event_id AS VARCHAR), 10, 'y') END AS source_id FROM points""")
def p1_source_ref(spark, d):
    i = c("event_id")
    pad = lambda fill: F.lpad(i.cast("string"), 10, fill)
    ref = F.when(i % 5 == 0, text(" BV", pad("x"), " ")).when(i % 5 == 1, text("https://video.example.org/v/av", i, "?p=2")).when(i % 5 == 2, text("https://evil.example.com/BV", pad("x"))).when(i % 5 == 3, text("see bv", pad("y"), "/")).otherwise("nothing")
    return points(spark, d).select("event_id", S.parse_source_ref(ref, ["video.example.org"]).alias("r")).select("event_id", "r.kind", "r.source_id")


@query(f"""WITH {NOTES}, k AS (SELECT *, count(*) OVER (PARTITION BY measure) AS n FROM notes) SELECT measure, CASE WHEN ix - 1 < (n + 1) // 2 THEN 0 ELSE 1 END AS image_ix, ix - 1 AS ix, ['fret', 'line', 'bar'][fret % 3 + 1] AS label, q * 1.0::DOUBLE AS x, duration64 * 1.0::DOUBLE AS w FROM k WHERE discount * 10 >= 0.35""")
def p26_decode_detections(spark, d):
    d_ = lambda x: x.cast("double")
    box = F.struct("ix", F.array(d_(c("fret") % 3), d_(c("discount") * 10), d_(c("q")), F.lit(0.0), d_(c("q") + c("duration64")), F.lit(4.0)).alias("b"))
    g = notes(spark, d).groupBy(c("measure").alias("batch_id")).agg(F.transform(F.sort_array(F.collect_list(box)), lambda x: x["b"]).alias("boxes"), F.count("*").cast("int").alias("n"))
    half = F.floor((c("n") + 1) / 2).cast("int")
    found = M.decode_detections(g.select("batch_id", "boxes", F.array(half, c("n") - half).alias("counts")), ["fret", "line", "bar"])
    return found.select(c("batch_id").alias("measure"), "image_ix", "ix", "label", "x", "w")


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings WHERE embedding[1] > 0")
def f2_predict_rows(spark, d):
    def make():
        def model(f: pd.DataFrame) -> pd.DataFrame:
            f = f[[v[0] > 0 for v in f["embedding"]]]  # a variable number of rows
            return pd.DataFrame({"vec_id": f["vec_id"], "positive": [int((v > 0).sum()) for v in f["embedding"]]})

        return model

    return M.predict(table(spark, d, "embeddings").select("vec_id", "embedding"), make, "vec_id long, positive int")


@query(f"""WITH {NOTES}, a AS (SELECT CAST(measure * 10 + ix AS VARCHAR) AS ref, CASE WHEN q % 13 = 0 THEN -measure ELSE measure END AS image_id, 1 + string % 4 AS category_id, q - 1 AS w, fret AS h FROM notes)
SELECT 'missing_category' AS "check", 'bar' AS ref UNION ALL SELECT 'extra_category', 'other' UNION ALL SELECT 'unknown_image', ref FROM a WHERE image_id < 0 UNION ALL SELECT 'unknown_category', ref FROM a WHERE category_id NOT IN (1, 2, 4) UNION ALL SELECT 'empty_box', ref FROM a WHERE w <= 0 OR h <= 0
UNION ALL SELECT 'small_image', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 20 < 8""")
def c4_validate_coco(spark, d):
    n = notes(spark, d)
    images = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 20).alias("width"), F.lit(10).alias("height"))
    boxes = n.select((c("measure") * 10 + c("ix")).alias("id"), F.when(c("q") % 13 == 0, -c("measure")).otherwise(c("measure")).alias("image_id"), (1 + c("string") % 4).alias("category_id"), F.array(F.lit(0.0), F.lit(0.0), (c("q") - 1).cast("double"), c("fret").cast("double")).alias("bbox"))
    kinds = spark.createDataFrame([(1, "fret"), (2, "string"), (4, "other")], "id int, name string")
    return U.validate_coco(images, boxes, kinds, ["fret", "string", "bar"])


@query(f"""WITH {NOTES}, e AS (SELECT measure AS m, CASE WHEN q % 7 = 0 THEN -measure ELSE measure END AS number, q, string, duration64 FROM notes WHERE ix = 1 AND flag = 'R')
SELECT number, CASE WHEN q % 11 = 0 THEN 'signature' WHEN duration64 * 3 > 64 THEN 'range' WHEN q % 5 = 0 THEN 'rest_with_notes' WHEN q % 3 = 0 THEN 'duplicate_string' WHEN q % 7 = 0 THEN 'unknown_measure' END AS error FROM e""")
def u1_measure_edits(spark, d):
    n = notes(spark, d)
    event = "array<struct<onset64:int,duration64:int,rest:boolean,notes:array<struct<string:int,fret:int,technique:string>>>>"
    none = F.lit(None).cast("string")
    note = lambda string: F.struct(string.cast("int").alias("string"), c("fret").alias("fret"), none.alias("technique"))
    pair = F.array(note(c("string")), note(F.when(c("q") % 3 == 0, c("string")).otherwise(7 - c("string"))))
    made = F.array(F.struct(F.lit(0), c("duration64") * 3, c("q") % 5 == 0, pair)).cast(event)
    edits = n.filter("ix = 1 and flag = 'R'").select(F.lit("s").alias("score_id"), F.when(c("q") % 7 == 0, -c("measure")).otherwise(c("measure")).alias("number"), made.alias("events"), F.lit(4).alias("ts_num"), F.when(c("q") % 11 == 0, 3).otherwise(4).alias("ts_den"), F.lit(True).alias("human_verified"))
    measures = n.select("measure").distinct().select(F.lit("s").alias("score_id"), c("measure").alias("number"), F.array().cast(event).alias("events"), F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"), F.lit(False).alias("human_verified"))
    good, bad = U.apply_measure_edits(measures, edits)
    return good.filter("human_verified and size(events) = 1 and size(baseline) = 0").select("number", none.alias("error")).unionByName(bad.select("number", "error"))


# -- orderings -------------------------------------------------------------------------------------------------

@query("SELECT o_custkey AS score_id, o_orderkey AS asset_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderdate, o_orderkey) AS INT) AS position FROM orders")
def k2_ordered_assets(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("score_id"), c("o_orderkey").alias("asset_id"), (c("o_orderkey") % 3).alias("sort_order"), c("o_orderdate").alias("created_at"))
    return A.ordered_assets(o).select("score_id", "asset_id", "position")


@query(f"""WITH {NOTES}, g AS (SELECT score_id, measure, count(*) AS n, max(status) AS f, min(q) AS a, min(flag) AS l FROM notes GROUP BY ALL) SELECT score_id, measure, CAST(row_number() OVER (PARTITION BY score_id ORDER BY n DESC, f, a, l, measure) AS INT) AS position FROM g""")
def k3_rank_clusters(spark, d):
    g = notes(spark, d).groupBy("score_id", c("measure").alias("cluster_id")).agg(F.count("*").alias("member_count"), F.max("status").alias("source_id"), F.min("q").alias("project_id"), F.min("flag").alias("analysis_id"))
    return A.rank_clusters(g, ["score_id"]).select("score_id", c("cluster_id").alias("measure"), "position")


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CAST(row_number() OVER (PARTITION BY score_id ORDER BY measure, onset64, string) AS INT) AS position FROM notes")
def k8_order_notes(spark, d):
    return A.order_notes(notes(spark, d).withColumn("start", c("onset64")), ["score_id"]).select(*ID, "position")


# -- signal and sequences --------------------------------------------------------------------------------------

FRAMES = "f AS (SELECT vec_id AS score_id, CAST(i AS INT) AS frame_ix, CAST(embedding[i * 8 + 1 : i * 8 + 16] AS DOUBLE[]) AS x FROM embeddings, range(0, 7) t(i))"


def frames(spark, d) -> DataFrame:
    return signal.frame_signal(table(spark, d, "embeddings").select(c("vec_id").alias("score_id"), c("embedding").cast("array<double>").alias("samples")), 16, 8, 3)


@query(f"WITH {FRAMES} SELECT score_id, frame_ix, round((frame_ix * 8 + 8) / 11025.0::DOUBLE, 7) AS t, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 16 + 1e-12), 6) AS rms FROM f")
def t1_t2_frames(spark, d):
    return frames(spark, d).select("score_id", "frame_ix", F.round("t", 7).alias("t"), F.round(signal.rms(c("frame")), 6).alias("rms"))


@query(f"""WITH {FRAMES}, b AS (SELECT score_id, frame_ix, k, sqrt(pow(list_sum(list_transform(range(0, 16), lambda n: x[n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 15)) * cos(2 * pi() * k * n / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda n: x[n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 15)) * sin(2 * pi() * k * n / 16))), 2)) AS m FROM f, range(0, 9) t(k)),
p AS (SELECT *, lag(m) OVER (PARTITION BY score_id, k ORDER BY frame_ix) AS p FROM b) SELECT score_id, frame_ix, round(sum(greatest(0.0, m - coalesce(p, 0))) / (sum(m) + 1e-8), 5) AS flux FROM p GROUP BY ALL""")
def t3_t4_flux(spark, d):
    f = frames(spark, d).select("score_id", "frame_ix", signal.spectrum("frame").alias("spectrum"))
    return signal.flux(f).select("score_id", "frame_ix", F.round("flux", 5).alias("flux"))


@query(f"""WITH RECURSIVE {NOTES}, p AS (SELECT measure, CAST(q * 4 AS DOUBLE) AS x, row_number() OVER (PARTITION BY measure ORDER BY q, ix) AS k FROM notes), g AS (SELECT measure, x - lag(x) OVER (PARTITION BY measure ORDER BY k) AS g FROM p), m AS (SELECT measure, 0.3 * median(g) AS m FROM g WHERE g >= 20 GROUP BY measure),
r AS (SELECT measure, k, [x] AS s FROM p WHERE k = 1 UNION ALL SELECT p.measure, p.k, CASE WHEN p.x - s[-1] < m THEN list_append(s[:-2], (s[-1] + p.x) / 2) ELSE list_append(s, p.x) END FROM r JOIN p ON p.measure = r.measure AND p.k = r.k + 1 JOIN m ON m.measure = r.measure)
SELECT measure, unnest(s) AS x FROM (SELECT measure, arg_max(s, k) AS s FROM r JOIN m USING (measure) GROUP BY measure)""")
def w4_filter_boundaries(spark, d):
    return W.filter_boundaries(notes(spark, d).select("measure", (c("q") * 4).alias("x")), ["measure"], "x", 5.0)


# -- streams ---------------------------------------------------------------------------------------------------

def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now, through a file sink in the shared folder."""
    spark = stream.sparkSession
    folder = scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files; a table of one file is found by its name in the folder around it."""
    now = table(spark, d, name)
    alone = all(f.endswith(f"/{name}.parquet") for f in now.inputFiles())
    source = spark.readStream.schema(now.schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(d) if alone else source.parquet(f"{d}/{name}.parquet")


@query("SELECT DISTINCT user_id || event_type AS content FROM events")
def z1_stream_dedupe(spark, d):
    e = _stream(spark, d, "events").withColumn("content", F.concat(c("user_id").cast("string"), "event_type"))
    return _drained(Z.stream_dedupe(e.withColumn("sha256", F.sha2("content", 256)).withColumn("ts", c("ts").cast("timestamp")), late="100 days").select("content"), "append").distinct()


@query("SELECT user_id AS score_id, arg_max(event_type, ts) AS status, max(ts) AS ts FROM events WHERE event_id % 2 = user_id % 2 GROUP BY user_id")
def z3_stream_status(spark, d):
    e = _stream(spark, d, "events").select(c("user_id").alias("score_id"), (c("event_id") % 2).alias("analysis_id"), c("ts").cast("timestamp").alias("ts"), c("event_type").alias("status"), F.lit("").alias("message"))
    current = table(spark, d, "events").select(c("user_id").alias("score_id"), (c("user_id") % 2).alias("analysis_id")).distinct()
    return _drained(Z.stream_status(e, current), "complete").select("score_id", "status", c("ts").cast("timestamp_ntz").alias("ts"))


# -- more signal, sequences and matching -------------------------------------------------------------------------

@query("""WITH s AS (SELECT vec_id, i, sqrt(abs(CAST(embedding[i + 1] AS DOUBLE))) AS m, i * 5512.5 / 63 AS hz FROM embeddings, range(0, 64) t(i)), p AS (SELECT vec_id, CAST(((69 + CAST(round_even(12 * log2(greatest(hz, 1.0) / 440.0), 0) AS INT)) % 12 + 12) % 12 AS INT) AS pc, CASE WHEN hz BETWEEN 55 AND 5000 THEN m ELSE 0 END AS w FROM s),
b AS (SELECT e.vec_id, CAST(k AS INT) AS pitch_class, coalesce(sum(w), 0) AS v FROM embeddings e CROSS JOIN range(0, 12) t(k) LEFT JOIN p ON p.vec_id = e.vec_id AND p.pc = k GROUP BY ALL)
SELECT vec_id, pitch_class, round(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 0), 0), 6) AS share FROM b""")
def t5_chroma(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("spec"))
    return e.select("vec_id", F.posexplode(signal.chroma(c("spec"))).alias("pitch_class", "v")).select("vec_id", "pitch_class", F.round("v", 6).alias("share"))


@query(f"""WITH RECURSIVE {NOTES}, b AS (SELECT measure AS image_id, CAST(string % 2 AS VARCHAR) AS notes, ix, CAST(q AS DOUBLE) AS x, flag FROM notes), p AS (SELECT *, row_number() OVER (PARTITION BY image_id, notes ORDER BY ix) AS k FROM b WHERE flag <> 'R'),
t AS (SELECT image_id, notes, list({{'t': CAST(ix AS INT), 'x': x}}) AS ts FROM b WHERE flag <> 'A' GROUP BY ALL),
r AS (SELECT image_id, notes, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS p, CAST(NULL AS INT) AS t FROM t UNION ALL
 SELECT image_id, notes, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.t) END, p, best.t FROM (SELECT r.image_id, r.notes, p.k, r.used, CAST(p.ix AS INT) AS p,
  list_sort(list_transform(list_filter(ts, lambda c: abs(p.x - c.x) <= 6 AND NOT list_contains(r.used, c.t)), lambda c: {{'d': abs(p.x - c.x), 't': c.t}}))[1] AS best FROM r JOIN p ON p.image_id = r.image_id AND p.notes = r.notes AND p.k = r.k + 1 JOIN t ON t.image_id = r.image_id AND t.notes = r.notes))
SELECT image_id, notes, p AS pred_ord, t AS truth_ord FROM r WHERE t IS NOT NULL""")
def j18_match_chords(spark, d):
    n = notes(spark, d).select(c("measure").alias("image_id"), (c("string") % 2).cast("string").alias("notes"), c("ix").alias("ord"), c("q").cast("double").alias("x"), "flag")
    return J.match_chords(n.filter("flag <> 'R'"), n.filter("flag <> 'A'"), 6.0)


@query(f"""WITH RECURSIVE {NOTES}, w AS (SELECT measure, row_number() OVER o AS i, CAST(q AS DOUBLE) AS a, CAST(lead(q) OVER o AS DOUBLE) AS b, CAST(lead(q, 2) OVER o AS DOUBLE) AS e, CAST(lead(q, 3) OVER o AS DOUBLE) AS f, min(fret) OVER u AS "left", max(fret + 5 * string) OVER u AS "right" FROM notes WINDOW o AS (PARTITION BY measure ORDER BY q, ix), u AS (PARTITION BY measure ORDER BY q, ix ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
m AS (SELECT *, list_sort([b - a, e - b, f - e])[2] AS m FROM w WHERE f IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY i) AS k FROM m WHERE m BETWEEN 3 AND 14 AND abs(b - a - m) <= 4 AND abs(e - b - m) <= 4 AND abs(f - e - m) <= 4 AND "right" - "left" >= 20),
r AS (SELECT measure, k, i AS last, 0 AS system, true AS taken FROM k WHERE k = 1 UNION ALL SELECT k.measure, k.k, CASE WHEN k.i >= r.last + 4 THEN k.i ELSE r.last END, CASE WHEN k.i >= r.last + 4 THEN r.system + 1 ELSE r.system END, k.i >= r.last + 4 FROM r JOIN k ON k.measure = r.measure AND k.k = r.k + 1)
SELECT r.measure, r.system, k.m AS spacing, k.a AS first, k.f AS last, CAST("left" AS DOUBLE) AS "left", CAST("right" AS DOUBLE) AS "right" FROM r JOIN k USING (measure, k) WHERE r.taken""")
def w10_staff_groups(spark, d):
    rows = notes(spark, d).select("measure", F.struct(c("q").alias("q"), "ix").alias("o"), c("q").alias("y"), c("fret").alias("a"), (c("fret") + 5 * c("string")).alias("z"))
    g = W.staff_groups(rows.select("measure", (c("y") + c("o.ix") * 0.0).alias("y"), "a", "z", "o"), ["measure"], "y", 4, 3.0, 14.0, 4.0, "a", "z", 20.0)
    return g.select("measure", "system", "spacing", F.get("lines", F.lit(0)).alias("first"), F.get("lines", F.lit(3)).alias("last"), "left", "right")


@query(f"""WITH RECURSIVE {POINTS}, k AS (SELECT CAST(score_id AS VARCHAR) AS run_id, us AS ord, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY score_id ORDER BY us) AS k FROM points),
r AS (SELECT run_id, k, ord, v, v AS last, true AS taken FROM k WHERE k = 1 UNION ALL SELECT k.run_id, k.k, k.ord, k.v, CASE WHEN abs(k.v - r.last) >= 25 THEN k.v ELSE r.last END, abs(k.v - r.last) >= 25 FROM r JOIN k ON k.run_id = r.run_id AND k.k = r.k + 1)
SELECT run_id, ord, v AS value FROM r WHERE taken""")
def z2_stream_suppress(spark, d):
    own = spark.newSession()  # its state store is no concern of the caller's session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = _stream(own, d, "events").select(c("user_id").cast("string").alias("run_id"), F.unix_micros(c("ts").cast("timestamp")).alias("ord"), c("value").cast("double").alias("value"))
    out = _drained(Z.stream_suppress(e, 25.0), "append")
    return spark.read.schema(out.schema).parquet(*out.inputFiles())



# -- scans of trees and of one large document, table functions ----------------------------------------------------

@query(f"""WITH {NOTES}, k AS (SELECT score_id, measure % 40 AS number, max(q) AS quality, max(duration64) / 8 AS d, min(fret) AS fret, min(string) AS string FROM notes GROUP BY ALL) SELECT CAST(score_id AS VARCHAR) AS score_id, CAST(number AS INT) AS number, CAST(d AS DOUBLE) AS duration, string, fret FROM k WHERE score_id % 3 > 0""")
def s3_diagnostics(spark, d):
    folder = scratch(spark)
    m = notes(spark, d).groupBy("score_id", (c("measure") % 40).alias("number")).agg(F.max("q").alias("quality"), (F.max("duration64") / 8).alias("d"), F.min("fret").alias("fret"), F.min("string").alias("string"))
    event = F.struct(F.lit(0.0).alias("onset"), c("d").alias("duration"), F.lit(False).alias("rest"), F.array(F.struct("string", "fret")).alias("notes"))
    docs = m.groupBy("score_id").agg(F.collect_list(F.struct("number", "quality", F.array(event).alias("events"))).alias("measures"))
    whole = F.struct(F.when(c("score_id") % 3 > 0, "tab").otherwise("other").alias("engine"), c("score_id").cast("string").alias("score_id"), "measures")
    put_files(docs.select(F.concat(c("score_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(whole, {"pretty": "true"}).alias("content")), folder)
    return IO.read_diagnostics(spark, folder, "tab")["notes"].select("score_id", "number", "duration", "string", "fret")


@query(f"WITH {NOTES} SELECT measure * 8 + ix AS id, measure AS image_id, string AS category_id, CAST(q AS DOUBLE) AS x, CAST(fret AS DOUBLE) AS y, CAST(duration64 AS DOUBLE) AS area FROM notes")
def s6_scan_coco(spark, d):
    """Every note as an annotation of a document. A document holds 65,536 measures, whatever the table's size, so no task
    writes all of them; many tasks read each."""
    folder = scratch(spark)
    n = notes(spark, d).withColumn("doc", F.floor(c("measure") / 65_536))
    box = F.array(c("q").cast("double"), c("fret").cast("double"), F.lit(9.0), F.lit(4.0))
    note = F.to_json(F.struct((c("measure") * 8 + c("ix")).alias("id"), c("measure").alias("image_id"), c("string").alias("category_id"), box.alias("bbox"), c("duration64").cast("double").alias("area"), F.lit(0).alias("iscrowd")))
    image = F.to_json(F.struct(c("measure").alias("id"), F.lit("p.png").alias("file_name")))
    fixed = [(0, '{"info": {"year": 2020}, "images": [{"id": -1, "file_name": "cover.png"}'), (2, '], "categories": [{"id": 1, "name": "fret"}], "annotations": ['), (4, '{"id": "not a number"}]}')]
    heads = n.select("doc").distinct().select("doc", F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(v).alias("value")) for p, v in fixed))))
    images = n.select("doc", "measure").distinct().select("doc", F.lit(1).alias("part"), F.concat(F.lit(","), image).alias("value"))
    lines = heads.unionByName(images).unionByName(n.select("doc", F.lit(3).alias("part"), F.concat(note, F.lit(",")).alias("value")))
    documents = n.agg(F.countDistinct("doc")).first()[0]
    lines.repartition(max(1, documents), "doc").sortWithinPartitions("doc", "part").select("doc", "value").write.partitionBy("doc").text(folder, lineSep=" ")
    return IO.scan_coco(spark, folder)["annotations"].select("id", "image_id", "category_id", c("bbox")[0].alias("x"), c("bbox")[1].alias("y"), "area")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS project_id, 'v' || (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END) || '-' || o_custkey AS source_id FROM orders WHERE o_orderkey % 5 > 0 OR o_orderkey % 3 = 0")
def s10_project_metadata(spark, d):
    """Two generations of metadata files; the later one holds a third of the projects, and some values are no objects."""
    folder = scratch(spark)
    o = table(spark, d, "orders")
    for version, rows in ((1, o), (2, o.filter("o_orderkey % 3 = 0"))):
        entry = F.concat(F.lit('"'), c("o_orderkey").cast("string"), F.when((c("o_orderkey") % 5 == 0) & F.lit(version == 1), '":7').otherwise(F.concat(F.lit('":'), F.to_json(F.struct(F.concat(F.lit(f"v{version}-"), c("o_custkey").cast("string")).alias("source_id"))))))
        one = rows.groupBy(F.floor(c("o_orderkey") / 4096).alias("k")).agg(F.concat(F.lit('{"projects":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value"))
        one.write.partitionBy("k").text(f"{folder}/generation-{version}")
        spark.createDataFrame([("not json",), ('{"projects": 3}',)], "value string").write.text(f"{folder}/bad-{version}")
    return IO.read_project_metadata(spark, folder, "part-*").select("project_id", "source_id")


@query("SELECT s_nationkey AS project_id, s_suppkey AS run_id, CAST(k AS INT) AS frame, sha256(s_name || k || chr(10)) AS sha256 FROM supplier, range(1, 4) g(k) WHERE s_suppkey % 5 > 0 AND k <= 1 + s_suppkey % 3")
def s11_scan_frames(spark, d):
    """Frame files of a run for each supplier; those whose first frame is missing are no runs."""
    folder = scratch(spark)
    s = table(spark, d, "supplier").withColumn("k", F.explode(F.sequence(F.lit(1), (1 + c("s_suppkey") % 3).cast("int")))).filter("s_suppkey % 5 > 0 or k > 1")
    name = F.format_string("%d/analysis/%d/frame-%04d.png", "s_nationkey", "s_suppkey", "k")
    put_files(s.repartition("s_suppkey").select(name.alias("name"), F.concat("s_name", c("k").cast("string"), F.lit("\n")).alias("content")), f"{folder}/media")
    return IO.scan_frames(spark, f"{folder}/media").select(c("project_id").cast("long").alias("project_id"), c("run_id").cast("long").alias("run_id"), "frame", "sha256")


CLUSTERS = """e AS (SELECT label * 1000000 + vec_id // 1000 AS run_id, vec_id AS ord, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS f FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM e),
r AS (SELECT run_id, k, ord, [f] AS sums, [1] AS sizes, CAST(1 AS BIGINT) AS at, CAST(0 AS DOUBLE) AS distance FROM k WHERE k = 1 UNION ALL
 SELECT run_id, k, ord, CASE WHEN hit THEN list_transform(sums, lambda s, i: CASE WHEN i = best THEN list_transform(s, lambda x, j: x + f[j]) ELSE s END) ELSE list_append(sums, f) END, CASE WHEN hit THEN list_transform(sizes, lambda n, i: CASE WHEN i = best THEN n + 1 ELSE n END) ELSE list_append(sizes, 1) END, CASE WHEN hit THEN best ELSE len(sizes) + 1 END, CASE WHEN hit THEN least_d ELSE 0 END
 FROM (SELECT *, list_min(ds) AS least_d, list_position(ds, list_min(ds)) AS best, list_min(ds) <= 0.3 AS hit FROM (SELECT r.run_id, k.k, k.ord, k.f, r.sums, r.sizes, list_transform(r.sums, lambda s, i: list_sum(list_transform(s, lambda x, j: CASE WHEN (x / r.sizes[i] >= 0.5) <> (k.f[j] = 1) THEN 1 ELSE 0 END)) / len(k.f)::DOUBLE) AS ds FROM r JOIN k ON k.run_id = r.run_id AND k.k = r.k + 1)))
SELECT run_id, ord, CAST(at - 1 AS INT) AS cluster_id, round(distance, 6) AS distance FROM r"""


@query(f"WITH RECURSIVE {CLUSTERS.replace(' AS at,', ' AS place,').replace('at - 1', 'place - 1')}")
def f4_leader_clusters_sql(spark, d):
    """The solver as a table function, called from SQL."""
    TF.register(spark)
    glyphs = table(spark, d, "embeddings").select((c("label") * 1_000_000 + F.floor(c("vec_id") / 1000)).alias("run_id"), c("vec_id").alias("ord"), F.transform("embedding", lambda x: (x > 0).cast("tinyint")).alias("feature"))
    return spark.sql("SELECT run_id, ord, cluster_id, round(distance, 6) AS distance FROM leader_clusters(TABLE({glyphs}), 0.3)", glyphs=glyphs)


ORACLE_SQL["w24_leader_clusters"] = ORACLE_SQL["f4_leader_clusters_sql"]  # the same clusters by the operator itself


@query()
def f4_smooth_starts_sql(spark, d):
    TF.register(spark)
    week = 7 * 24 * 3_600_000_000
    p = points(spark, d).select((c("score_id") * 1000 + F.floor(c("us") / week) % 1000).alias("score_id"), c("event_id").alias("frame_id"), (c("us") % week / 6e8).alias("t"), (c("event_id") % 3).cast("int").alias("index"), c("value").alias("conf"))
    labels = p.withColumn("value", F.when(c("frame_id") % 7 == 0, 900).otherwise((c("t") * 0.75).cast("int") + c("index")))
    return spark.sql("SELECT score_id, frame_id, start_measure, confidence FROM smooth_starts(TABLE({labels}))", labels=labels)


def sixteen_steps():
    """A model that reads a vector of 64 as the outputs of 16 steps for 4 classes."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": frame["vec_id"], "logits": [np.asarray(v, float).reshape(16, 4).tolist() for v in frame["embedding"]]})

    return model


sixteen_steps.schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType())))])


@query("""WITH s AS (SELECT vec_id, unnest(range(0, 16)) AS j, embedding AS e FROM embeddings), r AS (SELECT vec_id, j, e[4 * j + 1 : 4 * j + 4] AS r FROM s), b AS (SELECT vec_id, j, list_position(r, list_max(r)) - 1 AS i, CAST(list_max(r) AS DOUBLE) AS p FROM r), k AS (SELECT *, lag(i) OVER (PARTITION BY vec_id ORDER BY j) AS was FROM b)
SELECT vec_id, coalesce(string_agg(substr('358', i, 1), '' ORDER BY j) FILTER (i <> 0 AND i IS DISTINCT FROM was), '') AS text, round(coalesce(avg(p) FILTER (i <> 0 AND i IS DISTINCT FROM was), 0), 5) AS confidence FROM k GROUP BY vec_id""")
def f1_predict_sql(spark, d):
    """Inference as a table function, decoded by built-in expressions."""
    TF.register(spark)
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    read = spark.sql("SELECT * FROM predict(TABLE({vectors}), 'tabspark.queries_io:sixteen_steps', 32)", vectors=vectors)
    return M.read_text(read, "logits", "358").select("vec_id", "text", F.round("confidence", 5).alias("confidence"))

"""More registered queries: operators whose input the given tables have only in other words (see ``queries``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import models as M, scalars as S
from .operators import aggs as A, edits as U, joins as J, seq as W, signal as T
from .queries import NOTES, POINTS, c, dealt, notes, points, query, table

ID = ("score_id", "measure", "ix")
IDS = "score_id, measure, ix"


def text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- scalars ---------------------------------------------------------------------------------------------------

@query(f"""WITH {NOTES}, x AS (SELECT {IDS}, q, fret, coalesce(CASE q % 3 WHEN 0 THEN 30000 / 1001.0 WHEN 2 THEN q END, CASE WHEN fret % 2 = 0 THEN 25.0 END, 0.0) AS fps, CASE WHEN q % 4 = 0 THEN fret * 1.0 ELSE q * 1.5 END AS duration, CASE WHEN q % 11 <> 0 THEN q END AS w FROM notes)
SELECT {IDS}, w AS width, fret AS height, CAST(fps AS DOUBLE) AS fps, CAST(duration AS DOUBLE) AS duration, CASE WHEN w IS NULL THEN 'missing' WHEN w < 2 OR fret < 2 OR fps <= 0 OR duration <= 0 THEN 'invalid' END AS reason FROM x""")
def p6_normalise_probe(spark, d):
    q, fret = c("q"), c("fret")
    first = F.when(q % 3 == 0, "30000/1001").when(q % 3 == 1, "0/0").otherwise(q.cast("string"))
    second = F.when(fret % 2 == 0, "25").otherwise("none")
    p = S.normalise_probe(F.when(q % 11 == 0, "").otherwise(q.cast("string")), fret.cast("string"), [first, second], [F.when(q % 4 == 0, "N/A").otherwise((q * 1.5).cast("string")), fret.cast("string")])
    return notes(spark, d).select(*ID, p.alias("p")).select(*ID, "p.*")


@query(f"WITH {NOTES} SELECT {IDS}, discount AS start, least(CAST(q AS DOUBLE), 40.0) AS \"end\" FROM notes")
def p11_clip_range(spark, d):
    return notes(spark, d).select(*ID, S.clip_range(c("discount"), c("q").cast("double"), F.lit(40.0)).alias("r")).select(*ID, "r.*")


@query(f"WITH {NOTES} SELECT {IDS}, CAST(CASE flag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 END AS DOUBLE) AS duration FROM notes")
def p17_rest_glyph(spark, d):
    return notes(spark, d).select(*ID, S.rest_duration(c("flag"), {"A": 1.0, "R": 0.5}).alias("duration"))


@query(f"WITH {NOTES} SELECT {IDS}, q % 3 <> 0 AND q * 40 <= 1000 AND 10 * ix < 40 AND 10 * ix >= 10 AS is_label FROM notes")
def p18_measure_label(spark, d):
    t = F.when(c("q") % 3 == 0, text("m", c("q"))).otherwise((c("q") * 40).cast("string"))
    return notes(spark, d).select(*ID, S.is_measure_label(t, c("ix") * 10, F.lit(40), F.lit(10)).alias("is_label"))


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN fret % 5 = 0 THEN 0 WHEN fret % 5 <> 1 THEN fret END AS fret, CASE WHEN fret % 5 = 0 THEN 'dead_note' ELSE flag END AS technique FROM notes")
def p19_normalise_token(spark, d):
    t = F.when(c("fret") % 5 == 0, " X ").when(c("fret") % 5 == 1, "?").otherwise(c("fret").cast("string"))
    return notes(spark, d).select(*ID, S.normalise_token(t, c("flag")).alias("t")).select(*ID, "t.*")


@query(f"WITH {NOTES} SELECT {IDS}, status = 'O' AND q % 5 <> 0 AND q % 7 <> 0 AND q % 4 = 0 AS plain FROM notes")
def p20_plain_fret(spark, d):
    q = c("q")
    return notes(spark, d).select(*ID, S.is_plain_fret(c("status") == "O", c("fret"), q % 5 == 0, F.when(q % 7 == 0, True), F.lit(False), q % 4).alias("plain"))


@query(f"""WITH {NOTES}, b AS (SELECT {IDS}, greatest(q, 10) AS x1, greatest(fret, 5) AS y1, least(q + duration64, 40) AS x2, least(fret + 3 * string, 30) AS y2, q, fret, duration64, string FROM notes)
SELECT {IDS}, x1 - 10 AS x, y1 - 5 AS y, x2 - x1 AS w, y2 - y1 AS h, greatest(0, CAST(floor(q * 0.3) AS INT) - 2) AS px1, least(60, CAST(ceil(q * 0.3 + duration64) AS INT) + 2) AS px2 FROM b WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def p21_boxes(spark, d):
    q, f = c("q"), c("fret")
    box = S.clip_box(q, f, c("duration64"), 3 * c("string"), F.lit(10), F.lit(5), F.lit(40), F.lit(30))
    pixels = S.clamp_box(q * 0.3, f * 0.3, q * 0.3 + c("duration64"), f * 0.3, F.lit(60), F.lit(60), 2)
    return notes(spark, d).select(*ID, box.alias("b"), pixels.alias("p")).filter("b is not null").select(*ID, "b.*", c("p.x1").alias("px1"), c("p.x2").alias("px2"))


@query(f"WITH {POINTS} SELECT event_id, us > 1705000000000000 AS active FROM points")
def p25_active(spark, d):
    return points(spark, d).select("event_id", S.active(c("us"), F.lit(1705000000000000)).alias("active"))


@query(f"WITH {POINTS} SELECT event_id, kind IN ('view', 'click') AND event_id % 3 <> 0 AS owned FROM points")
def p28_owned_path(spark, d):
    path = text("/data/", F.when(c("kind").isin("view", "click"), "mine/").otherwise("mine2/"), c("kind"), F.when(c("event_id") % 3 == 0, "/../x").when(c("event_id") % 3 == 1, "/a..b").otherwise(""))
    return points(spark, d).select("event_id", S.owned_path(path, "/data/mine/").alias("owned"))


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN q % 3 = 2 THEN 'new' WHEN fret % 2 = 0 THEN flag END AS layout, CAST((q % 3 = 2 OR fret % 2 = 0)::INT + (q % 3 = 1)::INT AS INT) AS entries FROM notes")
def p29_merge_key(spark, d):
    pair = lambda k, v: F.create_map(F.lit(k), v)
    old = F.when(c("fret") % 2 == 0, pair("layout", c("flag"))).otherwise(pair("other", c("flag")))
    new = F.when(c("q") % 3 == 1, pair("x", F.lit("1"))).when(c("q") % 3 == 2, pair("layout", F.lit("new")))
    m = notes(spark, d).withColumn("m", S.merge_key(old, new, "layout"))
    return m.select(*ID, c("m")["layout"].alias("layout"), F.size("m").alias("entries"))


@query(f"WITH {NOTES} SELECT {IDS}, q % 9 <= 6 AND fret % 4 <= 2 AS written FROM notes")
def p30_rhythm_row(spark, d):
    return notes(spark, d).select(*ID, S.rhythm_row(F.pow(F.lit(2), c("q") % 9).cast("int"), c("fret") % 4).alias("written"))


@query(f"WITH {NOTES}, x AS (SELECT {IDS}, price - 1000 AS f FROM notes) SELECT {IDS}, CASE WHEN f > 0 THEN CAST(((69 + CAST(round_even(12 * log2(f / 440.0), 0) AS INT)) % 12 + 12) % 12 AS INT) END AS pitch_class FROM x")
def m6_pitch_class(spark, d):
    return notes(spark, d).select(*ID, S.pitch_class(c("price") - 1000).cast("int").alias("pitch_class"))


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN flag = 'R' THEN 'rest_' ELSE 'note_' END || duration64 || repeat('.', q % 3) AS label FROM notes")
def m10_duration_label(spark, d):
    return notes(spark, d).select(*ID, S.duration_label(c("duration64"), c("q") % 3, c("flag") == "R").alias("label"))


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN q % 3 > 0 THEN q % 2 || ',1' ELSE '0,0' END || ',' || CASE WHEN q % 3 > 1 THEN '1,' || fret % 2 ELSE '0,0' END AS cells FROM notes")
def m16_token_feature(spark, d):
    tiny = lambda *v: F.array(*v).cast("array<tinyint>")
    glyphs = F.slice(F.array(tiny(c("q") % 2, F.lit(1)), tiny(F.lit(1), c("fret") % 2)), F.lit(1), (c("q") % 3).cast("int"))
    return notes(spark, d).select(*ID, F.array_join(S.token_feature(glyphs, 2).cast("array<string>"), ",").alias("cells"))


@query("""WITH s AS (SELECT vec_id, unnest(range(0, 16)) AS j, embedding AS e FROM embeddings), r AS (SELECT vec_id, j, e[4 * j + 1 : 4 * j + 4] AS r FROM s), b AS (SELECT vec_id, j, list_position(r, list_max(r)) - 1 AS i, CAST(list_max(r) AS DOUBLE) AS p FROM r),
k AS (SELECT *, lag(i) OVER (PARTITION BY vec_id ORDER BY j) AS was FROM b)
SELECT vec_id, coalesce(string_agg(substr('358', i, 1), '' ORDER BY j) FILTER (i <> 0 AND i IS DISTINCT FROM was), '') AS text, round(coalesce(avg(p) FILTER (i <> 0 AND i IS DISTINCT FROM was), 0), 5) AS confidence FROM k GROUP BY vec_id""")
def m18_ctc_decode(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.slice("embedding", 4 * j + 1, 4))
    e = table(spark, d, "embeddings").select("vec_id", rows.alias("logits"))
    return M.read_text(e, "logits", "358").select("vec_id", "text", F.round("confidence", 5).alias("confidence"))


@query(f"WITH {NOTES} SELECT {IDS}, q % 4 <> 0 AND q <= 36 AND discount >= 0.03 AS accepted FROM notes")
def f3_accept_prediction(spark, d):
    t = F.when(c("q") % 4 == 0, text(c("q"), "x")).otherwise(c("q").cast("string"))
    return notes(spark, d).select(*ID, M.accept_prediction(t, c("discount"), 0.03).alias("accepted"))


# -- joins -----------------------------------------------------------------------------------------------------

@query(f"""WITH {NOTES}, j AS (SELECT a.measure, a.ix AS label_id, b.ix AS i, a.fret * 5.0 - (b.ix - 1) * 30.0 AS o FROM notes a JOIN notes b USING (measure)),
r AS (SELECT *, CASE WHEN o >= 0 AND o < 30 AND o <= 24 THEN 0 WHEN abs(o) <= 12 THEN 1 END AS p FROM j)
SELECT measure, label_id, i AS measure_index FROM (SELECT *, row_number() OVER (PARTITION BY measure, label_id ORDER BY p, CASE WHEN p = 1 THEN abs(o) ELSE 0 END, i) AS k FROM r WHERE p IS NOT NULL) WHERE k = 1""")
def j6_attach_labels(spark, d):
    n = notes(spark, d)
    labels = n.select("measure", c("ix").alias("label_id"), (c("fret") * 5.0).alias("x"))
    bars = n.select("measure", c("ix").alias("measure_index"), ((c("ix") - 1) * 30.0).alias("left"), (c("ix") * 30.0).alias("right"))
    return J.attach_labels(labels, bars, ["measure"], F.lit(4.0))


@query(f"WITH {NOTES} SELECT a.measure, a.ix, b.ix AS span FROM notes a JOIN notes b ON a.measure = b.measure AND b.flag = 'R' AND a.onset64 BETWEEN b.onset64 - b.q AND b.onset64 + b.q")
def j8_attach_spans(spark, d):
    n = notes(spark, d)
    spans = n.filter("flag = 'R'").select("measure", c("ix").alias("span"), (c("onset64") - c("q")).alias("start"), (c("onset64") + c("q")).alias("end"))
    return J.attach_spans(n.select("measure", "ix", c("onset64").alias("x")), spans, ["measure"]).select("measure", "ix", "span")


@query(f"""WITH {NOTES} SELECT measure, ix, best FROM (SELECT a.measure, a.ix, b.ix AS best, row_number() OVER (PARTITION BY a.measure, a.ix ORDER BY b.price DESC, b.ix) AS k FROM notes a JOIN notes b ON a.measure = b.measure AND a.onset64 BETWEEN b.onset64 - b.q AND b.onset64 + b.q AND a.ix <> b.ix) WHERE k = 1""")
def j9_best_match(spark, d):
    n = notes(spark, d)
    other = n.select("measure", c("ix").alias("best"), (c("onset64") - c("q")).alias("lo"), (c("onset64") + c("q")).alias("hi"), c("price").alias("p"))
    return J.best_match(n.select("measure", "ix", "onset64"), other, ["measure"], ["measure", "ix"], c("onset64").between(c("lo"), c("hi")) & (c("ix") != c("best")), [F.desc("p"), c("best")]).select("measure", "ix", "best")


@query(f"""WITH {NOTES}, s AS (SELECT measure, onset64 AS x, (lead(fret) OVER w - fret) / 12.0 AS rate FROM notes WINDOW w AS (PARTITION BY measure ORDER BY onset64)), g AS (SELECT * FROM s WHERE rate IS NOT NULL),
m AS (SELECT n.measure, n.ix, arg_max(g.rate, g.x) AS rate FROM notes n LEFT JOIN g ON n.measure = g.measure AND g.x <= n.onset64 + 6 GROUP BY ALL)
SELECT measure, ix, round(least(2.0, greatest(0.5, coalesce(rate, 1.0))), 6) AS rate FROM m""")
def j12_tick_rate(spark, d):
    n = notes(spark, d)
    anchors = n.select("measure", c("onset64").alias("x"), c("fret").cast("double").alias("y"))
    return J.tick_rate(anchors, n.select("measure", "ix", (c("onset64") + 6).alias("x")), ["measure"], "x", "y").select("measure", "ix", F.round("rate", 6).alias("rate"))


@query(f"""WITH {POINTS}, s AS (SELECT score_id, event_id AS section, t AS start, kind AS label FROM points WHERE event_id % 5 = 0)
SELECT event_id, section_label FROM (SELECT p.event_id, s.label AS section_label, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - s.start), s.start, s.section) AS k FROM points p LEFT JOIN s USING (score_id)) WHERE k = 1""")
def j14_nearest_section(spark, d):
    p = points(spark, d)
    sections = p.filter("event_id % 5 = 0").select("score_id", c("event_id").alias("section"), c("t").alias("start_seconds"), c("kind").alias("label"))
    return J.nearest_section(p.select("score_id", "event_id", c("t").alias("time_seconds")), sections).select("event_id", "section_label")


@query(f"""WITH {NOTES}, k AS (SELECT score_id, measure % 50 + ix AS number, CAST(q * 37 + fret AS VARCHAR) AS signature FROM notes WHERE flag = 'R'),
v AS (SELECT n.score_id, n.measure AS frame_id, k.number - n.ix AS start, count(*) AS n FROM notes n JOIN k ON n.score_id = k.score_id AND k.signature = CAST(n.q * 37 + n.fret AS VARCHAR) GROUP BY ALL)
SELECT score_id, frame_id, CAST(start AS BIGINT) AS start_measure, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY score_id, frame_id ORDER BY n DESC, start) AS k FROM v) WHERE k = 1 AND n >= 2 AND start >= 0""")
def j22_signature_votes(spark, d):
    n = notes(spark, d).withColumn("signature", (c("q") * 37 + c("fret")).cast("string"))
    known = n.filter("flag = 'R'").select("score_id", (c("measure") % 50 + c("ix")).cast("long").alias("number"), "signature")
    return J.signature_votes(n.select("score_id", c("measure").alias("frame_id"), c("ix").alias("index"), "signature"), known)


@query(f"""WITH {NOTES}, p AS (SELECT * FROM notes WHERE q % 11 <> 0), g AS (SELECT measure FROM (SELECT measure, count(*) AS n, bool_and(fret % 9 <> 0) AS ok FROM p GROUP BY ALL) JOIN (SELECT measure, count(*) AS m FROM notes GROUP BY ALL) USING (measure) WHERE n = m AND ok)
SELECT n.measure, n.ix AS ordinal, CASE WHEN g.measure IS NOT NULL THEN CAST(n.fret AS VARCHAR) END AS predicted, CASE WHEN g.measure IS NOT NULL THEN n.discount END AS predicted_confidence FROM notes n LEFT JOIN g USING (measure)""")
def j23_apply_predictions(spark, d):
    n = notes(spark, d)
    t = F.when(c("fret") % 9 == 0, "?").otherwise(c("fret").cast("string"))
    preds = n.filter("q % 11 <> 0").select("measure", c("ix").alias("ordinal"), t.alias("text"), c("discount").alias("confidence"))
    return J.apply_predictions(n.select("measure", c("ix").alias("ordinal")), preds, ["measure"])


@query(f"""WITH {NOTES}, a AS (SELECT score_id, max(status) AS tag, count(*) AS hits FROM notes GROUP BY score_id), b AS (SELECT score_id, CASE WHEN score_id % 2 = 0 THEN 'O' ELSE 'X' END AS tag, sum(q) AS hits FROM notes WHERE flag = 'R' AND score_id % 3 > 0 GROUP BY score_id)
SELECT a.score_id, a.tag, CAST(a.hits + CASE WHEN a.tag = b.tag THEN b.hits ELSE 0 END AS BIGINT) AS hits FROM a LEFT JOIN b USING (score_id)""")
def j25_merge_summary(spark, d):
    n = notes(spark, d)
    new = n.groupBy("score_id").agg(F.max("status").alias("tag"), F.count("*").alias("hits"))
    old = n.filter("flag = 'R' and score_id % 3 > 0").groupBy("score_id").agg(F.sum("q").alias("hits")).withColumn("tag", F.when(c("score_id") % 2 == 0, "O").otherwise("X"))
    return J.merge_summary(new, old, ["score_id"], "tag", ["hits"])


@query(f"""WITH {NOTES}, k AS (SELECT measure, ix AS id, q AS x, fret AS y, duration64 * 0.25 AS w, (q % 9) * 1.0 AS h, string % 3 AS bands FROM notes),
s AS (SELECT n.measure, n.ix, k.*, row_number() OVER (PARTITION BY n.measure, n.ix ORDER BY k.h DESC, k.x DESC, k.y DESC, k.w DESC, k.bands DESC) AS r FROM notes n JOIN k ON n.measure = k.measure AND n.q >= k.x - 0.5 AND n.q <= k.x + k.w + 0.5 AND k.h >= 2.5 AND k.y <= 20 + 1.8),
b AS (SELECT * FROM s WHERE r = 1),
t AS (SELECT DISTINCT b.measure, b.ix FROM b JOIN k ON b.measure = k.measure AND k.w <= 1.0 AND k.h <= 1.0 AND k.x > b.x + b.w AND k.x <= b.x + b.w + 2 AND k.y >= b.y)
SELECT n.measure, n.ix AS token_id, CASE WHEN b.w IS NULL THEN NULL WHEN b.w >= 1.4 THEN CASE WHEN b.bands >= 2 THEN 0.5 ELSE 1.0 END WHEN t.ix IS NOT NULL THEN 3.0 ELSE 2.0 END::DOUBLE AS duration_units FROM notes n LEFT JOIN b ON n.measure = b.measure AND n.ix = b.ix LEFT JOIN t ON n.measure = t.measure AND n.ix = t.ix""")
def j27_assign_rhythm(spark, d):
    n = notes(spark, d)
    tokens = n.select("measure", c("ix").alias("token_id"), c("q").alias("x"), F.lit(20.0).alias("top"))
    parts = n.select("measure", c("q").alias("x"), c("fret").alias("y"), (c("duration64") * 0.25).alias("w"), ((c("q") % 9) * 1.0).alias("h"), (c("string") % 3).alias("beam_bands"))
    return J.assign_rhythm(tokens, parts, ["measure"], F.lit(2.0)).select("measure", "token_id", "duration_units")


# -- aggregations ----------------------------------------------------------------------------------------------

@query(f"""WITH {NOTES}, g AS (SELECT measure, string_agg(CASE WHEN ix % 2 = 1 THEN 'Tempo' ELSE CAST(q * 4 AS VARCHAR) END, ' ' ORDER BY ix) AS text, avg(discount) AS conf FROM notes GROUP BY measure),
x AS (SELECT *, try_cast(regexp_extract(upper(text), 'TEMPO\\s*[:=]?\\s*(\\d{{2,3}}(?:\\.\\d+)?)', 1) AS DOUBLE) AS v FROM g)
SELECT measure, text, round(conf, 6) AS conf, CASE WHEN v BETWEEN 30 AND 300 THEN v END AS tempo FROM x""")
def a2_line_tempos(spark, d):
    words = notes(spark, d).select("measure", c("ix").alias("left"), F.when(c("ix") % 2 == 1, "Tempo").otherwise((c("q") * 4).cast("string")).alias("text"), c("discount").alias("conf"))
    return A.line_tempos(words, ["measure"]).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {NOTES}, j AS (SELECT a.measure, a.ix AS cluster_id, b.ix AS o, b.fret AS label, b.discount * 100 AS confidence, abs(a.q - b.q) / 50.0 AS d FROM notes a JOIN notes b ON a.measure = b.measure AND a.flag = 'R' AND b.flag <> 'R')
SELECT measure, cluster_id, label, round(greatest(0.0, confidence * (1 - d / 0.15)), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY measure, cluster_id ORDER BY d, o) AS k FROM j) WHERE k = 1 AND d <= 0.15""")
def a7_propagate_labels(spark, d):
    n = notes(spark, d)
    bare = n.filter("flag = 'R'").select("measure", c("ix").alias("cluster_id"), c("q").alias("u"))
    named = n.filter("flag <> 'R'").select("measure", c("ix").alias("other_id"), c("fret").alias("label"), (c("discount") * 100).alias("confidence"), c("q").alias("v"))
    return A.propagate_labels(bare, named, ["measure"], F.abs(c("u") - c("v")) / 50.0).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {NOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY ix) - 1 AS k, true AS ocr FROM notes WHERE status = 'F' AND measure % 2 = 1), e AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY ix) - 1 AS k, false AS ocr FROM notes WHERE measure NOT IN (SELECT measure FROM o))
SELECT score_id, measure AS number, CAST(k AS INT) AS ord, ix AS pos, fret AS first FROM (SELECT min(score_id) OVER (PARTITION BY measure) AS score_id, measure, k, ix, fret, q FROM (SELECT n.score_id, n.measure, x.k, n.ix, n.fret, n.q, x.ix AS there FROM notes n LEFT JOIN (SELECT * FROM o UNION ALL SELECT * FROM e) x ON n.measure = x.measure AND n.ix = x.ix)) WHERE k IS NOT NULL AND q % 3 > 0""")
def a17_predicted_events(spark, d):
    n = notes(spark, d)
    event = F.struct(c("ix").alias("pos"), F.when(c("q") % 3 > 0, F.array("fret")).otherwise(F.array().cast("array<int>")).alias("notes"))
    m = n.groupBy("measure").agg(F.min("score_id").alias("score_id"), F.sort_array(F.collect_list(event)).alias("events"), F.sort_array(F.collect_list(F.when((c("status") == "F") & (c("measure") % 2 == 1), event))).alias("ocr_events"))
    return A.predicted_events(m.withColumnRenamed("measure", "number")).select("score_id", "number", "ord", "pos", F.get("notes", F.lit(0)).alias("first"))


@query(f"""WITH {NOTES}, l AS (SELECT measure, round_even((fret * 0.5 + fret * 0.5 + (q % 3) * 0.2) * 2, 0) / 4 AS y, least(ix * 10, ix * 10 + q - 3) AS a, greatest(ix * 10, ix * 10 + q - 3) AS b FROM notes WHERE (q % 3) * 0.2 <= 0.3 AND abs(q - 3) >= 2),
m AS (SELECT *, max(b) OVER (PARTITION BY measure, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM l), i AS (SELECT *, sum(CASE WHEN x IS NULL OR a > x + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY measure, y ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
v AS (SELECT measure, y, sum(n) AS covered, min(a) AS "left", max(b) AS "right" FROM (SELECT measure, y, g, max(b) - min(a) AS n, min(a) AS a, max(b) AS b FROM i GROUP BY ALL) GROUP BY ALL)
SELECT measure, CAST(y AS DOUBLE) AS y, CAST(covered AS BIGINT) AS covered, "left", "right" FROM v WHERE covered >= 3""")
def a22_staff_rows(spark, d):
    lines = notes(spark, d).select("measure", (c("ix") * 10).alias("x1"), (c("fret") * 0.5).alias("y1"), (c("ix") * 10 + c("q") - 3).alias("x2"), (c("fret") * 0.5 + (c("q") % 3) * 0.2).alias("y2"))
    return A.staff_rows(lines, ["measure"], 3.0).select("measure", "y", c("covered").cast("long").alias("covered"), "left", "right")


@query(f"WITH {POINTS} SELECT score_id, round(arg_min(floor(CAST(value AS DOUBLE)) * 3 + event_id % 2 * 0.04, event_id), 1) AS tempo FROM points WHERE event_id % 3 <> 0 AND floor(CAST(value AS DOUBLE)) * 3 + event_id % 2 * 0.04 BETWEEN 30 AND 300 GROUP BY score_id")
def p14_score_tempo(spark, d):
    marks = points(spark, d).select("score_id", c("event_id").alias("ord"), F.when(c("event_id") % 3 == 0, "fast").otherwise(text(" ", F.floor(c("value").cast("double")) * 3 + c("event_id") % 2 * 0.04, " ")).alias("tempo"))
    return A.tempo_from_score(marks)


@query(f"WITH {NOTES} SELECT measure, ix, fret, 1 AS category_id FROM notes")
def p27_collapse_categories(spark, d):
    return A.collapse_categories(notes(spark, d).select("measure", "ix", "fret", c("string").alias("category_id")))


# -- sequences -------------------------------------------------------------------------------------------------

@query(f"""WITH {NOTES}, g AS (SELECT measure, ix, onset64 * 2.03::DOUBLE AS top, onset64 * 2.03::DOUBLE + 10.5 AS bottom, 1.0::DOUBLE + q % 3 AS spacing FROM notes), b AS (SELECT measure, ix, spacing, greatest(0, coalesce(round_even((lag(bottom) OVER w + top) / 2, 0), 0), round_even(top - 15 * spacing, 0)) AS crop_top,
least(150, coalesce(round_even((bottom + lead(top) OVER w) / 2, 0), 150), round_even(bottom + 5 * spacing, 0)) AS crop_bottom FROM g WINDOW w AS (PARTITION BY measure ORDER BY top)) SELECT measure, ix, CAST(crop_top AS INT) AS crop_top, CAST(crop_bottom AS INT) AS crop_bottom FROM b WHERE crop_bottom - crop_top >= 7 * spacing""")
def w12_system_bounds(spark, d):
    g = notes(spark, d).select("measure", "ix", (c("onset64") * 2.03).alias("top"), (c("onset64") * 2.03 + 10.5).alias("bottom"), (1.0 + c("q") % 3).alias("spacing"))
    return W.system_bounds(g, ["measure"], "top", "bottom", "spacing", F.lit(150)).select("measure", "ix", "crop_top", "crop_bottom")


@query("""WITH runs AS (SELECT DISTINCT l_suppkey AS frame, l_orderkey % 97 AS y, min(l_partkey % 4) OVER w * 60 + min(l_quantity % 7) OVER w AS x1, min(l_partkey % 4) OVER w * 60 + min(l_quantity % 7) OVER w + 30 + 4 * (max(l_quantity) OVER w % 11) AS x2 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_orderkey % 97)),
bars AS (SELECT s_suppkey AS frame, k AS measure_index, k * 60.0::DOUBLE + s_suppkey % 3 * 5 AS "left", k * 60.0::DOUBLE + s_suppkey % 3 * 5 + 60 AS "right" FROM supplier, range(4) g(k)), size AS (SELECT frame, median("right" - "left") AS w FROM bars GROUP BY frame),
wide AS (SELECT runs.*, w, y - row_number() OVER (PARTITION BY frame ORDER BY y) AS island FROM runs JOIN size USING (frame) WHERE x2 - x1 BETWEEN w * 0.65 AND w * 1.15),
rep AS (SELECT frame, w, round_even(avg(y), 0) AS y, round_even(median(CAST(x1 AS DOUBLE)), 0) AS a, round_even(median(CAST(x2 AS DOUBLE)), 0) AS z FROM wide GROUP BY frame, w, island),
pair AS (SELECT t.frame, t.y AS ty, b.y AS y, (t.a + t.z + b.a + b.z) / 4 AS x FROM rep t JOIN rep b ON t.frame = b.frame AND t.y < 30 AND b.y > 60 AND abs(t.a - b.a) <= t.w * 0.08 AND abs(t.z - b.z) <= t.w * 0.08)
SELECT frame, arg_min(measure_index, (ty, y, measure_index)) AS highlighted_index FROM pair JOIN bars USING (frame) WHERE x >= "left" AND x <= "right" GROUP BY frame""")
def w25_highlight_index(spark, d):
    start = F.min(c("l_partkey") % 4) * 60 + F.min(c("l_quantity") % 7)
    runs = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("frame"), (c("l_orderkey") % 97).alias("y")).agg(start.alias("x1"), (start + 30 + 4 * (F.max("l_quantity") % 11)).alias("x2"))
    suppliers = table(spark, d, "supplier").select(c("s_suppkey").alias("frame"))
    left = c("measure_index") * 60.0 + c("frame") % 3 * 5
    bars = suppliers.withColumn("measure_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("left", left).withColumn("right", left + 60)
    return W.highlight_index(runs, bars, suppliers.select("frame", F.lit(30).alias("top"), F.lit(60).alias("bottom")), ["frame"])


CENTRES = """c AS (SELECT DISTINCT l_suppkey AS doc_id, l_returnflag || l_linestatus AS page, (l_orderkey % 50) * 20 + l_linenumber % 3 AS y FROM lineitem), p AS (SELECT doc_id, page, list(y ORDER BY y) AS ys FROM c GROUP BY ALL)"""


def _centres(spark, d):
    return dealt(table(spark, d, "lineitem"), "l_suppkey").select(c("l_suppkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("page"), (c("l_orderkey") % 50 * 20 + c("l_linenumber") % 3).alias("y"), c("l_quantity").cast("double").alias("strength"))


# Both passes of the search: windows of six neighbours, then groups grown from pairs; e2 to e5 add a line each.
GROWN = "\n".join(f"""e{k} AS (SELECT e.doc_id, e.page, i, j, any_value(one) AS one, any_value(gap) AS gap, arg_min(c.y, (abs(c.y - (one + gap * {k})), c.y)) AS stop, list_append(any_value(g), arg_min(c.y, (abs(c.y - (one + gap * {k})), c.y))) AS g FROM e{k - 1} e JOIN c ON c.doc_id = e.doc_id AND c.page = e.page AND c.y > e.stop AND abs(c.y - (one + gap * {k})) <= greatest(SLACK, gap * SHARE) GROUP BY e.doc_id, e.page, i, j),""" for k in range(2, 6))


@query(f"""WITH RECURSIVE {CENTRES}, e1 AS (SELECT doc_id, page, i, i + k AS j, ys[i] AS one, ys[i + k] - ys[i] AS gap, ys[i + k] AS stop, [ys[i], ys[i + k]] AS g FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS i FROM p), range(1, 5) t(k) WHERE i + k <= len(ys) AND ys[i + k] - ys[i] BETWEEN 4 AND 80),
{GROWN.replace("SLACK", "3.0").replace("SHARE", "0.25")}
q AS (SELECT doc_id, page, 1 AS phase, i, j, g FROM e5 UNION ALL SELECT doc_id, page, 0, 0, 0, ys[i:i + 5] FROM (SELECT *, unnest(range(1, len(ys) - 4)) AS i FROM p)),
s AS (SELECT *, list_sort(list_transform(range(1, 6), lambda x: g[x + 1] - g[x]))[3] AS m FROM q), u AS (SELECT *, list_avg(list_transform(range(1, 6), lambda x: abs(g[x + 1] - g[x] - m))) / m AS r FROM s WHERE phase = 1 OR m BETWEEN 4 AND 80),
k AS (SELECT doc_id, page, phase, g, CAST(m AS DOUBLE) AS m, r, row_number() OVER (PARTITION BY doc_id, page ORDER BY phase, CASE WHEN phase = 0 THEN g[1] ELSE r END, CASE WHEN phase = 0 THEN r ELSE g[1] END, i, j) AS k FROM u WHERE r <= 0.2),
z AS (SELECT doc_id, page, k, [{{'g': g, 'm': m, 'r': r, 'p': phase}}] AS kept FROM k WHERE k = 1 UNION ALL SELECT k.doc_id, k.page, k.k, CASE WHEN len(list_filter(kept, lambda x: NOT (k.g[6] < x.g[1] OR k.g[1] > x.g[6]))) = 0 THEN list_append(kept, {{'g': k.g, 'm': k.m, 'r': k.r, 'p': k.phase}}) ELSE kept END FROM z JOIN k ON k.doc_id = z.doc_id AND k.page = z.page AND k.k = z.k + 1),
o AS (SELECT doc_id, page, unnest(arg_max(kept, k)) AS x FROM z GROUP BY doc_id, page)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY x.g[1]) - 1 AS INT) AS "group", CAST(x.g[1] AS DOUBLE) AS first, CAST(x.g[6] AS DOUBLE) AS last, x.m AS spacing, round(x.r, 6) AS irregularity, x.p = 1 AS recovered FROM o""")
def w11_line_groups(spark, d):
    g = W.line_groups(_centres(spark, d), ["doc_id", "page"])
    return g.select("doc_id", "page", "group", c("lines")[0].alias("first"), c("lines")[5].alias("last"), "spacing", F.round("irregularity", 6).alias("irregularity"), "recovered")


@query(f"""WITH c AS (SELECT l_suppkey AS doc_id, l_returnflag || l_linestatus AS page, (l_orderkey % 50) * 20 + l_linenumber % 3 AS y, max(l_quantity)::DOUBLE AS s FROM lineitem GROUP BY ALL), p AS (SELECT doc_id, page, list(y ORDER BY y) AS ys FROM c GROUP BY ALL),
e1 AS (SELECT doc_id, page, i, j, ys[i] AS one, ys[j] - ys[i] AS gap, ys[j] AS stop, [ys[i], ys[j]] AS g FROM (SELECT *, unnest(range(i + 1, len(ys) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS i FROM p)) WHERE ys[j] - ys[i] BETWEEN 5 AND 50),
{GROWN.replace("SLACK", "2.0").replace("SHARE", "0.28")}
q AS (SELECT doc_id, page, i, j, g FROM e5), s AS (SELECT *, list_sort(list_transform(range(1, 6), lambda x: g[x + 1] - g[x]))[3] AS m FROM q), u AS (SELECT *, list_avg(list_transform(range(1, 6), lambda x: abs(g[x + 1] - g[x] - m))) / m AS r FROM s),
v AS (SELECT u.doc_id, u.page, i, j, avg(c.s) - 80 * any_value(r) AS score FROM (SELECT *, unnest(g) AS one_y FROM u WHERE r <= 0.22) u JOIN c ON c.doc_id = u.doc_id AND c.page = u.page AND c.y = u.one_y GROUP BY ALL)
SELECT doc_id, page, round(max(score), 6) AS score FROM v GROUP BY ALL""")
def w11_best_line_group(spark, d):
    return W.best_line_group(_centres(spark, d), ["doc_id", "page"], 6, 200.0).select("doc_id", "page", F.round("score", 6).alias("score"))


@query(f"""WITH {NOTES}, p AS (SELECT measure, q, ix, 0.8 + (fret % 10) / 50.0 AS share, 0.85 + (string % 3) / 20.0 AS run, q % 4 AS below FROM notes), k AS (SELECT *, share >= 0.86 AND run >= 0.9 AS weak, share >= 0.86 AND run >= 0.9 AND below <= 2.0 AS ok FROM p), h AS (SELECT *, sum(ok::INT) OVER (PARTITION BY measure) AS n FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY measure, q ORDER BY ix) AS same FROM h WHERE ok OR (n < 3 AND weak)), g AS (SELECT *, lag(q) OVER (PARTITION BY measure ORDER BY q, same) AS was FROM f), i AS (SELECT *, sum(CASE WHEN q - was <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY measure ORDER BY q, same ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT measure, round(avg(q), 6) AS x FROM i GROUP BY measure, island""")
def w26_bar_candidates(spark, d):
    p = notes(spark, d).select("measure", c("q").alias("x"), (F.lit(0.8) + (c("fret") % 10) / 50.0).alias("share"), (F.lit(0.85) + (c("string") % 3) / 20.0).alias("run"), (c("q") % 4).alias("below"))
    return W.bar_candidates(p, ["measure"], 4.0).select("measure", F.round("x", 6).alias("x"))


@query(f"""WITH {NOTES}, g AS (SELECT measure, CASE WHEN fret % 2 = 0 THEN 'dark_on_light' ELSE 'light_on_dark' END AS polarity, 5 + (q % 2) AS lines, onset64 * 2 AS top, onset64 * 2 + 10 AS bottom, 2.0 + q % 3 AS spacing, price AS score FROM notes),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY (polarity = CASE WHEN measure % 256 >= 128 THEN 'dark_on_light' ELSE 'light_on_dark' END)::INT DESC, score DESC, top) AS k FROM g WHERE lines = 6) WHERE k = 1),
f AS (SELECT DISTINCT b.measure FROM b JOIN g ON b.measure = g.measure AND g.lines = 5 AND g.polarity = b.polarity AND g.bottom < b.top AND g.spacing BETWEEN 0.6 * b.spacing AND 1.6 * b.spacing AND b.top - g.bottom <= 14 * b.spacing)
SELECT b.measure, CASE WHEN f.measure IS NOT NULL THEN 'staff_tab_pair' ELSE 'tab_only' END AS layout, b.polarity, b.top, b.bottom FROM b LEFT JOIN f USING (measure)""")
def w27_choose_layout(spark, d):
    n = notes(spark, d)
    g = n.select("measure", F.when(c("fret") % 2 == 0, "dark_on_light").otherwise("light_on_dark").alias("polarity"), (5 + c("q") % 2).alias("lines"), (c("onset64") * 2).alias("top"), (c("onset64") * 2 + 10).alias("bottom"), (2.0 + c("q") % 3).alias("spacing"), c("price").alias("score"))
    return W.choose_layout(g.withColumn("background", c("measure") % 256), ["measure", "background"], c("background")).drop("background")


# -- signal ----------------------------------------------------------------------------------------------------

@query(f"""WITH RECURSIVE {POINTS}, n AS (SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) - 1 AS INT) AS i, CAST(value AS DOUBLE) AS v FROM points),
l AS (SELECT score_id, list(v ORDER BY i) AS v, CAST(count(*) AS INT) AS n, quantile_cont(v, 0.58) FILTER (v > 0) AS q FROM n GROUP BY score_id),
k AS (SELECT n.score_id, n.i, row_number() OVER (PARTITION BY n.score_id ORDER BY n.v DESC, n.i) AS k FROM n JOIN l USING (score_id) WHERE n.i >= 8 AND n.i < l.n - 8 AND n.v >= l.q),
g AS (SELECT score_id, CAST(0 AS BIGINT) AS k, [0] AS b FROM l UNION ALL SELECT g.score_id, k.k, CASE WHEN len(b) < 8 AND list_min(list_transform(b, lambda x: abs(x - k.i))) >= 8 THEN list_append(b, k.i) ELSE b END FROM g JOIN k ON k.score_id = g.score_id AND k.k = g.k + 1),
c AS (SELECT score_id, list_sort(list_append(arg_max(b, k), any_value(n))) AS b FROM g JOIN l USING (score_id) GROUP BY score_id),
w AS (SELECT score_id, 0 AS t, b FROM c UNION ALL SELECT score_id, t + 1, CASE WHEN len(b) <= 8 AND x.n > 28 THEN list_sort(list_append(b, -list_sort(list_transform(range(x.a + 8, x.z - 7), lambda i: {{'v': l.v[i + 1], 'i': CAST(-i AS INT)}}), 'DESC')[1].i)) ELSE b END
 FROM (SELECT score_id, t, b, list_sort(list_transform(range(1, len(b)), lambda i: {{'n': b[i + 1] - b[i], 'a': b[i], 'z': b[i + 1]}}), 'DESC')[1] AS x FROM w WHERE t < 8) JOIN l USING (score_id)),
e AS (SELECT score_id, b, unnest(range(1, len(b))) AS j FROM w WHERE t = 8) SELECT score_id, b[j] AS start, b[j + 1] AS "end" FROM e""")
def t15_boundaries(spark, d):
    order = Window.partitionBy("score_id").orderBy("us", "event_id")
    p = points(spark, d).withColumn("segment", (F.row_number().over(order) - 1).cast("int"))
    return T.section_boundaries(p, ["score_id"], "segment", "value")


@query(f"WITH {POINTS}, n AS (SELECT score_id, event_id, row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) - 1 AS i, abs(value) AS v, max(abs(value)) OVER (PARTITION BY score_id) AS top FROM points) SELECT event_id, round(CASE WHEN i = 0 THEN 0.35 ELSE least(0.95, 0.35 + v / (top + 1e-8) * 0.6) END, 3) AS confidence FROM n")
def t16_boundary_confidence(spark, d):
    w = Window.partitionBy("score_id")
    p = points(spark, d).withColumn("i", F.row_number().over(w.orderBy("us", "event_id")) - 1).withColumn("v", F.abs("value")).withColumn("top", F.max(F.abs("value")).over(w))
    return p.select("event_id", T.boundary_confidence(c("i"), c("v"), c("top")).alias("confidence"))


# -- edits -----------------------------------------------------------------------------------------------------

@query("SELECT s_suppkey AS score_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(60 + s_suppkey % 90 AS DOUBLE) ELSE 100.0 END AS tempo_bpm, CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'visual' END AS tempo_source, s_suppkey % 2 = 0 AS tempo_locked, '<sound tempo=\"' || CASE WHEN s_suppkey % 2 = 0 THEN printf('%.1f', CAST(60 + s_suppkey % 90 AS DOUBLE)) ELSE '100.0' END || '\"/>' AS xml FROM supplier")
def u5_lock_tempo(spark, d):
    p = table(spark, d, "supplier").select(c("s_suppkey").alias("score_id"), F.lit(100.0).alias("tempo_bpm"), F.lit("visual").alias("tempo_source"), F.lit(False).alias("tempo_locked"), F.lit('<sound tempo="100.0"/>').alias("xml"))
    locks = p.filter("score_id % 2 = 0").select("score_id", (60 + c("score_id") % 90).cast("double").alias("tempo_bpm"))
    return U.lock_tempo(p, locks)


@query(f"WITH {NOTES} SELECT {IDS}, CASE WHEN flag = 'R' AND q > 10 THEN 0 ELSE fret END AS fret, CASE WHEN flag = 'R' AND q > 10 THEN 1 ELSE string END AS string FROM notes")
def u8_update_when(spark, d):
    return U.update_when(notes(spark, d).select(*ID, "fret", "string", "flag", "q"), (c("flag") == "R") & (c("q") > 10), fret=F.lit(0), string=F.lit(1)).select(*ID, "fret", "string")


@query(f"""WITH RECURSIVE {NOTES}, ev AS (SELECT measure, list({{'o': CAST(onset64 AS INT), 'd': CAST(least(duration64, 12) AS INT), 's': [string]}} ORDER BY onset64) AS e FROM notes WHERE ix % 2 = 1 GROUP BY measure),
ins AS (SELECT measure, CAST(6 * (fret % 12) AS INT) AS at, string AS s, row_number() OVER (PARTITION BY measure ORDER BY fret % 12, string, fret, ix) AS k FROM notes WHERE flag = 'R' AND fret % 12 > 0),
r AS (SELECT measure, CAST(0 AS BIGINT) AS k, e FROM ev UNION ALL SELECT r.measure, i.k, CASE WHEN len(list_filter(e, lambda x: x.o = i.at)) > 0 THEN list_transform(e, lambda x: CASE WHEN x.o = i.at THEN {{'o': x.o, 'd': x.d, 's': list_append(list_filter(x.s, lambda t: t <> i.s), i.s)}} ELSE x END)
 ELSE list_append(list_transform(e, lambda x: CASE WHEN x.o < i.at AND x.o + x.d > i.at THEN {{'o': x.o, 'd': i.at - x.o, 's': x.s}} ELSE x END), {{'o': i.at, 'd': least(8, coalesce(list_min(list_transform(list_filter(e, lambda x: x.o > i.at), lambda x: x.o)) - i.at, 8)), 's': [i.s]}}) END FROM r JOIN ins i ON i.measure = r.measure AND i.k = r.k + 1),
z AS (SELECT measure, unnest(arg_max(e, k)) AS x FROM r GROUP BY measure)
SELECT measure, x.o AS onset64, x.d AS duration64, array_to_string(x.s, ',') AS strings FROM z""")
def u11_insert_notes(spark, d):
    n = notes(spark, d)
    note = F.struct(c("string"), c("fret"), F.lit(None).cast("string").alias("technique"))
    events = n.filter("ix % 2 = 1").select("measure", "onset64", F.least("duration64", F.lit(12)).alias("duration64"), F.lit(False).alias("rest"), F.array(note).alias("notes"))
    inserts = n.filter("flag = 'R' and fret % 12 > 0").select("measure", (6 * (c("fret") % 12)).alias("at64"), "string", "fret", F.lit(8).alias("length64"))
    out = U.insert_notes(events, inserts.join(events.select("measure").distinct(), "measure", "left_semi"), ["measure"])
    return out.select("measure", "onset64", "duration64", F.array_join(F.transform("notes", lambda x: x["string"].cast("string")), ",").alias("strings"))


@query(f"""WITH {NOTES} SELECT measure, onset64, CASE WHEN flag = 'R' AND string <= 3 THEN 1 ELSE 2 END - CASE WHEN flag = 'R' AND string = 3 THEN 1 ELSE 0 END AS left_notes, flag = 'R' AND string = 3 AS rest FROM notes""")
def u12_delete_notes(spark, d):
    n = notes(spark, d)
    made = lambda s: F.struct(s.cast("int").alias("string"), c("fret").alias("fret"))
    events = n.select("measure", "onset64", F.lit(False).alias("rest"), F.array(made(c("string")), made(6 - c("string"))).alias("notes"))
    deletes = n.filter("flag = 'R' and string <= 3").select("measure", "onset64", F.array("string").alias("strings"))
    return U.delete_notes(events, deletes, ["measure"]).select("measure", "onset64", F.size("notes").alias("left_notes"), "rest")


@query(f"""WITH {NOTES}, m AS (SELECT *, string + CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS s, onset64 + CASE WHEN flag = 'R' THEN 12 ELSE 0 END AS o FROM notes), b AS (SELECT *, (count(*) OVER (PARTITION BY measure, o, s) > 1 OR s NOT BETWEEN 1 AND 6 OR o < 0)::INT AS bad FROM m), a AS (SELECT *, max(bad) OVER (PARTITION BY measure) AS any_bad FROM b)
SELECT measure, ix, CASE WHEN any_bad = 0 THEN s ELSE string END AS string, CASE WHEN any_bad = 0 THEN o ELSE onset64 END AS onset64 FROM a""")
def u16_move_notes(spark, d):
    return U.move_notes(notes(spark, d), ["measure"], c("flag") == "R", 1, 12).select("measure", "ix", "string", "onset64")


@query(f"""WITH {NOTES}, l AS (SELECT *, CASE WHEN q % 2 = 0 THEN ix + 1 WHEN q % 3 = 0 THEN ix + 2 END AS link, lead(ix) OVER (PARTITION BY measure, string ORDER BY ix) AS nxt FROM notes)
SELECT measure, ix AS note_id, CASE WHEN link IS NULL OR nxt = link THEN flag END AS technique, CASE WHEN nxt = link THEN link END AS link_to FROM l""")
def u17_prune_links(spark, d):
    link = F.when(c("q") % 2 == 0, c("ix") + 1).when(c("q") % 3 == 0, c("ix") + 2)
    n = notes(spark, d).select("measure", "string", c("ix").alias("note_id"), c("flag").alias("technique"), link.alias("link_to"))
    return U.prune_links(n, ["measure"], ["note_id"]).select("measure", "note_id", "technique", "link_to")


@query(f"""WITH {NOTES}, w AS (SELECT DISTINCT score_id, q AS number FROM notes WHERE flag = 'A'), f AS (SELECT score_id, measure AS frame_id, min(fret) AS a, count(*) AS n FROM notes GROUP BY ALL), v AS (SELECT w.*, frame_id FROM w JOIN f ON w.score_id = f.score_id AND w.number >= a AND w.number < a + n),
k AS (SELECT score_id, q AS number, measure AS frame_id, max(price) AS quality, max(status) AS signature FROM notes GROUP BY ALL), b AS (SELECT * FROM (SELECT v.score_id, v.number, v.frame_id, signature, row_number() OVER (PARTITION BY v.score_id, v.number ORDER BY quality DESC, signature DESC, v.frame_id DESC) AS r FROM v JOIN k USING (score_id, number, frame_id)) WHERE r = 1)
SELECT w.score_id, w.number, b.frame_id, b.signature, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.score_id = w.score_id AND v.number = w.number) THEN 'not_covered' WHEN b.frame_id IS NULL THEN 'no_candidate' END AS reason FROM w LEFT JOIN b ON b.score_id = w.score_id AND b.number = w.number""")
def u19_propose_measure(spark, d):
    n = notes(spark, d)
    frames = n.groupBy("score_id", c("measure").alias("frame_id")).agg(F.min("fret").alias("start_measure"), F.count("*").alias("measures"))
    found = n.groupBy("score_id", c("q").alias("number"), c("measure").alias("frame_id")).agg(F.max("price").alias("quality"), F.max("status").alias("signature"))
    return U.propose_measure(frames, found, n.filter("flag = 'A'").select("score_id", c("q").alias("number")).distinct())


@query("SELECT s_suppkey AS score_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new.MP3' ELSE 'old.wav' END AS audio_path, CASE WHEN s_suppkey % 3 <> 0 THEN 'done' END AS audio_analysis FROM supplier")
def u21_replace_audio(spark, d):
    p = table(spark, d, "supplier").select(c("s_suppkey").alias("score_id"), F.lit("old.wav").alias("audio_path"), F.lit("done").alias("audio_analysis"))
    path = F.when(c("score_id") % 3 == 0, "new.MP3").otherwise("new.txt")
    return U.replace_audio(p, p.filter("score_id % 3 < 2").select("score_id", path.alias("path")))


@query("SELECT s_suppkey AS score_id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_acctbal AS VARCHAR) ELSE s_name END AS recognition_summary, CASE WHEN s_suppkey % 4 = 0 THEN 'ready' ELSE 'waiting' END AS status_message FROM supplier")
def u23_commit_summary(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "score_id")
    new = s.filter("score_id % 4 = 0").select("score_id", c("s_acctbal").cast("string").alias("recognition_summary"), F.lit("ready").alias("status_message"))
    return U.commit_summary(s.select("score_id", c("s_name").alias("recognition_summary"), F.lit("waiting").alias("status_message")), new)

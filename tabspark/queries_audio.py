"""Registered queries of the tempo, beat, section and alignment operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import signal as T
from .queries import POINTS, c, points, query, table

RATE = 11025 / 512  # frames a second


def _series(spark, d):
    """Points of a score as a novelty series: position from 0, value."""
    order = Window.partitionBy("score_id").orderBy("us", "event_id")
    return points(spark, d).select("score_id", (F.row_number().over(order) - 1).alias("frame_ix"), c("value").cast("double").alias("novelty"))


X = f"""{POINTS}, x AS (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) - 1 AS i, CAST(value AS DOUBLE) AS v FROM points),
own AS (SELECT score_id, avg(v) AS mean, var_pop(v) * count(*) + 1e-8 AS energy, count(*) AS n, least(count(*) - 1, 23) AS high FROM x GROUP BY score_id),
k AS (SELECT score_id, i, v - mean AS c FROM x JOIN own USING (score_id))"""

# plan says the kind of each score (free, locked or short) and its expected tempo; the rest follows from it.
TEMPO = f"""coarse AS (SELECT a.score_id, lag, sum(a.c * b.c) / any_value(energy) AS r, any_value(expected) AS expected FROM plan p, range(6, 24) g(lag), k a, k b WHERE p.kind = 'free' AND lag <= p.high AND a.score_id = p.score_id AND b.score_id = p.score_id AND a.i = b.i + lag GROUP BY a.score_id, lag),
best AS (SELECT score_id, arg_max(lag, (r * CASE WHEN expected IS NOT NULL THEN exp(-2.4 * abs(log2(60 * {RATE} / lag / expected))) WHEN 60 * {RATE} / lag < 75 THEN 0.88 ELSE 1 END, -lag)) AS lag FROM coarse GROUP BY score_id),
ends AS (SELECT score_id, greatest(6.0, lag - 1)::DOUBLE AS a, least(high, lag + 1)::DOUBLE AS z FROM best JOIN plan USING (score_id)),
lags AS (SELECT score_id, CASE WHEN j = 80 THEN z ELSE a + j * ((z - a) / 80) END AS lag FROM ends, range(81) g(j) UNION ALL SELECT score_id, 60 * {RATE} / expected FROM plan WHERE kind = 'locked'),
pos AS (SELECT score_id, lag, i, c, i - lag AS spot, CAST(floor(i - lag) AS BIGINT) AS lo FROM lags JOIN k USING (score_id) WHERE i >= ceil(lag)),
fine AS (SELECT l.score_id, l.lag, coalesce(sum(pos.c * (a.c + (pos.spot - pos.lo) * (b.c - a.c))), 0) / any_value(p.energy) AS r, any_value(p.expected) AS expected FROM lags l JOIN plan p ON p.score_id = l.score_id LEFT JOIN pos ON pos.score_id = l.score_id AND pos.lag = l.lag LEFT JOIN k a ON a.score_id = pos.score_id AND a.i = pos.lo LEFT JOIN k b ON b.score_id = pos.score_id AND b.i = pos.lo + 1 GROUP BY l.score_id, l.lag),
kept AS (SELECT score_id, arg_max(lag, (s, -lag)) AS lag, arg_max(r, (s, -lag)) AS r FROM (SELECT *, r * CASE WHEN expected IS NOT NULL THEN exp(-2.4 * abs(log2(60 * {RATE} / lag / expected))) ELSE 1 END AS s FROM fine) GROUP BY score_id),
phases AS (SELECT score_id, lag, unnest(list_transform(range(0, CAST(greatest(16, round_even(lag * 8, 0)) AS INT)), lambda j: j * (lag / greatest(16, round_even(lag * 8, 0))))) AS phase FROM kept),
comb AS (SELECT score_id, phase, phase + unnest(range(0, CAST(ceil((n - phase) / lag) AS INT) + 1)) * lag AS spot, n FROM phases JOIN own USING (score_id)),
sums AS (SELECT comb.score_id, phase, sum(a.v + (spot - floor(spot)) * (coalesce(b.v, a.v) - a.v)) AS s FROM comb JOIN x a ON a.score_id = comb.score_id AND a.i = CAST(floor(spot) AS BIGINT) LEFT JOIN x b ON b.score_id = comb.score_id AND b.i = CAST(floor(spot) AS BIGINT) + 1 WHERE spot < n GROUP BY comb.score_id, phase),
beat AS (SELECT score_id, arg_max(phase, (round(s, 9), phase)) AS phase FROM sums GROUP BY score_id)
SELECT score_id, round(CASE kind WHEN 'free' THEN 60 * {RATE} / lag ELSE coalesce(expected, 120) END, 5) AS tempo_bpm, round(coalesce(least(0.96, greatest(0.0, r * 2.2)), 0), 5) AS confidence, round(coalesce(phase, 0) / {RATE}, 5) AS phase_seconds FROM plan LEFT JOIN kept USING (score_id) LEFT JOIN beat USING (score_id)"""


def _tempo(spark, d, hints=None):
    found = T.estimate_tempo(_series(spark, d), ["score_id"], hints=hints)
    return found.select("score_id", *(F.round(x, 5).alias(x) for x in ("tempo_bpm", "confidence", "phase_seconds")))


@query(f"WITH {X}, plan AS (SELECT *, NULL::DOUBLE AS expected, CASE WHEN high <= 6 THEN 'short' ELSE 'free' END AS kind FROM own), {TEMPO}")
def t9_t10_free_tempo(spark, d):
    return _tempo(spark, d)


@query(f"""WITH {X}, hint AS (SELECT own.*, CASE WHEN score_id % 4 > 0 THEN (40 + score_id * 7 % 180)::DOUBLE END AS expected, score_id % 4 = 2 AS locked FROM own),
plan AS (SELECT *, CASE WHEN locked THEN 'locked' WHEN high <= 6 THEN 'short' ELSE 'free' END AS kind FROM hint), {TEMPO}""")
def t9_t11_hinted_tempo(spark, d):
    scores = points(spark, d).select("score_id").distinct()
    hints = scores.select("score_id", F.when(c("score_id") % 4 > 0, 40 + c("score_id") * 7 % 180).cast("double").alias("expected"), (c("score_id") % 4 == 2).alias("locked"))
    return _tempo(spark, d, hints)


@query(f"""WITH {X}, q AS (SELECT score_id, greatest(1e-5, quantile_cont(abs(v), 0.85) * 0.12) AS t FROM x GROUP BY score_id), a AS (SELECT x.score_id, coalesce(min(CASE WHEN abs(v) >= t THEN i END) / {RATE}, 0) AS active, 60.0 / (50 + x.score_id % 100) AS p, (x.score_id % 11) / 10.0 AS phase FROM x JOIN q USING (score_id) GROUP BY x.score_id),
f AS (SELECT *, phase + greatest(0, floor((active - phase) / p)) * p AS first, greatest(0.0, active - p) AS low FROM a), g AS (SELECT *, greatest(0.0, first - greatest(0, floor((first - low) / p)) * p) AS first_beat FROM f)
SELECT score_id, k AS beat, round(first_beat + k * p, 3) AS t FROM (SELECT *, unnest(generate_series(0, CAST(floor((9.5 - first_beat) / p) AS BIGINT))) AS k FROM g WHERE first_beat <= 9.5)""")
def t12_active_beats(spark, d):
    x = _series(spark, d).withColumn("rms", F.abs("novelty"))
    plan = T.active_start(x, ["score_id"]).select("score_id", "active_start", (50.0 + c("score_id") % 100).alias("tempo_bpm"), ((c("score_id") % 11) / 10.0).alias("phase"), F.lit(9.5).alias("duration"))
    return T.beat_grid(plan).select("score_id", c("beat").cast("long").alias("beat"), "t")


FEATURES = """f AS (SELECT label AS score_id, vec_id * 0.0625 AS t, abs(CAST(embedding[1] AS DOUBLE)) AS rms, abs(CAST(embedding[2] AS DOUBLE)) AS novelty, list_transform(embedding[3:14], lambda x: abs(CAST(x AS DOUBLE))) AS chroma FROM embeddings),
dur AS (SELECT score_id, max(t) + 0.0625 AS duration, quantile_cont(rms, 0.9) + 1e-8 AS scale FROM f GROUP BY score_id),
s AS (SELECT score_id, duration, unnest(CASE WHEN score_id % 3 = 1 THEN list_filter(list_concat([0.0::DOUBLE], list_transform(range(0, CAST(ceil(duration) AS INT)), lambda k: 0.25 + k * 1.5)), lambda x: x < duration) ELSE list_transform(range(0, CAST(ceil(duration / 2) AS INT)), lambda k: k * 2.0) END) AS start FROM dur),
e AS (SELECT score_id, row_number() OVER w - 1 AS segment, start, coalesce(lead(start) OVER w, duration) AS stop FROM s WINDOW w AS (PARTITION BY score_id ORDER BY start)),
m AS (SELECT e.score_id, segment, avg(rms) AS r, avg(novelty) AS a, stddev_pop(novelty) AS d, list_transform(range(1, 13), lambda i: list_avg(list_transform(list(chroma), lambda c: c[i]))) AS c FROM e JOIN f ON f.score_id = e.score_id AND f.t >= start AND f.t < stop GROUP BY e.score_id, segment),
v AS (SELECT e.score_id, e.segment, CASE WHEN r IS NULL THEN list_transform(range(15), lambda i: 0.0::DOUBLE) ELSE list_concat(list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8)), [r / scale * 0.72, a * 0.85, d * 0.85]) END AS feature FROM e JOIN dur USING (score_id) LEFT JOIN m ON m.score_id = e.score_id AND m.segment = e.segment)"""


def _features(spark, d):
    """Rows of a label as frames of a recording of 16 a second; a third of them have beats, three eighths of a second
    apart from 0.25 s on, the others are cut every 2 s."""
    e = table(spark, d, "embeddings")
    of = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    frames = e.select(c("label").alias("score_id"), (c("vec_id") * 0.0625).alias("t"), of(0).alias("rms"), of(1).alias("novelty"), F.transform(F.slice("embedding", 3, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))
    durations = frames.groupBy("score_id").agg((F.max("t") + 0.0625).alias("duration"))
    beats = durations.filter("score_id % 3 = 1").select("score_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((c("duration") - 0.26) / 0.375).cast("int")), lambda k: 0.25 + k * 0.375)).alias("beat", "t"))
    return T.segment_features(frames, T.segment_edges(beats, durations, ["score_id"]), ["score_id"])


@query(f"WITH {FEATURES} SELECT score_id, segment, unnest(range(15)) AS place, round(unnest(feature), 6) AS value FROM v")
def t13_segment_features(spark, d):
    return _features(spark, d).select("score_id", c("segment").cast("long").alias("segment"), F.posexplode("feature").alias("place", "value")).select("score_id", "segment", c("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(f"""WITH {FEATURES}, w AS (SELECT score_id, segment, feature AS f, lag(feature) OVER o AS b, lag(feature, 2) OVER o AS a, lead(feature) OVER o AS n, lead(feature, 2) OVER o AS m FROM v WINDOW o AS (PARTITION BY score_id ORDER BY segment))
SELECT score_id, segment, round(CASE WHEN a IS NULL OR m IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(range(1, 16), lambda i: pow((a[i] + b[i]) / 2 - (f[i] + n[i]) / 2, 2)))) END, 6) AS novelty FROM w""")
def t14_feature_novelty(spark, d):
    return T.segment_novelty(_features(spark, d), ["score_id"], "segment").select("score_id", c("segment").cast("long").alias("segment"), F.round("segment_novelty", 6).alias("novelty"))


@query("""WITH RECURSIVE sc AS (SELECT s_suppkey AS score_id, s_suppkey % 3 > 0 AS video, coalesce(nullif(s_suppkey % 4, 0), 1) AS a, CASE WHEN s_suppkey % 5 = 0 THEN 12 + s_suppkey % 9 ELSE 10 + s_suppkey % 50 END AS z, coalesce(nullif(s_suppkey % 6, 0), 0) * 0.25::DOUBLE AS o, 240.0::DOUBLE / (60 + s_suppkey % 120) AS p, 30.0::DOUBLE + s_suppkey % 60 AS d FROM supplier),
sec AS (SELECT s_suppkey AS score_id, k, k * (14.0::DOUBLE + s_suppkey % 7) AS spot, ['A', 'B', 'A', ''][k + 1] AS name FROM supplier, range(4) g(k) WHERE s_suppkey % 8 > 0),
vis AS (SELECT score_id, m, t, row_number() OVER (PARTITION BY score_id ORDER BY m, t) AS k, count(*) OVER (PARTITION BY score_id) AS n FROM (SELECT l_suppkey AS score_id, l_partkey % 80 AS m, (l_orderkey % 1000) / 10.0::DOUBLE AS t FROM lineitem WHERE l_suppkey % 7 > 0 OR l_orderkey % 500 = 3) JOIN sc USING (score_id) WHERE video AND z > a AND m BETWEEN a AND z),
rec AS (SELECT score_id, k, m AS last, true AS taken FROM vis WHERE k = 1 UNION ALL SELECT v.score_id, v.k, CASE WHEN v.k = v.n OR v.m - last >= 8 THEN v.m ELSE last END, v.k = v.n OR v.m - last >= 8 FROM rec JOIN vis v ON v.score_id = rec.score_id AND v.k = rec.k + 1),
video AS (SELECT score_id, m, t, 0.88 AS confidence, 'video_highlight' AS basis FROM rec JOIN vis USING (score_id, k) WHERE taken), cnt AS (SELECT score_id, count(*) AS n, max(m) AS m FROM video GROUP BY score_id),
op AS (SELECT sc.*, m AS v FROM sc LEFT JOIN cnt USING (score_id) WHERE z > a AND coalesce(n, 0) < 2), grid AS (SELECT score_id, m, o + (m - a) * p AS t, 0.62, 'audio_beat_grid' FROM (SELECT *, unnest(generate_series(a, z, 8)) AS m FROM op) WHERE o + (m - a) * p <= d),
ending AS (SELECT op.score_id, z, o + (z - a) * p, 0.58, 'audio_beat_grid' FROM op LEFT JOIN (SELECT score_id, max(m) AS g FROM grid GROUP BY score_id) USING (score_id) WHERE coalesce(g, v) <> z AND o + (z - a) * p <= d),
rows_ AS (SELECT * FROM video UNION ALL SELECT * FROM grid UNION ALL SELECT * FROM ending),
near AS (SELECT r.score_id, r.m, r.t, r.confidence, arg_min(name, (abs(round(spot, 3) - r.t), k)) AS name FROM (SELECT DISTINCT score_id, m, t, confidence FROM rows_) r JOIN sec USING (score_id) GROUP BY ALL)
SELECT r.score_id, CAST(r.m AS INT) AS measure_number, round(r.t, 3) AS time_seconds, round_even((r.m - a)::DOUBLE / (z - a), 5) AS score_position, CASE WHEN r.confidence = 0.58 THEN '自动 · 结尾' WHEN coalesce(name, '') <> '' THEN '自动 · ' || name WHEN basis = 'video_highlight' THEN '自动 · 视频高亮' ELSE '自动 · 节拍网格' END AS label, r.confidence::DOUBLE AS confidence, basis
FROM rows_ r JOIN sc USING (score_id) LEFT JOIN near ON near.score_id = r.score_id AND near.m = r.m AND near.t = r.t AND near.confidence = r.confidence""")
def t17_t18_suggestions(spark, d):
    k = c("s_suppkey")
    supplier, ints = table(spark, d, "supplier"), lambda x: x.cast("int")
    scores = supplier.select(k.alias("score_id"), F.when(k % 3 > 0, "video_audio").otherwise("audio").alias("source_kind"), ints(k % 4).alias("start_measure"), F.when(k % 5 == 0, 0).otherwise(ints(10 + k % 50)).alias("end_measure"), ints(12 + k % 9).alias("measure_count"), F.when(k % 6 > 0, (k % 6) * 0.25).alias("first_beat"), (60.0 + k % 120).alias("tempo_bpm"), (30.0 + k % 60).alias("duration"))
    sections = supplier.filter(k % 8 > 0).select(k.alias("score_id"), F.explode(F.transform(F.array(*map(F.lit, "ABA"), F.lit("")), lambda x, i: F.struct((i * (14.0 + k % 7)).alias("start_seconds"), x.alias("label")))).alias("x")).select("score_id", "x.*")
    visual = table(spark, d, "lineitem").filter("l_suppkey % 7 > 0 or l_orderkey % 500 = 3").select(c("l_suppkey").alias("score_id"), (c("l_partkey") % 80).alias("measure_number"), ((c("l_orderkey") % 1000) / 10.0).alias("time_seconds"))
    return T.suggest_alignment(scores, sections, visual)

"""Registered queries: each applies operators of the library to the given tables, with SQL that says the same.

``notes`` reads line items as notes (supplier = score, order = measure, running number = event), ``points`` reads
events as points in time of a score (user), ``corpus`` reads documents as corpus rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggs as A, edits as U, joins as J, seq as W, signal as T
from .streaming import forms as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TASK_ROWS = 500_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The table by a key in tasks of about TASK_ROWS rows, where the session's shuffle partitions would hold more: what a
    task sorts doesn't grow with the table. The count reads the files' footers only."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def notes(spark: SparkSession, d: str, by: str = "l_orderkey") -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    q = c("l_quantity").cast("int")
    return dealt(table(spark, d, "lineitem"), by).select(
        c("l_suppkey").alias("score_id"), c("l_orderkey").alias("measure"), F.row_number().over(w).alias("ix"), (4 * (1 + q % 8)).alias("duration64"), (1 + c("l_partkey") % 6).cast("int").alias("string"), (c("l_partkey") % 37).cast("int").alias("fret"),
        c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"), q.alias("q"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"),
    ).withColumn("onset64", (c("ix") - 1) * 12)


NOTES = """n AS (SELECT l_suppkey AS score_id, l_orderkey AS measure, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS ix,
 4 * (1 + CAST(l_quantity AS INT) % 8) AS duration64, CAST(1 + l_partkey % 6 AS INT) AS string, CAST(l_partkey % 37 AS INT) AS fret, l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS INT) AS q, l_extendedprice AS price, l_discount AS discount FROM lineitem),
notes AS (SELECT *, (ix - 1) * 12 AS onset64 FROM n)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(c("ts").cast("timestamp"))
    return table(spark, d, "events").select(c("user_id").alias("score_id"), "event_id", us.alias("us"), (us / 1e6).alias("t"), c("event_type").alias("kind"), c("value").alias("value"), "props")


POINTS = "points AS (SELECT user_id AS score_id, event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, event_type AS kind, value, props FROM events)"


# -- scalars ---------------------------------------------------------------------------------------------------

@query(f"WITH {NOTES} SELECT score_id, measure, ix, 8.0 / (1 << (q % 6)) * CASE q % 3 WHEN 1 THEN 1.5 WHEN 2 THEN 1.75 ELSE 1.0 END AS units FROM notes")
def m1_written_to_units(spark, d):
    n = notes(spark, d)
    return n.select("score_id", "measure", "ix", S.written_to_units(F.pow(F.lit(2), c("q") % 6), c("q") % 3).alias("units"))


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN duration64 IN (8, 12) THEN 'eighth' WHEN duration64 IN (16, 24, 28) THEN 'quarter' WHEN duration64 = 32 THEN 'half' WHEN duration64 = 4 THEN '16th' ELSE 'eighth' END AS name,
CASE WHEN duration64 IN (12, 24) THEN 1 WHEN duration64 = 28 THEN 2 ELSE 0 END AS dots FROM notes""")
def m2_notation(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.notation_of(c("duration64")).alias("x")).select("score_id", "measure", "ix", "x.*")


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN duration64 IN (4, 8, 16, 32) THEN duration64 WHEN duration64 = 12 THEN 8 WHEN duration64 = 24 THEN 16 WHEN duration64 = 28 THEN 16 END AS base,
CASE WHEN duration64 IN (4, 8, 16, 32) THEN 0 WHEN duration64 IN (12, 24) THEN 1 WHEN duration64 = 28 THEN 2 END AS dots FROM notes""")
def m3_duration_shape(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.duration_shape(c("duration64")).alias("x")).select("score_id", "measure", "ix", "x.base", "x.dots")


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CAST((ix - 1) // 4 + 1 AS VARCHAR) || CASE (ix - 1) % 4 WHEN 0 THEN '' WHEN 1 THEN 'e' WHEN 2 THEN '&' ELSE 'a' END AS beat FROM notes")
def m4_beat_label(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.beat_label(c("ix") - 1).alias("beat"))


@query(f"""WITH {NOTES}, m AS (SELECT score_id, measure, ix, [64, 59, 55, 50, 45, 40][string] + fret AS midi FROM notes)
SELECT score_id, measure, ix, midi, ['C','C','D','D','E','F','F','G','G','A','A','B'][midi % 12 + 1] AS step, CASE WHEN midi % 12 IN (1, 3, 6, 8, 10) THEN 1 ELSE 0 END AS alter, midi // 12 - 1 AS octave FROM m""")
def m5_pitch(spark, d):
    n = notes(spark, d).withColumn("midi", S.midi_of(c("string"), c("fret")))
    return n.select("score_id", "measure", "ix", "midi", S.spell_pitch(c("midi")).alias("p")).select("score_id", "measure", "ix", "midi", "p.*")


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN (1 << (q % 7)) <= 32 THEN CAST((1 + fret % 9) * 64 / (1 << (q % 7)) AS INT) END AS capacity FROM notes")
def m7_capacity(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.capacity64(1 + c("fret") % 9, F.pow(F.lit(2), c("q") % 7).cast("int")).alias("capacity"))


@query(f"""WITH RECURSIVE {NOTES}, g AS (SELECT DISTINCT q AS gap FROM notes),
r AS (SELECT gap, gap AS rest, '' AS told FROM g UNION ALL
 SELECT gap, rest - k, told || CASE WHEN told = '' THEN '' ELSE ',' END || k FROM (SELECT gap, rest, told, (SELECT max(v) FROM (VALUES (64),(56),(48),(32),(28),(24),(16),(14),(12),(8),(7),(6),(4),(3),(2),(1)) t(v) WHERE v <= rest) AS k FROM r WHERE rest > 0))
SELECT score_id, measure, ix, told AS rests FROM notes JOIN r ON gap = q AND rest = 0""")
def m8_split_rest(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", F.array_join(S.split_rest(c("q")).cast("array<string>"), ",").alias("rests"))


@query(f"WITH {NOTES} SELECT score_id, measure, ix, duration64 % 8 = 0 AS on_grid FROM notes")
def m9_on_grid(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.on_grid(c("duration64") / 8.0, 1).alias("on_grid"))


@query(f"""WITH {NOTES}, b AS (SELECT *, lead(price) OVER w AS p2, lead(q) OVER w AS q2 FROM notes WINDOW w AS (PARTITION BY measure ORDER BY ix)),
o AS (SELECT *, greatest(0, least(price + 10 * q, p2 + 10 * q2) - greatest(price, p2)) * 10.0 AS i FROM b WHERE p2 IS NOT NULL)
SELECT score_id, measure, ix, round(i / (100.0 * q + 100.0 * q2 - i), 6) AS iou FROM o""")
def m11_iou(spark, d):
    w = Window.partitionBy("measure").orderBy("ix")
    n = notes(spark, d).withColumn("p2", F.lead("price").over(w)).withColumn("q2", F.lead("q").over(w)).filter("p2 is not null")
    box = lambda p, q: (p, F.lit(0.0), q * 10.0, F.lit(10.0))
    return n.select("score_id", "measure", "ix", F.round(S.iou(box(c("price"), c("q")), box(c("p2"), c("q2"))), 6).alias("iou"))


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, CAST(CASE WHEN fret = 2 THEN 2.4 WHEN fret = 3 THEN 3.2 WHEN fret IN (4,5,7,9,12,16,17,19,24) THEN fret WHEN fret = 8 THEN 8.2 WHEN fret = 10 THEN 9.6
WHEN fret IN (14, 15) THEN 14.7 WHEN fret IN (21, 22) THEN 21.7 ELSE 12 END AS DOUBLE) AS node FROM notes""")
def m12_harmonic(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.harmonic_node(c("fret")).alias("node"))


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN q < 26 THEN chr(65 + q) ELSE 'S' || (q + 1) END AS label FROM notes")
def m13_section_label(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.section_label(c("q")).alias("label"))


@query(f"WITH {POINTS}, s AS (SELECT event_id, CAST(floor(greatest(value, 0) * 10) AS BIGINT) AS k FROM points) SELECT event_id, lpad(CAST(k // 600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 600 // 10 AS VARCHAR), 2, '0') || '.' || (k % 10) AS clock FROM s")
def m14_clock(spark, d):
    return points(spark, d).select("event_id", S.fmt_time(c("value")).alias("clock"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, embedding AS v FROM embeddings), p AS (SELECT a.vec_id, a.b AS x, z.b AS y, a.v AS v, z.v AS w FROM e a JOIN e z ON z.vec_id = a.vec_id + 1)
SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda t: CASE WHEN t[1] = t[2] THEN 0 ELSE 1 END)) / CAST(len(x) AS DOUBLE) AS hamming, round(list_sum(list_transform(list_zip(v, w), lambda t: CAST(abs(t[1] - t[2]) AS DOUBLE))) / len(v), 5) AS mad FROM p""")
def m15_m17_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    n = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("e2"), c("bits").alias("b2"))
    return e.join(n, "vec_id").select("vec_id", S.hamming(c("bits"), c("b2")).alias("hamming"), F.round(S.mad(c("embedding"), c("e2")), 5).alias("mad"))


@query(f"""WITH {NOTES}, x AS (SELECT score_id, measure, ix, CASE q % 4 WHEN 0 THEN 'Tempo: ' || (q * 8) WHEN 1 THEN (q * 7) || ' bpm' WHEN 2 THEN 'q = ' || q || ',5' ELSE '32 7 9 ' || q END AS s FROM notes),
y AS (SELECT *, replace(upper(s), ',', '.') AS u FROM x), z AS (SELECT *, try_cast(regexp_extract(u, 'TEMPO\\s*[:=]?\\s*(\\d{{2,3}}(?:\\.\\d+)?)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(u, '(\\d{{2,3}}(?:\\.\\d+)?)\\s*BPM', 1) AS DOUBLE) AS b, try_cast(regexp_extract(u, '\\bQ\\b\\s*=\\s*(\\d{{2,3}}(?:\\.\\d+)?)', 1) AS DOUBLE) AS e FROM y)
SELECT score_id, measure, ix, coalesce(CASE WHEN a BETWEEN 30 AND 300 THEN a END, CASE WHEN b BETWEEN 30 AND 300 THEN b END, CASE WHEN e BETWEEN 30 AND 300 THEN e END) AS tempo FROM z""")
def p12_tempo_text(spark, d):
    q = c("q").cast("string")
    s = F.when(c("q") % 4 == 0, F.concat(F.lit("Tempo: "), (c("q") * 8).cast("string"))).when(c("q") % 4 == 1, F.concat((c("q") * 7).cast("string"), F.lit(" bpm"))).when(c("q") % 4 == 2, F.concat(F.lit("q = "), q, F.lit(",5"))).otherwise(F.concat(F.lit("32 7 9 "), q))
    return notes(spark, d).select("score_id", "measure", "ix", S.tempo_from_text(s).alias("tempo"))


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, CASE fret % 9 WHEN 0 THEN 'palm_mute' WHEN 1 THEN 'harmonic' WHEN 2 THEN 'bend' WHEN 3 THEN 'slide' WHEN 4 THEN 'let_ring' WHEN 5 THEN 'hammer_on' WHEN 6 THEN 'pull_off' WHEN 7 THEN 'bend' END AS technique FROM notes""")
def p15_technique(spark, d):
    texts = F.array(*map(F.lit, ("P.M.-", "N.H.", "Full", "sl.", "let ring", "H", "p", "1/2 bend", "12")))
    return notes(spark, d).select("score_id", "measure", "ix", S.technique_from_text(F.get(texts, c("fret") % 9)).alias("technique"))


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN fret % 5 = 0 THEN 0 WHEN q <= 36 THEN q END AS fret, CASE WHEN fret % 5 = 0 THEN true WHEN q <= 36 THEN false END AS dead FROM notes")
def p16_fret_token(spark, d):
    s = F.when(c("fret") % 5 == 0, "(x)").otherwise(F.concat(F.lit("["), c("q").cast("string"), F.lit("]")))
    return notes(spark, d).select("score_id", "measure", "ix", S.parse_fret(s).alias("p")).select("score_id", "measure", "ix", "p.fret", "p.dead")


@query(f"WITH {NOTES} SELECT score_id, measure, ix, least(960, 90000.0 / 1001 * q) AS cap, CASE WHEN q % 7 = 0 THEN 0 ELSE CAST(floor(q * (30000 / 1001.0) / (q % 7)) AS BIGINT) + 1 END AS frames FROM notes")
def p5_p7_frames(spark, d):
    rate = S.parse_rate(F.lit("30000/1001"))
    return notes(spark, d).select("score_id", "measure", "ix", F.least(F.lit(960.0), rate * 3 * c("q")).alias("cap"), S.estimate_frames(F.lit(0.0), c("q").cast("double"), rate, c("q") % 7).alias("frames"))


@query(f"""WITH {NOTES}, x AS (SELECT score_id, measure, ix, least(1918, greatest(0, CAST(round_even(discount * 1920, 0) AS INT))) AS x, least(1918 + 2, 1920) AS w0, q FROM notes WHERE discount + q / 100.0 <= 1.000001)
SELECT score_id, measure, ix, x, least(1920 - x, greatest(2, CAST(round_even(q / 100.0 * 1920, 0) AS INT))) AS width FROM x WHERE q > 0""")
def p8_crop(spark, d):
    box = S.crop_to_pixels(F.lit(1920), F.lit(1080), c("discount"), F.lit(0.25), c("q") / 100.0, F.lit(0.5))
    return notes(spark, d).select("score_id", "measure", "ix", box.alias("b")).filter("b is not null").select("score_id", "measure", "ix", "b.x", "b.width")


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN q % 5 < 1 THEN 'step' WHEN q > 40.1 THEN 'end' WHEN least(q, 40) - 1.0 < 0.25 THEN 'short' WHEN CASE WHEN least(q, 40) <= 1 THEN 0 ELSE floor((least(q, 40) - 1.0) * 24.0 / (q % 5)) + 1 END > 180 THEN 'frames' END AS reason FROM notes""")
def p9_slice_rule(spark, d):
    return notes(spark, d).select("score_id", "measure", "ix", S.slice_rule(F.lit(1.0), c("q").cast("double"), F.lit(40.0), F.lit(24.0), c("q") % 5).alias("reason"))


@query(f"WITH {NOTES} SELECT score_id, measure, ix, unnest(generate_series(0, q)) AS i, unnest(list_transform(generate_series(0, q), lambda i: least(CAST(q AS DOUBLE), i * 2.0))) AS t FROM notes WHERE ix = 1")
def p10_frame_table(spark, d):
    n = notes(spark, d).filter("ix = 1").withColumn("f", F.explode(S.frame_table(F.lit(0.0), c("q").cast("double"), F.lit(1.0), F.lit(2), c("q") + 1)))
    return n.select("score_id", "measure", "ix", "f.i", "f.t")


@query("SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS host, regexp_matches(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '(^|\\.)example\\.(com|org)$') AS allowed FROM pages")
def p2_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", S.url_host(c("url")).alias("host"), S.host_allowed(c("url"), ["example.com", "example.org"]).alias("allowed"))


@query("SELECT page_id, length(substr(regexp_replace(trim(regexp_replace(url, '[<>:\"/\\\\|?*]+', '_', 'g'), ' .'), 'zz', 'zz'), 1, 100)) AS n, coalesce(nullif(substr(trim(regexp_replace(url, '[<>:\"/\\\\|?*]+', '_', 'g'), ' .'), 1, 100), ''), 'score') AS stem FROM pages")
def p4_safe_stem(spark, d):
    p = table(spark, d, "pages").select("page_id", S.safe_stem(c("url"), "score").alias("stem"))
    return p.withColumn("n", F.char_length("stem").cast("long"))


@query("SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 12) AS id, CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 THEN 'test' WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'val' ELSE 'train' END AS split, CASE WHEN source LIKE '%src1%' THEN 'test' WHEN CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) % 10 = 0 THEN 'test' WHEN CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) % 10 = 1 THEN 'val' ELSE 'train' END AS held FROM documents")
def p22_p24_splits(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.hash_id([c("source"), c("doc_id").cast("string")], 12).alias("id"), S.hash_split(c("doc_id").cast("string")).alias("split"), S.hash_split_holdout(c("source"), ["src1"]).alias("held"))


@query(f"WITH {POINTS} SELECT event_id, CAST(props ->> 'k' AS INT) AS k FROM points")
def s2_parse_object(spark, d):
    return points(spark, d).select("event_id", S.parse_object(c("props"), "k int").alias("o")).select("event_id", "o.k")


@query(f"""WITH {NOTES} SELECT score_id, measure, ix, r AS rule FROM notes, (VALUES ('string'), ('fret'), ('duration')) v(r) WHERE CASE r WHEN 'string' THEN string > 5 WHEN 'fret' THEN fret > 30 ELSE duration64 > 28 END""")
def c3_rules(spark, d):
    rules = {"string": c("string").between(1, 5), "fret": c("fret").between(0, 30), "duration": c("duration64").between(1, 28)}
    return U.validate_rows(notes(spark, d).select("score_id", "measure", "ix", "string", "fret", "duration64"), rules).select("score_id", "measure", "ix", "rule")


# -- joins -----------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def j1_sessions(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_nationkey", c("c_nationkey").alias("user_id"), c("c_acctbal").alias("expires_at"))
    na = table(spark, d, "nation").select(c("n_nationkey").alias("user_id"), "n_name")
    return J.resolve_sessions(cu, na, F.lit(0)).select("c_custkey", "c_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j2_owned(spark, d):
    own = table(spark, d, "customer").filter("c_acctbal > 5000").select(c("c_custkey").alias("o_custkey"))
    return J.owned(table(spark, d, "orders"), own, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, coalesce(o.orders, '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def j3_payload(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    p = J.with_children(table(spark, d, "customer").select("c_custkey"), "c_custkey", orders=(o, ["o_orderkey"], ["o_orderdate", "o_orderkey"]))
    return p.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN q % 10 IN (0, 5) THEN NULL WHEN q % 10 <= 2 THEN q // 10 + 1 WHEN q % 10 >= 8 THEN q // 10 + 2 END AS line FROM notes WHERE q < 48 AND q % 10 <> 5")
def j4_nearest_line(spark, d):
    lines = F.array(*[F.lit(10.0 * i) for i in range(6)])
    n = notes(spark, d).filter("q < 48 and q % 10 <> 5")
    return n.select("score_id", "measure", "ix", F.when(c("q") % 10 != 0, J.nearest_line(c("q").cast("double"), lines, F.lit(2.0))).alias("line"))


@query("SELECT user_id, event_id, lo FROM (SELECT user_id, event_id, floor(value / 25) * 25 AS lo FROM events)")
def j5_in_interval(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.floor(c("value") / 25).alias("band"))
    bands = e.select("band").distinct().select("band", (c("band") * 25.0).alias("left"), (c("band") * 25.0 + 25.0).alias("right"))
    return J.in_measure(e, bands, ["band"], "value").select("user_id", "event_id", c("left").alias("lo"))


@query(f"WITH {POINTS} SELECT p.event_id, r.event_id AS mark FROM (SELECT * FROM points WHERE kind <> 'click') p LEFT JOIN LATERAL (SELECT event_id FROM points k WHERE k.score_id = p.score_id AND k.kind = 'click' AND k.us <= p.us ORDER BY k.us DESC, k.event_id DESC LIMIT 1) r ON true")
def j7_asof(spark, d):
    p = points(spark, d)
    marks = p.filter("kind = 'click'").select("score_id", "us", c("event_id").alias("ord"), c("event_id").alias("mark"))
    return J.asof_backward(p.filter("kind <> 'click'").select("score_id", "us", "event_id"), marks, ["score_id"], "us", ["mark"]).select("event_id", "mark")


@query(f"""WITH {POINTS}, a AS (SELECT * FROM points WHERE kind = 'click'), b AS (SELECT * FROM points WHERE kind <> 'click')
SELECT b.event_id, (SELECT a.event_id FROM a WHERE a.score_id = b.score_id ORDER BY abs(a.us - b.us), a.us, a.event_id LIMIT 1) AS nearest_id FROM b""")
def j10_nearest(spark, d):
    p = points(spark, d)
    return J.nearest_in_time(p.filter("kind <> 'click'").select("score_id", "us", "event_id"), p.filter("kind = 'click'"), ["score_id"], "us", "us", "event_id").select("event_id", "nearest_id")


@query(f"""WITH {POINTS}, p AS (SELECT score_id, us, min(value) AS v FROM points WHERE kind = 'click' GROUP BY ALL), q AS (SELECT * FROM points WHERE kind <> 'click'),
s AS (SELECT q.event_id, q.us, (SELECT struct_pack(u := p.us, v := p.v) FROM p WHERE p.score_id = q.score_id AND p.us <= q.us ORDER BY p.us DESC LIMIT 1) AS b, (SELECT struct_pack(u := p.us, v := p.v) FROM p WHERE p.score_id = q.score_id AND p.us >= q.us ORDER BY p.us LIMIT 1) AS a FROM q)
SELECT event_id, round(CASE WHEN b IS NULL THEN a.v WHEN a IS NULL THEN b.v WHEN a.u = b.u THEN b.v ELSE b.v + (a.v - b.v) * (us - b.u) / CAST(a.u - b.u AS DOUBLE) END, 5) AS position FROM s""")
def j11_interpolate(spark, d):
    p = points(spark, d)
    pts = p.filter("kind = 'click'").select("score_id", "us", c("value").alias("position"))
    return J.interpolate(pts, p.filter("kind <> 'click'").select("score_id", "us", "event_id"), ["score_id"], "us", "position").select("event_id", F.round("position", 5).alias("position"))


@query(f"""WITH {NOTES}, ch AS (SELECT measure, CAST(onset64 AS BIGINT) * 40 AS tick, 300000 + 10000 * q AS us FROM notes WHERE ix > 1 AND flag <> 'A'), al AS (SELECT * FROM ch UNION ALL SELECT DISTINCT measure, CAST(0 AS BIGINT), 500000 FROM ch),
s AS (SELECT *, coalesce((tick - lag(tick) OVER w) * lag(us) OVER w / 480.0 / 1000, 0) AS step FROM al WINDOW w AS (PARTITION BY measure ORDER BY tick))
SELECT measure, tick, round(sum(step) OVER (PARTITION BY measure ORDER BY tick), 4) AS time_ms, us AS us_per_quarter FROM s""")
def j13_tempo_map(spark, d):
    ch = notes(spark, d).filter("ix > 1 and flag <> 'A'").select("measure", (c("onset64").cast("long") * 40).alias("tick"), (300000 + 10000 * c("q")).alias("us_per_quarter"), c("ix").alias("ord"))
    return J.tempo_map(ch, ["measure"]).withColumn("time_ms", F.round("time_ms", 4))


@query(f"""WITH {NOTES} SELECT measure AS score_id, string AS measure_number, min(q) FILTER (WHERE ix <= 2) IS NOT NULL AS had FROM notes GROUP BY ALL""")
def j15_alignment(spark, d):
    n = notes(spark, d).select(c("measure").alias("score_id"), c("string").alias("measure_number"), "ix", c("flag").alias("label"))
    pts = n.filter("ix <= 2").select("score_id", "measure_number").distinct().withColumn("had", F.lit(True))
    new = J.apply_alignment(pts, n.select("score_id", "measure_number", "ix", "label"), [c("ix")])
    return new.select("score_id", "measure_number", F.coalesce("had", F.lit(False)).alias("had"))


@query(f"""WITH {NOTES} SELECT measure, count(*) AS verified, CAST(sum(CASE WHEN w = n THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM (
SELECT coalesce(a.measure, b.measure) AS measure, a.v AS w, b.v AS n FROM (SELECT measure, string, arg_max(fret, ix) AS v FROM notes WHERE flag <> 'R' GROUP BY ALL) a FULL JOIN (SELECT measure, string, arg_max(fret, ix) AS v FROM notes WHERE flag <> 'A' GROUP BY ALL) b USING (measure, string)) GROUP BY measure""")
def j20_verified(spark, d):
    n = notes(spark, d)
    last = lambda df, name: A.distinct_last(df, ["measure", "string"], "ix").select("measure", "string", c("fret").alias(name))
    both = last(n.filter("flag <> 'R'"), "w").join(last(n.filter("flag <> 'A'"), "n"), ["measure", "string"], "full_outer")
    return both.groupBy("measure").agg(F.count("*").alias("verified"), F.sum(F.when(c("w") == c("n"), 1).otherwise(0)).alias("correct"))


@query(f"WITH {NOTES} SELECT count(*) AS verified, CAST(sum(CASE WHEN w = n THEN 1 ELSE 0 END) AS BIGINT) AS correct, sum(CASE WHEN w = n THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS accuracy FROM (SELECT a.v AS w, b.v AS n FROM (SELECT measure, string, arg_max(fret, ix) AS v FROM notes WHERE flag <> 'R' GROUP BY ALL) a FULL JOIN (SELECT measure, string, arg_max(fret, ix) AS v FROM notes WHERE flag <> 'A' GROUP BY ALL) b USING (measure, string))")
def j20_accuracy(spark, d):
    n = notes(spark, d)
    return J.verified_accuracy(n.filter("flag <> 'R'"), n.filter("flag <> 'A'"), ["measure", "string"], "fret", "ix")


@query("SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def j21_lookup(spark, d):
    dim = table(spark, d, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup(table(spark, d, "customer"), dim, ["c_nationkey"], "n_name", "none").select("c_custkey", "n_name")


@query(f"WITH {NOTES} SELECT score_id, measure, ix FROM (SELECT *, max(flag = 'R') OVER (PARTITION BY measure) AS h FROM notes) WHERE NOT h OR flag = 'R'")
def j24_prefer(spark, d):
    return J.prefer(notes(spark, d), ["measure"], "flag", "R").select("score_id", "measure", "ix")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 IN (0, 2) AND o_orderkey % 2 = 0 THEN 'upload' WHEN o_orderkey % 3 IN (0, 1) AND o_orderkey % 5 = 0 THEN 'video' END AS source, CASE WHEN NOT ((o_orderkey % 3 IN (0, 2) AND o_orderkey % 2 = 0) OR (o_orderkey % 3 IN (0, 1) AND o_orderkey % 5 = 0)) THEN 'no_' || ['auto', 'video', 'upload'][o_orderkey % 3 + 1] END AS reason FROM orders")
def j26_audio_source(spark, d):
    mode = F.get(F.array(*map(F.lit, ("auto", "video", "upload"))), (c("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", J.choose_audio_source(mode, F.when(c("o_orderkey") % 2 == 0, "a.mp3"), F.when(c("o_orderkey") % 5 == 0, "v.mp4")).alias("x")).select("o_orderkey", "x.*")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def j19_exact_copies(spark, d):
    return J.dedupe_exact(table(spark, d, "documents").select("doc_id", "text"), c("text"), [c("doc_id")]).select("doc_id", "first_id")


@query(f"""WITH RECURSIVE {NOTES}, p AS (SELECT score_id, string, measure * 10 + ix AS p, onset64 / 8.0::DOUBLE + discount AS x, row_number() OVER (PARTITION BY score_id, string ORDER BY measure * 10 + ix) AS k FROM notes WHERE flag <> 'R'),
t AS (SELECT score_id, string, list({{'t': CAST(measure * 10 + ix AS INT), 'x': onset64 / 8.0::DOUBLE + discount}}) AS ts FROM notes WHERE flag <> 'A' GROUP BY ALL),
r AS (SELECT score_id, string, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS p, CAST(NULL AS INT) AS t FROM t UNION ALL
 SELECT score_id, string, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.t) END, p, best.t FROM (SELECT r.score_id, r.string, p.k, r.used, CAST(p.p AS INT) AS p,
  list_sort(list_transform(list_filter(ts, lambda c: abs(p.x - c.x) <= 0.26 AND NOT list_contains(r.used, c.t)), lambda c: {{'d': abs(p.x - c.x), 't': c.t}}))[1] AS best FROM r JOIN p ON p.score_id = r.score_id AND p.string = r.string AND p.k = r.k + 1 JOIN t ON t.score_id = r.score_id AND t.string = r.string))
SELECT score_id, string, p AS pred_ord, t AS truth_ord FROM r WHERE t IS NOT NULL""")
def j16_match_events(spark, d):
    n = notes(spark, d).withColumn("ord", (c("measure") * 10 + c("ix")).cast("int")).withColumn("onset", c("onset64") / 8.0 + c("discount"))
    return J.match_events(n.filter("flag <> 'R'"), n.filter("flag <> 'A'"), ["score_id", "string"], tolerance=0.26)


@query(f"""WITH RECURSIVE {NOTES}, b AS (SELECT measure AS image_id, string % 2 AS category_id, CAST(measure * 10 + ix AS INT) AS ord, CAST(price AS DOUBLE) AS x, q * 100.0::DOUBLE AS w, discount * 10 AS score, flag FROM notes),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, ord) AS k FROM b WHERE flag <> 'R' AND score >= 0.35), t AS (SELECT image_id, category_id, list({{'t': ord, 'x': x, 'w': w}}) AS ts FROM b WHERE flag = 'R' GROUP BY ALL),
r AS (SELECT image_id, category_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS ord, CAST(NULL AS INT) AS t FROM t UNION ALL
 SELECT image_id, category_id, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.t) END, ord, best.t FROM (SELECT r.image_id, r.category_id, p.k, r.used, p.ord,
  list_sort(list_filter(list_transform(list_filter(ts, lambda c: NOT list_contains(r.used, c.t)), lambda c: {{'d': -greatest(0.0, least(p.x + p.w, c.x + c.w) - greatest(p.x, c.x)) * 10.0 / (p.w * 10.0 + c.w * 10.0 - greatest(0.0, least(p.x + p.w, c.x + c.w) - greatest(p.x, c.x)) * 10.0), 't': c.t}}), lambda c: c.d <= -0.5))[1] AS best
  FROM r JOIN p ON p.image_id = r.image_id AND p.category_id = r.category_id AND p.k = r.k + 1 JOIN t ON t.image_id = r.image_id AND t.category_id = r.category_id))
SELECT p.image_id, p.category_id, p.ord, p.score, r.t AS truth_ord FROM p LEFT JOIN r ON r.image_id = p.image_id AND r.category_id = p.category_id AND r.ord = p.ord""")
def j17_match_detections(spark, d):
    n = notes(spark, d).select(c("measure").alias("image_id"), (c("string") % 2).alias("category_id"), (c("measure") * 10 + c("ix")).cast("int").alias("ord"), c("price").alias("x"), F.lit(0.0).alias("y"), (c("q") * 100.0).alias("w"), F.lit(10.0).alias("h"), (c("discount") * 10).alias("score"), "flag")
    return J.match_detections(n.filter("flag <> 'R'"), n.filter("flag = 'R'")).select("image_id", "category_id", "ord", "score", "truth_ord")


# -- aggregations ----------------------------------------------------------------------------------------------

VALIDATE = f"""WITH {NOTES}, e AS (SELECT *, onset64 + duration64 AS fin, coalesce(max(onset64 + duration64) OVER (PARTITION BY measure ORDER BY onset64, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM notes),
g AS (SELECT measure, CAST(sum(duration64) AS BIGINT) AS committed, max(fin) AS fin, max(before - onset64) AS ov, max(onset64 > before) AS gap FROM e GROUP BY measure),
v AS (SELECT measure, 64 AS capacity, committed, greatest(0, 64 - committed) AS missing, greatest(0, ov, fin - 64, committed - 64) AS overflow, gap OR fin < 64 AS has_gaps FROM g)
SELECT *, NOT has_gaps AND overflow = 0 AND committed = 64 AS complete FROM v"""


@query(VALIDATE)
def a9_validate_measures(spark, d):
    return A.validate_measures(notes(spark, d).withColumn("ord", c("ix")), ["measure"], F.lit(64))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text, CAST(min(turn) AS BIGINT) AS conf FROM conversations GROUP BY conv_id")
def a1_rows(spark, d):
    v = table(spark, d, "conversations").select("conv_id", c("turn").alias("left"), "text", c("turn").alias("conf"), F.lit(0).alias("top"))
    return A.words_to_rows(v, ["conv_id"], F.lit(10)).select("conv_id", "text", "conf")


@query(f"WITH {POINTS} SELECT score_id, kind, max(value) AS conf FROM points GROUP BY ALL")
def a3_best_readings(spark, d):
    return A.best_readings(points(spark, d).withColumnRenamed("value", "conf"), ["score_id", "kind"])


@query(f"""WITH {NOTES}, v AS (SELECT measure, fret - ix AS start, count(*) AS n, sum(greatest(10.0, q)) AS w FROM notes WHERE fret - ix >= 0 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY n DESC, w DESC, start) AS r FROM v)
SELECT measure, start AS start_measure, least(100.0, w / n) AS confidence FROM b WHERE r = 1 AND n >= 2""")
def a5_start_votes(spark, d):
    return A.start_votes(notes(spark, d).select("measure", c("ix").alias("index"), c("fret").alias("value"), c("q").cast("double").alias("conf")), ["measure"])


@query(f"""WITH {NOTES}, v AS (SELECT *, fret - ix AS start FROM notes), g AS (SELECT measure, start, count(DISTINCT ix) AS n, sum(greatest(10.0, q)) AS w FROM v GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY n DESC, w DESC, start) AS r FROM g)
SELECT v.measure, v.ix AS "index", v.fret AS value, CAST(v.q AS DOUBLE) AS conf FROM v JOIN b ON b.measure = v.measure AND r = 1 WHERE n < 2 OR v.start = b.start""")
def a4_repair_labels(spark, d):
    return A.repair_labels(notes(spark, d).select("measure", c("ix").alias("index"), c("fret").alias("value"), c("q").cast("double").alias("conf")), ["measure"])


@query(f"""WITH {NOTES}, v AS (SELECT measure, flag, sum(greatest(10.0, q)) AS w, min(ix) AS o FROM notes GROUP BY ALL), b AS (SELECT *, sum(w) OVER (PARTITION BY measure) AS total, row_number() OVER (PARTITION BY measure ORDER BY w DESC, o) AS r FROM v)
SELECT n.measure, n.ix, round(100.0 * b.w / b.total, 6) AS confidence FROM notes n JOIN b ON b.measure = n.measure AND r = 1 WHERE n.flag = b.flag AND 100.0 * b.w / b.total >= n.q""")
def a6_vote_labels(spark, d):
    code = F.when(c("flag") == "A", "1").when(c("flag") == "N", "2").otherwise("3")
    g = A.vote_labels(notes(spark, d).select("measure", "ix", c("ix").alias("ord"), code.alias("raw_label"), c("q").cast("double").alias("raw_confidence")), ["measure"])
    return _winners(g)


def _winners(g: DataFrame) -> DataFrame:
    """Members whose own label won with a share of at least their confidence; their confidence is that share."""
    v = g.groupBy("measure", "raw_label").agg(F.sum(F.greatest(F.lit(10.0), c("raw_confidence"))).alias("w"), F.min("ord").alias("o"))
    win = A.head_per_group(v.withColumn("share", 100 * c("w") / F.sum("w").over(Window.partitionBy("measure"))), ["measure"], [F.desc("w"), c("o")], 1)
    return g.join(win.select("measure", "raw_label", "share"), ["measure", "raw_label"]).filter("share >= raw_confidence").select("measure", "ix", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {NOTES}, g AS (SELECT measure, flag AS signature, count(*) AS n, avg(q) AS m, min(ix) AS o FROM notes GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY n DESC, m DESC, o) AS r FROM g)
SELECT b.measure, b.signature, b.n AS votes, (SELECT ix FROM notes x WHERE x.measure = b.measure AND x.flag = b.signature ORDER BY q DESC, ix LIMIT 1) AS ord, (SELECT CAST(max(q) AS DOUBLE) FROM notes x WHERE x.measure = b.measure AND x.flag = b.signature) AS quality FROM b WHERE r = 1""")
def a8_vote_measures(spark, d):
    return A.vote_measures(notes(spark, d).select("measure", c("flag").alias("signature"), c("q").cast("double").alias("quality"), c("ix").alias("ord")), ["measure"])


@query(f"WITH {POINTS} SELECT score_id, kind, round(min(t), 3) AS t FROM points GROUP BY ALL")
def a10_earliest(spark, d):
    p = points(spark, d).select("score_id", "kind", F.lit(0).alias("start_measure"), F.hash("kind").alias("highlighted_index"), c("t").alias("time_seconds"))
    return A.sync_suggestions(p, ["score_id", "kind"]).select("score_id", "kind", c("time_seconds").alias("t"))


@query(f"""WITH {NOTES}, p AS (SELECT DISTINCT measure, fret, min(q) OVER (PARTITION BY measure, fret) AS s FROM notes), g AS (SELECT measure, lead(fret) OVER w - fret AS dm, lead(s) OVER w - s AS dt FROM p WINDOW w AS (PARTITION BY measure ORDER BY fret)),
k AS (SELECT measure, dt / CAST(dm AS DOUBLE) AS x FROM g WHERE dm BETWEEN 1 AND 8 AND dt > 0) SELECT measure, least(300.0, greatest(30.0, 240 / quantile_cont(x, 0.5))) AS tempo FROM k WHERE x BETWEEN 0.3 AND 8 GROUP BY measure""")
def a11_tempo_from_sync(spark, d):
    p = notes(spark, d).groupBy("measure", c("fret").alias("measure_number")).agg(F.min("q").alias("time_seconds"))
    return A.tempo_from_sync(p, ["measure"])


@query(f"""WITH {POINTS} SELECT score_id, round(quantile_cont(value, 0.5), 1) AS value FROM (SELECT score_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) AS r FROM points)
WHERE r <= 8 AND value IS NOT NULL GROUP BY score_id""")
def a12_median_of_first(spark, d):
    p = points(spark, d).withColumn("value", F.when(c("event_id") % 3 > 0, c("value")))
    return A.median_of_first(p, ["score_id"], "value", [c("us"), c("event_id")], 8)


@query(f"""WITH {NOTES}, g AS (SELECT score_id, fret % 7 > 0 AND q % 5 > 0 AS known, 2 * q AS confidence FROM notes), s AS (SELECT score_id, count(*) AS total, count(*) FILTER (known) AS seen, coalesce(avg(confidence) FILTER (known), 0) AS mean, count(*) FILTER (known AND confidence < 60) AS low FROM g GROUP BY score_id)
SELECT score_id, total AS total_glyphs, seen AS recognized_glyphs, low AS low_confidence_glyphs, round_even(seen / total::DOUBLE, 3) AS glyph_coverage, round_even(mean / 100 * (seen / total::DOUBLE), 3) AS confidence FROM s""")
def a13_summary(spark, d):
    glyphs = notes(spark, d).withColumn("confidence", c("q") * 2).withColumn("label", F.when(c("q") % 5 == 0, "").when(c("fret") % 7 > 0, c("fret").cast("string")))
    return A.recognition_summary(glyphs, ["score_id"])


@query(f"""WITH {NOTES}, f AS (SELECT score_id, CASE WHEN q % 4 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN fret % 3 > 0 THEN measure END AS start_measure, CASE WHEN string < 3 THEN 'tab_only' ELSE 'staff_tab_pair' END AS layout, CASE WHEN ix % 2 = 0 THEN 'dark_on_light' ELSE 'light_on_dark' END AS polarity FROM notes),
m AS (SELECT score_id, count(DISTINCT measure) AS n, min(measure) AS a, max(measure) AS z FROM notes GROUP BY score_id)
SELECT score_id, 'technique' AS kind, 't' || string AS name, count(*) AS n FROM notes WHERE fret % 5 = 0 GROUP BY ALL UNION ALL SELECT score_id, 'layout', layout, count(*) FROM f WHERE status = 'ok' GROUP BY ALL UNION ALL SELECT score_id, 'polarity', polarity, count(*) FROM f WHERE status = 'ok' GROUP BY ALL
UNION ALL SELECT score_id, 'frames', CASE WHEN status = 'ok' THEN 'parsed' ELSE 'failed' END, count(*) FROM f GROUP BY ALL UNION ALL SELECT score_id, 'frames', 'unresolved', count(*) FROM f WHERE status = 'ok' AND start_measure IS NULL GROUP BY ALL
UNION ALL SELECT score_id, 'measures', unnest(['count', 'start', 'end', 'missing']), unnest([n, a, z, z - a + 1 - n]) FROM m""")
def a13_summary_counts(spark, d):
    n = notes(spark, d)
    frames = n.select("score_id", F.when(c("q") % 4 == 0, "error").otherwise("ok").alias("status"), F.when(c("fret") % 3 > 0, c("measure")).alias("start_measure"), F.when(c("string") < 3, "tab_only").otherwise("staff_tab_pair").alias("layout"), F.when(c("ix") % 2 == 0, "dark_on_light").otherwise("light_on_dark").alias("polarity"))
    marks = n.filter("fret % 5 = 0").select("score_id", F.concat(F.lit("t"), c("string").cast("string")).alias("technique"))
    return A.summary_counts(marks, frames, n.select("score_id", c("measure").alias("number")), ["score_id"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a14_value_counts(spark, d):
    return A.value_counts(table(spark, d, "documents"), ["lang"], "source")


@query(f"WITH {NOTES}, r AS (SELECT score_id, min(fret) AS lo, max(fret) AS hi FROM notes GROUP BY ALL), x AS (SELECT score_id, unnest(generate_series(lo, hi)) AS number FROM r) SELECT score_id, CAST(number AS INT) AS number FROM x EXCEPT SELECT score_id, fret FROM notes")
def a15_missing(spark, d):
    return A.missing_measures(notes(spark, d).select("score_id", c("fret").alias("number")).distinct(), ["score_id"])


@query(f"WITH {NOTES} SELECT measure, q AS ticks, max(duration64) AS duration, string_agg(DISTINCT (7 - string) || ':' || fret, ',' ORDER BY (7 - string) || ':' || fret) AS notes FROM notes GROUP BY ALL")
def a16_truth_events(spark, d):
    return A.truth_events(notes(spark, d).select("measure", c("q").alias("ticks"), c("duration64").alias("duration"), "string", "fret"), ["measure"])


@query("""WITH m AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE quality = 1) AS t FROM labels), x AS (SELECT tp / CAST(greatest(1, p) AS DOUBLE) AS precision, tp / CAST(greatest(1, t) AS DOUBLE) AS recall FROM m)
SELECT precision, recall, 2 * precision * recall / greatest(1e-12, precision + recall) AS f1 FROM x""")
def a18_prf(spark, d):
    one = lambda w: F.sum(F.when(w, 1).otherwise(0))
    q, t = c("quality") == 1, c("toxic") == 1
    return table(spark, d, "labels").agg(one(q & t).alias("tp"), one(t).alias("p"), one(q).alias("t")).select(*A.prf(c("tp"), c("p"), c("t")))


@query("""WITH k AS (SELECT DISTINCT quality AS k FROM labels), f AS (SELECT k, 2.0 * (SELECT count(*) FROM labels WHERE quality = k AND toxic = k) / ((SELECT count(*) FROM labels WHERE quality = k) + (SELECT count(*) FROM labels WHERE toxic = k)) AS f1 FROM k)
SELECT (SELECT count(*) FROM labels WHERE quality = toxic) / CAST((SELECT count(*) FROM labels) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1, count(*) AS classes FROM f""")
def a19_report(spark, d):
    return A.classification_report(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH k(label) AS (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (99)), n AS (SELECT k.label, coalesce(m.n, 1) AS n FROM k LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) m USING (label)), w AS (SELECT label, least(12.0, greatest(1.0, sqrt((SELECT max(n) FROM n) / CAST(n AS DOUBLE)))) AS w FROM n)
SELECT label, round(w / (SELECT avg(w) FROM w), 8) AS weight FROM w""")
def a20_class_weights(spark, d):
    e = table(spark, d, "embeddings").select(c("label").cast("long").alias("label"))
    return A.class_weights(e, "label", [*range(10), 99]).select(c("label").cast("int").alias("label"), F.round("weight", 8).alias("weight"))


@query(f"""WITH {NOTES}, s AS (SELECT score_id, price AS a, price + q AS b FROM notes), m AS (SELECT *, max(b) OVER (PARTITION BY score_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM s), i AS (SELECT *, sum(CASE WHEN x IS NULL OR a > x + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT score_id, round(sum(l), 4) AS covered FROM (SELECT score_id, g, max(b) - min(a) AS l FROM i GROUP BY ALL) GROUP BY score_id""")
def a21_covered(spark, d):
    s = notes(spark, d, "l_suppkey").select("score_id", c("price").alias("start"), (c("price") + c("q")).alias("end"))
    return A.covered_length(s, ["score_id"]).withColumn("covered", F.round("covered", 4))


@query("""WITH v AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS w, avg(n_chars) AS m FROM documents GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, n DESC, m DESC, lang DESC) AS r, sum(n) OVER (PARTITION BY source) AS total FROM v)
SELECT source, lang AS prediction, m AS confidence, n / CAST(total AS DOUBLE) AS agreement, CAST(total AS BIGINT) AS member_count, (SELECT arg_max(doc_id, (n_chars, doc_id)) FROM documents x WHERE x.source = b.source) AS representative FROM b WHERE r = 1""")
def a23_rollup(spark, d):
    m = table(spark, d, "documents").select("source", c("lang").alias("prediction"), c("n_chars").alias("confidence"), F.lit(0).alias("area"), c("doc_id").alias("member_id"))
    return A.cluster_rollup(m, ["source"]).drop("member_ids")


@query("""WITH k AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, sum(n) / CAST(count(*) AS DOUBLE) AS reduction, (SELECT sum(n) FROM (SELECT n FROM k ORDER BY n DESC LIMIT 20)) / CAST(sum(n) AS DOUBLE) AS top_share, avg(CASE WHEN n >= 20 THEN 1.0 ELSE 0.0 END) AS sure, avg(n) AS mean_confidence FROM k""")
def a24_corpus_summary(spark, d):
    k = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("member_count")).withColumn("confidence", c("member_count"))
    return A.corpus_summary(k, 20, 20)


@query("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS sources FROM documents GROUP BY ROLLUP (lang, source)")
def a25_split_counts(spark, d):
    return A.split_counts(table(spark, d, "documents"), "lang", "source", "text")


@query(f"WITH {NOTES} SELECT measure, count(DISTINCT string) < count(*) AS duplicate_string, max(flag = 'R') AS rest_with_notes FROM notes GROUP BY measure HAVING count(DISTINCT string) < count(*) OR max(flag = 'R')")
def a26_conflicts(spark, d):
    return A.event_conflicts(notes(spark, d).withColumn("rest", c("flag") == "R"), ["measure"])


@query(f"WITH {NOTES} SELECT measure, string_agg(s, ',' ORDER BY s) AS signature FROM (SELECT measure, lpad(CAST(onset64 AS VARCHAR), 6, '0') || ':' || string || ':' || lpad(CAST(fret AS VARCHAR), 2, '0') AS s FROM notes) GROUP BY measure")
def a27_signature(spark, d):
    return A.signatures(notes(spark, d), ["measure"])


@query(f"WITH {POINTS} SELECT score_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM points GROUP BY score_id")
def a28_outcomes(spark, d):
    return A.outcome_counts(points(spark, d), ["score_id"], c("value") > 50)


@query("SELECT doc_id, first(CAST(v AS DOUBLE) ORDER BY i) AS tempo FROM (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS v FROM (SELECT c_custkey AS doc_id, [CAST(c_nationkey + 20 AS VARCHAR), CAST(c_nationkey * 9 + 25 AS VARCHAR)] AS m FROM customer)) WHERE CAST(v AS DOUBLE) BETWEEN 30 AND 300 GROUP BY doc_id")
def p13_tempo_pages(spark, d):
    t = F.concat(F.lit("Slow = "), (c("c_nationkey") + 20).cast("string"), F.lit(" and q = "), (c("c_nationkey") * 9 + 25).cast("string"))
    return A.tempo_from_pages(table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.lit(1).alias("page"), t.alias("text")))


# -- windows, sequences, folds ---------------------------------------------------------------------------------

@query(f"""WITH {POINTS}, i AS (SELECT *, sum(CASE WHEN us - p <= 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(us) OVER (PARTITION BY score_id ORDER BY us) AS p FROM points))
SELECT score_id, CAST(g AS BIGINT) AS island, min(us) AS first, max(us) AS last, count(*) AS n FROM i GROUP BY ALL""")
def w1_islands(spark, d):
    return W.island_centres(points(spark, d), ["score_id"], "us", 3_600_000_000).select("score_id", "island", "first", "last", "n")


@query(f"""WITH RECURSIVE {NOTES}, o AS (SELECT measure, fret, row_number() OVER (PARTITION BY measure ORDER BY fret) AS r FROM notes),
f AS (SELECT measure, r, fret, fret AS first, 1 AS g FROM o WHERE r = 1 UNION ALL SELECT o.measure, o.r, o.fret, CASE WHEN o.fret - f.first <= 5 THEN f.first ELSE o.fret END, CASE WHEN o.fret - f.first <= 5 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.measure = f.measure AND o.r = f.r + 1)
SELECT measure, CAST(fret AS DOUBLE) AS fret, g AS "group" FROM f""")
def w2_chord_groups(spark, d):
    return W.chord_groups(notes(spark, d), ["measure"], "fret", 5.0)


@query(f"""WITH RECURSIVE {NOTES}, o AS (SELECT measure, fret, row_number() OVER (PARTITION BY measure ORDER BY fret) AS r FROM notes),
f AS (SELECT measure, r, fret, CAST(fret AS DOUBLE) AS s, 1 AS n, 1 AS g FROM o WHERE r = 1 UNION ALL SELECT o.measure, o.r, o.fret, CASE WHEN abs(o.fret - f.s / f.n) <= 5 THEN f.s + o.fret ELSE o.fret END, CASE WHEN abs(o.fret - f.s / f.n) <= 5 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(o.fret - f.s / f.n) <= 5 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.measure = f.measure AND o.r = f.r + 1)
SELECT measure, CAST(fret AS DOUBLE) AS fret, g AS "group" FROM f""")
def w3_mean_groups(spark, d):
    return W.mean_groups(notes(spark, d), ["measure"], "fret", 5.0)


@query(f"""WITH RECURSIVE {NOTES}, o AS (SELECT measure, ix, q FROM notes), f AS (SELECT measure, ix, q AS kept, q, true AS k FROM o WHERE ix = 1 UNION ALL SELECT o.measure, o.ix, CASE WHEN abs(o.q - f.kept) >= 10 THEN o.q ELSE f.kept END, o.q, abs(o.q - f.kept) >= 10 FROM f JOIN o ON o.measure = f.measure AND o.ix = f.ix + 1)
SELECT measure, ix, CAST(q AS DOUBLE) AS q FROM f WHERE k""")
def w5_suppress(spark, d):
    return W.suppress_adjacent(notes(spark, d), ["measure"], "ix", "q", 10.0)


@query(f"WITH {POINTS} SELECT score_id, event_id FROM (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM points WINDOW w AS (PARTITION BY score_id ORDER BY us)) WHERE value >= p AND value > n AND value >= 60")
def w6_peaks(spark, d):
    return W.peaks(points(spark, d), ["score_id"], "us", "value", F.lit(60.0)).select("score_id", "event_id")


@query(f"""WITH RECURSIVE {POINTS}, w AS (SELECT score_id, us, CAST(value AS DOUBLE) AS v, lag(value) OVER o AS p, lead(value) OVER o AS n FROM points WINDOW o AS (PARTITION BY score_id ORDER BY us)), k AS (SELECT score_id, us, v, row_number() OVER (PARTITION BY score_id ORDER BY us) AS k FROM w WHERE v >= p AND v > n AND v >= 60),
r AS (SELECT score_id, k, [{{'us': us, 'v': v}}] AS s FROM k WHERE k = 1 UNION ALL SELECT r.score_id, k.k, CASE WHEN k.us - s[-1].us >= 7200000000 THEN list_append(s, {{'us': k.us, 'v': k.v}}) WHEN k.v > s[-1].v THEN list_append(s[:-2], {{'us': k.us, 'v': k.v}}) ELSE s END FROM r JOIN k ON k.score_id = r.score_id AND k.k = r.k + 1),
z AS (SELECT score_id, unnest(arg_max(s, k)) AS x FROM r GROUP BY score_id) SELECT score_id, x.us AS us, x.v AS value FROM z""")
def w7_thin_peaks(spark, d):
    return W.thin_peaks(W.peaks(points(spark, d), ["score_id"], "us", "value", F.lit(60.0)), ["score_id"], "us", "value", 7.2e9)


@query(f"WITH {POINTS} SELECT score_id, event_id, round(sum(value) OVER (PARTITION BY score_id ORDER BY us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 6) AS baseline FROM points")
def w8_baseline(spark, d):
    return W.moving_baseline(points(spark, d), ["score_id"], "us", "value").select("score_id", "event_id", F.round("baseline", 6).alias("baseline"))


@query(f"WITH {POINTS}, g AS (SELECT score_id, us - lag(us) OVER (PARTITION BY score_id ORDER BY us) AS g FROM points), s AS (SELECT score_id, quantile_cont(CAST(g AS DOUBLE), 0.5) AS m, max(g) AS hi, min(g) AS lo FROM g WHERE g IS NOT NULL GROUP BY score_id) SELECT score_id, m AS spacing, round(greatest(hi - m, m - lo) / m, 6) AS irregularity FROM s")
def w9_spacing(spark, d):
    return W.spacing_stats(points(spark, d), ["score_id"], "us").withColumn("irregularity", F.round("irregularity", 6))


@query(f"WITH {NOTES}, o AS (SELECT score_id, measure, ix, duration64, coalesce(sum(duration64) OVER (PARTITION BY measure ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM notes) SELECT measure, ix, CAST(onset AS BIGINT) AS onset64, least(duration64, 64 - onset) AS duration64 FROM o WHERE onset < 64")
def w13_onsets(spark, d):
    return W.build_onsets(notes(spark, d).withColumn("ord", c("ix")), ["measure"]).select("measure", "ix", "onset64", "duration64")


@query(f"WITH {NOTES} SELECT score_id, measure, ix, CASE WHEN flag <> 'N' THEN lead(fret) OVER w END AS next_fret, coalesce(lag(flag <> 'N') OVER w, false) AS link_stop FROM notes WINDOW w AS (PARTITION BY score_id, string ORDER BY measure, ix)")
def w14_links(spark, d):
    n = notes(spark, d).withColumn("technique", F.when(c("flag") == "A", "slide").when(c("flag") == "R", "hammer_on"))
    return W.technique_links(n, ["score_id"], ["measure", "ix"]).select("score_id", "measure", "ix", "next_fret", "link_stop")


@query(f"""WITH RECURSIVE {NOTES}, f AS (SELECT measure, ix, ix AS x, fret AS y, true AS k FROM notes WHERE ix = 1 UNION ALL SELECT n.measure, n.ix, CASE WHEN n.fret > f.y THEN n.ix ELSE f.x END, CASE WHEN n.fret > f.y THEN n.fret ELSE f.y END, n.fret > f.y FROM f JOIN notes n ON n.measure = f.measure AND n.ix = f.ix + 1)
SELECT measure, CAST(x AS DOUBLE) AS ix, CAST(y AS DOUBLE) AS fret FROM f WHERE k""")
def w15_anchors(spark, d):
    return W.monotone_anchors(notes(spark, d), ["measure"], "ix", "fret")


@query(f"WITH {POINTS} SELECT score_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY score_id) AS n FROM points) WHERE i % 4 = 0 OR i = n - 1")
def w16_stride(spark, d):
    return W.stride_sample(points(spark, d), ["score_id"], [c("us"), c("event_id")], 4).select("score_id", "event_id")


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source FROM documents)), k AS (SELECT *, greatest(1, round_even(n * 0.12, 0)) AS t FROM s)
SELECT source, CASE WHEN i < t THEN 'test' WHEN i < 2 * t THEN 'val' ELSE 'train' END AS split FROM k""")
def w17_ordered_split(spark, d):
    return W.ordered_split(table(spark, d, "documents").select(c("doc_id").cast("string").alias("source")), "source")


@query(f"WITH {NOTES} SELECT measure, ix, CAST(onset64 + coalesce(sum(q % 3) OVER (PARTITION BY measure ORDER BY onset64 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onset64, duration64 + q % 3 AS duration64 FROM notes")
def w18_reflow(spark, d):
    return W.reflow(notes(spark, d).withColumn("delta", c("q") % 3), ["measure"], "delta").select("measure", "ix", "onset64", "duration64")


@query(f"WITH {NOTES} SELECT measure, ix, CAST(onset64 - coalesce(sum(CASE WHEN flag = 'R' THEN duration64 ELSE 0 END) OVER (PARTITION BY measure ORDER BY onset64 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onset64 FROM notes QUALIFY flag <> 'R'")
def w19_delete_beats(spark, d):
    return W.delete_beats(notes(spark, d), ["measure"], c("flag") == "R").select("measure", "ix", "onset64")


@query(f"""WITH {NOTES}, e AS (SELECT *, sum(CASE WHEN flag = 'R' THEN 0 ELSE 1 END) OVER (PARTITION BY measure ORDER BY onset64 ROWS UNBOUNDED PRECEDING) AS b FROM notes), r AS (SELECT measure, b, sum(CASE WHEN flag = 'R' THEN duration64 ELSE 0 END) AS r FROM e GROUP BY ALL), l AS (SELECT measure, max(b) AS lb, max(onset64 + duration64) AS fin FROM e GROUP BY ALL)
SELECT e.measure, e.ix, CAST(r.r + CASE WHEN e.b = lb THEN greatest(0, 96 - fin) ELSE 0 END AS BIGINT) AS following_rest FROM e JOIN r USING (measure, b) JOIN l USING (measure) WHERE flag <> 'R'""")
def w20_rest_capacity(spark, d):
    return W.rest_capacity(notes(spark, d).withColumn("rest", c("flag") == "R"), ["measure"], 96).select("measure", "ix", "following_rest")


@query(f"""WITH {NOTES}, e AS (SELECT measure, onset64 AS o, coalesce(max(onset64 + duration64) OVER (PARTITION BY measure ORDER BY onset64, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM notes),
g AS (SELECT measure, o - f AS gap FROM e WHERE o > f UNION ALL SELECT measure, 96 - max(onset64 + duration64) FROM notes GROUP BY measure HAVING max(onset64 + duration64) < 96) SELECT measure, CAST(sum(gap) AS BIGINT) AS rest64 FROM g GROUP BY measure""")
def w21_fill_rests(spark, d):
    return W.fill_rests(notes(spark, d).withColumn("ord", c("ix")), ["measure"], 96).groupBy("measure").agg(F.sum("duration64").alias("rest64"))


@query(f"""WITH {NOTES}, s AS (SELECT measure, ix, CASE WHEN flag <> 'N' THEN string END AS a FROM notes), k AS (SELECT measure, ix, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY measure ORDER BY ix), 4) AS ts_num, last_value(a IGNORE NULLS) OVER (PARTITION BY measure ORDER BY ix) IS NULL AS dflt FROM s)
SELECT measure, ix, ts_num, CASE WHEN dflt THEN 4 ELSE 8 END AS ts_den, lag(ts_num) OVER w IS NULL OR lag(ts_num) OVER w <> ts_num OR lag(dflt) OVER w <> dflt AS changed FROM k WINDOW w AS (PARTITION BY measure ORDER BY ix)""")
def w22_signatures(spark, d):
    n = notes(spark, d).select("measure", "ix", F.when(c("flag") != "N", c("string")).alias("ts_num"), F.when(c("flag") != "N", F.lit(8)).alias("ts_den"))
    return W.signature_changes(n, ["measure"], "ix").select("measure", "ix", "ts_num", "ts_den", "changed")


@query()
def w23_smooth_starts(spark, d):
    week = 7 * 24 * 3_600_000_000
    p = points(spark, d).select((c("score_id") * 1000 + F.floor(c("us") / week) % 1000).alias("score_id"), c("event_id").alias("frame_id"), (c("us") % week / 6e8).alias("t"), (c("event_id") % 3).cast("int").alias("index"), c("value").alias("conf"))
    return W.smooth_starts(p.withColumn("value", F.when(c("frame_id") % 7 == 0, 900).otherwise((c("t") * 0.75).cast("int") + c("index"))))


@query()
def w24_leader_clusters(spark, d):
    e = table(spark, d, "embeddings").select((c("label") * 1_000_000 + F.floor(c("vec_id") / 1000)).alias("run_id"), c("vec_id").alias("ord"), F.transform("embedding", lambda x: (x > 0).cast("tinyint")).alias("feature"))
    return W.leader_clusters(e, 0.3).withColumn("distance", F.round("distance", 6))


# -- signal ----------------------------------------------------------------------------------------------------

NOVELTY = f"""{POINTS}, b AS (SELECT *, greatest(value - sum(value) OVER (PARTITION BY score_id ORDER BY us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 * 0.72, 0) AS n FROM points), h AS (SELECT score_id, quantile_cont(n, 0.98) AS h FROM b GROUP BY score_id),
nov AS (SELECT b.*, CASE WHEN h > 1e-8 THEN least(2.0, n / h) ELSE n END AS novelty FROM b JOIN h USING (score_id))"""


@query(f"WITH {NOVELTY} SELECT score_id, event_id, round(novelty, 6) AS novelty FROM nov")
def t6_novelty(spark, d):
    return T.novelty(points(spark, d), ["score_id"], "us", "value").select("score_id", "event_id", F.round("novelty", 6).alias("novelty"))


@query(f"""WITH RECURSIVE {NOVELTY}, h2 AS (SELECT score_id, greatest(0.16, median(novelty) + 0.65 * stddev_pop(novelty)) AS t FROM nov GROUP BY score_id), w AS (SELECT score_id, us, novelty AS v, lag(novelty) OVER o AS p, lead(novelty) OVER o AS n FROM nov WINDOW o AS (PARTITION BY score_id ORDER BY us)),
k AS (SELECT w.score_id, us, v, row_number() OVER (PARTITION BY w.score_id ORDER BY us) AS k FROM w JOIN h2 ON h2.score_id = w.score_id WHERE v >= p AND v > n AND v >= t),
r AS (SELECT score_id, k, [{{'us': us, 'v': v}}] AS s FROM k WHERE k = 1 UNION ALL SELECT r.score_id, k.k, CASE WHEN k.us - s[-1].us >= 600000000 THEN list_append(s, {{'us': k.us, 'v': k.v}}) WHEN k.v > s[-1].v THEN list_append(s[:-2], {{'us': k.us, 'v': k.v}}) ELSE s END FROM r JOIN k ON k.score_id = r.score_id AND k.k = r.k + 1),
z AS (SELECT score_id, unnest(arg_max(s, k)) AS x FROM r GROUP BY score_id) SELECT score_id, x.us AS us, round(x.v, 6) AS novelty FROM z""")
def t7_onsets(spark, d):
    n = T.novelty(points(spark, d), ["score_id"], "us", "value")
    return T.onsets(n, ["score_id"], "us", 600_000_000).withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH {POINTS}, x AS (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY us) - 1 AS i, value - avg(value) OVER (PARTITION BY score_id) AS c FROM points), e AS (SELECT score_id, sum(c * c) AS e FROM x GROUP BY score_id)
SELECT a.score_id, CAST(b.i - a.i AS INT) AS lag, round(sum(a.c * b.c) / (max(e.e) + 1e-8), 6) AS correlation FROM x a JOIN x b ON a.score_id = b.score_id AND b.i - a.i BETWEEN 1 AND 6 JOIN e ON e.score_id = a.score_id GROUP BY ALL""")
def t8_autocorrelation(spark, d):
    p = points(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("score_id").orderBy("us")) - 1)
    return T.autocorrelation(p, ["score_id"], "i", "value", list(range(1, 7))).withColumn("correlation", F.round("correlation", 6))


@query("SELECT s_suppkey AS score_id, unnest(generate_series(0, CAST(floor((20 - s_suppkey % 2) / 0.5) AS INT))) AS beat, unnest(list_transform(generate_series(0, CAST(floor((20 - s_suppkey % 2) / 0.5) AS INT)), lambda i: s_suppkey % 2 + i * 0.5)) AS t FROM supplier")
def t12_beat_grid(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("score_id"), F.lit(120.0).alias("tempo_bpm"), F.lit(0.0).alias("phase"), F.lit(20.0).alias("duration"), ((c("s_suppkey") % 2) + F.when(c("s_suppkey") % 2 == 1, 0.5).otherwise(0.0)).cast("double").alias("active_start"))
    return T.beat_grid(s).select("score_id", c("beat").cast("long").alias("beat"), "t")


@query(f"""WITH {POINTS} SELECT score_id, event_id, round(abs(CASE WHEN lag(1, 2) OVER w IS NULL OR lead(1, 2) OVER w IS NULL THEN 0 ELSE (value + lead(value) OVER w) / 2 - (lag(value) OVER w + lag(value, 2) OVER w) / 2 END), 6) AS segment_novelty FROM points WINDOW w AS (PARTITION BY score_id ORDER BY us)""")
def t14_segment_novelty(spark, d):
    p = points(spark, d).withColumn("feature", F.array(c("value").cast("double")))
    return T.segment_novelty(p, ["score_id"], "us").select("score_id", "event_id", F.round("segment_novelty", 6).alias("segment_novelty"))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS start, CAST(vec_id // 8 AS BIGINT) AS score_id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT DISTINCT score_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[][]) AS ts, CAST(NULL AS INT) AS label FROM e UNION ALL
 SELECT score_id, k, CASE WHEN hit > 0 THEN ts ELSE list_append(ts, v) END, CAST(CASE WHEN hit > 0 THEN hit - 1 ELSE len(ts) END AS INT) FROM (SELECT r.score_id, e.k, ts, e.v, coalesce(list_position(list_transform(ts, lambda t: list_cosine_similarity(t, e.v) >= 0.6), true), 0) AS hit FROM r JOIN e ON e.score_id = r.score_id AND e.k = r.k + 1))
SELECT e.score_id, e.start, r.label FROM r JOIN e USING (score_id, k)""")
def t16_section_labels(spark, d):
    e = table(spark, d, "embeddings").withColumn("start", c("vec_id")).withColumn("score_id", F.floor(c("vec_id") / 8))
    return T.label_sections(e, ["score_id"], "start", "embedding", 0.6)


@query("""SELECT s_suppkey AS score_id, CAST(m AS INT) AS measure_number, round(0.5 + (m - 1) * 2.0, 3) AS time_seconds, round_even((m - 1) / (s_suppkey % 40)::DOUBLE, 5) AS score_position, CASE WHEN m % 8 = 1 THEN '自动 · 节拍网格' ELSE '自动 · 结尾' END AS label, CASE WHEN m % 8 = 1 THEN 0.62 ELSE 0.58 END::DOUBLE AS confidence, 'audio_beat_grid' AS basis
FROM supplier, generate_series(1, 40) g(m) WHERE s_suppkey % 40 > 0 AND (m % 8 = 1 OR m = 1 + s_suppkey % 40) AND m <= 1 + s_suppkey % 40 AND 0.5 + (m - 1) * 2.0 <= 60""")
def t18_align_grid(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("score_id"), F.lit("audio").alias("source_kind"), F.lit(1).alias("start_measure"), F.lit(None).cast("int").alias("end_measure"), (1 + c("s_suppkey") % 40).cast("int").alias("measure_count"), F.lit(0.5).alias("first_beat"), F.lit(120.0).alias("tempo_bpm"), F.lit(60.0).alias("duration"))
    return T.suggest_alignment(s, spark.createDataFrame([], "score_id bigint, start_seconds double, label string"))


@query(f"""WITH RECURSIVE {NOTES}, p AS (SELECT DISTINCT score_id, measure AS m FROM notes), x AS (SELECT score_id, m, min(m) OVER (PARTITION BY score_id ORDER BY m RANGE BETWEEN 8 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p),
r AS (SELECT score_id, min(m) AS m FROM p GROUP BY score_id UNION ALL SELECT x.score_id, x.nxt FROM r JOIN x ON x.score_id = r.score_id AND x.m = r.m WHERE x.nxt IS NOT NULL)
SELECT score_id, m AS measure_number, m * 2.0::DOUBLE AS time_seconds, 'video_highlight' AS basis FROM (SELECT * FROM r UNION SELECT score_id, max(m) FROM p GROUP BY score_id)""")
def t17_align_video(spark, d):
    n = notes(spark, d).select("score_id", c("measure").alias("measure_number"), (c("measure") * 2.0).alias("time_seconds")).distinct()
    return T.align_video(n, ["score_id"])


# -- orderings and sets ----------------------------------------------------------------------------------------

@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS rank FROM orders) WHERE rank <= 3")
def k1_latest(spark, d):
    return A.head_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(lower(url), '://([^/?#:]+)', 1) ORDER BY length(html) DESC, page_id) AS r FROM pages) WHERE r = 1")
def k5_largest(spark, d):
    p = table(spark, d, "pages").withColumn("host", S.url_host(c("url"))).withColumn("size", F.char_length("html"))
    return A.head_per_group(p, ["host"], [F.desc("size"), c("page_id")], 1).select("page_id")


@query("SELECT source_id, track_index, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, track_index) AS INT) AS rank FROM (SELECT p_brand AS source_id, p_partkey AS track_index, (CASE WHEN p_type LIKE '%STEEL%' THEN 100000 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 10000 ELSE 0 END) + p_size AS score FROM part) WHERE score > 0")
def k4_tracks(spark, d):
    p = table(spark, d, "part").select(c("p_brand").alias("source_id"), c("p_partkey").alias("track_index"), c("p_type").alias("name"), (c("p_size") > 25).alias("has_tab"), c("p_size").alias("note_count"))
    return A.rank_tracks(p, "STEEL").select("source_id", "track_index", "score", "rank")


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7/' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 5")
def k7_balanced_sample(spark, d):
    return A.balanced_sample(table(spark, d, "embeddings"), "label", ["vec_id"], 5, 7).select("vec_id", "label")


@query(f"WITH {NOTES} SELECT measure, string, 'R' AS kind FROM notes WHERE flag = 'R' UNION ALL SELECT measure, NULL, 'A' FROM notes WHERE flag = 'A'")
def x1_union(spark, d):
    n = notes(spark, d)
    return A.union_all(n.filter("flag = 'R'").select("measure", "string", F.lit("R").alias("kind")), n.filter("flag = 'A'").select("measure", F.lit("A").alias("kind")))


@query(f"WITH {NOTES} SELECT measure, string FROM notes WHERE flag = 'R' UNION SELECT measure, string FROM notes WHERE flag = 'A'")
def x2_all_keys(spark, d):
    n = notes(spark, d)
    return A.all_keys(n.filter("flag = 'R'"), n.filter("flag = 'A'"), ["measure", "string"])


@query(f"WITH {NOTES} SELECT measure, string, arg_max(fret, ix) AS fret FROM notes GROUP BY measure, string")
def x3_distinct_last(spark, d):
    return A.distinct_last(notes(spark, d), ["measure", "string"], "ix").select("measure", "string", "fret")


@query(f"WITH {NOTES} SELECT measure, string, ix FROM notes n WHERE flag = 'R' AND NOT EXISTS (SELECT 1 FROM notes a WHERE a.measure = n.measure AND a.string = n.string AND a.flag = 'A')")
def x4_new_keys(spark, d):
    n = notes(spark, d)
    return A.new_keys(n.filter("flag = 'R'"), n.filter("flag = 'A'"), ["measure", "string"]).select("measure", "string", "ix")


@query(f"WITH {NOTES} SELECT measure, flag, ix FROM notes n WHERE flag <> 'R' AND measure NOT IN (SELECT measure FROM notes WHERE flag = 'R') UNION ALL SELECT measure, flag, ix FROM notes WHERE flag = 'R'")
def x5_replace_slice(spark, d):
    n = notes(spark, d).select("measure", "flag", "ix")
    return A.replace_slice(n.filter("flag <> 'R'"), n.filter("flag = 'R'"), ["measure"])


@query("SELECT source, count(DISTINCT lang) AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def x6_leaks(spark, d):
    return A.split_leaks(table(spark, d, "documents"), "source", "lang")


# -- edits -----------------------------------------------------------------------------------------------------

@query(f"WITH {NOTES} SELECT measure AS score_id, CAST(CASE WHEN ix > 2 THEN ix + 1 ELSE ix END AS INT) AS number FROM notes UNION ALL SELECT DISTINCT measure, 3 FROM notes WHERE flag = 'R' AND false")
def u2_shift(spark, d):
    n = notes(spark, d).select(c("measure").alias("score_id"), c("ix").alias("number"))
    return U.insert_measure(n, n.select("score_id").distinct().withColumn("after", F.lit(2)))


@query(f"WITH {NOTES} SELECT measure AS score_id, CASE WHEN ix > 2 THEN ix + 1 ELSE ix END AS number FROM notes UNION ALL SELECT DISTINCT measure, 3 FROM notes")
def u2_insert(spark, d):
    n = notes(spark, d).select(c("measure").alias("score_id"), c("ix").alias("number"))
    return U.insert_measures(n, n.select("score_id").distinct().withColumn("after", F.lit(2))).select("score_id", "number")


@query("SELECT s_suppkey AS score_id, CAST(unnest(generate_series(1, 1 + s_nationkey % 5)) AS INT) AS number, 4 AS ts_num, 4 AS ts_den FROM supplier")
def u3_blank(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("score_id"), "s_nationkey")
    return U.blank_score(s, 1 + c("s_nationkey") % 5).select("score_id", "number", "ts_num", "ts_den")


@query("""SELECT c_custkey AS score_id, CAST(CASE WHEN c_nationkey % 4 = 0 THEN 90 WHEN c_custkey % 3 = 0 THEN 100 WHEN c_custkey % 5 = 0 THEN 110 WHEN c_custkey % 2 = 0 AND c_nationkey % 4 <> 1 THEN 130 ELSE 90 END AS DOUBLE) AS tempo_bpm,
CASE WHEN c_nationkey % 4 = 0 THEN 'user' WHEN c_custkey % 3 = 0 THEN 'visual' WHEN c_custkey % 5 = 0 THEN 'video_timing' WHEN c_custkey % 2 = 0 AND c_nationkey % 4 <> 1 THEN 'audio_analysis' WHEN c_nationkey % 4 = 1 THEN 'visual' ELSE 'default' END AS tempo_source FROM customer""")
def u4_tempo(spark, d):
    cu = table(spark, d, "customer")
    p = cu.select(c("c_custkey").alias("score_id"), F.lit(90.0).alias("tempo_bpm"), F.when(c("c_nationkey") % 4 == 0, "user").when(c("c_nationkey") % 4 == 1, "visual").otherwise("default").alias("tempo_source"), (c("c_nationkey") % 4 == 0).alias("tempo_locked"))
    options = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("tempo"), F.lit(m).alias("m")) for s, t, m in (("visual", 100.0, 3), ("video_timing", 110.0, 5), ("audio_analysis", 130.0, 2))])
    cand = cu.select(c("c_custkey").alias("score_id"), F.inline(options)).filter("score_id % m = 0")
    return U.resolve_tempo(p, cand).select("score_id", "tempo_bpm", "tempo_source")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'P' THEN 'processing' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 1 THEN 'ready' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 2 THEN 'failed' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 3 THEN 'draft' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'draft' END AS status FROM orders")
def u6_status(spark, d):
    status = F.when(c("o_orderstatus") == "P", "processing").otherwise("draft")
    event = F.get(F.array(*map(F.lit, ("start", "finish", "fail", "cancel"))), (c("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", U.next_status(status, event).alias("status"))


@query(f"WITH {POINTS} SELECT p.score_id, p.event_id FROM points p JOIN (SELECT score_id, min(kind) AS kind FROM points GROUP BY score_id) USING (score_id, kind)")
def u7_accept(spark, d):
    p = points(spark, d).withColumnRenamed("kind", "analysis_id")
    return U.accept_results(p, p.groupBy("score_id").agg(F.min("analysis_id").alias("analysis_id"))).select("score_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def u9_cascade(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return U.cascade_delete(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query(f"""WITH {NOTES}, r AS (SELECT measure, ix, onset64 AS s, onset64 + duration64 AS e FROM notes), p AS (SELECT measure, ix, s, least(e, 20) AS e FROM r WHERE s < 20 AND s < least(e, 20) UNION ALL SELECT measure, ix, greatest(s, 44), e FROM r WHERE e > 44)
SELECT measure, ix, s AS start, e AS "end" FROM p""")
def u10_subtract(spark, d):
    n = notes(spark, d).select("measure", "ix", c("onset64").alias("start"), (c("onset64") + c("duration64")).alias("end"))
    return U.subtract_interval(n, n.select("measure").distinct().withColumn("cut_start", F.lit(20)).withColumn("cut_end", F.lit(44)), ["measure"])


@query(f"WITH {NOTES} SELECT measure, ix, CASE WHEN string > 3 THEN CASE WHEN min(CASE WHEN string > 3 THEN CASE WHEN flag = 'A' THEN 1 ELSE 0 END END) OVER (PARTITION BY measure) = 1 THEN NULL ELSE 'bend' END WHEN flag = 'A' THEN 'bend' END AS technique FROM notes")
def u13_toggle(spark, d):
    n = notes(spark, d).withColumn("technique", F.when(c("flag") == "A", "bend"))
    return U.toggle_technique(n, ["measure"], c("string") > 3, "bend").select("measure", "ix", "technique")


@query(f"WITH {NOTES}, e AS (SELECT *, coalesce(onset64 + 16 <= lead(onset64) OVER (PARTITION BY measure ORDER BY onset64), true) AS f FROM notes) SELECT measure, ix, string > 3 AND NOT f AS rejected, CASE WHEN string > 3 AND f THEN 16 ELSE duration64 END AS duration64 FROM e")
def u14_set_duration(spark, d):
    return U.set_duration(notes(spark, d), ["measure"], c("string") > 3, F.lit(16)).select("measure", "ix", "rejected", "duration64")


REFINGER = f"WITH {NOTES}, g0 AS (SELECT measure, ix, string, fret, fret + [64, 59, 55, 50, 45, 40][string] - [64, 59, 55, 50, 45, 40][string + 1] AS f, flag <> 'N' AND string + 1 <= 6 AND coalesce(fret + [64, 59, 55, 50, 45, 40][string] - [64, 59, 55, 50, 45, 40][string + 1] BETWEEN 0 AND 36, false) AS go FROM notes)" + "".join(
    f", g{i + 1} AS (SELECT measure, ix, string, fret, f, go AND NOT coalesce(list_contains(list(string) FILTER (NOT go) OVER (PARTITION BY measure), string + 1), false) AS go FROM g{i})" for i in range(6)
)


@query(f"{REFINGER} SELECT measure, ix, CASE WHEN go THEN string + 1 ELSE string END AS string, CASE WHEN go THEN f ELSE fret END AS fret, go AS moved FROM g6")
def u15_refinger(spark, d):
    n = notes(spark, d).withColumn("selected", c("flag") != "N")
    return U.refinger(n, ["measure"], 1).select("measure", "ix", "string", "fret", "moved")


@query(f"WITH {NOTES} SELECT score_id, fret AS number FROM notes UNION ALL SELECT score_id, number FROM (WITH r AS (SELECT score_id, min(fret) AS lo, max(fret) AS hi FROM notes GROUP BY ALL), x AS (SELECT score_id, unnest(generate_series(lo, hi)) AS number FROM r) SELECT score_id, number FROM x EXCEPT SELECT score_id, fret FROM notes)")
def u18_fill(spark, d):
    return U.fill_missing(notes(spark, d).select("score_id", c("fret").alias("number")))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END), ''), 'Score ' || c_mktsegment) AS title, 'draft' AS status FROM customer")
def u20_projects(spark, d):
    r = table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 2 == 0, " ").otherwise(c("c_name")).alias("title"), c("c_mktsegment").alias("source_id"))
    return U.new_projects(r, F.current_timestamp()).select("c_custkey", "title", "status")


@query(f"WITH {NOTES} SELECT n.measure AS score_id, n.ix AS point_id FROM notes n WHERE NOT (n.string = 2 AND n.measure % 2 = 0)")
def u22_delete_points(spark, d):
    n = notes(spark, d).select(c("measure").alias("score_id"), c("ix").alias("point_id"), "string")
    deletes = n.filter("string = 2").select("score_id", "point_id").withColumn("user_id", F.lit(1))
    owners = n.select("score_id").distinct().filter("score_id % 2 = 0").withColumn("user_id", F.lit(1))
    return U.delete_points(n.select("score_id", "point_id"), deletes, owners)[0]


# -- streaming forms over a finished table -----------------------------------------------------------------------

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def z4_windows(spark, d):
    return Z.window_counts(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - p < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def z4_sessions(spark, d):
    return Z.session_counts(table(spark, d, "events"))

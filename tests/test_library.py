"""The library's operators on small tables with the values that their rules give."""

import json
import re
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tabspark.functions import models, scalars as S
from tabspark.operators import aggs as A, edits as U, joins as J, seq as W, signal as T
from tabspark.sources import io as IO
from tabspark.streaming import forms as Z


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]



def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_rests_and_notation(spark):
    r = one(spark, a=S.split_rest(F.lit(40)), b=S.notation_of(F.lit(7)), d=S.duration_shape(F.lit(7)), e=S.written_to_units(F.lit(4), F.lit(1)), f=S.split_rest(F.lit(0)))
    assert r.a == [32, 8] and tuple(r.b) == ("16th", 2) and tuple(r.d) == (4, 2) and r.e == 3.0 and r.f == []


@pytest.mark.parametrize("text, want", [("BPM 180", 180.0), ("Tempo: 96.5", 96.5), ("Q = 144", 144.0), ("32 7 9 12", None), ("tempo 20", None), (None, None)])
def test_tempo_text(spark, text, want):
    assert one(spark, t=S.tempo_from_text(F.lit(text).cast("string"))).t == want


@pytest.mark.parametrize("text, want", [("H", "hammer_on"), ("P", "pull_off"), ("sl.", "slide"), ("P.M.", "palm_mute"), ("Full", "bend"), ("N.H.", "harmonic"), ("12", None)])
def test_technique(spark, text, want):
    assert one(spark, t=S.technique_from_text(F.lit(text))).t == want


def test_source_reference(spark):
    hosts = ["video.example.org"]
    refs = ["BV1xx411c7mD", "https://video.example.org/v/bv1xx411c7mD?p=2", "https://evil.example.com/BV1xx411c7mD", "av170001", "nothing", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string").select("i", S.parse_source_ref(F.col("r"), hosts).alias("p")).orderBy("i")
    assert [None if r.p is None else r.p.source_id for r in df.collect()] == ["BV1xx411c7mD", "BV1xx411c7mD", None, "av170001", None, None]


def test_media(spark):
    r = one(spark, n=S.estimate_frames(F.lit(2.0), F.lit(8.0), F.lit(30.0), F.lit(60)), b=S.crop_to_pixels(F.lit(1920), F.lit(1080), F.lit(0.1), F.lit(0.2), F.lit(0.8), F.lit(0.5)), r=S.parse_rate(F.lit("0/0")), q=S.parse_rate(F.lit("30000/1001")), z=S.parse_rate(F.lit(None).cast("string")))
    assert r.n == 4 and tuple(r.b) == (192, 216, 1536, 540) and r.r == 0.0 and round(r.q, 3) == 29.97 and r.z == 0.0


def test_ctc_and_predictions(spark):
    logits = F.array(*[F.array(*map(F.lit, row)) for row in ([0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.9, 0.05, 0.05], [0.1, 0.2, 0.7])])
    r = one(spark, d=S.ctc_decode(logits, "12"))
    assert r.d.text == "12" and abs(r.d.confidence - 0.75) < 1e-9
    assert one(spark, a=models.accept_prediction(F.lit("12"), F.lit(0.9))).a and not one(spark, a=models.accept_prediction(F.lit("x"), F.lit(0.9))).a


def test_json_object(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("[1]",), ("bad",), (None,)], "j string").select(S.parse_object(F.col("j"), "k int").alias("o"))
    assert [None if r.o is None else r.o.k for r in df.collect()] == [3, None, None, None]


@pytest.mark.parametrize("events, want", [([(0, 16), (16, 48)], (64, 0, 0, False, True)), ([(0, 32), (40, 24)], (56, 8, 0, True, False)), ([(0, 48), (32, 32)], (80, 0, 16, False, False))])
def test_measure_validation(spark, events, want):
    df = spark.createDataFrame([("s", 1, o, d, i) for i, (o, d) in enumerate(events)], "score_id string, number int, onset64 int, duration64 int, ord int")
    r = A.validate_measures(df, ["score_id", "number"], F.lit(64)).first()
    assert (r.committed, r.missing, r.overflow, r.has_gaps, r.complete) == want


def test_attach_mark_to_last_group(spark):
    groups = spark.createDataFrame([(1, 80.0, "a"), (1, 180.0, "b")], "m int, x double, g string")
    marks = spark.createDataFrame([(1, 125.0, "hammer_on")], "m int, x double, technique string")
    shifted = J.asof_backward(marks, groups.withColumn("ord", F.lit(0)), ["m"], "x", ["g"])
    assert values(shifted, "technique", "g") == [("hammer_on", "a")]


def test_interpolation_clamps_and_extends(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "k int, t double, pos double")
    q = spark.createDataFrame([(1, -4.0), (1, 4.0), (1, 20.0)], "k int, t double")
    assert sorted(r.pos for r in J.interpolate(p, q, ["k"], "t", "pos").collect()) == [0.0, 2.0, 5.0]
    assert sorted(r.pos for r in J.interpolate(p, q, ["k"], "t", "pos", clamp=False, floor=0.0).collect()) == [0.0, 2.0, 10.0]


def test_tempo_map(spark):
    ch = spark.createDataFrame([(1, 480, 250_000, 0), (1, 480, 1_000_000, 1), (1, 960, 0, 2)], "k int, tick int, us_per_quarter int, ord int")
    seg = J.tempo_map(ch, ["k"])
    assert sorted(values(seg, "tick", "time_ms")) == [(0, 0.0), (480, 500.0)]
    q = spark.createDataFrame([(1, 960), (1, -3)], "k int, tick int")
    assert sorted(values(J.ticks_to_ms(q, seg, ["k"]), "tick", "ms")) == [(-3, 0.0), (960, 1500.0)]


def test_greedy_matching(spark):
    p = spark.createDataFrame([("s", 1, "1:5", 0, 0.0), ("s", 1, "1:5", 1, 0.1)], "score_id string, number int, notes string, ord int, onset double")
    t = spark.createDataFrame([("s", 1, "1:5", 0, 0.05)], "score_id string, number int, notes string, ord int, onset double")
    assert values(J.match_events(p, t, ["score_id", "number", "notes"]), "pred_ord", "truth_ord") == [(0, 0)]
    box = "image_id int, category_id int, ord int, x double, y double, w double, h double"
    det = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.35), (1, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.2)], box + ", score double")
    truth = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 10.0, 5.0)], box)
    assert sorted(values(J.match_detections(det, truth), "ord", "truth_ord"), key=str) == [(0, 7), (1, None)]


def test_chords_match_by_notes_and_place(spark):
    kind = "image_id int, notes string, x double, ord int"
    p = spark.createDataFrame([(1, "1:5,2:7", 10.0, 0), (1, "1:5,2:7", 11.0, 1), (1, "3:1", 50.0, 2)], kind)
    t = spark.createDataFrame([(1, "1:5,2:7", 12.0, 0), (1, "1:5,2:7", 30.0, 1), (1, "3:2", 50.0, 2)], kind)
    assert values(J.match_chords(p, t, 4.0), "pred_ord", "truth_ord") == [(0, 0)]


def test_alignment_is_applied_once(spark):
    pts = spark.createDataFrame([], "score_id string, measure_number int, time_seconds double, label string")
    sug = spark.createDataFrame([("s", 1, 0.0, "A" * 200), ("s", 9, 16.0, "B")], "score_id string, measure_number int, time_seconds double, label string")
    first = J.apply_alignment(pts, sug, [F.col("time_seconds")])
    assert first.count() == 2 and J.apply_alignment(first, sug, [F.col("time_seconds")]).count() == 2
    assert first.agg(F.max(F.length("label"))).first()[0] == 80


def test_smoothing_repairs_a_bad_label(spark):
    rows = [("s", i, t, k, v, 90.0) for i, (t, ls) in enumerate([(0.0, [10, 11, 12]), (2.0, [12, 13, 14]), (4.0, [999, 15, 16]), (6.0, [16, 17, 18])]) for k, v in enumerate(ls)]
    df = spark.createDataFrame(rows, "score_id string, frame_id int, t double, index int, value int, conf double")
    assert [r.start_measure for r in W.smooth_starts(df).orderBy("frame_id").collect()] == [10, 12, 14, 16]
    none = df.withColumn("value", F.lit(None).cast("int"))
    assert [r.start_measure for r in W.smooth_starts(none).collect()] == [None] * 4


def test_signature_votes(spark):
    frames = spark.createDataFrame([("s", 1, 0, "a"), ("s", 1, 1, "b"), ("s", 2, 0, "b"), ("s", 2, 1, "z")], "score_id string, frame_id int, index int, signature string")
    known = spark.createDataFrame([("s", 5, "a"), ("s", 6, "b")], "score_id string, number int, signature string")
    assert values(J.resolve_by_signature(frames, known), "frame_id", "start_measure") == [(1, 5)]


def test_clusters(spark):
    a, b = [0] * 20, [1] * 20
    near = [0] * 19 + [1]
    df = spark.createDataFrame([(1, 0, a), (1, 1, near), (1, 2, b)], "run_id int, ord int, feature array<tinyint>")
    assert [r.cluster_id for r in W.leader_clusters(df, 0.075).orderBy("ord").collect()] == [0, 0, 1]


def test_staff_rows_and_groups(spark):
    rows = [(1, 50.0, float(y), 550.0, float(y)) for y in range(100, 151, 10)]
    lines = spark.createDataFrame(rows, "page int, x1 double, y1 double, x2 double, y2 double")
    g = W.staff_groups(A.staff_rows(lines, ["page"]), ["page"], "y")
    assert values(g, "system", "spacing") == [(0, 10.0)]


def test_edits(spark):
    note = [{"string": 1, "fret": 3, "technique": None}]
    m = spark.createDataFrame([("s", 1, [(0, 16, False, [(1, 3, None)])], 4, 4, False)], f"score_id string, number int, events array<{U.EVENT}>, ts_num int, ts_den int, human_verified boolean")
    e = spark.createDataFrame([("s", 1, [(0, 16, False, [(2, 7, "bend"), (3, 9, None)])], None, None, True), ("s", 9, [], None, None, True), ("s", 2, [(0, 80, False, [])], 4, 4, True)], m.schema)
    good, bad = U.apply_measure_edits(m, e)
    r = good.first()
    assert r.human_verified and len(r.events[0].notes) == 2 and r.baseline[0].notes[0].fret == note[0]["fret"]
    assert sorted(values(bad, "number", "error")) == [(2, "range"), (9, "unknown_measure")]


def test_insert_and_refinger(spark):
    m = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "score_id string, number int")
    ins = spark.createDataFrame([("s", 1)], "score_id string, after int")
    assert sorted(r.number for r in U.insert_measures(m, ins).collect()) == [1, 2, 3, 4]
    n = spark.createDataFrame([("s", 1, 5, True), ("s", 2, 0, False)], "score_id string, string int, fret int, selected boolean")
    assert sorted(values(U.refinger(n, ["score_id"], 1), "string", "fret", "moved")) == [(1, 5, False), (2, 0, False)]
    assert values(U.refinger(n.filter("selected"), ["score_id"], 1), "string", "fret", "moved") == [(2, 10, True)]


def test_sources_round_trip(spark, tmp_path):
    doc = {"engine": "e", "score_id": "s", "frames": [{"name": "f", "time_seconds": 1.0}], "measures": [{"number": 1, "events": [{"onset": 0.0, "duration": 2.0, "rest": False, "notes": [{"string": 1, "fret": 5}]}]}], "sync_suggestions": [{"measure_number": 1, "time_seconds": 0.5}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    t = IO.read_diagnostics(spark, str(tmp_path / "d.json"))
    assert [t[k].count() for k in ("frames", "measures", "events", "notes", "sync_suggestions")] == [1, 1, 1, 1, 1]
    (tmp_path / "m.jsonl").write_text('{"source_id":"a","status":"ok"}\n\n{"source_id":"b","status":"error"}\n')
    assert [r.source_id for r in IO.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]
    (tmp_path / "w.tsv").write_text("page_num\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t1\t1\t5\t5\t9\t9\t91\t12\n1\t1\t1\t1\tx\t5\t9\t9\t91\t7\n")
    assert values(IO.read_ocr_words(spark, str(tmp_path / "w.tsv")), "left", "text") == [(5, "12")]
    (tmp_path / "l.tsv").write_text("a.png\t5\nb.png\t23\nc.png\tx\n")
    assert values(IO.read_label_list(spark, str(tmp_path / "l.tsv")), "path", "label") == [("a.png", 5)]
    (tmp_path / "s.xml").write_text('<score><part><measure number="1"><note><rest/><duration>2</duration></note><note><duration>2</duration><notations><technical><string>1</string><fret>3</fret></technical></notations></note></measure></part></score>')
    assert values(IO.read_score_xml(spark, str(tmp_path / "s.xml")).orderBy("ix"), "rest", "fret") == [(True, None), (False, 3)]
    df = spark.createDataFrame([("s", 1)], "score_id string, number int")
    IO.publish(df, str(tmp_path / "pub"))
    IO.publish(df.withColumn("number", F.lit(2)), str(tmp_path / "pub"))
    assert values(IO.read_published(spark, str(tmp_path / "pub")), "number") == [(2,)]


def test_label_tree_and_xml(spark):
    tree = [("src", 0, [([(1, [([(4, 0, False, 0, 1.0, [(5, 1, True, False, False, False, 0)])],)])],)])]
    n = IO.flatten_labels(spark.createDataFrame(tree, IO.LABELS))
    assert values(n, "number", "beat", "fret") == [(1, 0, 5)]
    e = spark.createDataFrame([("s", 1, 40, 8, [(1, 3, None)], 4, 4, True)], "score_id string, number int, onset64 int, duration64 int, notes array<struct<string:int,fret:int,technique:string>>, ts_num int, ts_den int, changed boolean")
    xml = IO.render_score_xml(e).first().xml
    assert xml.count("<rest/>") == 3 and "<step>G</step>" in xml and "<beats>4</beats>" in xml


def test_stream_forms(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "sha256 string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    frames = spark.readStream.schema("sha256 string, ts timestamp").parquet(str(src))
    q = Z.stream_dedupe(frames).writeStream.format("memory").queryName("dedupe").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedupe").count() == 2


def test_empty_tables(spark):
    e = spark.createDataFrame([], "score_id string, number int, onset64 int, duration64 int, ord int")
    assert A.validate_measures(e, ["score_id", "number"], F.lit(64)).count() == 0
    assert W.fill_rests(e, ["score_id", "number"]).count() == 0
    assert A.missing_measures(e, ["score_id"]).count() == 0


def test_plans(spark):
    from tabspark.plans import analysis

    rows = [("s", i, float(t), k, v, 90.0) for i, (t, ls) in enumerate([(0, [1, 2]), (2, [2, 3]), (4, [4, 5])]) for k, v in enumerate(ls)]
    labels = spark.createDataFrame(rows, "score_id string, frame_id int, t double, index int, value int, conf double")
    cand = labels.select("score_id", "frame_id", "index", F.concat(F.lit("sig"), F.col("value")).alias("signature"), F.lit(1.0).alias("quality"), F.col("frame_id").alias("ord"))
    out = analysis.recognise_measures(labels, cand, F.lit(64))
    assert sorted(values(out["measures"], "number", "votes")) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)] and out["missing"].count() == 0
    ev = spark.createDataFrame([("s", 1, "1:5", 0, 0.0, 2.0), ("s", 1, "2:5", 1, 2.0, 2.0)], "score_id string, number int, notes string, ord int, onset double, duration double")
    r = analysis.score_recognition(ev, ev.filter("ord = 0")).first()
    assert (r.tp, r.precision, r.recall, r.duration_accuracy) == (1, 0.5, 1.0, 1.0)


def test_rates_sections_and_marks(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 10.0), (1, 20.0, 60.0)], "k int, t double, pos double")
    q = spark.createDataFrame([(1, -1.0), (1, 5.0), (1, 15.0), (2, 1.0)], "k int, t double")
    assert sorted(values(J.tick_rate(a, q, ["k"], "t", "pos"), "k", "t", "rate")) == [(1, -1.0, 1.0), (1, 5.0, 1.0), (1, 15.0, 2.0), (2, 1.0, 1.0)]
    s = spark.createDataFrame([("s", 0, 0.0, "A"), ("s", 1, 10.0, "B")], "score_id string, section int, start_seconds double, label string")
    g = spark.createDataFrame([("s", 4.0), ("s", 5.0), ("s", 6.0)], "score_id string, time_seconds double")
    assert sorted(values(J.nearest_section(g, s), "time_seconds", "section_label")) == [(4.0, "A"), (5.0, "A"), (6.0, "B")]
    p = spark.createDataFrame([(1, 2, "Moderate = 180"), (1, 1, "x = 12 then q = 90.5")], "doc_id int, page int, text string")
    assert values(A.tempo_from_pages(p), "tempo") == [(90.5,)]
    m = spark.createDataFrame([("s", 0, "bad"), ("s", 1, "92.04"), ("s", 2, "80")], "score_id string, ord int, tempo string")
    assert values(A.tempo_from_score(m), "tempo") == [(92.0,)]


def test_store_and_files(spark, tmp_path):
    for t, schema in IO.STORE.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "store" / t))
    tables = IO.load_store(spark, str(tmp_path / "store"))
    assert set(tables) == set(IO.STORE) and all(t.count() == 0 for t in tables.values())
    coco = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 4}], "annotations": [{"id": 5, "image_id": 2, "category_id": 1, "bbox": [0, 0, 3, 0]}], "categories": [{"id": 1, "name": "fret"}]}
    (tmp_path / "c.json").write_text(json.dumps(coco, indent=1))
    d = IO.read_coco(spark, str(tmp_path / "c.json"))
    assert values(d["annotations"], "id", "image_id") == [(5, 2)] and values(d["categories"], "name") == [("fret",)]
    wrong = {tuple(r) for r in U.validate_coco(d["images"], d["annotations"], d["categories"], ["fret", "string"]).collect()}
    assert wrong == {("missing_category", "string"), ("unknown_image", "5"), ("empty_box", "5"), ("small_image", "1")}
    for name, projects in (("1.json", {"a": {"source_id": "old"}, "b": 3}), ("2.json", {"a": {"source_id": "new"}})):
        (tmp_path / "meta").mkdir(exist_ok=True)
        (tmp_path / "meta" / name).write_text(json.dumps({"projects": projects}))
    assert values(IO.read_project_metadata(spark, str(tmp_path / "meta"), "*.json"), "project_id", "source_id") == [("a", "new")]


def test_manifest_without_a_file(spark, tmp_path):
    (tmp_path / "scores").mkdir()
    (tmp_path / "scores" / "one.gp5").write_text("x")
    (tmp_path / "scores" / "two.txt").write_text("x")
    m = IO.read_manifest(spark, str(tmp_path / "none.jsonl"), files=str(tmp_path / "scores"), pattern="*.gp5")
    assert values(m, "source_id", "status", "error") == [("one", "ok", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0, "train"), ("a", 1.23456, "test")], "path string, score double, split string")
    IO.write_split(df, str(tmp_path / "split"))
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"split=test", "split=train"}
    IO.write_tsv(df.select("path", "score"), str(tmp_path / "tsv"), order=["path"])
    lines = [x for p in sorted((tmp_path / "tsv").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["a\t1.2346", "b\t2.0000"]
    IO.write_summary(df, str(tmp_path / "sum"), n=F.count("*"), best=F.max("score"))
    assert json.loads(next((tmp_path / "sum").glob("part-*")).read_text()) == {"n": 2, "best": 2.0}
    good, bad = IO.with_errors(df, F.when(F.col("score") < 2, F.col("path")), ["path"], F.concat(F.lit("cannot read "), "path", F.lit(" because it is long")), 15)
    assert values(good, "path", "parsed") == [("a", "a")] and values(bad, "path", "error") == [("b", "cannot read b b")]


def test_score_tempo_and_link_ends(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<score><measure number="1"><direction><per-minute> 12 </per-minute><sound tempo="92.04"/></direction></measure></score>')
    (tmp_path / "b.xml").write_text("<score/>")
    got = {r.path.rsplit("/", 1)[1]: r.tempo for r in IO.read_score_tempo(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {"a.xml": 92.0, "b.xml": None}
    rows = [("s", 1, 0, 32, [(1, 3, "hammer_on"), (2, 5, "slide")], 4, 4, True), ("s", 1, 32, 32, [(1, 5, "bend")], 4, 4, True), ("s", 2, 0, 64, [(1, 7, "pull_off")], 4, 4, False)]
    e = spark.createDataFrame(rows, "score_id string, number int, onset64 int, duration64 int, notes array<struct<string:int,fret:int,technique:string>>, ts_num int, ts_den int, changed boolean")
    xml = IO.render_score_xml(e).first().xml
    assert xml.count('<hammer-on type="start">H</hammer-on>') == xml.count('<hammer-on type="stop">H</hammer-on>') == 1
    assert "slide" not in xml and "pull-off" not in xml  # no later note on their strings


def test_score_xml_in_one_pass(spark, tmp_path):
    """Texts are made where the events lie, which are read once; events of one onset keep their own notes."""
    rows = [("s", 1, 8, 8, [(1, 3, None), (2, 5, None)], 4, 4, True), ("s", 1, 8, 8, [(6, 1, None)], 4, 4, True), ("s", 2, 100, 4, [], 4, 4, False), ("t", 1, 0, 64, [(3, 0, "slide")], 3, 4, False)]
    e = spark.createDataFrame(rows, "score_id string, number int, onset64 int, duration64 int, notes array<struct<string:int,fret:int,technique:string>>, ts_num int, ts_den int, changed boolean")
    out = IO.render_score_xml(e.repartition(3, "score_id"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    xml = {r.score_id: r.xml for r in out.collect()}
    sign = "<attributes><time><beats>4</beats><beat-type>4</beat-type></time></attributes>"
    assert xml["s"].startswith(f'<part><measure number="1">{sign}<note><rest/><duration>8</duration>') and xml["s"].count("<fret>3</fret>") == xml["s"].count("<fret>1</fret>") == 1 and xml["s"].count("<chord/>") == 1
    assert "".join(re.findall("<rest/><duration>([0-9]+)<", xml["s"].split('number="2"')[1])) == "64324" + "4" and "".join(re.findall("<rest/><duration>([0-9]+)<", xml["s"].split('number="2"')[0])) == "848"
    assert xml["t"].startswith('<part><measure number="1"><note><pitch>') and "rest" not in xml["t"]
    lines = [x + "</measure>" for x in re.sub("</?part>", "", xml["s"]).split("</measure>")[:-1]]
    (tmp_path / "lines.txt").write_text("\n".join([*lines, '<measure number="9"><note>', "", '<measure number="x"><note><duration> 4 </duration></note></measure>']))
    got = IO.read_score_xml(spark, str(tmp_path / "lines.txt"), lines=True).select("number", "ix", "rest", "duration", "string", "fret").collect()
    assert sorted(tuple(r)[4:] for r in got if r.number == 1 and not r.rest) == [(1, 3), (2, 5), (6, 1)] and sum(r.duration for r in got if r.rest and r.number) == 8 + 48 + 100 + 4
    assert [tuple(r) for r in got if r.number is None] == [(None, 0, False, 4, None, None)]


def test_rests_of_any_gap(spark):
    df = spark.range(300).select(F.col("id").cast("int").alias("g")).withColumn("r", S.split_rest(F.col("g"))).withColumn("p", S.rests_of(F.lit(5), F.col("g")))
    for r in df.collect():
        left, want = r.g, []
        while left:
            want.append(max(d for d in S.RESTS if d <= left))
            left -= want[-1]
        assert r.r == want and [tuple(x) for x in r.p] == [(5 + sum(want[:i]), d) for i, d in enumerate(want)]


def test_models(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, x double")
    got = models.predict(df, lambda: lambda f: f.assign(x=f["x"] * 2), "id int, x double", batch=2)
    assert sorted(values(got, "id", "x")) == [(i, 2.0 * i) for i in range(5)]
    logits = spark.createDataFrame([([[0.1, 0.9, 0.0], [0.0, 0.8, 0.2], [0.9, 0.0, 0.1], [0.1, 0.7, 0.2], [0.2, 0.1, 0.7]],)], "logits array<array<double>>")
    r = models.read_text(logits, "logits", "37").first()
    assert r.text == "337" and abs(r.confidence - (0.9 + 0.7 + 0.7) / 3) < 1e-9
    boxes = spark.createDataFrame([("b", [1, 2], [[0.0, 0.9, 1.0, 1.0, 4.0, 3.0], [1.0, 0.5, 0.0, 0.0, 2.0, 2.0], [0.0, 0.1, 0.0, 0.0, 1.0, 1.0]])], "batch_id string, counts array<int>, boxes array<array<double>>")
    assert sorted(values(models.decode_detections(boxes, ["fret", "line"]), "image_ix", "label", "w")) == [(0, "fret", 3.0), (1, "line", 2.0)]


def test_several_inserts_in_a_measure(spark):
    e = spark.createDataFrame([(1, 0, 32, False, [(1, 3, None)])], "m int, onset64 int, duration64 int, rest boolean, notes array<struct<string:int,fret:int,technique:string>>")
    ins = spark.createDataFrame([(1, 16, 2, 5, 8), (1, 16, 3, 6, 8), (1, 0, 1, 9, 8), (2, 4, 1, 1, 8)], "m int, at64 int, string int, fret int, length64 int")
    got = sorted((r.m, r.onset64, r.duration64, [(n.string, n.fret) for n in r.notes]) for r in U.insert_notes(e, ins, ["m"]).collect())
    assert got == [(1, 0, 16, [(1, 9)]), (1, 16, 8, [(2, 5), (3, 6)]), (2, 4, 8, [(1, 1)])]


def test_section_boundaries(spark):
    flat = [0.0] * 100
    flat[20], flat[24], flat[60], flat[96] = 5.0, 4.0, 6.0, 9.0  # 24 is too near to 20, 96 to the end
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(flat)] + [("t", i, 0.0) for i in range(9)], "score_id string, segment int, segment_novelty double")
    got = sorted(values(T.section_boundaries(df, ["score_id"]), "score_id", "start", "end"))
    assert [g for g in got if g[0] == "t"] == [("t", 0, 9)] and ("s", 20) in [g[:2] for g in got] and ("s", 60) in [g[:2] for g in got]
    assert all(e - b >= 8 for k, b, e in got if k == "s") and max(e - b for k, b, e in got if k == "s") <= 28
    assert [r.c for r in spark.createDataFrame([(0, 0.0), (5, 2.0), (9, 4.0)], "a int, n double").select(T.boundary_confidence(F.col("a"), F.col("n"), F.lit(4.0)).alias("c")).collect()] == [0.35, 0.65, 0.95]


def test_merged_boundaries_and_chroma(spark):
    df = spark.createDataFrame([("p", float(x)) for x in (0, 50, 52, 100, 150)], "page string, x double")
    assert values(W.filter_boundaries(df, ["page"], "x", 5.0).orderBy("x"), "x") == [(0.0,), (51.0,), (100.0,), (150.0,)]
    c = one(spark, c=T.chroma(F.array(*[F.lit(1.0) if i == 40 else F.lit(0.0) for i in range(513)]))).c
    hz = 40 * 11_025 / 2 / 512
    import math

    assert len(c) == 12 and max(range(12), key=c.__getitem__) == round(69 + 12 * math.log2(hz / 440)) % 12 and abs(sum(x * x for x in c) - 1) < 1e-6


def test_stream_status(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", "start", "m"), ("a", 2, "2024-01-01 00:01:00", "finish", "n"), ("a", 1, "2024-01-01 00:02:00", "fail", "o")], "score_id string, analysis_id int, ts string, status string, message string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    events = spark.readStream.schema("score_id string, analysis_id int, ts timestamp, status string, message string").parquet(str(src))
    current = spark.createDataFrame([("a", 2)], "score_id string, analysis_id int")
    q = Z.stream_status(events, current).writeStream.format("memory").queryName("status").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("status"), "score_id", "status") == [("a", "finish")]


def test_stream_suppress(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 0, 1.0), ("a", 1, 1.2), ("a", 2, 2.5), ("a", 3, 2.6), ("b", 0, 9.0)]
    spark.createDataFrame(rows, "run_id string, ord long, value double").coalesce(1).write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frames = spark.readStream.schema("run_id string, ord long, value double").parquet(str(src))
        q = Z.stream_suppress(frames, 1.0).writeStream.format("memory").queryName("suppress").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(values(spark.table("suppress"), "run_id", "ord")) == [("a", 0), ("a", 2), ("b", 0)]


def _every_step(labels):
    """W23 with all steps of all states tried one by one, as the operator's words have it."""
    frames = sorted({(r[1], r[0]) for r in labels})
    of = {f: [(i, v, c) for g, _, i, v, c in labels if g == f and v is not None] for _, f in frames}
    top = min(1000, max(256, max(v for ls in of.values() for _, v, _ in ls if v <= 1000) + 12))
    emits = [[sum((35.0 + c for i, v, c in of[f] if v - i == s), 0.0) for s in range(top + 1)] for _, f in frames]
    score, back = [e - s * 0.25 for s, e in enumerate(emits[0])], []
    for (was, _), (now, _), e in zip(frames, frames[1:], emits[1:]):
        dt = max(0.05, now - was)
        jump = max(3, math.ceil(dt * 2.0) + 2)
        steps = [max((score[p] - abs(s - p - dt * 0.75) * 7.0, -p) for p in range(max(0, s - jump), s + 1)) for s in range(top + 1)]
        score = [v + e[s] for s, (v, _) in enumerate(steps)]
        back.append([-p for _, p in steps])
    path = [max(range(top + 1), key=lambda s: (score[s], -s))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return dict(zip([f for _, f in frames], reversed(path)))


def test_smoothing_tries_every_step_in_linear_time(spark):
    rng, rows, want = random.Random(7), [], {}
    for score, dt in (("a", 1.0), ("b", 40.0), ("c", 0.04), ("d", 2.0)):
        t, own = 0.0, []
        for f in range(14):
            own += [(f, t, i, rng.choice([int(t * 0.75) + i, int(t * 0.75) + i + rng.randrange(-4, 5), rng.randrange(1100)]), float(rng.randrange(90)) if score == "d" else rng.random() * 90) for i in range(rng.choice([1, 2]))]
            t += dt if score == "d" else rng.random() * dt * 2
        rows += [(score, *r) for r in own]
        want |= {(score, f): s for f, s in _every_step([r if r[3] >= r[2] else (*r[:3], None, r[4]) for r in own]).items()}
    df = spark.createDataFrame(rows, "score_id string, frame_id int, t double, index int, value int, conf double")
    assert {(r.score_id, r.frame_id): r.start_measure for r in W.smooth_starts(df).collect()} == want
    same = [(f, f * 400.0, f % 3, 100 + f % 3, 50.0) for f in range(12)]  # nearly all paths are equally good
    path = _every_step(same)
    assert {r[0]: r[1] for r in W.starts_of(same)} == path
    many, t = [], 0.0
    for f in range(1000):
        t = t + rng.random() * 150 if f % 12 else 0.0
        many.append((f, t, f % 3, int(t * 0.75) + f % 3, rng.random() * 90))
    start = time.process_time()
    for k in range(0, 1000, 12):  # 4 to 5 s where each step is tried for itself
        assert len(W.starts_of(many[k : k + 12])) == len(many[k : k + 12])
    assert time.process_time() - start < 2

"""Scans of trees and of one large document, compressed scores, and table functions called from SQL."""

import hashlib
import json
import os
import zipfile

import pytest

from tabspark import queries
from tabspark.functions import tables
from tabspark.operators import seq as W
from tabspark.sources import io as IO
from tabspark.sources.scratch import put_files


@pytest.mark.parametrize("indent", [None, 1])
def test_one_document_in_many_tasks(spark, tmp_path, indent):
    images = [{"id": i, "file_name": f"p {i}.png", "width": 9, "height": 4} for i in range(300)]
    boxes = [{"id": i, "image_id": i % 300, "category_id": 1, "bbox": [i, 0.5, 3, 2], "area": 6.0, "iscrowd": 0} for i in range(5000)]
    odd = [{"id": 9001, "image_id": 1, "segmentation": {"counts": [1]}, "bbox": [0, 0, 1, 1]}, {"id": "none", "image_id": 3}]
    doc = {"info": {"name": "set"}, "licenses": [{"id": 1, "name": "free", "url": "u"}], "images": images, "annotations": [*boxes, *odd], "categories": [{"id": 1, "name": "fret"}], "empty": []}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=indent))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        got = IO.scan_coco(spark, str(tmp_path / "c.json"))
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "c.json")).rdd.getNumPartitions() > 4
        assert sorted((r.id, r.file_name, r.width, r.height) for r in got["images"].collect()) == [tuple(x.values()) for x in images]
        assert sorted((r.id, r.image_id, r.bbox, r.area) for r in got["annotations"].collect()) == [(x["id"], x["image_id"], [float(v) for v in x["bbox"]], 6.0) for x in boxes]
        assert [tuple(r) for r in got["categories"].collect()] == [(1, "fret")]
        assert {r.section for r in got["errors"].collect()} == {"annotations"} and got["errors"].count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_the_last_metadata_file_wins(spark, tmp_path):
    files = {"z/projects.json": {"projects": {"a": {"source_id": "oldest"}, "b": {"source_id": "only"}, "c": 3}}, "a/projects.json": {"projects": {"a": {"source_id": "newest"}}}, "a/b/projects.json": {"projects": [1]}, "c/projects.json": [1, 2], "d/other.json": {"projects": {"d": {}}}}
    for i, (name, value) in enumerate(files.items()):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(value))
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "projects.json").write_text("{broken")
    same = tmp_path / "b" / "projects.json"  # as old as a/: the later path wins
    same.parent.mkdir()
    same.write_text(json.dumps({"projects": {"a": {"source_id": "by path"}}}))
    os.utime(same, (1_000_001, 1_000_001))
    assert sorted((r.project_id, r.source_id) for r in IO.read_project_metadata(spark, str(tmp_path)).collect()) == [("a", "by path"), ("b", "only")]


def test_runs_are_folders_with_a_first_frame(spark, tmp_path):
    for name in ("p1/analysis/r1/frame-0001.png", "p1/analysis/r1/frame-0012.png", "p1/analysis/r2/frame-0002.png", "own/x/r3/frame-0001.jpg", "own/x/r3/frame-last.jpg", "own/x/r3/other.jpg"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode())
    got = sorted((r.project_id, r.run_id, r.frame, r.sha256) for r in IO.scan_frames(spark, str(tmp_path)).collect())
    sha = lambda n: hashlib.sha256(n.encode()).hexdigest()
    assert got == sorted([("p1", "r1", 1, sha("p1/analysis/r1/frame-0001.png")), ("p1", "r1", 12, sha("p1/analysis/r1/frame-0012.png")), ("own", "r3", 1, sha("own/x/r3/frame-0001.jpg")), ("own", "r3", 0, sha("own/x/r3/frame-last.jpg"))])


def test_compressed_scores(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.mxl", "w") as z:
        z.writestr("META-INF/container.xml", '<sound tempo="50"/>')
        z.writestr("score.musicxml", '<score><sound tempo="20"/><m:per-minute> 123.45 </m:per-minute></score>')
    with zipfile.ZipFile(tmp_path / "b.mxl", "w") as z:
        z.writestr("readme.txt", "no score")
    (tmp_path / "c.mxl").write_bytes(b"no archive")
    (tmp_path / "d.xml").write_text("<score><sound tempo='88'/></score>")
    got = {r.path.rsplit("/", 1)[1]: r.tempo for r in IO.read_score_tempo(spark, str(tmp_path)).collect()}
    assert got == {"a.mxl": pytest.approx(123.5, abs=0.051), "b.mxl": None, "c.mxl": None, "d.xml": 88.0}


def test_table_functions_equal_the_operators(spark):
    tables.register(spark)
    labels = spark.createDataFrame([(s, f, f * 1.5, f % 2, s + f + f % 2 if f % 5 else None, 50.0) for s in (1, 2, 3) for f in range(20)], "score_id long, frame_id long, t double, index int, value int, conf double")
    got = spark.sql("SELECT * FROM smooth_starts(TABLE({labels}))", labels=labels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.smooth_starts(labels).collect())) and got.columns == ["score_id", "frame_id", "start_measure", "confidence"]
    glyphs = spark.createDataFrame([(r, i, [int((i * k + r) % 3 == 0) for k in range(20)]) for r in (1, 2) for i in range(30)], "run_id int, ord int, feature array<tinyint>")
    got = spark.sql("SELECT * FROM leader_clusters(TABLE({glyphs}), 0.2)", glyphs=glyphs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.leader_clusters(glyphs, 0.2).collect()))
    with pytest.raises(Exception, match="columns needed"):
        spark.sql("SELECT * FROM leader_clusters(TABLE({labels}), 0.2)", labels=labels).collect()
    empty = spark.sql("SELECT * FROM leader_clusters(TABLE({glyphs}), 0.2)", glyphs=glyphs.filter("false"))
    assert empty.collect() == []


def test_a_task_lists_many_folders(spark, tmp_path):
    names = spark.range(60).selectExpr("concat('p/analysis/', id, '/frame-0001.png') AS name", "concat('c', id) AS content")
    assert put_files(names, f"file://{tmp_path}") == 60
    sc = spark.sparkContext
    sc.setJobGroup("listing", "frames")
    try:
        got = IO.scan_frames(spark, str(tmp_path))
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("listing")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(sc.statusTracker().getStageInfo(i).numTasks for j in jobs for i in j.stageIds) <= 4 * sc.defaultParallelism  # one for each folder before
    assert {(r.run_id, r.sha256) for r in got.collect()} == {(str(i), hashlib.sha256(f"c{i}".encode()).hexdigest()) for i in range(60)}


def test_tasks_stay_small_as_tables_grow(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 1000)
    few, many = queries.dealt(spark.range(4000), "id"), queries.dealt(spark.range(50_000), "id")
    assert few.rdd.getNumPartitions() == spark.range(4000).rdd.getNumPartitions() and many.rdd.getNumPartitions() == 50 and many.count() == 50_000
    assert queries.notes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 6

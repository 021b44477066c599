"""Line groups, staffs, crops, highlights, summaries and matchings against plain reckonings of their rules."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import aggs as A, joins as J, seq as W


def regular(group):
    gaps = [b - a for a, b in zip(group, group[1:])]
    middle = statistics.median(gaps)
    return middle, statistics.mean(abs(g - middle) for g in gaps) / middle


def grow(ys, i, j, slack, share, lines=6):
    group, at, gap = [ys[i], ys[j]], j, ys[j] - ys[i]
    for k in range(2, lines):
        place = ys[i] + gap * k
        near = [(abs(ys[n] - place), n) for n in range(at + 1, len(ys)) if abs(ys[n] - place) <= max(slack, gap * share)]
        if not near:
            return None
        at = min(near)[1]
        group.append(ys[at])
    return group


def plain_groups(ys):
    kept = []
    clear = lambda g: all(g[-1] < k[0][0] or g[0] > k[0][-1] for k in kept)
    for i in range(len(ys) - 5):
        g = ys[i : i + 6]
        middle, uneven = regular(g)
        if 4 <= middle <= 80 and uneven <= 0.2 and clear(g):
            kept.append((g, middle, uneven, False))
    grown = [(regular(g)[1], g[0], i, j, g) for i in range(len(ys)) for j in range(i + 1, min(len(ys), i + 5)) if 4 <= ys[j] - ys[i] <= 80 and (g := grow(ys, i, j, 3.0, 0.25))]
    for uneven, _, _, _, g in sorted(x for x in grown if x[0] <= 0.2):
        if clear(g):
            kept.append((g, regular(g)[0], uneven, True))
    return sorted(kept)


@pytest.fixture(scope="module")
def pages():
    out = {0: [*range(250, 351, 20), *range(700, 781, 20), *range(850, 951, 20)], 1: [*range(100, 201, 20), 215, 300, 307, 320, 340, 352, 360, 380, 400], 2: [5, 6, 7], 3: []}
    rng = random.Random(4)
    for page in range(4, 24):
        step = rng.choice([6, 10, 17, 24])
        out[page] = sorted({s * 40 * step // 6 + k * step + rng.choice([0, 0, 1, 2]) for s in range(5) for k in range(6) if rng.random() < 0.95} | {rng.randrange(1200) for _ in range(rng.randrange(12))})
    return out


def test_line_groups_in_two_passes(spark, pages):
    df = spark.createDataFrame([(p, float(y)) for p, ys in pages.items() for y in [*ys, *ys[:2]]], "page int, y double")
    got = {}
    for r in W.line_groups(df, ["page"]).orderBy("page", "group").collect():
        got.setdefault(r.page, []).append((r.lines, r.spacing, pytest.approx(r.irregularity), r.recovered))
    want = {p: g for p, ys in pages.items() if (g := plain_groups(ys))}
    assert got == want and {x[3] for g in want.values() for x in g} == {True, False}
    assert [g[0][0] for g in got[0]] == [250.0, 850.0]


def test_best_line_group(spark, pages):
    rng = random.Random(6)
    strength = {p: {y: rng.random() * 100 for y in ys} for p, ys in pages.items()}
    df = spark.createDataFrame([(p, float(y), s) for p, of in strength.items() for y, s in of.items()], "page int, y double, strength double")
    got = {r.page: (r.lines, pytest.approx(r.score)) for r in W.best_line_group(df, ["page"], 5, 160.0).collect()}
    for p, ys in pages.items():
        best = None
        for i in range(len(ys)):
            for j in range(i + 1, len(ys)):
                g = grow(ys, i, j, 2.0, 0.28, 5) if 5 <= ys[j] - ys[i] <= 40 else None
                if g and regular(g)[1] <= 0.22:
                    score = statistics.mean(strength[p][y] for y in g) - regular(g)[1] * 80
                    best = (score, g) if best is None or score > best[0] + 1e-9 else best
        assert (best is None and p not in got) or got[p] == (best[1], best[0]), p


def test_line_groups_of_many_full_pages(spark):
    """A task reckons many pages at a time: seconds, not minutes, for 1000 pages of some 140 centres."""
    rng = random.Random(8)
    kinds = [sorted(rng.sample([20 * k + r for k in range(50) for r in range(3)], 140)) for _ in range(4)]
    centres = spark.createDataFrame([(k, [(float(y), float(y * 7 % 50)) for y in ys]) for k, ys in enumerate(kinds)], "kind int, c array<struct<y:double,strength:double>>")
    df = centres.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(250)))).select("kind", "copy", F.inline("c"))
    start = time.perf_counter()
    groups = W.line_groups(df, ["kind", "copy"]).groupBy("kind", "copy").agg(F.sort_array(F.collect_list(F.struct("group", "lines", "spacing", "irregularity", "recovered"))).alias("g")).groupBy("kind", "g").count().collect()
    best = W.best_line_group(df, ["kind", "copy"], 6, 200.0).groupBy("kind", "lines", "score").count().collect()
    assert time.perf_counter() - start < 30
    assert {r.kind: [(x.lines, x.spacing, pytest.approx(x.irregularity), x.recovered) for x in r.g] for r in groups} == {k: plain_groups(ys) for k, ys in enumerate(kinds)}
    assert [r["count"] for r in groups] == [r["count"] for r in best] == [250] * 4


def test_unknown_strengths_are_left_out(spark):
    known, none = [(1, float(y), None if y == 20 else 6.0) for y in range(0, 60, 10)], [(2, float(y), None) for y in range(0, 60, 10)]
    rows = spark.createDataFrame([*known, (1, None, 9.0), *none], "page int, y double, strength double")
    assert sorted((r.page, r.lines, r.score) for r in W.best_line_group(rows, ["page"], 6, 160.0).collect()) == [(1, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0], 6.0), (2, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0], None)]


def test_staffs_take_the_median_gap_and_their_extents(spark):
    ys = [100.0, 107.0, 114.7, 121.7, 128.7, 135.7, 300, 306, 312, 318, 324, 330, 500, 510, 520, 531, 541, 551]  # mean gap of the first differs from the median
    rows = spark.createDataFrame([(1, float(y), 10.0 + k, 95.0 + 3 * k if k < 6 else 300.0) for k, y in enumerate(ys)], "page int, y double, left double, right double")
    got = [(r.spacing, r.lines[0], r.left, r.right) for r in W.staff_groups(rows, ["page"], left="left", right="right", width=90.0).orderBy("system").collect()]
    assert got == [(7.0, 100.0, 10.0, 110.0), (6.0, 300.0, 16.0, 300.0)]
    lines = spark.createDataFrame([(1, 0.0, 10.0, 100.0, 10.25), (1, 0.0, 50.0, 100.0, 50.31), (1, 0.0, 20.0, 1.9, 20.0), (1, 5.0, 30.0, 80.0, 30.0)], "page int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.y, r.covered, r.left, r.right) for r in A.staff_rows(lines, ["page"]).collect()) == [(10.0, 100.0, 0.0, 100.0), (30.0, 75.0, 5.0, 80.0)]


def test_crops_are_whole_pixels(spark):
    g = spark.createDataFrame([(1, 100.25, 130.25, 6.0), (1, 301.0, 331.0, 6.0), (1, 360.0, 361.0, 6.0)], "page int, top double, bottom double, spacing double")
    got = [(r.top, r.crop_top, r.crop_bottom) for r in W.system_bounds(g, ["page"], "top", "bottom", "spacing", F.lit(400)).orderBy("top").collect()]
    assert got == [(100.25, 10, 160), (301.0, 216, 346), (360.0, 346, 391)]


def test_highlight_by_measure_width(spark):
    """Widths and tolerances are of a measure, not of a run; bars are rows in a row; ends of a measure count."""
    bars = spark.createDataFrame([(f, i, i * 100.0, i * 100.0 + 100) for f in "abcd" for i in range(3)], "frame string, measure_index int, left double, right double")
    staff = spark.createDataFrame([(f, 50, 90) for f in "abcd"], "frame string, top int, bottom int")
    run = lambda f, ys, a, z: [(f, y, a, z) for y in ys]
    rows = run("a", (10, 11, 12), 101, 199) + run("a", (95, 96), 104, 203) + run("a", (30,), 0, 30)  # 203 differs by 4 of 8
    rows += run("b", (10,), 0, 70) + run("b", (95,), 9, 70)  # 9 > 8 % of a measure
    rows += run("c", (10,), 60, 140) + run("c", (95,), 60, 140)  # the middle is at an end of two measures: the first
    rows += run("d", (10,), 290, 380) + run("d", (20,), 102, 200) + run("d", (95,), 102, 200) + run("d", (97,), 290, 380)  # the first pair lies in no measure
    df = spark.createDataFrame(rows, "frame string, y int, x1 int, x2 int")
    assert {r.frame: r.highlighted_index for r in W.highlight_index(df, bars, staff, ["frame"]).collect()} == {"a": 1, "c": 0, "d": 1}


def test_summaries_count_glyphs_and_sampled_frames(spark):
    g = spark.createDataFrame([("s", "3", 80.0), ("s", "", 99.0), ("s", None, 99.0), ("s", "12", 50.0), ("t", None, 1.0)], "score_id string, label string, confidence double")
    got = {r.score_id: r[1:] for r in A.recognition_summary(g, ["score_id"]).collect()}
    assert got == {"s": (4, 2, 1, 0.5, 0.325), "t": (1, 0, 0, 0.0, 0.0)}
    f = spark.createDataFrame([("s", i, None if i < 7 else 100.0 + i) for i in range(12)] + [("t", i, None) for i in range(8)] + [("t", 9, 90.0)], "score_id string, ix int, tempo double")
    assert [(r.score_id, r.tempo) for r in A.median_of_first(f, ["score_id"], "tempo", [F.col("ix")]).collect()] == [("s", 107.0)]
    marks = spark.createDataFrame([("s", 0, "5"), ("s", 1, "301"), ("s", 2, " 92.04 "), ("s", 3, "80")], "score_id string, ord int, tempo string")
    assert A.tempo_from_score(marks).first().tempo == 92.0
    seen = spark.createDataFrame([("s", 3, 1, 2.00049), ("s", 4, 0, 1.99961), ("s", None, 0, 0.0)], "score_id string, start_measure int, highlighted_index int, time_seconds double")
    assert [tuple(r) for r in A.sync_suggestions(seen, ["score_id"]).collect()] == [("s", 4, 2.0)]


def plain_matches(pred, truth, tolerance):
    used, out = set(), []
    for o, x in sorted(pred):
        near = [(abs(x - y), t) for t, y in truth if t not in used and abs(x - y) <= tolerance]
        if near:
            used.add(min(near)[1])
            out.append((o, min(near)[1]))
    return sorted(out)


def test_greedy_matching_equals_the_plain_one(spark):
    rng = random.Random(2)
    p, t, want = [], [], []
    for key in range(30):
        pred = [(i, rng.randrange(60) / 4) for i in range(rng.randrange(25))]
        truth = [(i, rng.randrange(60) / 4) for i in rng.sample(range(40), rng.randrange(25))]
        p += [(key, i, x) for i, x in pred]
        t += [(key, i, x) for i, x in truth]
        want += [(key, *m) for m in plain_matches(pred, truth, 0.5)]
    schema = "k int, ord int, onset double"
    assert sorted(map(tuple, J.match_events(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), ["k"], tolerance=0.5).collect())) == sorted(want)


def test_long_lists_stay_linear(spark):
    """100,000 rows of one key, all within reach of their neighbours."""
    n, begun = 100_000, time.monotonic()
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("ord"), (F.col("id") * 0.1).alias("onset"))
    assert J.match_events(df, df.withColumn("onset", F.col("onset") + 0.04), ["k"], tolerance=0.26).count() == n
    x = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("i"), F.pmod(F.col("id") * 7919, F.lit(1013)).cast("double").alias("v"))
    kept, last = [], None
    for i in range(n):
        v = i * 7919 % 1013
        if last is None or i - last[0] >= 3:
            kept.append(last := (i, v))
        elif v > last[1]:
            kept[-1] = last = (i, v)
    assert sorted((r.i, r.v) for r in W.thin_peaks(x, ["k"], "i", "v", 3).collect()) == kept
    boxes = spark.range(4000).select(F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 5.0).alias("x"), F.lit(0.0).alias("y"), F.lit(9.0).alias("w"), F.lit(4.0).alias("h"), F.lit(0.9).alias("score"))
    assert J.match_detections(boxes, boxes).filter("truth_ord = ord").count() == 4000
    assert time.monotonic() - begun < 60


def plain_boxes(p, t, least):
    used, out = set(), []
    for ord, x, y, w, h, _ in sorted(p, key=lambda b: (-b[5], b[0])):
        over = []
        for k, (number, a, b, c, d, _) in enumerate(t):
            inter = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            if k not in used and inter / (w * h + c * d - inter) >= least:
                over.append((-inter / (w * h + c * d - inter), number, k))
        used |= {min(over)[2]} if over else set()
        out.append((ord, min(over)[1] if over else None))
    return out


def test_boxes_of_many_groups_are_matched_in_turn(spark, monkeypatch):
    """As one box after the other would take them, in one grouping of the rows, whether the pairs of a group are held or not."""
    rng = random.Random(12)
    box = lambda i: (i, rng.randrange(30) / 2, rng.randrange(6) / 2, rng.choice([4.0, 5.0, 9.0]), rng.choice([3.0, 4.0]), rng.choice([0.4, 0.5, 0.9]))
    groups = {k: ([box(i) for i in range(rng.randrange(60 if k % 9 == 0 else 5))], [box(i) for i in range(rng.randrange(60 if k % 9 == 0 else 5))]) for k in range(120)}
    schema = "image_id int, category_id int, ord int, x double, y double, w double, h double, score double"
    det, truth = (spark.createDataFrame([(k, 1, *b) for k, g in groups.items() for b in g[side]], schema) for side in (0, 1))
    want = sorted(((k, *m) for k, g in groups.items() for m in plain_boxes(*g, 0.5)), key=str)
    out = J.match_detections(det, truth)
    assert sorted(((r.image_id, r.ord, r.truth_ord) for r in out.collect()), key=str) == want and out.columns == [*det.columns, "truth_ord"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    twins = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 4.0, 4.0, 0.9), (1, 1, 3, 0.0, 0.0, 4.0, 4.0, 0.8), (None, 1, 3, 0.0, 0.0, 4.0, 4.0, 0.9)], schema)  # of one number; no image
    assert sorted(((r.image_id, r.score, r.truth_ord) for r in J.match_detections(twins, twins.filter("score = 0.9")).collect()), key=str) == [(1, 0.8, None), (1, 0.9, 3), (None, 0.9, None)]
    flat = [[(g, *b) for g, k in enumerate(groups) for b in sorted(groups[k][side], key=order)] for side, order in ((0, lambda b: (-b[5], b[0])), (1, lambda b: (b[1], b[0])))]
    p, t = (np.array(x, float).T for x in flat)
    for block in (10**6, 0):
        monkeypatch.setattr(J, "BLOCK", block or 1)
        at = J._taken(p[0].astype(int), p[2:6], t[0].astype(int), t[2:6], t[1], len(groups), 0.5)
        assert sorted(((list(groups)[int(g)], int(o), None if i < 0 else int(t[1][i])) for g, o, i in zip(p[0], p[1], at)), key=str) == want


def test_a_median_is_rounded_after_it_is_scaled(spark):
    f = spark.createDataFrame([("s", 1, 14.85), ("s", 2, 16.45), ("t", 1, -14.85), ("t", 2, -16.45)], "score_id string, ix int, tempo double")  # their mean is 15.649999999999999
    got = A.median_of_first(f, ["score_id"], "tempo", [F.col("ix")])
    assert sorted((r.score_id, r.tempo) for r in got.collect()) == [("s", 15.7), ("t", -15.7)]

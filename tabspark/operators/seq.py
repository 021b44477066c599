"""Sequence operators (W): islands, folds against the last kept row, smoothing, clustering.

Folds run over one sorted array for each group (``collect_list`` and ``aggregate``); the groups are measures, frames
or runs of a recording, which are small by nature. Grouped pandas functions are used where a state is a vector."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import rests_of


def fold(df: DataFrame, keys: Sequence[str], item: Column, start: Column, step, finish=None) -> DataFrame:
    """Fold over each group's items in the order of the item struct; the result is the column ``out``."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_xs")).select(*keys, F.aggregate("_xs", start, step, finish).alias("out"))


def islands(df: DataFrame, keys: Sequence[str], order: str, gap: float, also: Sequence[str] = ()) -> DataFrame:
    """Number of the run of rows that are at most ``gap`` from the row before."""
    w = Window.partitionBy(*keys).orderBy(order, *also)
    new = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def island_centres(df: DataFrame, keys: Sequence[str], order: str, gap: float, weight: str | None = None) -> DataFrame:
    """Runs with their ends, size and mean (or weighted mean) centre."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return islands(df, keys, order, gap).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), (F.sum(F.col(order) * w) / F.sum(w)).alias("centre"))


def _grouped(df: DataFrame, keys: Sequence[str], x: str, joins) -> DataFrame:
    """Number the groups of sorted positions; ``joins(state, x)`` says whether x belongs to the open group, whose state
    is struct<first, sum, n>."""
    start = F.struct(F.array().cast("array<struct<x:double,g:int>>").alias("out"), F.lit(0).alias("g"), F.lit(0.0).alias("first"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, v: Column) -> Column:
        same = (s["n"] > 0) & joins(s, v)
        g = F.when(same, s["g"]).otherwise(s["g"] + 1)
        return F.struct(F.concat(s["out"], F.array(F.struct(v.alias("x"), g.alias("g")))).alias("out"), g.alias("g"), F.when(same, s["first"]).otherwise(v).alias("first"), F.when(same, s["sum"] + v).otherwise(v).alias("sum"), F.when(same, s["n"] + 1).otherwise(1).alias("n"))

    return fold(df, keys, F.col(x).cast("double"), start, step, lambda s: s["out"]).select(*keys, F.inline("out")).withColumnsRenamed({"x": x, "g": "group"})


def chord_groups(df: DataFrame, keys: Sequence[str], x: str, width: float) -> DataFrame:
    """Positions within ``width`` of the first of their group."""
    return _grouped(df, keys, x, lambda s, v: v - s["first"] <= width)


def mean_groups(df: DataFrame, keys: Sequence[str], x: str, width: float) -> DataFrame:
    """Positions within ``width`` of the running mean of their group."""
    return _grouped(df, keys, x, lambda s, v: F.abs(v - s["sum"] / s["n"]) <= width)


def filter_boundaries(df: DataFrame, keys: Sequence[str], x: str, spacing: float) -> DataFrame:
    """Boundaries; one nearer to the last kept than 0.3 of the median of the gaps of 4 spacings or more is merged
    into their mean. Groups without such a gap have none."""
    big = F.lit(4.0 * spacing)
    xs = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(x).cast("double"))).alias("_xs"))
    gaps = F.filter(F.transform(F.slice("_xs", F.lit(2), F.greatest(F.size("_xs") - 1, F.lit(0))), lambda v, i: v - F.get("_xs", i)), lambda g: g >= big)
    n = F.size("_g")
    median = (F.get("_g", ((n - 1) / 2).cast("int")) + F.get("_g", (n / 2).cast("int"))) / 2
    near = xs.withColumn("_g", F.sort_array(gaps)).filter("size(_g) > 0").withColumn("_m", 0.3 * median)
    step = lambda s, v: F.when((F.size(s) > 0) & (v - F.element_at(s, -1) < F.col("_m")), F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array((F.element_at(s, -1) + v) / 2))).otherwise(F.concat(s, F.array(v)))
    return near.select(*keys, F.explode(F.aggregate("_xs", F.array().cast("array<double>"), step)).alias(x))


def suppress_adjacent(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float) -> DataFrame:
    """Rows whose value differs from that of the last kept row by ``threshold`` or more."""
    start = F.array().cast(f"array<struct<o:{df.schema[order].dataType.simpleString()},v:double>>")
    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    step = lambda s, x: F.when((F.size(s) == 0) | (F.abs(x["v"] - F.element_at(s, -1)["v"]) >= threshold), F.concat(s, F.array(x))).otherwise(s)
    return fold(df, keys, item, start, step).select(*keys, F.inline("out")).withColumnsRenamed({"o": order, "v": value})


def peaks(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: Column) -> DataFrame:
    """Rows not under the one before, over the one after, and at the threshold; ends of a series don't count."""
    w = Window.partitionBy(*keys).orderBy(order)
    p, n = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("_p", (F.col(value) >= p) & (F.col(value) > n) & (F.col(value) >= threshold)).filter("_p").drop("_p")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _thinned(orders: pd.Series, values: pd.Series, gap: pd.Series) -> pd.Series:
    """Which peaks of a run stay: one pass that carries the place of the last kept one."""

    def one(o, v, gap: float) -> list[bool]:
        kept, last = [False] * len(o), -1
        for i, (x, y) in enumerate(zip(o.tolist(), v.tolist())):
            if last < 0 or x - o[last] >= gap:
                kept[i], last = True, i
            elif y > v[last]:
                kept[last], kept[i], last = False, True, i
        return kept

    return pd.Series([one(np.asarray(o), np.asarray(v), g) for o, v, g in zip(orders, values, gap)], dtype=object)


def thin_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str, gap: float) -> DataFrame:
    """Peaks at least ``gap`` from the last kept; a higher one that is nearer takes its place.

    A peak that far from the peak before it is kept whatever came earlier, so a series falls into runs that are thinned
    one by one, each in one pass over its peaks."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = df.withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) < gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    xs = runs.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("_xs"))
    stays = _thinned(F.transform("_xs", lambda x: x["o"]), F.transform("_xs", lambda x: x["v"]), F.lit(float(gap)))
    kept = xs.withColumn("_k", stays).select(*keys, F.inline(F.filter("_xs", lambda x, i: F.get("_k", i))))
    return kept.withColumnsRenamed({"o": order, "v": value})


def moving_baseline(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int = 9) -> DataFrame:
    """Centred moving sum over the width, as if zeros stood beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn("baseline", F.sum(value).over(w) / width)


def spacing_stats(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Median of the gaps between neighbours and their largest deviation from it, over it."""
    gap = F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(x))
    g = df.withColumn("_g", gap).filter("_g is not null").groupBy(*keys).agg(F.median("_g").alias("spacing"), F.max("_g").alias("_hi"), F.min("_g").alias("_lo"))
    return g.select(*keys, "spacing", F.try_divide(F.greatest(F.col("_hi") - F.col("spacing"), F.col("spacing") - F.col("_lo")), F.col("spacing")).alias("irregularity"))


def _middle(gaps: Column, n: int) -> Column:
    """Median of an array of ``n`` values."""
    s = F.sort_array(gaps)
    return F.get(s, F.lit(n // 2)) if n % 2 else (F.get(s, F.lit(n // 2 - 1)) + F.get(s, F.lit(n // 2))) / 2


def _uneven(gaps: Column, middle: Column, n: int) -> Column:
    """Mean deviation of gaps from their median, over it."""
    return F.aggregate(F.transform(gaps, lambda g: F.abs(g - middle)), F.lit(0.0), lambda s, v: s + v) / n / middle


def _gaps(values: Column) -> Column:
    return F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda v, i: v - F.get(values, i))


def staff_groups(rows: DataFrame, keys: Sequence[str], y: str = "y", lines: int = 6, low: float = 4.0, high: float = 12.0, deviation: float = 0.8, left: str | None = None, right: str | None = None, width: float = 0.0) -> DataFrame:
    """Groups of ``lines`` rows whose gaps are near their median, from the top, without overlap; with extents
    (left, right) those of their rows, and only groups as wide as ``width``."""
    w = Window.partitionBy(*keys).orderBy(y)
    ahead = w.rowsBetween(0, lines - 1)
    c = rows.withColumn("_i", F.row_number().over(w)).withColumn("lines", F.collect_list(F.col(y).cast("double")).over(ahead))
    edge = {"left": F.min(left).over(ahead) if left else F.lit(None), "right": F.max(right).over(ahead) if right else F.lit(None)}
    c = c.withColumns({n: e.cast("double") for n, e in edge.items()}).filter(F.size("lines") == lines).withColumn("_g", _gaps(F.col("lines"))).withColumn("spacing", _middle(F.col("_g"), lines - 1))
    c = c.filter(F.col("spacing").between(low, high) & F.forall("_g", lambda g: F.abs(g - F.col("spacing")) <= deviation))
    c = c.filter(F.col("right") - F.col("left") >= width) if left and right else c
    item = F.struct("_i", "spacing", "lines", "left", "right")
    start = F.array().cast("array<struct<_i:int,spacing:double,lines:array<double>,left:double,right:double>>")
    step = lambda s, v: F.when((F.size(s) > 0) & (v["_i"] < F.coalesce(F.try_element_at(s, F.lit(-1))["_i"], F.lit(-lines)) + lines), s).otherwise(F.concat(s, F.array(v)))
    return fold(c, keys, item, start, step).select(*keys, F.posexplode("out").alias("system", "g")).select(*keys, "system", "g.spacing", "g.lines", "g.left", "g.right")


def system_bounds(groups: DataFrame, keys: Sequence[str], top: str, bottom: str, spacing: str, page_height: Column, above: float = 15, below: float = 5, least: float = 7) -> DataFrame:
    """Crop of each system in whole pixels: so many spacings above and below, cut half-way to its neighbours and at
    the page; those less than ``least`` spacings high are left out."""
    w = Window.partitionBy(*keys).orderBy(top)
    px = lambda v: F.bround(v.cast("double")).cast("int")
    height = page_height.cast("int")
    up = F.coalesce(px((F.lag(bottom).over(w) + F.col(top)) / 2), F.lit(0))
    down = F.coalesce(px((F.col(bottom) + F.lead(top).over(w)) / 2), height)
    g = groups.withColumn("crop_top", F.greatest(F.lit(0), up, px(F.col(top) - above * F.col(spacing)))).withColumn("crop_bottom", F.least(height, down, px(F.col(bottom) + below * F.col(spacing))))
    return g.filter(F.col("crop_bottom") - F.col("crop_top") >= least * F.col(spacing))


def build_onsets(events: DataFrame, keys: Sequence[str], capacity: int = 64) -> DataFrame:
    """Onsets of events (ord, duration64) one after the other; those past the capacity go, the last one is cut."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    on = events.withColumn("onset64", F.coalesce(F.sum("duration64").over(w), F.lit(0))).filter(F.col("onset64") < capacity)
    return on.withColumn("duration64", F.least(F.col("duration64"), F.lit(capacity) - F.col("onset64")))


def technique_links(notes: DataFrame, keys: Sequence[str], order: Sequence[str], linked: Sequence[str] = ("hammer_on", "pull_off", "slide")) -> DataFrame:
    """For each note with a linking technique the fret of the next note on its string, over measures; and whether
    the note is the target of the one before."""
    w = Window.partitionBy(*keys, "string").orderBy(*order)
    is_link = F.coalesce(F.col("technique").isin(list(linked)), F.lit(False))
    return notes.withColumn("next_fret", F.when(is_link, F.lead("fret").over(w))).withColumn("link_stop", F.coalesce(F.lag(is_link).over(w), F.lit(False)))


def monotone_anchors(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Anchors that grow strictly in both values against the last kept."""
    item = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    step = lambda s, v: F.when((F.size(s) == 0) | ((v["x"] > F.try_element_at(s, F.lit(-1))["x"]) & (v["y"] > F.try_element_at(s, F.lit(-1))["y"])), F.concat(s, F.array(v))).otherwise(s)
    return fold(df, keys, item, F.array().cast("array<struct<x:double,y:double>>"), step).select(*keys, F.inline("out")).withColumnsRenamed({"x": x, "y": y})


def stride_sample(df: DataFrame, keys: Sequence[str], order: Sequence[Column], stride: int, limit: int = 0) -> DataFrame:
    """Every stride-th row and the last one; at most ``limit`` rows if it is over 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    kept = n.filter(((F.col("_i") % stride) == 0) | (F.col("_i") == F.col("_n") - 1))
    if limit > 0:
        kept = kept.filter((F.ceil(F.col("_i") / stride)) < limit)
    return kept.drop("_i", "_n")


def ordered_split(df: DataFrame, source: str, share: float = 0.12, buckets: int = 256) -> DataFrame:
    """Split of each source by the order of its hash: the first share is test, the next val, the rest train; one
    at least of each of the first two. Sources are ranked inside buckets of the hash's first digits, and the buckets'
    sizes (at most ``buckets`` rows) are added up, so no task ranks all of them."""
    s = df.select(source).filter(F.col(source).isNotNull()).distinct().withColumn("_h", F.sha2(source, 256)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = s.groupBy("_b").agg(F.count("*").alias("_c"))
    offsets = sizes.withColumn("_o", F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).withColumn("_all", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    ranked = s.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1).join(F.broadcast(offsets), "_b")
    count = F.greatest(F.lit(1), F.bround(F.col("_all") * share))
    at = F.col("_r") + F.col("_o")
    return ranked.select(source, F.when(at < count, "test").when(at < 2 * count, "val").otherwise("train").alias("split"))


def reflow(events: DataFrame, keys: Sequence[str], delta: str, order: str = "onset64") -> DataFrame:
    """Onsets moved by the sum of the changes of the durations before; durations changed."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("onset64", F.col("onset64") + F.coalesce(F.sum(delta).over(w), F.lit(0))).withColumn("duration64", F.col("duration64") + F.coalesce(F.col(delta), F.lit(0)))


def delete_beats(events: DataFrame, keys: Sequence[str], deleted: Column) -> DataFrame:
    """Deleted events go and later ones move left by their lengths."""
    return reflow(events.withColumn("_d", F.when(deleted, -F.col("duration64")).otherwise(0)), keys, "_d").filter(~deleted).drop("_d")


def rest_capacity(events: DataFrame, keys: Sequence[str], capacity: int = 64) -> DataFrame:
    """Length of the rests right after each event, with the empty tail if they reach the end of the measure."""
    later = Window.partitionBy(*keys).orderBy("onset64")
    e = events.withColumn("_b", F.sum(F.when(F.col("rest"), 0).otherwise(1)).over(later.rowsBetween(Window.unboundedPreceding, 0)))
    run = e.groupBy(*keys, "_b").agg(F.sum(F.when(F.col("rest"), F.col("duration64")).otherwise(0)).alias("_r"))
    last = e.groupBy(*keys).agg(F.max("_b").alias("_lb"), F.max(F.col("onset64") + F.col("duration64")).alias("_e"))
    j = e.filter(~F.col("rest")).join(run, [*keys, "_b"]).join(last, list(keys))
    tail = F.when(F.col("_b") == F.col("_lb"), F.greatest(F.lit(0), F.lit(capacity) - F.col("_e"))).otherwise(0)
    return j.withColumn("following_rest", F.col("_r") + tail).drop("_b", "_r", "_lb", "_e")


def with_gaps(events: DataFrame, keys: Sequence[str], order: Sequence[str], capacity: int = 64) -> DataFrame:
    """Events and, in one pass over them, where the gap before each (``gap_at``, ``gap``) and the gap after the last of its
    measure (``end_at``, ``end_gap``) begins and how long it is, in 64ths; null where there is none."""
    w = Window.partitionBy(*keys).orderBy("onset64", *order)
    end = F.col("onset64") + F.col("duration64")
    e = events.withColumn("gap_at", F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    e = e.withColumn("gap", F.when(F.col("onset64") > F.col("gap_at"), F.col("onset64") - F.col("gap_at")))
    e = e.withColumn("end_at", F.when(F.col("_last"), F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return e.withColumn("end_gap", F.when(F.col("end_at") < capacity, capacity - F.col("end_at"))).drop("_last")


def fill_rests(events: DataFrame, keys: Sequence[str], capacity: int = 64) -> DataFrame:
    """The rests that fill the gaps before events and the end: (keys, onset64, duration64), split by M8."""
    e = with_gaps(events, keys, ["ord"], capacity)
    gaps = e.select(*keys, F.inline(F.array(F.struct(F.col("gap_at").alias("start"), "gap"), F.struct(F.col("end_at").alias("start"), F.col("end_gap").alias("gap"))))).filter("gap is not null")
    return gaps.select(*keys, F.inline(rests_of(F.col("start"), F.col("gap"))))


def signature_changes(measures: DataFrame, keys: Sequence[str], order: str = "number") -> DataFrame:
    """The signature in force (an absent one is the one before, 4/4 at first) and whether it is new."""
    w = Window.partitionBy(*keys).orderBy(order)
    sig = F.when(F.col("ts_num").isNotNull() & F.col("ts_den").isNotNull(), F.struct("ts_num", "ts_den"))
    known = measures.withColumn("_s", F.coalesce(F.last(sig, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.struct(F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"))))
    before = F.lag("_s").over(w)
    return known.withColumn("changed", before.isNull() | (before != F.col("_s"))).withColumn("ts_num", F.col("_s.ts_num")).withColumn("ts_den", F.col("_s.ts_den")).drop("_s")


def _sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum of each value and the ``width - 1`` before it, by doubled widths."""
    if width >= len(x):
        return np.maximum.accumulate(x)
    m, p = x, 1
    while p < width:
        d = min(p, width - p)
        m = np.concatenate([m[:d], np.maximum(m[d:], m[:-d])])
        p += d
    return m


def start_path(times: list[float], emits: list[dict[int, float]], top: int) -> list[int]:
    """The best monotone path of W23: a state for each frame, by the frames' times and what each adds to which states.

    A step's cost has the slope 7 on both sides of its best length, so the best predecessors of all states are two
    sliding maxima, whatever the longest step. Their sums are rounded otherwise than those of single steps, and many
    steps are equally good but for rounding; so where the way back meets several predecessors within what rounding can
    change, the sums of single steps decide, which are then worked out for those states alone (for all states of the
    frames so far, where more than 64 of a frame are asked for)."""
    n, states = len(times), np.arange(top + 1)
    slope = states * 7.0
    near, steps = np.zeros((n, top + 1)), [(0.0, 0)]
    near[0] = states * -0.25
    for s, v in emits[0].items():
        near[0, s] = v - s * 0.25
    for k in range(1, n):
        dt = max(0.05, times[k] - times[k - 1])
        jump, want = min(top, max(3, math.ceil(dt * 2.0) + 2)), dt * 0.75
        steps.append((want, jump))
        a, score = int(min(jump, want)), near[k - 1]
        best = _sliding_max(score - slope, a + 1) + slope - 7.0 * want
        if jump > a:
            best[a + 1 :] = np.maximum(best[a + 1 :], _sliding_max(score + slope, jump - a)[: top - a] - slope[a + 1 :] + 7.0 * want)
        for s, v in emits[k].items():
            best[s] += v
        near[k] = best
    slack = (np.abs(near).max() + 7.0 * (top + max(w for w, _ in steps))) * n * 1e-14
    exact: list = [{} for _ in range(n)]  # of some states each, or arrays of all

    def options(k: int, s: int) -> np.ndarray:
        want, jump = steps[k]
        sums = near[k - 1, max(0, s - jump) : s + 1][::-1] - np.abs(np.arange(min(jump, s) + 1) - want) * 7.0
        return np.flatnonzero(~(sums < sums.max() - slack))

    def decided(k: int, s: int, d: np.ndarray) -> tuple[float, int]:
        """Sum and length of the best step, of equal ones the longest: the least earlier state."""
        sums = np.array([exact[k - 1][s - x] for x in d.tolist()]) - np.abs(d - steps[k][0]) * 7.0
        at = len(d) - 1 - int(sums[::-1].argmax())
        return float(sums[at]), int(d[at])

    def work_out_all(last: int) -> None:
        for k in range(last + 1):
            if isinstance(exact[k], dict):
                if k:
                    want, jump = steps[k]
                    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(jump, -np.inf), exact[k - 1]]), jump + 1)
                    exact[k] = (before - np.abs(np.arange(jump, -1, -1) - want) * 7.0).max(axis=1)
                    for s, v in emits[k].items():
                        exact[k][s] += v
                else:
                    exact[0] = near[0]

    def work_out(k: int, wanted: list[int]) -> None:
        """Sums of single steps of states of a frame, and of those that they come from."""
        todo: list[tuple[int, dict[int, np.ndarray]]] = []
        while k >= 0 and isinstance(exact[k], dict) and (new := [s for s in wanted if s not in exact[k]]):
            if len(new) > 64:
                work_out_all(k)
                break
            own = {s: options(k, s) if k else None for s in new}
            todo.append((k, own))
            wanted, k = sorted({s - x for s, d in own.items() for x in d.tolist()}) if k else [], k - 1
        for k, own in reversed(todo):
            for s, d in own.items():
                exact[k][s] = decided(k, s, d)[0] + emits[k].get(s, 0.0) if k else emits[0].get(s, 0.0) - s * 0.25

    last = np.flatnonzero(~(near[-1] < near[-1].max() - slack)).tolist()
    if len(last) > 1:
        work_out(n - 1, last)
    path = [last[0] if len(last) == 1 else max(last, key=lambda s: (exact[-1][s], -s))]
    for k in range(n - 1, 0, -1):
        s = path[-1]
        d = options(k, s)
        if len(d) > 1:
            work_out(k - 1, [s - x for x in d.tolist()])
        path.append(s - (int(d[0]) if len(d) == 1 else decided(k, s, d)[1]))
    return path[::-1]


def starts_of(rows: Iterable[tuple]) -> list[tuple]:
    """W23 of one score's labels (frame_id, t, index, value, conf), in the order of t and frame_id: rows (frame_id,
    start_measure, confidence)."""
    seen = []
    for (t, f), own in itertools.groupby((r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]), key=lambda r: (r[1], r[0])):
        seen.append((t, f, [(int(i), int(v), math.nan if c is None else float(c)) for _, _, i, v, c in own if i is not None and v is not None and i == i and v == v]))
    observed = [v for *_, ls in seen for _, v, _ in ls if v <= 1000]
    if not observed:
        return [(f, None, None) for _, f, _ in seen]
    top, emits = min(1000, max(256, max(observed) + 12)), []
    for *_, ls in seen:
        e: dict[int, float] = {}
        for i, v, c in ls:
            if 0 <= v - i <= top:
                e[v - i] = e.get(v - i, 0.0) + (35.0 + max(0.0, c))
        emits.append(e)
    out = []
    for (_, f, ls), s, e in zip(seen, start_path([float(t) for t, *_ in seen], emits, top), emits):
        fit = [c for i, v, c in ls if v == s + i]
        out.append((f, s, min(100.0, sum(fit) / len(fit)) if fit else min(45.0, e.get(s, 0.0) / 2)))
    return out


def smooth_starts(labels: DataFrame) -> DataFrame:
    """Start numbers of the frames of each score as the best monotone path.

    labels: score_id, frame_id, t, index (null for a frame without a label), value, conf. States are start numbers;
    a label that fits adds 35 + its confidence; a step of d measures in time dt costs 7 * |d - 0.75 dt|, and d lies
    between 0 and max(3, ceil(2 dt) + 2). The first frame prefers small numbers slightly. A frame's confidence is the
    mean of its fitting labels, else at most 45. Scores without a label up to 1000 keep null starts. Scores lie sorted
    in their partition and are read one after the other; one is a group of a few hundred frames.
    """
    s = labels.schema
    names = ["score_id", "frame_id", "t", "index", "value", "conf"]
    out = T.StructType([s["score_id"], s["frame_id"], T.StructField("start_measure", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
    form = pa.schema([*to_arrow_schema(T.StructType(out.fields[:2])), pa.field("start_measure", pa.int32()), pa.field("confidence", pa.float64())])

    def solve(batches):
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
        found = ((score, *r) for score, own in itertools.groupby(rows, key=lambda r: r[0]) for r in starts_of(r[1:] for r in own))
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), form)], schema=form)

    return labels.select(*names).repartition("score_id").sortWithinPartitions("score_id", "t", "frame_id").mapInArrow(solve, out)


def clusters_of(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """W24 of one run's glyphs."""
    pdf = pdf.sort_values("ord")
    x = np.stack(pdf["feature"].map(lambda v: np.asarray(v, np.int8)).tolist())
    sums, sizes, protos, out = [], [], np.zeros((0, x.shape[1]), np.int8), []
    for row in x:
        d = (protos != row).mean(axis=1) if len(protos) else np.zeros(0)
        k = int(d.argmin()) if len(d) else -1
        if k >= 0 and d[k] <= threshold:
            sums[k] += row
            sizes[k] += 1
            protos[k] = sums[k] / sizes[k] >= 0.5
            out.append((k, float(d[k])))
        else:
            sums.append(row.astype(float))
            sizes.append(1)
            protos = np.vstack([protos, row])
            out.append((len(sizes) - 1, 0.0))
    return pd.DataFrame({"run_id": pdf["run_id"].values, "ord": pdf["ord"].values, "cluster_id": [k for k, _ in out], "distance": [d for _, d in out]})


def leader_clusters(glyphs: DataFrame, threshold: float = 0.075) -> DataFrame:
    """Clusters of each run's glyphs (run_id, ord, feature) in order: a glyph joins the nearest prototype within
    the threshold (the first of equals), whose prototype is the majority of its members' cells; else it leads a new
    cluster. Returns run_id, ord, cluster_id, distance. A run is one recording, so a group is bounded by its length."""
    s = glyphs.schema
    return glyphs.groupBy("run_id").applyInPandas(lambda pdf: clusters_of(pdf, threshold), f"run_id {s['run_id'].dataType.simpleString()}, ord {s['ord'].dataType.simpleString()}, cluster_id int, distance double")


BLOCK = 200_000


def search(y: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the first place from low to before high of sorted values that are not under it; high, if there is none."""
    while (wide := low < high).any():
        middle = np.where(wide, (low + high) // 2, 0)
        under = y[middle] < x
        low, high = np.where(wide & under, middle + 1, low), np.where(wide & ~under, middle, high)
    return low


def _pairs(y: np.ndarray, end: np.ndarray, ahead: int | None, low: float, high: float):
    """Pairs (first, second) of places of sorted centres ``low`` to ``high`` apart, the second at most ``ahead`` centres
    after the first and before its page's end, in blocks of about BLOCK."""
    i = np.arange(len(y))
    reach = y + high
    last = search(y, i + 1, end if ahead is None else np.minimum(end, i + 1 + ahead), reach + 2 * np.spacing(np.abs(reach)))
    n = last - i - 1
    for some in np.split(i, np.flatnonzero(np.diff(np.cumsum(n) // BLOCK)) + 1):
        first = np.repeat(some, n[some])
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        gap = y[second] - y[first]
        ok = (gap >= low) & (gap <= high)
        yield first[ok], second[ok]


def _grown(y: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray, lines: int, slack: float, share: float) -> np.ndarray:
    """Groups (rows of places) of ``lines`` centres grown from pairs: each further line is the centre after the last that is
    nearest to its place (of equally near ones the first), no more than max(slack, share * gap) from it."""
    at = np.stack([first, second], axis=1)
    for k in range(2, lines):
        last, stop, gap = at[:, -1], end[at[:, 0]], y[at[:, 1]] - y[at[:, 0]]
        place = y[at[:, 0]] + gap * k
        away = lambda i: np.where((i > last) & (i < stop), np.abs(y[np.minimum(i, len(y) - 1)] - place), np.inf)  # noqa: B023, E731
        right = search(y, last + 1, stop, place)
        best = np.where(away(right - 1) <= away(right), right - 1, right)
        d = away(best)
        while (same := (away(best - 1) == d) & np.isfinite(d)).any():
            best = best - same
        ok = d <= np.maximum(slack, gap * share)
        at = np.column_stack([at, best])[ok]
    return at


def _regular(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spacing (median gap) and irregularity (mean deviation from it, over it) of groups, one a row."""
    gaps = np.diff(lines, axis=1)
    n, s = gaps.shape[1], np.sort(gaps, axis=1)
    middle = s[:, n // 2] if n % 2 else (s[:, n // 2 - 1] + s[:, n // 2]) / 2
    return middle, sum(np.abs(g - middle) for g in gaps.T) / n / middle


def _pages(centres: DataFrame, keys: Sequence[str], y: str, strength: str | None, found, out: str) -> DataFrame:
    """Of the sorted distinct centres of many pages at a time what ``found(page, end, y, strength)`` tells: numbers of
    pages and the columns of ``out``. A centre's place is in the arrays; ``end`` is where the next page begins."""
    value = (F.max(strength) if strength else F.lit(0.0)).cast("double")
    single = centres.filter(F.abs(F.col(y).cast("double")) < float("inf")).groupBy(*keys, F.col(y).cast("double").alias("_y")).agg(value.alias("_s"))
    lists = single.groupBy(*keys).agg(F.collect_list("_y").alias("_ys"), F.collect_list(F.coalesce("_s", F.lit(float("nan")))).alias("_ss"))
    names = [f.strip().split()[0] for f in out.split(",")]

    def solve(batches):
        for b in batches:
            size = b.column("_ys").value_lengths().to_numpy(zero_copy_only=False)
            for pages in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1) if len(size) else ():
                some = b.slice(pages[0], len(pages))
                page = np.repeat(np.arange(len(pages)), size[pages])
                ys, ss = (some.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("_ys", "_ss"))
                order = np.lexsort((ys, page))
                of, columns = found(page, np.cumsum(size[pages])[page], ys[order], ss[order])
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(own) for k in keys), *columns], names=[*keys, *names])

    types = ", ".join(f"`{k}` {single.schema[k].dataType.simpleString()}" for k in keys)
    return lists.select(*keys, "_ys", "_ss").mapInArrow(solve, f"{types}, {out}")


def _rows(values: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _heads(page: np.ndarray) -> np.ndarray:
    """Places where a page begins, in sorted numbers of pages."""
    return np.flatnonzero(np.diff(page, prepend=-1))


def line_groups(centres: DataFrame, keys: Sequence[str], y: str = "y", lines: int = 6, low: float = 4.0, high: float = 80.0, tolerance: float = 0.2) -> DataFrame:
    """Regular groups of ``lines`` line centres of a page, in two passes of interval selection.

    First windows of consecutive centres (median gap ``low`` to ``high``, irregularity at most ``tolerance``), from the
    top; then, where nothing lies, groups grown over stray centres from pairs at most four centres apart, the most
    regular first. Equal centres count once. One row a group: keys, group (from the top), lines, spacing, irregularity,
    recovered. What meets in one row is one page; a task reckons many pages at a time."""

    def found(page, end, y, _):
        i = np.arange(len(y))
        i = i[i + lines <= end]
        at = [i[:, None] + np.arange(lines)]
        at += [_grown(y, end, *pair, lines, 3.0, 0.25) for pair in _pairs(y, end, 4, low, high)]
        own, phase = np.concatenate(at), np.repeat([0, 1], [len(i), sum(map(len, at[1:]))])
        spacing, uneven = _regular(y[own])
        ok = (uneven <= tolerance) & ((phase == 1) | (spacing >= low) & (spacing <= high))
        own, phase, spacing, uneven = own[ok], phase[ok], spacing[ok], uneven[ok]
        top, bottom, of = y[own[:, 0]], y[own[:, -1]], page[own[:, 0]]
        left = np.lexsort((own[:, 1], own[:, 0], np.where(phase == 0, uneven, top), np.where(phase == 0, top, uneven), phase, of))
        kept = [left[:0]]
        while len(left):  # the first of each page stays, and what lies clear of it
            heads = _heads(of[left])
            kept.append(left[heads])
            best = np.repeat(left[heads], np.diff(heads, append=len(left)))
            left = left[(bottom[left] < top[best]) | (top[left] > bottom[best])]
        kept = np.concatenate(kept)
        kept = kept[np.lexsort((top[kept], of[kept]))]
        heads = _heads(of[kept])
        group = np.arange(len(kept)) - np.repeat(heads, np.diff(heads, append=len(kept)))
        return of[kept], [pa.array(group, pa.int32()), _rows(y[own[kept]]), pa.array(spacing[kept]), pa.array(uneven[kept]), pa.array(phase[kept] == 1)]

    return _pages(centres, keys, y, None, found, "group int, lines array<double>, spacing double, irregularity double, recovered boolean")


def best_line_group(centres: DataFrame, keys: Sequence[str], lines: int, height: float, y: str = "y", strength: str = "strength") -> DataFrame:
    """The one group of ``lines`` centres of a frame of this height with the largest mean strength less 80 times its
    irregularity (0.22 at most), grown from any pair 5 to height / 4 apart; of equal ones the first. Unknown strengths
    are left out of the mean."""

    def found(page, end, y, s):
        best = [np.empty((0, lines), np.int64)]
        for pair in _pairs(y, end, None, 5.0, height / 4):
            best.append(first(page, y, s, _grown(y, end, *pair, lines, 2.0, 0.28)))
        at = first(page, y, s, np.concatenate(best))
        spacing, uneven = _regular(y[at])
        return page[at[:, 0]], [pa.array(score(y, s, at), from_pandas=True), _rows(y[at]), pa.array(spacing), pa.array(uneven)]

    def score(y, s, at):
        known = ~np.isnan(s[at])
        with np.errstate(invalid="ignore"):  # no strength is known
            return sum(np.where(known, s[at], 0.0).T) / known.sum(axis=1) - _regular(y[at])[1] * 80

    def first(page, y, s, at):
        at = at[_regular(y[at])[1] <= 0.22]
        at = at[np.lexsort((at[:, 1], at[:, 0], -score(y, s, at), page[at[:, 0]]))]
        return at[_heads(page[at[:, 0]])]

    return _pages(centres, keys, y, strength, found, "score double, lines array<double>, spacing double, irregularity double")


def highlight_index(runs: DataFrame, measures: DataFrame, staffs: DataFrame, keys: Sequence[str], tolerance: float = 0.08) -> DataFrame:
    """The highlighted measure of a frame. runs: the longest dark run (y, x1, x2) of image rows; measures:
    measure_index, left, right; staffs: top, bottom.

    Runs of 0.65 to 1.15 median measures on consecutive rows are one bar, with mean height and median ends in whole
    pixels. A bar over the staff and one under it whose ends differ by at most ``tolerance`` measures make a pair; the
    first pair, from the top, whose middle lies in a measure (ends included, the first measure of two) decides."""
    size = measures.groupBy(*keys).agg(F.median(F.col("right") - F.col("left")).alias("_w"))
    wide = runs.join(size, list(keys)).filter((F.col("x2") - F.col("x1")).between(F.col("_w") * 0.65, F.col("_w") * 1.15))
    px = lambda v: F.bround(v.cast("double"))
    bars = islands(wide, keys, "y", 1).groupBy(*keys, "island", "_w").agg(px(F.avg("y")).alias("y"), px(F.median("x1")).alias("a"), px(F.median("x2")).alias("z")).join(staffs, list(keys))
    over = bars.filter("y < top").select(*keys, "_w", F.col("y").alias("_ty"), F.col("a").alias("_ta"), F.col("z").alias("_tz"))
    under = bars.filter("y > bottom").select(*keys, F.col("y").alias("_by"), F.col("a").alias("_ba"), F.col("z").alias("_bz"))
    near = lambda p, q: F.abs(F.col(p) - F.col(q)) <= F.col("_w") * tolerance
    pairs = over.join(under, list(keys)).filter(near("_ta", "_ba") & near("_tz", "_bz")).withColumn("_x", (F.col("_ta") + F.col("_tz") + F.col("_ba") + F.col("_bz")) / 4)
    hit = pairs.join(measures, list(keys)).filter("_x >= left and _x <= right")
    return hit.groupBy(*keys).agg(F.min(F.struct("_ty", "_by", "measure_index")).alias("_h")).select(*keys, F.col("_h.measure_index").alias("highlighted_index"))


def bar_candidates(profile: DataFrame, keys: Sequence[str], spacing: float) -> DataFrame:
    """Columns (x, share, run, below) that look like bar lines; where fewer than three do, a weaker rule holds;
    neighbours within max(5, 0.75 spacings) are one line at their mean."""
    ok = (F.col("share") >= 0.86) & (F.col("run") >= 0.9) & (F.col("below") <= max(2.0, 0.35 * spacing))
    weak = (F.col("share") >= 0.86) & (F.col("run") >= 0.9)
    n = F.sum(F.when(ok, 1).otherwise(0)).over(Window.partitionBy(*keys))
    c = profile.withColumn("_n", n).filter(ok | ((F.col("_n") < 3) & weak))
    return island_centres(c, keys, "x", max(5.0, 0.75 * spacing)).select(*keys, F.col("centre").alias("x"))


def choose_layout(groups: DataFrame, keys: Sequence[str], background: Column) -> DataFrame:
    """Groups (polarity, lines, top, bottom, spacing, score): the best six-line group of the polarity that the
    background asks for (any, if there is none), and whether a five-line group stands above it at a like spacing."""
    want = F.when(background >= 128, "dark_on_light").otherwise("light_on_dark")
    six = groups.filter("lines = 6").withColumn("_pref", (F.col("polarity") == want).cast("int"))
    best = six.groupBy(*keys).agg(F.max(F.struct("_pref", "score", (-F.col("top")).alias("t"), "top", "bottom", "spacing", "polarity")).alias("b"))
    five = groups.filter("lines = 5").select(*keys, F.col("bottom").alias("f_bottom"), F.col("spacing").alias("f_spacing"), F.col("polarity").alias("f_pol"))
    over = best.join(five, list(keys)).filter((F.col("f_pol") == F.col("b.polarity")) & (F.col("f_bottom") < F.col("b.top")) & F.col("f_spacing").between(0.6 * F.col("b.spacing"), 1.6 * F.col("b.spacing")) & (F.col("b.top") - F.col("f_bottom") <= 14 * F.col("b.spacing"))).select(*keys).distinct().withColumn("_pair", F.lit(True))
    return best.join(over, list(keys), "left").select(*keys, F.when(F.col("_pair"), "staff_tab_pair").otherwise("tab_only").alias("layout"), F.col("b.polarity").alias("polarity"), F.col("b.top").alias("top"), F.col("b.bottom").alias("bottom"))

"""Joins (J): equi, nearest, interval, as-of, greedy one-to-one. Every join has an equi key, so it is a hash or merge
join with a residual condition; ordered ones are windows over a union. Ties go to the first row in order."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seq import BLOCK, search


def resolve_sessions(sessions: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out with their owner."""
    return sessions.filter(F.col("expires_at") > now).join(owners, "user_id")


def owned(df: DataFrame, owners: DataFrame, keys: Sequence[str] = ("score_id", "user_id")) -> DataFrame:
    """Rows that an owner has."""
    return df.join(owners, list(keys), "left_semi")


def with_children(parents: DataFrame, key: str, **children: tuple[DataFrame, Sequence[str], Sequence[str]]) -> DataFrame:
    """An array column for each child table (table, columns, order); an empty array where there are none."""
    for name, (child, columns, order) in children.items():
        rows = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
        parents = parents.join(rows, key, "left")
        parents = parents.withColumn(name, F.coalesce(F.transform(name, lambda x: F.struct(*[x[c].alias(c) for c in columns])), F.array()))
    return parents


def nearest_line(y: Column, lines: Column, tolerance: Column) -> Column:
    """Number (from 1) of the line nearest to y within the tolerance, the first of equals; null if none."""
    best = F.array_min(F.transform(lines, lambda l, i: F.struct(F.abs(y - l).alias("d"), (i + 1).cast("int").alias("i"))))
    return F.when(best["d"] <= tolerance, best["i"])


def assign_string(tokens: DataFrame, staffs: DataFrame, keys: Sequence[str], tolerance: Column) -> DataFrame:
    """J4 over tables: tokens (y) with the string of their staff's ``lines``."""
    return tokens.join(staffs, list(keys)).withColumn("string", nearest_line(F.col("y"), F.col("lines"), tolerance))


def in_measure(items: DataFrame, measures: DataFrame, keys: Sequence[str], at: str = "x", left: str = "left", right: str = "right") -> DataFrame:
    """Items with the measure whose half-open interval holds them."""
    return items.join(measures, list(keys)).filter((F.col(at) >= F.col(left)) & (F.col(at) < F.col(right)))


def attach_labels(labels: DataFrame, measures: DataFrame, keys: Sequence[str], spacing: Column) -> DataFrame:
    """A label's measure: the first that holds it near its left edge, else the nearest left edge within 3 spacings.

    labels: keys, label_id, x; measures: keys, measure_index, left, right. One row for each label that has one.
    """
    both = labels.join(measures, list(keys))
    offset = F.col("x") - F.col("left")
    inside = (offset >= 0) & (F.col("x") < F.col("right")) & (offset <= F.least(F.col("right") - F.col("left"), 6 * spacing))
    rank = F.when(inside, F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("d"), F.col("measure_index").alias("i"))).when(F.abs(offset) <= 3 * spacing, F.struct(F.lit(1).alias("p"), F.abs(offset).cast("double").alias("d"), F.col("measure_index").alias("i")))
    return both.withColumn("rank", rank).filter("rank is not null").groupBy(*keys, "label_id").agg(F.min("rank").alias("rank")).select(*keys, "label_id", F.col("rank.i").alias("measure_index"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], within: float | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (later ones of equal time win), by a union and a
    window, so nothing is multiplied. Right rows need a column ``ord`` for equal times."""
    empty = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    tagged_l = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema["ord"].dataType).alias("ord"), F.lit(None).cast(right.schema[on].dataType).alias("_at"), *empty)
    others = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, on)]
    tagged_r = right.select(*keys, on, *others, F.lit(0).alias("_side"), "ord", F.col(on).alias("_at"), *values)
    w = Window.partitionBy(*keys).orderBy(on, "_side", "ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_side") == 0, F.struct("_at", *values)), ignorenulls=True).over(w)
    out = tagged_l.unionByName(tagged_r).withColumn("_r", carried).filter("_side = 1")
    if within is not None:
        out = out.withColumn("_r", F.when(F.col(on) - F.col("_r._at") <= within, F.col("_r")))
    return out.select(*left.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


def attach_spans(items: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "x") -> DataFrame:
    """Items that a span (start, end, both included) covers, with the span's other columns."""
    return items.join(spans, list(keys)).filter(F.col(at).between(F.col("start"), F.col("end")))


def best_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], covers: Column, order: Sequence[Column]) -> DataFrame:
    """The best right row by ``order`` of those that cover a left row."""
    w = Window.partitionBy(*left_id).orderBy(*order)
    return left.join(right, list(keys)).filter(covers).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, right_id: str) -> DataFrame:
    """The id of the right row nearest in time, the earlier one and then the lesser id of equals. Two
    one-sided searches over a union: linear in the rows, however many share a key."""
    rid = right.schema[right_id].dataType
    a = left.select("*", F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(rid).alias("_id"))
    b = right.select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys], F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(right_id).alias("_id"))
    rows = a.unionByName(b)
    at = F.when(F.col("_side") == 0, F.struct("_t", "_id"))
    # the least id of the latest time at or before, and the least id of the first time after
    back = Window.partitionBy(*keys).orderBy("_t", "_side", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_t", F.desc("_side"), "_id").rowsBetween(0, Window.unboundedFollowing)
    both = rows.withColumn("_b", F.last(at, ignorenulls=True).over(back)).withColumn("_a", F.first(at, ignorenulls=True).over(ahead)).filter("_side = 1")
    before, after = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    pick = F.when(F.col("_a").isNull() | (before <= after), F.col("_b._id")).otherwise(F.col("_a._id"))
    return both.select(*left.columns, F.coalesce(pick, F.col("_a._id")).alias("nearest_id"))


def named_or_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str, left_t: str, right_t: str, right_id: str) -> DataFrame:
    """The asset of the same name, else the nearest in time."""
    named = right.groupBy(*keys, name).agg(F.min(right_id).alias("_named"))
    found = nearest_in_time(left, right, keys, left_t, right_t, right_id).join(named, [*keys, name], "left")
    return found.withColumn("evidence_id", F.coalesce("_named", "nearest_id")).drop("_named", "nearest_id")


def interpolate(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str, clamp: bool = True, floor: float | None = None) -> DataFrame:
    """Y at each query's x on the line through the points; at the ends the first or last value (clamp) or
    the line of the end segment goes on. Points of equal x keep the one that sorts first."""
    p = points.groupBy(*keys, x).agg(F.min(y).alias(y))
    seg = Window.partitionBy(*keys).orderBy(x)
    p = p.withColumn("_s", F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(seg).alias("x1"), F.lead(y).over(seg).alias("y1"), F.lag(x).over(seg).alias("xp"), F.lag(y).over(seg).alias("yp")))
    others = [c for c in queries.columns if c not in (*keys, x)]
    a = queries.select("*", F.lit(1).alias("_side"), F.lit(None).cast(p.schema["_s"].dataType).alias("_s"))
    b = p.select(*keys, x, *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in others], F.lit(0).alias("_side"), "_s")
    w = Window.partitionBy(*keys).orderBy(x, "_side")
    both = a.unionByName(b).withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_side = 1")
    line = lambda x0, y0, x1, y1: y0 + (y1 - y0) * (F.col(x) - x0) / (x1 - x0)
    c = F.col
    ahead = c("_a.y0") if clamp else F.coalesce(line(c("_a.x0"), c("_a.y0"), c("_a.x1"), c("_a.y1")), c("_a.y0"))
    behind = c("_b.y0") if clamp else F.coalesce(line(c("_b.xp"), c("_b.yp"), c("_b.x0"), c("_b.y0")), c("_b.y0"))
    value = F.when(c("_b").isNull(), ahead).when(c("_b.x1").isNull(), F.when(c(x) == c("_b.x0"), c("_b.y0")).otherwise(behind)).otherwise(line(c("_b.x0"), c("_b.y0"), c("_b.x1"), c("_b.y1")))
    if floor is not None:
        value = F.greatest(value, F.lit(floor))
    return both.select(*queries.columns, value.alias(y))


def tempo_map(changes: DataFrame, keys: Sequence[str], division: int = 480, default: int = 500_000) -> DataFrame:
    """(keys, tick, time_ms, us_per_quarter) segments of tempo changes (tick, us_per_quarter, ord): the last of
    one tick wins, those not positive are dropped, and tick 0 has the default unless it has its own."""
    good = changes.filter("us_per_quarter > 0").groupBy(*keys, "tick").agg(F.max(F.struct("ord", "us_per_quarter")).alias("_l"))
    own = good.select(*keys, "tick", F.col("_l.us_per_quarter").alias("us_per_quarter"))
    start = changes.select(*keys).distinct().join(own.filter("tick = 0").select(*keys), list(keys), "left_anti").select(*keys, F.lit(0).cast(own.schema["tick"].dataType).alias("tick"), F.lit(default).cast(own.schema["us_per_quarter"].dataType).alias("us_per_quarter"))
    w = Window.partitionBy(*keys).orderBy("tick")
    step = F.coalesce((F.col("tick") - F.lag("tick").over(w)) * F.lag("us_per_quarter").over(w) / F.lit(division) / 1000, F.lit(0.0))
    return own.unionByName(start).withColumn("_step", step).withColumn("time_ms", F.sum("_step").over(w)).select(*keys, "tick", "time_ms", "us_per_quarter")


def ticks_to_ms(queries: DataFrame, segments: DataFrame, keys: Sequence[str], division: int = 480) -> DataFrame:
    """Time of each query's tick (under 0 counts as 0)."""
    q = queries.withColumn("_tick", F.col("tick")).withColumn("tick", F.greatest("tick", F.lit(0)))
    seg = segments.withColumn("ord", F.lit(0)).withColumn("_t0", F.col("tick"))
    out = asof_backward(q, seg, keys, "tick", ["_t0", "time_ms", "us_per_quarter"])
    return out.withColumn("ms", F.col("time_ms") + (F.col("tick") - F.col("_t0")) * F.col("us_per_quarter") / F.lit(division) / 1000).drop("_t0", "time_ms", "us_per_quarter", "tick").withColumnRenamed("_tick", "tick")


def apply_alignment(points: DataFrame, suggestions: DataFrame, order: Sequence[Column], label_chars: int = 80) -> DataFrame:
    """The points and one suggestion for each measure that has no point yet, with a clipped label."""
    w = Window.partitionBy("score_id", "measure_number").orderBy(*order)
    new = suggestions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(points, ["score_id", "measure_number"], "left_anti")
    new = new.withColumn("label", F.substring("label", 1, label_chars))
    return points.unionByName(new.select(*[c for c in points.columns if c in new.columns]), allowMissingColumns=True)


MATCHES = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("t", T.IntegerType())]))


@F.pandas_udf(MATCHES)
def _nearest_free(p: pd.Series, px: pd.Series, t: pd.Series, tx: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Greedy matching on a line: predictions in their order take the nearest free target, of equally near ones that of
    the least number. Targets lie sorted by place; free neighbours on both sides are found by pointers that skip what
    is used, so a list costs no more than sorting it."""

    def find(jump: list[int], i: int) -> int:
        root = i
        while jump[root] != root:
            root = jump[root]
        while jump[i] != root:
            jump[i], i = root, jump[i]
        return root

    def one(p, px, t, tx, tolerance: float) -> list[dict]:
        targets = sorted(zip(tx.tolist(), t.tolist()))
        xs = [x for x, _ in targets]
        n, out = len(xs), []
        up, down = list(range(n + 1)), list(range(n + 1))  # next free place at or after i; before i, counted from 1
        for q, number in sorted(zip(px.tolist(), p.tolist()), key=lambda a: a[1]):
            i = bisect.bisect_left(xs, q)
            right, left = find(up, i), find(down, i)
            options = [(abs(q - xs[right]), targets[right][1], right)] if right < n else []
            if left:
                first = find(up, bisect.bisect_left(xs, xs[left - 1]))  # the least number at the same place
                options.append((abs(q - xs[first]), targets[first][1], first))
            if options and min(options)[0] <= tolerance:
                _, target, at = min(options)
                up[at], down[at + 1] = at + 1, at
                out.append({"p": number, "t": target})
        return out

    return pd.Series([one(*x) for x in zip(p, px, t, tx, tolerance)], dtype=object)


def match_events(pred: DataFrame, truth: DataFrame, keys: Sequence[str], at: str = "onset", tolerance: float = 0.26) -> DataFrame:
    """Greedy one-to-one matching. Predictions, in the order ``ord``, take the nearest unused target (ord) of
    the same key (which holds the note set) within the tolerance. One row for each match: keys, pred_ord, truth_ord.

    Where neighbours on the line, of either side, are further apart than the tolerance, no match can reach across; so
    a key falls into stretches that are matched one by one."""
    side = lambda df, n: df.select(*keys, F.col("ord").cast("int").alias("_o"), F.col(at).cast("double").alias("_x"), F.lit(n).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_x", "_side", "_o")
    both = side(pred, 0).unionByName(side(truth, 1)).withColumn("_new", F.when(F.col("_x") - F.lag("_x").over(w) <= tolerance, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda n: F.collect_list(F.when(F.col("_side") == n, F.struct("_o", "_x")))
    parts = both.groupBy(*keys, "_part").agg(of(0).alias("_p"), of(1).alias("_t")).filter("size(_p) > 0 and size(_t) > 0")
    of_all = lambda c, n: F.transform(c, lambda v: v[n])
    found = _nearest_free(of_all("_p", "_o"), of_all("_p", "_x"), of_all("_t", "_o"), of_all("_t", "_x"), F.lit(float(tolerance)))
    return parts.select(*keys, F.explode(found).alias("m")).select(*keys, F.col("m.p").alias("pred_ord"), F.col("m.t").alias("truth_ord"))


def _overlap(p: Sequence[np.ndarray], t: Sequence[np.ndarray]) -> np.ndarray:
    """Intersection over union of boxes (x, y, w, h), 0 for an empty union."""
    (x, y, w, h), (tx, ty, tw, th) = p, t
    inter = np.maximum(0.0, np.minimum(x + w, tx + tw) - np.maximum(x, tx)) * np.maximum(0.0, np.minimum(y + h, ty + th) - np.maximum(y, ty))
    union = w * h + tw * th - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _best_boxes(p: Sequence[np.ndarray], t: Sequence[np.ndarray], number: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """For each box in order the place of the free target from low to before high of the largest overlap, the least number
    first; -1 where none has the least overlap. One box after the other, for groups with too many pairs to hold."""
    free, out = np.ones(len(number), bool), np.full(len(low), -1)
    for k, (i, j) in enumerate(zip(low, high)):
        over = _overlap([v[k] for v in p], [v[i:j] for v in t])
        ok = np.flatnonzero(free[i:j] & (over >= least))
        if len(ok):
            out[k] = i + min(ok, key=lambda n: (-over[n], number[i + n]))
            free[out[k]] = False
    return out


def _taken(pg: np.ndarray, p: Sequence[np.ndarray], tg: np.ndarray, t: Sequence[np.ndarray], number: np.ndarray, groups: int, least: float) -> np.ndarray:
    """Greedy matching of boxes in many groups at a time: for each box (in order in its group) the place of its target or
    -1. Targets are sorted by their left edges in a group; a box only looks at those whose left edge lies within its
    reach. A box takes its best target as soon as no box before it may want that one, which is what taking turns gives."""
    widest = np.zeros(groups)
    np.maximum.at(widest, tg, t[2])
    begin, end = np.searchsorted(tg, pg), np.searchsorted(tg, pg, "right")
    low, high = search(t[0], begin, end, p[0] - widest[pg]), search(t[0], begin, end, np.nextafter(p[0] + p[2], np.inf))
    n = np.maximum(high - low, 0)
    large = np.bincount(pg, n, groups)[pg] > BLOCK
    out = np.full(len(pg), -1)
    for g in np.unique(pg[large]):
        own, here = slice(*np.searchsorted(pg, [g, g + 1])), slice(*np.searchsorted(tg, [g, g + 1]))
        best = _best_boxes([v[own] for v in p], [v[here] for v in t], number[here], low[own] - here.start, high[own] - here.start, least)
        out[own] = np.where(best < 0, -1, best + here.start)
    n[large] = 0
    i, pairs = np.arange(len(pg)), []
    for some in np.split(i, np.flatnonzero(np.diff(np.cumsum(n) // BLOCK)) + 1):
        a = np.repeat(some, n[some])
        b = low[a] + np.arange(len(a)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        over = _overlap([v[a] for v in p], [v[b] for v in t])
        ok = over >= least
        pairs.append((a[ok], b[ok], over[ok]))
    a, b, over = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((number[b], -over, a))
    a, b = a[order], b[order]
    first = np.empty(len(tg), np.int64)
    while len(a):
        first[b[::-1]] = a[::-1]  # the first box that may want each target
        best = np.flatnonzero(np.diff(a, prepend=-1))
        best = best[first[b[best]] == a[best]]
        out[a[best]] = b[best]
        used = np.zeros(len(tg), bool)
        used[b[best]] = True
        left = (out[a] < 0) & ~used[b]
        a, b = a[left], b[left]
    return out


def match_detections(detections: DataFrame, truth: DataFrame, least_score: float = 0.35, least_iou: float = 0.5) -> DataFrame:
    """Greedy matching in (image, class): detections by falling score (then ``ord``) take the unused target of the
    largest overlap, the first of equals. Returns the kept detections with truth_ord, null for a false positive. What
    meets in one row is an image's class; a task matches many at a time."""
    keys, box = ["image_id", "category_id"], ["x", "y", "w", "h"]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def targets(ps: pa.Array, ts: pa.Array) -> pa.Array:
        size, of = ps.value_lengths().to_numpy(zero_copy_only=False), ts.value_lengths().to_numpy(zero_copy_only=False)
        pg, tg = np.repeat(np.arange(len(ps)), size), np.repeat(np.arange(len(ts)), of)
        p, t = ({n: x.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("score", "ord", *box)} for x in (ps, ts))
        by, order = np.lexsort((p["ord"], -p["score"], pg)), np.lexsort((t["ord"], t["x"], tg))
        number = t["ord"][order]
        best = np.empty(len(pg), np.int64)
        best[by] = _taken(pg[by], [p[n][by] for n in box], tg, [t[n][order] for n in box], number, len(ps), least_iou)
        known = pa.array(np.append(number, 0).astype(np.int32)[best], pa.int32(), mask=best < 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), known)

    kept = detections.filter(F.col("score") >= least_score)
    measures = lambda score: F.struct(score.cast("double").alias("score"), F.col("ord").cast("int").cast("double").alias("ord"), *(F.col(n).cast("double").alias(n) for n in box))
    rest = [n for n in kept.columns if n not in keys]
    p = kept.select(*keys, F.struct(measures(F.col("score")).alias("m"), F.struct(*rest).alias("row")).alias("_p"))
    t = truth.dropna(subset=keys).select(*keys, measures(F.lit(0.0)).alias("_t"))
    both = p.unionByName(t, allowMissingColumns=True).groupBy(*keys).agg(F.collect_list("_p").alias("_p"), F.collect_list("_t").alias("_t")).filter("size(_p) > 0")
    rows = F.inline(F.arrays_zip(F.col("_p")["row"].alias("row"), F.col("_m").alias("truth_ord")))
    return both.withColumn("_m", targets(F.col("_p")["m"], F.col("_t"))).select(*keys, rows).select(*keys, "row.*", "truth_ord").select(*kept.columns, "truth_ord")


def dedupe_exact(frames: DataFrame, content: Column, order: Sequence[Column], parsed: Column | None = None) -> DataFrame:
    """The first frame, in scan order, with the same content; copies count once the first one was parsed."""
    w = Window.partitionBy("_h").orderBy(*order)
    ok = F.lit(True) if parsed is None else parsed
    first = F.first(F.when(ok, F.struct(*[F.col(c) for c in frames.columns])), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frames.withColumn("_h", F.sha2(content, 256)).withColumn("_f", first).withColumn("first_id", F.coalesce(F.col(f"_f.{frames.columns[0]}"), F.col(frames.columns[0]))).drop("_h", "_f")


def verified_accuracy(original: DataFrame, corrected: DataFrame, keys: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """Verified and correct positions and accuracy over both sides' positions; the last of a repeated position wins."""
    last = lambda df, name: df.groupBy(*keys).agg(F.max(F.struct(ordinal, value)).alias("_v")).select(*keys, F.col(f"_v.{value}").alias(name))
    both = last(original, "was").join(last(corrected, "now"), list(keys), "full_outer")
    correct = F.sum(F.when(F.col("was") == F.col("now"), 1).otherwise(0))
    return both.agg(F.count("*").alias("verified"), F.coalesce(correct, F.lit(0)).alias("correct")).withColumn("accuracy", F.col("correct") / F.greatest(F.lit(1), F.col("verified")))


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """A value of a dimension table, with a default. Spark picks a broadcast by the table's size."""
    return df.join(dim.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def signature_votes(unresolved: DataFrame, known: DataFrame) -> DataFrame:
    """J22, one round: unresolved (score_id, frame_id, index, signature) votes for a start by the numbers of known
    (score_id, number, signature); two votes and a start of 0 or more are needed. Equal counts: the lesser start."""
    votes = unresolved.join(known, ["score_id", "signature"]).withColumn("start", F.col("number") - F.col("index"))
    counts = votes.groupBy("score_id", "frame_id", "start").agg(F.count("*").alias("n"))
    best = counts.groupBy("score_id", "frame_id").agg(F.max(F.struct("n", (-F.col("start")).alias("s"))).alias("b"))
    return best.filter("b.n >= 2 and b.s <= 0").select("score_id", "frame_id", (-F.col("b.s")).alias("start_measure"), F.col("b.n").alias("votes"))


def resolve_by_signature(frames: DataFrame, known: DataFrame, rounds: int = 3) -> DataFrame:
    """At most ``rounds`` rounds; measures of frames resolved in one are known in the next."""
    found = None
    for _ in range(rounds):
        left = frames if found is None else frames.join(found, ["score_id", "frame_id"], "left_anti")
        new = signature_votes(left, known)
        found = new if found is None else found.unionByName(new)
        placed = frames.join(new, ["score_id", "frame_id"]).select("score_id", (F.col("start_measure") + F.col("index")).alias("number"), "signature")
        known = known.unionByName(placed).distinct()
    return found


def apply_predictions(tokens: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions (ordinal, text, confidence) put on tokens (ordinal) of the same place, for groups where both
    have the same number and all texts are one or two digits; other groups keep their own text."""
    n = preds.groupBy(*keys).agg(F.count("*").alias("_np"), F.bool_and(F.coalesce(F.col("text").rlike(r"^\d{1,2}$"), F.lit(False))).alias("_ok"))
    m = tokens.groupBy(*keys).agg(F.count("*").alias("_nt"))
    good = n.join(m, list(keys)).filter("_np = _nt and _ok").select(*keys)
    new = preds.join(good, list(keys), "left_semi").select(*keys, "ordinal", F.col("text").alias("predicted"), F.col("confidence").alias("predicted_confidence"))
    return tokens.join(new, [*keys, "ordinal"], "left")


def prefer(df: DataFrame, keys: Sequence[str], kind: str, first: str) -> DataFrame:
    """In each group the rows of the preferred kind if there are any, else all."""
    has = F.max(F.col(kind) == first).over(Window.partitionBy(*keys))
    return df.withColumn("_has", has).filter(~F.col("_has") | (F.col(kind) == first)).drop("_has")


def merge_summary(new: DataFrame, old: DataFrame, keys: Sequence[str], tag: str, counters: Sequence[str]) -> DataFrame:
    """Counters of an earlier summary are added when its tag is the same."""
    o = old.select(*keys, F.col(tag).alias("_tag"), *[F.col(c).alias(f"_{c}") for c in counters])
    both = new.join(o, list(keys), "left")
    for c in counters:
        both = both.withColumn(c, F.when(F.col("_tag") == F.col(tag), F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(F.col(c)))
    return both.drop("_tag", *[f"_{c}" for c in counters])


def choose_audio_source(mode: Column, uploaded: Column, video: Column) -> Column:
    """struct<source, reason> of a wanted mode (auto, upload, video) and what is present."""
    up, vid = F.coalesce(uploaded, F.lit("")) != "", F.coalesce(video, F.lit("")) != ""
    source = F.when(mode.isin("auto", "upload") & up, "upload").when(mode.isin("auto", "video") & vid, "video")
    return F.struct(source.alias("source"), F.when(source.isNull(), F.concat(F.lit("no_"), mode)).alias("reason"))


def assign_rhythm(tokens: DataFrame, components: DataFrame, keys: Sequence[str], s: Column) -> DataFrame:
    """Duration of tokens (token_id, x) by the tallest component over them (x, y, w, h, beam_bands, top): wide
    ones by their beams (1 or, from two on, 0.5), narrow ones 2, or 3 with a small component at their lower right."""
    c = F.col
    comp = components.select(*keys, *[c(n).alias(f"c_{n}") for n in ("x", "y", "w", "h", "beam_bands")])
    stem = tokens.join(comp, list(keys)).filter((c("x") >= c("c_x") - 0.25 * s) & (c("x") <= c("c_x") + c("c_w") + 0.25 * s) & (c("c_h") >= 1.25 * s) & (c("c_y") <= c("top") + 0.9 * s))
    best = stem.groupBy(*keys, "token_id").agg(F.max(F.struct("c_h", "c_x", "c_y", "c_w", "c_beam_bands")).alias("b"))
    dots = components.filter((c("w") <= 0.45 * s) & (c("h") <= 0.45 * s)).select(*keys, c("x").alias("d_x"), c("y").alias("d_y"))
    dotted = best.join(dots, list(keys)).filter((c("d_x") > c("b.c_x") + c("b.c_w")) & (c("d_x") <= c("b.c_x") + c("b.c_w") + s) & (c("d_y") >= c("b.c_y"))).select(*keys, "token_id").distinct().withColumn("_dot", F.lit(True))
    shape = best.join(dotted, [*keys, "token_id"], "left")
    wide = c("b.c_w") >= 0.7 * s
    units = F.when(wide, F.when(c("b.c_beam_bands") >= 2, 0.5).otherwise(1.0)).otherwise(F.when(c("_dot"), 3.0).otherwise(2.0))
    return tokens.join(shape.select(*keys, "token_id", units.alias("duration_units")), [*keys, "token_id"], "left")


def tick_rate(anchors: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Slope of the anchors' segment at each query's x (that of the nearest segment beyond the ends), clamped; 1
    where there is no segment."""
    w = Window.partitionBy(*keys).orderBy(x)
    slope = (F.lead(y).over(w) - F.col(y)) / F.nullif(F.lead(x).over(w) - F.col(x), F.lit(0))
    seg = anchors.withColumn("rate", slope).filter("rate is not null").select(*keys, x, "rate", F.lit(0).alias("ord"))
    first = seg.groupBy(*keys).agg(F.min(F.struct(x, "rate")).alias("_f"))
    found = asof_backward(queries, seg, keys, x, ["rate"]).join(first, list(keys), "left")
    rate = F.coalesce("rate", "_f.rate", F.lit(1.0))
    return found.withColumn("rate", F.least(F.lit(high), F.greatest(F.lit(low), rate))).drop("_f")


def nearest_section(suggestions: DataFrame, sections: DataFrame, keys: Sequence[str] = ("score_id",)) -> DataFrame:
    """The label of the section whose start is nearest to a suggestion's time."""
    near = nearest_in_time(suggestions, sections, keys, "time_seconds", "start_seconds", "section")
    return near.join(sections.select(*keys, F.col("section").alias("nearest_id"), F.col("label").alias("section_label")), [*keys, "nearest_id"], "left").drop("nearest_id")


def match_chords(pred: DataFrame, truth: DataFrame, gap: float) -> DataFrame:
    """Chords (image_id, notes, x, ord) with the same notes at most ``gap`` apart, in the order of x."""
    return match_events(pred, truth, ["image_id", "notes"], "x", gap)

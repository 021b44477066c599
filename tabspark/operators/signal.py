"""Audio features (T). Samples are stored in chunks of frames; only the spectrum is an Arrow function."""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seq import moving_baseline, peaks, thin_peaks

FRAME, HOP, RATE = 2048, 512, 11_025


def frame_signal(audio: DataFrame, size: int = FRAME, hop: int = HOP, block: int = 64) -> DataFrame:
    """Overlapping frames of each recording's samples, the last ones padded by zeros, at the time of their middle. Samples are first cut into
    blocks of some frames, so that no row carries a whole recording along with one frame."""
    n = F.greatest(F.lit(1), F.ceil((F.size("samples") - size) / hop) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda b: F.struct(b.alias("b"), n.alias("n"), F.slice("samples", b * (block * hop) + 1, F.lit((block - 1) * hop + size)).alias("s")))
    blocks = audio.select("score_id", F.inline(cut))
    pad = lambda f: F.concat(f, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(f)))
    frames = F.transform(F.sequence(F.lit(0), F.least(F.lit(block - 1), F.col("n") - 1 - F.col("b") * block)), lambda i: F.struct((F.col("b") * block + i).alias("frame_ix"), pad(F.slice("s", i * hop + 1, F.lit(size))).cast("array<double>").alias("frame")))
    return blocks.select("score_id", F.inline(frames)).select("score_id", "frame_ix", ((F.col("frame_ix") * hop + size / 2) / RATE).alias("t"), "frame")


def rms(frame: Column) -> Column:
    """T2."""
    return F.sqrt(F.aggregate(frame, F.lit(0.0), lambda s, x: s + x * x) / F.size(frame) + 1e-12)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum(frames: pd.Series) -> pd.Series:
    """Magnitudes of the windowed frame."""
    x = np.stack(frames.map(np.asarray).tolist()) if len(frames) else np.zeros((0, 2))
    return pd.Series(list(np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1)))) if len(frames) else pd.Series([], dtype=object)


def flux(frames: DataFrame, spec: str = "spectrum") -> DataFrame:
    """T4: rises of the magnitudes against the frame before (silence before the first), over the sum of magnitudes."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    before = F.coalesce(F.lag(spec).over(Window.partitionBy("score_id").orderBy("frame_ix")), F.array_repeat(F.lit(0.0), F.size(spec)))
    rises = F.zip_with(F.col(spec), F.col("_p"), lambda a, b: F.greatest(F.lit(0.0), a - b))
    return frames.withColumn("_p", before).withColumn("flux", add(rises) / (add(F.col(spec)) + 1e-8)).drop("_p")


def chroma(spec: Column, rate: int = RATE, low: float = 55.0, high: float = 5000.0) -> Column:
    """T5: root magnitudes by pitch class, with norm 1; all 0 for silence."""
    hz = lambda i: i * F.lit(rate / 2.0) / (F.size(spec) - 1)
    pc = lambda i: F.pmod(F.bround(F.lit(69) + F.log2(F.greatest(hz(i), F.lit(1.0)) / 440.0) * 12).cast("int"), F.lit(12))
    cells = F.transform(spec, lambda m, i: F.struct(pc(i).alias("p"), F.when(hz(i).between(low, high), F.sqrt(m)).otherwise(0.0).alias("w")))
    bins = F.transform(F.array(cells), lambda c: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.aggregate(F.filter(c, lambda x: x["p"] == k), F.lit(0.0), lambda s, x: s + x["w"])))[0]
    return F.transform(F.array(bins), lambda v: F.transform(v, lambda x: F.when(norm(v) > 0, x / norm(v)).otherwise(0.0)))[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def novelty(df: DataFrame, keys: Sequence[str], order: str, value: str = "flux") -> DataFrame:
    """What rises over 0.72 of the moving baseline, over its 98th percentile, 2 at most."""
    b = moving_baseline(df, keys, order, value).withColumn("_n", F.greatest(F.col(value) - F.col("baseline") * 0.72, F.lit(0.0)))
    high = b.groupBy(*keys).agg(F.percentile("_n", 0.98).alias("_h"))
    j = b.join(high, list(keys))
    return j.withColumn("novelty", F.when(F.col("_h") > 1e-8, F.least(F.lit(2.0), F.col("_n") / F.col("_h"))).otherwise(F.col("_n"))).drop("_n", "_h", "baseline")


def onsets(df: DataFrame, keys: Sequence[str], order: str = "frame_ix", gap_frames: int = 2) -> DataFrame:
    """Peaks of the novelty over max(0.16, median + 0.65 deviations), thinned to the least gap."""
    s = df.groupBy(*keys).agg(F.greatest(F.lit(0.16), F.median("novelty") + 0.65 * F.stddev_pop("novelty")).alias("_t"))
    p = peaks(df.join(s, list(keys)), keys, order, "novelty", F.col("_t"))
    return thin_peaks(p, keys, order, "novelty", gap_frames)


BLOCK = 4096  # frames that a row of a blocked series owns


def blocks(series: DataFrame, keys: Sequence[str], order: str, value: str, halo: Column, size: int = BLOCK) -> DataFrame:
    """A series (positions from 0, no gaps) as arrays: block ``block`` owns positions from ``block * size`` on and also
    holds the ``halo`` positions before, from ``first`` on. Sums over lags or combs then need no join and no row for
    each lag; a series of any length is spread over rows of one size. ``halo`` may be a column of the series."""
    to = F.least(F.floor((F.col(order) + halo) / size), F.floor((F.col("_n") - 1) / size)).cast("int")
    n = series.groupBy(*keys).agg((F.max(order) + 1).cast("long").alias("_n"))
    placed = series.join(n, list(keys)).withColumn("block", F.explode(F.sequence(F.floor(F.col(order) / size).cast("int"), to)))
    packed = placed.groupBy(*keys, "block", F.col("_n").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("i"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return packed.select(*keys, "block", "n", F.get("_s", F.lit(0))["i"].alias("first"), (F.col("block") * F.lit(size).cast("long")).alias("own"), F.transform("_s", lambda x: x["v"]).alias("values"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def lag_sums(values: pd.Series, first: pd.Series, own: pd.Series, lags: pd.Series) -> pd.Series:
    """For each lag (whole or not) the sum of the products of a block's own values with those so much earlier, linear
    between positions; none before the series begins."""

    def one(v: np.ndarray, first: int, own: int, lags: np.ndarray) -> list[float]:
        v, out = np.asarray(v, float), []
        for lag in lags:
            i = np.arange(max(own, math.ceil(lag)), first + len(v))
            at = i - lag - first
            low = np.minimum(np.floor(at).astype(int), max(len(v) - 1, 0))
            out.append(float(np.dot(v[i - first], v[low] + (at - low) * (v[np.minimum(low + 1, len(v) - 1)] - v[low]))))
        return out

    return pd.Series([one(*x) for x in zip(values, first, own, lags)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def comb_sums(values: pd.Series, first: pd.Series, own: pd.Series, n: pd.Series, lag: pd.Series, phases: pd.Series, size: pd.Series) -> pd.Series:
    """For each phase the sum of the values at phase, phase + lag, ... below n, linear between positions; the last value
    holds beyond the last position. A block adds those between its own positions and the one before them."""

    def one(v: np.ndarray, first: int, own: int, n: int, lag: float, phases: np.ndarray, size: int) -> list[float]:
        v, out = np.asarray(v, float), []
        low, high = own - 1, n if own + size >= n else own + size - 1
        for phase in phases:
            k = np.arange(max(0, math.ceil((low - phase) / lag) - 1), max(0, math.ceil((high - phase) / lag) + 1))
            at = phase + k * lag
            at = at[(at >= low) & (at < high)] - first
            i = np.minimum(np.floor(at).astype(int), len(v) - 1)
            out.append(float((v[i] + (at - i) * (v[np.minimum(i + 1, len(v) - 1)] - v[i])).sum()))
        return out

    return pd.Series([one(*x) for x in zip(values, first, own, n, lag, phases, size)], dtype=object)


def _summed(df: DataFrame, keys: Sequence[str], at: str, sums: Column) -> DataFrame:
    """Sums of blocks by lag or phase: rows (keys, at, s), of which no series has more than some thousand."""
    parts = df.select(*keys, F.inline(F.arrays_zip(F.col(at).alias("at"), sums.alias("s"))))
    return parts.groupBy(*keys, "at").agg(F.sum("s").alias("s"))


def _centred(series: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    own = series.groupBy(*keys).agg(F.avg(value).alias("_m"), (F.var_pop(value) * F.count("*") + 1e-8).alias("energy"), F.count("*").alias("n"))
    return series.join(own.select(*keys, "_m"), list(keys)).withColumn("_c", F.col(value) - F.col("_m")), own.drop("_m")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Correlation of each lag shorter than the series (order counts from 0)."""
    series, own = _centred(df, keys, value)
    b = blocks(series, keys, order, "_c", F.lit(max(lags) + 1)).withColumn("lags", F.filter(F.array(*(F.lit(float(x)) for x in lags)), lambda x: x < F.col("n")))
    sums = _summed(b, keys, "lags", lag_sums("values", "first", "own", "lags"))
    return sums.join(own, list(keys)).select(*keys, F.col("at").cast("int").alias("lag"), (F.col("s") / F.col("energy")).alias("correlation"))


def _first_best(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("at")).alias("l"), "correlation")).alias("b")).select(*keys, (-F.col("b.l")).alias("lag"), F.col("b.correlation").alias("correlation"))


def estimate_tempo(df: DataFrame, keys: Sequence[str], order: str = "frame_ix", value: str = "novelty", frame_rate: float = RATE / HOP, hints: DataFrame | None = None, steps: int = 81) -> DataFrame:
    """(keys, lag, tempo_bpm, confidence, phase_seconds) of novelty series whose order counts from 0.

    ``hints`` may give an ``expected`` tempo and say that it is ``locked``. A free tempo is that of the whole lag (55 to
    220 bpm and shorter than the series) with the best correlation, then of the best of ``steps`` lags within one of it
    and inside that range; with an expected tempo lags count by their distance from it in octaves, without one coarse
    lags under 75 bpm count 0.88. A locked tempo keeps its lag. The confidence is the correlation of the lag that is
    kept. The phase is that of the comb of the lag with the largest sum of novelty (of equal ones the last). Series too
    short for a lag have the expected tempo or 120, with no confidence and phase 0.
    """
    series, own = _centred(df, keys, value)
    hinted = own.join(hints, list(keys), "left") if hints is not None else own.withColumns({"expected": F.lit(None).cast("double"), "locked": F.lit(False)})
    expected = F.when(F.col("expected") > 0, F.col("expected").cast("double"))
    low, high = max(1, round(frame_rate * 60 / 220)), F.least(F.col("n") - 1, F.lit(round(frame_rate * 60 / 55))).cast("int")
    plan = hinted.withColumn("expected", expected).withColumn("locked", F.coalesce("locked", F.lit(False)) & F.col("expected").isNotNull()).withColumn("high", high).withColumn("fixed", F.lit(60.0 * frame_rate) / F.col("expected"))
    plan = plan.withColumn("kind", F.when(F.col("locked"), "locked").when(F.col("high") <= low, "short").otherwise("free"))
    bpm = F.lit(60.0 * frame_rate) / F.col("at")
    octaves = F.exp(-2.4 * F.abs(F.log2(bpm / F.col("expected"))))
    halo = F.when(F.col("kind") == "locked", F.ceil("fixed") + 1).when(F.col("kind") == "free", F.col("high") + 2).otherwise(1)
    cut = lambda v: blocks(series.join(plan.select(*keys, halo.alias("_h")), list(keys)), keys, order, v, F.col("_h"))
    centred = cut("_c")

    def correlations(lags: DataFrame) -> DataFrame:
        sums = _summed(centred.join(lags, list(keys)), keys, "lags", lag_sums("values", "first", "own", "lags"))
        return sums.join(plan.select(*keys, "energy", "expected"), list(keys)).withColumn("correlation", F.col("s") / F.col("energy"))

    free = plan.filter("kind = 'free'")
    coarse = correlations(free.select(*keys, F.sequence(F.lit(low), F.col("high")).cast("array<double>").alias("lags")))
    coarse = _first_best(coarse.withColumn("score", F.col("correlation") * F.coalesce(octaves, F.when(bpm < 75, 0.88).otherwise(1.0))), keys)
    ends = free.join(coarse, list(keys)).select(*keys, F.greatest(F.lit(float(low)), F.col("lag") - 1).alias("a"), F.least(F.col("high").cast("double"), F.col("lag") + 1).alias("z"))
    fine = ends.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.when(k == steps - 1, F.col("z")).otherwise(F.col("a") + k * ((F.col("z") - F.col("a")) / (steps - 1)))).alias("lags"))
    lags = fine.unionByName(plan.filter("kind = 'locked'").select(*keys, F.array("fixed").alias("lags")))
    kept = _first_best(correlations(lags).withColumn("score", F.col("correlation") * F.coalesce(octaves, F.lit(1.0))), keys)
    phase = beat_phase(cut(value), kept, keys)
    out = plan.join(kept, list(keys), "left").join(phase, list(keys), "left")
    tempo = F.when(F.col("kind") == "free", F.lit(60.0 * frame_rate) / F.col("lag")).otherwise(F.coalesce("expected", F.lit(120.0)))
    sure = F.coalesce(F.least(F.lit(0.96), F.greatest(F.lit(0.0), F.col("correlation") * 2.2)), F.lit(0.0))
    return out.select(*keys, "lag", tempo.alias("tempo_bpm"), sure.alias("confidence"), (F.coalesce("phase", F.lit(0.0)) / frame_rate).alias("phase_seconds"))


def beat_phase(blocked: DataFrame, lags: DataFrame, keys: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Phase (in positions) of the comb of each series' lag with the largest sum; of equal ones the last.
    ``blocked`` holds at least one position before its own."""
    steps = F.greatest(F.lit(16), F.bround(F.col("lag") * 8).cast("int"))
    combs = lags.select(*keys, "lag", F.transform(F.sequence(F.lit(0), steps - 1), lambda k: k * (F.col("lag") / steps)).alias("phases"))
    sums = _summed(blocked.join(combs, list(keys)), keys, "phases", comb_sums("values", "first", "own", "n", "lag", "phases", F.lit(size)))
    return sums.groupBy(*keys).agg(F.max(F.struct("s", "at")).alias("b")).select(*keys, F.col("b.at").alias("phase"))


def active_start(frames: DataFrame, keys: Sequence[str], frame_rate: float = RATE / HOP) -> DataFrame:
    """Time of the first frame whose rms is at 0.12 of the 85th percentile, and 1e-5 at least; 0 if there is none."""
    least = frames.groupBy(*keys).agg(F.greatest(F.lit(1e-5), F.percentile("rms", 0.85) * 0.12).alias("_t"))
    first = frames.join(least, list(keys)).groupBy(*keys).agg(F.min(F.when(F.col("rms") >= F.col("_t"), F.col("frame_ix"))).alias("_f"))
    return first.select(*keys, F.coalesce(F.col("_f") / frame_rate, F.lit(0.0)).alias("active_start"))


def beat_grid(scores: DataFrame) -> DataFrame:
    """Beats from tempo, phase (s), duration and active_start (s); the first one is within a period of it."""
    period = F.lit(60.0) / F.greatest(F.col("tempo_bpm"), F.lit(1.0))
    up = F.greatest(F.lit(0.0), F.floor((F.col("active_start") - F.col("phase")) / period))
    first = F.col("phase") + up * period
    low = F.greatest(F.lit(0.0), F.col("active_start") - period)
    first = first - F.greatest(F.lit(0.0), F.floor((first - low) / period)) * period
    s = scores.withColumn("_p", period).withColumn("_f", F.greatest(F.lit(0.0), first)).filter(F.col("_f") <= F.col("duration"))
    return s.select("score_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("duration") - F.col("_f")) / F.col("_p")).cast("int")), lambda i: F.round(F.col("_f") + i * F.col("_p"), 3))).alias("beat", "t"))


def segment_edges(beats: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments (segment from 0, start, end) of recordings: every fourth beat begins one if there are 8 beats or
    more, else every 2 s; the first begins at 0 if that is more than 0.2 s earlier; the last ends at the duration."""
    n = beats.groupBy(*keys).agg(F.count("*").alias("_n"))
    all_of = durations.join(n, list(keys), "left").filter("duration > 0")
    fourth = beats.filter("beat % 4 = 0").join(all_of.filter("_n >= 8"), list(keys)).select(*keys, F.col("t").cast("double").alias("start"), "duration")
    grid = all_of.filter("coalesce(_n, 0) < 8").select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("duration") / 2).cast("int") - 1), lambda k: k * 2.0)).alias("start"), "duration")
    w = Window.partitionBy(*keys).orderBy("start")
    first = fourth.groupBy(*keys).agg(F.min("start").alias("_s"), F.max("duration").alias("duration")).filter("_s > 0.2").select(*keys, F.lit(0.0).alias("start"), "duration")
    starts = fourth.unionByName(grid).unionByName(first).filter("start < duration")
    return starts.select(*keys, (F.row_number().over(w) - 1).alias("segment"), "start", F.coalesce(F.lead("start").over(w), F.col("duration").cast("double")).alias("end"))


def segment_features(frames: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``feature`` of each segment: mean chroma with norm 1, mean rms over the recording's 90th percentile (by
    0.72), mean and deviation of the novelty (by 0.85); zeros where no frame lies. Frames (t, rms, novelty, chroma) meet
    their segment in one as-of pass, and all means of a segment in one aggregate."""
    w = Window.partitionBy(*keys).orderBy("_t", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.select(*keys, F.col("start").alias("_t"), F.lit(0).alias("_frame"), F.struct("segment", "end").alias("_e"), F.lit(None).cast("struct<rms:double,novelty:double,chroma:array<double>>").alias("_x"))
    cells = frames.select(*keys, F.col("t").alias("_t"), F.lit(1).alias("_frame"), F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"), F.struct(F.col("rms").cast("double").alias("rms"), F.col("novelty").cast("double").alias("novelty"), F.col("chroma").cast("array<double>").alias("chroma")).alias("_x"))
    placed = rows.unionByName(cells).withColumn("_e", F.last("_e", ignorenulls=True).over(w)).filter("_frame = 1 and _t < _e.end")
    tone = [F.avg(F.get("_x.chroma", F.lit(i))).alias(f"_c{i}") for i in range(12)]
    means = placed.groupBy(*keys, F.col("_e.segment").alias("segment")).agg(F.avg("_x.rms").alias("_r"), F.avg("_x.novelty").alias("_a"), F.stddev_pop("_x.novelty").alias("_d"), *tone)
    scale = frames.groupBy(*keys).agg((F.percentile("rms", 0.9) + 1e-8).alias("_q"))
    c = F.array(*(F.col(f"_c{i}") for i in range(12)))
    whole = F.concat(F.transform(F.array(c), lambda v: F.transform(v, lambda x: x / (norm(v) + 1e-8)))[0], F.array(F.col("_r") / F.col("_q") * 0.72, F.col("_a") * 0.85, F.col("_d") * 0.85))
    found = means.join(scale, list(keys)).select(*keys, "segment", whole.alias("feature"))
    return edges.join(found, [*keys, "segment"], "left").withColumn("feature", F.coalesce("feature", F.array_repeat(F.lit(0.0), F.lit(15))))


def segment_novelty(df: DataFrame, keys: Sequence[str], order: str, feature: str = "feature") -> DataFrame:
    """Distance between the mean features of the two rows before and of this and the next; 0 for the first two and
    the last two rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.array(*(F.lag(feature, k).over(w) if k > 0 else F.lead(feature, -k).over(w) for k in (2, 1, -1, -2)), F.col(feature))
    d = F.zip_with(F.zip_with("_w.a", "_w.b", lambda x, y: x + y), F.zip_with("_w.c", "_w.d", lambda x, y: x + y), lambda x, y: (x - y) / 2)
    inside = F.struct(near[0].alias("a"), near[1].alias("b"), near[4].alias("c"), near[2].alias("d"), near[3].alias("e"))
    return df.withColumn("_w", inside).withColumn("segment_novelty", F.when(F.col("_w.a").isNotNull() & F.col("_w.e").isNotNull(), norm(d)).otherwise(0.0)).drop("_w")


def section_boundaries(df: DataFrame, keys: Sequence[str], segment: str = "segment", value: str = "segment_novelty", gap: int = 8, most: int = 8, widest: int = 28, q: float = 0.58) -> DataFrame:
    """Sections (start, end, in segments from 0) of a track.

    Boundaries are the start, and, in the order of their novelty, segments ``gap`` from both ends and from each other
    whose novelty is at the quantile ``q`` of the positive ones; ``most`` with the start. While there are fewer than
    ``most`` sections, the widest (of equal ones the last) is cut at its highest novelty, if it is over ``widest``. A
    track has some hundred segments, which are folded as one array.
    """
    v = F.col(value).cast("double")
    own = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(segment, v.alias("v")))), lambda x: x["v"]).alias("_v"), F.percentile(F.when(v > 0, v), q).alias("_q"))
    n = F.size("_v")
    pairs = F.transform("_v", lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    inner = F.sort_array(F.filter(pairs, lambda x: (x["i"] >= gap) & (x["i"] < n - gap) & (-x["v"] >= F.col("_q"))))
    greedy = lambda s, x: F.when((F.size(s) < most) & F.forall(s, lambda b: F.abs(b - x["i"]) >= gap), F.concat(s, F.array(x["i"]))).otherwise(s)
    chosen = F.array_sort(F.concat(F.aggregate(inner, F.array(F.lit(0)), greedy), F.array(n)))

    def split(s: Column, _: Column) -> Column:
        spans = F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda left, i: F.struct((F.get(s, i + 1) - left).alias("n"), left.alias("left"), F.get(s, i + 1).alias("right")))
        wide = F.array_max(spans)
        best = F.array_max(F.transform(F.sequence(wide["left"] + gap, wide["right"] - gap), lambda i: F.struct(F.get("_v", i).alias("v"), (-i).alias("i"))))
        return F.when((F.size(s) <= most) & (wide["n"] > widest), F.array_sort(F.concat(s, F.array(-best["i"])))).otherwise(s)

    edges = own.withColumn("_b", chosen).withColumn("_b", F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col("_b"), split))
    spans = F.transform(F.slice("_b", F.lit(1), F.size("_b") - 1), lambda left, i: F.struct(left.alias("start"), F.get("_b", i + 1).alias("end")))
    return edges.select(*keys, F.inline(spans))


def boundary_confidence(start: Column, novelty: Column, peak: Column) -> Column:
    """Confidence that a section begins at a segment of this novelty, ``peak`` being the track's greatest; that of
    the first section is the least."""
    return F.round(F.when(start == 0, 0.35).otherwise(F.least(F.lit(0.95), F.lit(0.35) + novelty / (peak + 1e-8) * 0.6)), 3)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def label_sections(sections: DataFrame, keys: Sequence[str], order: str = "start", feature: str = "chroma", least: float = 0.975) -> DataFrame:
    """Number of the first section template that a section is like (cosine), else a new one; in order."""
    t = sections.schema[order].dataType.simpleString()
    start = F.struct(F.array().cast("array<array<double>>").alias("ts"), F.array().cast(f"array<struct<o:{t},l:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hits = F.filter(F.transform(s["ts"], lambda v, i: F.when(cosine(v, x["f"]) >= least, i.cast("int"))), lambda v: v.isNotNull())
        new = F.size(hits) == 0
        l = F.when(new, F.size(s["ts"])).otherwise(F.get(hits, F.lit(0)))  # noqa: E741
        return F.struct(F.when(new, F.concat(s["ts"], F.array(x["f"]))).otherwise(s["ts"]).alias("ts"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), l.cast("int").alias("l")))).alias("out"))

    xs = sections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(feature).cast("array<double>").alias("f")))).alias("_xs"))
    return xs.select(*keys, F.inline(F.aggregate("_xs", start, step, lambda s: s["out"]))).withColumnsRenamed({"o": order, "l": "label"})


def section_name(label: Column) -> Column:
    """A to Z, then S27 and so on."""
    return F.when(label < 26, F.char(F.lit(65) + label)).otherwise(F.concat(F.lit("S"), (label + 1).cast("string")))


def align_video(points: DataFrame, keys: Sequence[str], gap: int = 8) -> DataFrame:
    """Of highlighted measures (measure_number, time_seconds) the first, those ``gap`` measures after the last
    kept, and the last."""
    item = F.struct("measure_number", F.col("time_seconds").cast("double").alias("time_seconds"))
    t = points.schema["measure_number"].dataType.simpleString()
    xs = points.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_xs"))
    start = F.struct(F.lit(None).cast(t).alias("last"), F.array().cast(f"array<struct<measure_number:{t},time_seconds:double>>").alias("out"))
    ends = lambda i: (i == 0) | (i == F.size("_xs") - 1)
    step = lambda s, x: F.when(ends(x["i"]) | (x["x"]["measure_number"] - s["last"] >= gap), F.struct(x["x"]["measure_number"].alias("last"), F.concat(s["out"], F.array(x["x"])).alias("out"))).otherwise(s)
    return xs.select(*keys, F.inline(F.aggregate(F.transform("_xs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, step, lambda s: s["out"]))).withColumn("basis", F.lit("video_highlight"))


AUTO = {"label": "自动 · ", "video_highlight": "自动 · 视频高亮", "audio_beat_grid": "自动 · 节拍网格", "end": "自动 · 结尾"}  # fixed texts that users see


def suggest_alignment(scores: DataFrame, sections: DataFrame, visual: DataFrame | None = None, every: int = 8) -> DataFrame:
    """(score_id, measure_number, time_seconds, score_position, label, confidence, basis), measures to align.

    scores: score_id, source_kind, start_measure, end_measure, measure_count, first_beat, tempo_bpm, duration; measures
    of 0 or null have their defaults, and scores of one measure have no suggestions. Scores of video and audio take
    their highlighted measures (visual: score_id, measure_number, time_seconds); where these give fewer than two, they
    stay and every ``every``-th measure and the last follow from the beats, as far as the duration goes. Labels are those
    of the nearest section start (sections: score_id, start_seconds, label), of equally near ones the first.
    """
    real = lambda name: F.expr(f"nullif({name}, 0)")
    first = F.coalesce(real("start_measure"), F.lit(1)).cast("int")
    s = scores.withColumn("_a", first).withColumn("_z", F.coalesce(real("end_measure"), real("measure_count"), F.col("_a")).cast("int")).filter("_z > _a")
    step = F.lit(240.0) / F.greatest(F.col("tempo_bpm"), F.lit(1.0))
    origin = F.coalesce(F.col("first_beat").cast("double"), F.lit(0.0))
    row = lambda m, t, sure, basis: [m.cast("int").alias("measure_number"), t.cast("double").alias("time_seconds"), F.lit(sure).alias("confidence"), F.lit(basis).alias("basis")]
    spans = s.select("score_id", "_a", "_z")
    if visual is not None:
        seen = visual.join(s.filter("source_kind = 'video_audio'").select("score_id", "_a", "_z"), "score_id").filter("measure_number between _a and _z").select("score_id", F.col("measure_number").cast("int").alias("measure_number"), "time_seconds")
        video = align_video(seen, ["score_id"], every).select("score_id", *row(F.col("measure_number"), F.col("time_seconds"), 0.88, "video_highlight"))
    else:
        video = s.select("score_id", *row(F.col("_a"), origin, 0.88, "video_highlight")).filter("false")
    kept = video.groupBy("score_id").agg(F.count("*").alias("_v"), F.max("measure_number").alias("_m"))
    open_ = s.join(kept, "score_id", "left").filter("coalesce(_v, 0) < 2").withColumn("_o", origin).withColumn("_s", step)
    steps = open_.withColumn("_k", F.explode(F.sequence("_a", "_z", F.lit(every)))).withColumn("_t", F.col("_o") + (F.col("_k") - F.col("_a")) * F.col("_s")).filter("_t <= duration")
    grid = steps.select("score_id", *row(F.col("_k"), F.col("_t"), 0.62, "audio_beat_grid"))
    last = open_.join(grid.groupBy("score_id").agg(F.max("measure_number").alias("_g")), "score_id", "left").withColumn("_l", F.coalesce("_g", "_m")).withColumn("_t", F.col("_o") + (F.col("_z") - F.col("_a")) * F.col("_s"))
    last = last.filter("_l is not null and _l <> _z and _t <= duration").select("score_id", *row(F.col("_z"), F.col("_t"), 0.58, "audio_beat_grid"))
    near = sections.groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct(F.round(F.col("start_seconds").cast("double"), 3).alias("at"), F.col("label").alias("name")))).alias("_s"))
    name = F.array_min(F.transform("_s", lambda x, i: F.struct(F.abs(x["at"] - F.col("time_seconds")).alias("d"), i.alias("i"), x["name"].alias("name"))))["name"]
    text = F.when(F.col("confidence") == 0.58, AUTO["end"]).when(name != "", F.concat(F.lit(AUTO["label"]), name)).when(F.col("basis") == "video_highlight", AUTO["video_highlight"]).otherwise(AUTO["audio_beat_grid"])
    place = F.bround((F.col("measure_number") - F.col("_a")) / (F.col("_z") - F.col("_a")), 5)
    out = video.unionByName(grid).unionByName(last).join(spans, "score_id").join(near, "score_id", "left")
    return out.select("score_id", "measure_number", F.round("time_seconds", 3).alias("time_seconds"), place.alias("score_position"), text.alias("label"), "confidence", "basis")

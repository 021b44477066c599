"""The audio chain: each rule against a plain reckoning of it, and a click track from samples to suggestions."""

import math

import duckdb
import numpy as np
import pytest

from tabspark import queries
from tabspark.operators import signal as T
from tabspark.plans import analysis

RATE = T.RATE / T.HOP


def clicks(seconds=24, every=0.5, rate=T.RATE):
    x = np.zeros(rate * seconds)
    tone = np.sin(2 * np.pi * 900 * np.arange(int(0.025 * rate)) / rate)
    for k in range(int(seconds / every)):
        a = int((0.25 + k * every) * rate)
        x[a : a + len(tone)] += tone[: len(x) - a]
    return x


def test_click_track_from_samples_to_suggestions(spark):
    x = clicks()
    audio = spark.createDataFrame([("free", x.tolist()), ("locked", x.tolist()), ("flat", [0.1] * 900)], "score_id string, samples array<double>")
    hints = spark.createDataFrame([("locked", 60.0, True), ("flat", 90.0, False)], "score_id string, expected double, locked boolean")
    scores = spark.createDataFrame([("free", "audio", 1, 20, None), ("locked", "video_audio", 5, 0, 8), ("flat", "audio", 1, 1, 1)], "score_id string, source_kind string, start_measure int, end_measure int, measure_count int")
    visual = spark.createDataFrame([("locked", m, m * 1.5) for m in (1, 5, 6, 8, 9)] + [("free", 1, 0.0)], "score_id string, measure_number int, time_seconds double")
    out = analysis.analyse_audio(audio, hints, scores, visual)
    tempo = {r.score_id: r for r in out["tempo"].collect()}
    assert abs(tempo["free"].tempo_bpm - 120) < 5 and tempo["free"].confidence > 0.3 and 0 <= tempo["free"].phase_seconds < 0.6
    assert (tempo["locked"].tempo_bpm, tempo["flat"].tempo_bpm, tempo["flat"].confidence, tempo["flat"].phase_seconds) == (60.0, 90.0, 0.0, 0.0)
    beats = [r.t for r in out["beats"].filter("score_id = 'free'").orderBy("beat").collect()]
    assert len(beats) >= 40 and max(abs(b - a - 60 / tempo["free"].tempo_bpm) for a, b in zip(beats, beats[1:])) < 0.002
    onsets = sorted(r.t for r in out["onsets"].filter("score_id = 'free'").join(out["novelty"].select("score_id", "frame_ix", "t"), ["score_id", "frame_ix"]).collect())
    assert len(onsets) >= 30 and np.mean([min(abs(o - 0.25 - k * 0.5) for k in range(48)) for o in onsets]) < 0.1
    sections = sorted((r.score_id, r.section, r.label, r.start_seconds, r.end_seconds, r.confidence) for r in out["sections"].collect())
    assert [s for s in sections if s[0] == "free"] == [("free", 0, "A", beats[0], 24.0, 0.35)]
    got = {k: [] for k in ("free", "locked", "flat")}
    for r in out["suggestions"].orderBy("measure_number").collect():
        got[r.score_id].append((r.measure_number, r.score_position, r.label, r.confidence, r.basis))
    assert got["locked"] == [(5, 0.0, "自动 · A", 0.88, "video_highlight"), (8, 1.0, "自动 · A", 0.88, "video_highlight")]
    assert got["free"] == [(1, 0.0, "自动 · A", 0.62, "audio_beat_grid"), (9, 0.42105, "自动 · A", 0.62, "audio_beat_grid")] and got["flat"] == []


def test_frames_of_known_samples(spark):
    """Times of frame middles, flux against silence at first, and chroma up to 5 kHz."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=7000)
    f = T.frame_signal(spark.createDataFrame([("s", x.tolist())], "score_id string, samples array<double>"))
    f = T.flux(f.withColumn("spectrum", T.spectrum("frame"))).withColumn("chroma", T.chroma(T.F.col("spectrum"))).orderBy("frame_ix").collect()
    padded = np.pad(x, (0, 11 * 512 + 2048 - 7000 if len(f) == 12 else (len(f) - 1) * 512 + 2048 - 7000))
    before = np.zeros(1025)
    hz = np.fft.rfftfreq(2048, 1 / T.RATE)
    use = np.flatnonzero((hz >= 55) & (hz <= 5000))
    for i, r in enumerate(f):
        m = np.abs(np.fft.rfft(padded[i * 512 : i * 512 + 2048] * np.hanning(2048)))
        assert r.t == pytest.approx((i * 512 + 1024) / T.RATE) and r.flux == pytest.approx(np.maximum(m - before, 0).sum() / (m.sum() + 1e-8), abs=1e-6)
        c = np.bincount(np.mod(np.rint(69 + 12 * np.log2(hz[use] / 440)).astype(int), 12), np.sqrt(m[use]), 12)
        assert r.chroma == pytest.approx(c / np.linalg.norm(c), abs=1e-6)
        before = m
    assert f[0].flux == pytest.approx(1.0, abs=1e-6)
    silent = T.frame_signal(spark.createDataFrame([("s", [0.0] * 2048)], "score_id string, samples array<double>")).withColumn("spectrum", T.spectrum("frame"))
    assert silent.select(T.chroma(T.F.col("spectrum")).alias("c")).first().c == [0.0] * 12


def plain_tempo(x, expected=None, locked=False):
    c = x - x.mean()
    energy, n = float(c @ c) + 1e-8, len(x)

    def corr(lag):
        i = np.arange(math.ceil(lag), n)
        return float(c[i] @ np.interp(i - lag, np.arange(n), c)) / energy

    def near(lag):
        return math.exp(-2.4 * abs(math.log2(60 * RATE / lag / expected))) if expected else 1.0

    low, high = max(1, round(RATE * 60 / 220)), min(n - 1, round(RATE * 60 / 55))
    if locked:
        lag, tempo = 60 * RATE / expected, expected
    elif high <= low:
        return expected or 120.0, 0.0, 0.0
    else:
        coarse = max(range(low, high + 1), key=lambda k: corr(k) * (near(k) if expected else 0.88 if 60 * RATE / k < 75 else 1))
        lag = max(np.linspace(max(low, coarse - 1), min(high, coarse + 1), 81), key=lambda k: corr(k) * near(k))
        tempo = 60 * RATE / lag
    phases = np.linspace(0, lag, max(16, round(lag * 8)), endpoint=False)
    phase = max((float(np.interp(np.arange(p, n, lag), np.arange(n), x).sum()), p) for p in phases)[1]
    return tempo, min(0.96, max(0.0, corr(lag) * 2.2)), phase / RATE


def test_tempo_of_series_longer_than_a_block(spark):
    rng = np.random.default_rng(5)
    series, hints = {}, []
    for k, (n, beat) in enumerate([(10_000, 11.3), (4096, 9.0), (4097, 20.7), (300, 17.2), (7, 3.0), (6, 3.0), (1, 1.0), (8192, 12.9)]):
        x = rng.random(n) * 0.4
        x[np.minimum(np.rint(np.arange(2.0, n, beat)).astype(int), n - 1)] += 1
        for kind, hint in (("free", None), ("near", (97.0, False)), ("locked", (73.5, True))):
            series[f"{k}{kind}"] = (x, hint)
            hints += [(f"{k}{kind}", *hint)] if hint else []
    df = spark.createDataFrame([(s, i, float(v)) for s, (x, _) in series.items() for i, v in enumerate(x)], "score_id string, frame_ix int, novelty double")
    got = {r.score_id: r for r in T.estimate_tempo(df, ["score_id"], hints=spark.createDataFrame(hints, "score_id string, expected double, locked boolean")).collect()}
    for s, (x, hint) in series.items():
        want = plain_tempo(x, *(hint or ()))
        assert (got[s].tempo_bpm, got[s].confidence, got[s].phase_seconds) == pytest.approx(want, abs=1e-6), s


def test_segments_by_beats_and_their_novelty(spark):
    rng = np.random.default_rng(8)
    times = np.sort(rng.random(300) * 30)
    rows = [("a", float(t), float(rng.random()), float(rng.random()), rng.random(12).tolist()) for t in times]
    beats = [0.5 + 0.75 * k for k in range(38)]
    edges = [0.0, *beats[::4], 30.0]
    df = spark.createDataFrame(rows, "score_id string, t double, rms double, novelty double, chroma array<double>")
    b = spark.createDataFrame([("a", k, t) for k, t in enumerate(beats)] + [("b", 0, 0.1)], "score_id string, beat int, t double")
    d = spark.createDataFrame([("a", 30.0), ("b", 3.5), ("c", 0.0)], "score_id string, duration double")
    cut = T.segment_edges(b, d, ["score_id"])
    assert [(r.start, r.end) for r in cut.filter("score_id = 'a'").orderBy("segment").collect()] == list(zip(edges, edges[1:]))
    assert [(r.start, r.end) for r in cut.filter("score_id = 'b'").orderBy("segment").collect()] == [(0.0, 2.0), (2.0, 3.5)]
    got = T.segment_novelty(T.segment_features(df, cut, ["score_id"]), ["score_id"], "segment").filter("score_id = 'a'").orderBy("segment").collect()
    scale, want = np.quantile([r[2] for r in rows], 0.9) + 1e-8, []
    for a, z in zip(edges, edges[1:]):
        inside = [r for r in rows if a <= r[1] < z]
        tone = np.mean([r[4] for r in inside], axis=0)
        act = [r[3] for r in inside]
        want.append(np.concatenate([tone / (np.linalg.norm(tone) + 1e-8), [np.mean([r[2] for r in inside]) / scale * 0.72, np.mean(act) * 0.85, np.std(act) * 0.85]]))
    assert all(r.feature == pytest.approx(w, abs=1e-9) for r, w in zip(got, want)) and len(got) == len(want)
    rise = [0.0] * len(want)
    for i in range(2, len(want) - 2):
        rise[i] = float(np.linalg.norm((want[i - 2] + want[i - 1]) / 2 - (want[i] + want[i + 1]) / 2))
    assert [r.segment_novelty for r in got] == pytest.approx(rise, abs=1e-9) and rise[-2:] == [0.0, 0.0]


def test_novelty_is_zero_at_both_ends_alone(spark, tmp_path):
    series = {1: [1.0, 5.0, None, 2.0, 8.0, 3.0, 9.0, 4.0, 7.0, None], 2: [1.0, 2.0, 4.0, 8.0], 3: [1.0, 2.0, 4.0, 8.0, 16.0], 4: [3.0], 5: [6.0, 1.0, 2.0, 9.0, None, 4.0, 4.0]}
    rows = [(s * 100 + i, i, s, v) for s, x in series.items() for i, v in enumerate(x)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(CAST(? AS BIGINT) * 1000000), ?, 'view', ?, '{}')", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = {}
    for s, x in series.items():
        for i in range(len(x)):
            near = x[i - 2 : i + 2] if 2 <= i < len(x) - 2 else [0.0] * 4
            want[s, s * 100 + i] = None if None in near else abs((near[0] + near[1]) / 2 - (near[2] + near[3]) / 2)
    got = {(r.score_id, r.event_id): r.segment_novelty for r in queries.t14_segment_novelty(spark, str(tmp_path)).collect()}
    told = {(s, e): v for s, e, v in con.execute(queries.ORACLE_SQL["t14_segment_novelty"]).fetchall()}
    assert got == want and told == want


def test_beats_begin_with_the_first_sound(spark):
    loud = spark.createDataFrame([("a", i, 0.0 if i < 65 else 1.0) for i in range(200)] + [("b", i, 0.0) for i in range(5)], "score_id string, frame_ix int, rms double")
    start = {r.score_id: r.active_start for r in T.active_start(loud, ["score_id"]).collect()}
    assert start == {"a": pytest.approx(65 / RATE), "b": 0.0}
    plan = spark.createDataFrame([("a", 60.0, 0.4, 9.0, start["a"])], "score_id string, tempo_bpm double, phase double, duration double, active_start double")
    assert [r.t for r in T.beat_grid(plan).orderBy("beat").collect()] == [2.4, 3.4, 4.4, 5.4, 6.4, 7.4, 8.4]


def test_one_highlight_stays_before_the_grid(spark):
    s = spark.createDataFrame([("s", "video_audio", 2, 12, None, None, 120.0, 15.0)], "score_id string, source_kind string, start_measure int, end_measure int, measure_count int, first_beat double, tempo_bpm double, duration double")
    none = spark.createDataFrame([], "score_id string, start_seconds double, label string")
    seen = spark.createDataFrame([("s", 4, 3.21), ("s", 40, 9.0)], "score_id string, measure_number int, time_seconds double")
    got = sorted((r.confidence, r.measure_number, r.time_seconds, r.score_position, r.label) for r in T.suggest_alignment(s, none, seen).collect())
    assert got == [(0.62, 2, 0.0, 0.0, "自动 · 节拍网格"), (0.62, 10, 16.0, 0.8, "自动 · 节拍网格")][:1] + [(0.88, 4, 3.21, 0.2, "自动 · 视频高亮")]
    longer = s.withColumn("duration", T.F.lit(60.0))
    assert [(r.measure_number, r.confidence, r.label) for r in T.suggest_alignment(longer, none, seen).orderBy("confidence", "measure_number").collect()] == [(12, 0.58, "自动 · 结尾"), (2, 0.62, "自动 · 节拍网格"), (10, 0.62, "自动 · 节拍网格"), (4, 0.88, "自动 · 视频高亮")]

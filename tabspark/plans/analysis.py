"""Longer plans put together from operators: recognition, alignment and scoring of a whole library of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggs as A, joins as J, seq as W, signal as T
from ..sources.scratch import scratch, written


def recognise_measures(labels: DataFrame, candidates: DataFrame, capacity: Column) -> dict[str, DataFrame]:
    """From frame labels and measure candidates to one measure for each number of a score.

    labels: score_id, frame_id, t, index, value, conf. candidates: score_id, frame_id, index, signature, quality, ord.
    Starts are smoothed over each score's frames, give candidates their numbers, and repeated numbers vote.
    """
    starts = W.smooth_starts(labels)
    numbered = candidates.join(starts.select("score_id", "frame_id", "start_measure"), ["score_id", "frame_id"]).withColumn("number", F.col("start_measure") + F.col("index"))
    placed = numbered.filter("number is not null")
    measures = A.vote_measures(placed, ["score_id", "number"])
    return {"starts": starts, "measures": measures, "missing": A.missing_measures(measures, ["score_id"]), "unresolved": numbered.filter("number is null")}


def detect_sections(frames: DataFrame, beats: DataFrame, durations: DataFrame) -> DataFrame:
    """(score_id, section, label, start_seconds, end_seconds, confidence) from frames (t, rms, novelty, chroma), beats
    (beat, t) and durations."""
    keys = ["score_id"]
    segments = T.segment_novelty(T.segment_features(frames, T.segment_edges(beats, durations, keys), keys), keys, "segment")
    spans = T.section_boundaries(segments, keys).withColumnsRenamed({"start": "section", "end": "_z"})
    times = segments.select("score_id", "segment", F.col("start").alias("_at"), F.col("end").alias("_to"), "segment_novelty", "feature")
    mean = F.array(*(F.avg(F.get("feature", F.lit(i))) for i in range(15)))
    first = F.min(F.struct("segment", "_at", "segment_novelty"))
    inside = times.join(spans, keys).filter("segment >= section and segment < _z").groupBy("score_id", "section").agg(mean.alias("feature"), first.alias("_f"), F.max("_to").alias("_to"))
    named = T.label_sections(inside, keys, "section", "feature")
    peak = segments.groupBy("score_id").agg(F.max("segment_novelty").alias("_peak"))
    out = inside.join(named, ["score_id", "section"]).join(peak, keys)
    return out.select("score_id", "section", T.section_name(F.col("label")).alias("label"), F.round("_f._at", 3).alias("start_seconds"), F.round("_to", 3).alias("end_seconds"), T.boundary_confidence(F.col("section"), F.col("_f.segment_novelty"), F.col("_peak")).alias("confidence"))


def analyse_audio(audio: DataFrame, hints: DataFrame | None = None, scores: DataFrame | None = None, visual: DataFrame | None = None) -> dict[str, DataFrame]:
    """Novelty, onsets, tempo, beats and sections of recordings (score_id, samples), and, with ``scores`` (score_id,
    source_kind, start_measure, end_measure, measure_count), suggestions of how measures align. What later steps read
    again is written to a scratch folder, so each step runs once."""
    folder = scratch(audio.sparkSession)
    spectra = T.frame_signal(audio).withColumn("spectrum", T.spectrum("frame")).withColumn("rms", T.rms(F.col("frame"))).drop("frame")
    features = T.flux(spectra).select("score_id", "frame_ix", "t", "flux", "rms", T.chroma(F.col("spectrum")).alias("chroma"))
    novelty = written(T.novelty(written(features, folder, "features"), ["score_id"], "frame_ix"), folder, "novelty")
    tempo = written(T.estimate_tempo(novelty, ["score_id"], hints=hints), folder, "tempo")
    durations = audio.select("score_id", (F.size("samples") / T.RATE).alias("duration"))
    plan = tempo.select("score_id", "tempo_bpm", F.col("phase_seconds").alias("phase")).join(durations, "score_id").join(T.active_start(novelty, ["score_id"]), "score_id")
    beats = written(T.beat_grid(plan), folder, "beats")
    sections = written(detect_sections(novelty, beats, durations), folder, "sections")
    out = {"novelty": novelty, "onsets": T.onsets(novelty, ["score_id"]), "tempo": tempo, "beats": beats, "sections": sections}
    if scores is not None:
        first = beats.groupBy("score_id").agg(F.min("t").alias("first_beat"))
        whole = scores.join(plan.select("score_id", "tempo_bpm", "duration"), "score_id").join(first, "score_id", "left")
        out["suggestions"] = T.suggest_alignment(whole, sections, visual)
    return out


def score_recognition(pred: DataFrame, truth: DataFrame, tolerance: float = 0.26) -> DataFrame:
    """Precision, recall and F1 of chord events (score_id, number, notes, onset, duration, ord) and the share of
    matched ones whose duration is right."""
    keys = ["score_id", "number", "notes"]
    m = J.match_events(pred, truth, keys, tolerance=tolerance)
    d = m.join(pred.select(*keys, F.col("ord").alias("pred_ord"), F.col("duration").alias("pd")), [*keys, "pred_ord"]).join(truth.select(*keys, F.col("ord").alias("truth_ord"), F.col("duration").alias("td")), [*keys, "truth_ord"])
    hit = d.agg(F.count("*").alias("tp"), F.coalesce(F.sum(F.when(F.abs(F.col("pd") - F.col("td")) <= 0.01, 1).otherwise(0)), F.lit(0)).alias("right"))
    n = pred.agg(F.count("*").alias("pred")).crossJoin(truth.agg(F.count("*").alias("truth"))).crossJoin(hit)  # one row each
    return n.select("tp", "pred", "truth", *A.prf(F.col("tp"), F.col("pred"), F.col("truth")), (F.col("right") / F.greatest(F.lit(1), F.col("tp"))).alias("duration_accuracy"))

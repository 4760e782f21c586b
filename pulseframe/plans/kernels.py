"""Queries over the numerical kernels and pipelines; filters, spectra and text have an oracle of their own, NumPy tests hold the rest."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dsp
from ..operators import _sql, longrun, matching, percentiles, ranges, samples, spectral
from ..runtime import shared
from ..sources import files, signals, waves
from ..streaming import edge
from . import oracles, pipelines


def _signal(text: str):
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: signals.table(spark, sf_dir, t) for t in ("events", "lineitem", "nation") if "{" + t + "}" in text}
        return spark.sql(_sql.render(text, "spark"), **tables)

    return load


SYNTH, EVENTS, LINEITEM, GAPS = _signal(signals.SYNTH), _signal(signals.EVENTS), _signal(signals.LINEITEM), _signal(signals.GAPS)
SPLIT = _signal(signals.EVENTS_SPLIT)
#: The closed-form recordings with some noise, over whose floor a mains tone stands and the beats' own overtones don't.
NOISY_TEXT = f"SELECT recording_id, idx, v + 0.05 * {signals.NOISE} AS v FROM ({signals.SYNTH}) AS ny"
NOISY = _signal(NOISY_TEXT)
#: Samples of a chunk of the registered filters: recordings of the test tables have several.
CHUNK = 512

#: Height, distance and prominence of the registered peak scan.
PEAK_RULE = (20.0, 6, 10.0)


def _long(kernel, sos, name: str):
    """A filter within recordings in parallel."""
    return lambda spark, sf_dir: kernel(SPLIT(spark, sf_dir), sos, CHUNK).select("recording_id", "idx", F.round("v", 3).alias(name))


#: Every seventh sample as a point; annotations that begin at every 25th and are 1 to 1,500 samples long.
POINTS = f"SELECT recording_id, idx, v FROM ({signals.EVENTS_SPLIT}) AS px WHERE idx % 7 = 0"
NOTES = f"SELECT recording_id, idx AS lo, idx + idx * 37 % 1500 AS hi, CAST(idx / 25 AS BIGINT) AS note FROM ({signals.EVENTS_SPLIT}) AS nx WHERE idx % 25 = 0"
INSIDE = "FROM ({p}) AS p LEFT JOIN ({n}) AS n ON p.recording_id = n.recording_id AND p.idx BETWEEN n.lo AND n.hi"


def _ranges(first: bool):
    """Points with the annotations that hold them: with the first, or how many and how far they reach."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        met = ranges.join(_signal(POINTS)(spark, sf_dir), _signal(NOTES)(spark, sf_dir), ["recording_id"], "idx", "lo", "hi", "left", first)
        if first:
            return met.select("recording_id", "idx", "lo", "hi", "note")
        return met.groupBy("recording_id", "idx").agg(F.count("note").alias("notes"), F.min("lo").alias("least"), F.max("hi").alias("most"))

    return run


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four detectors against the true beats."""
    found = pipelines.beats(SYNTH(spark, sf_dir), 360.0, ("adaptive", "pan_tompkins", "hamilton", "christov"))
    truth = SYNTH(spark, sf_dir).filter("beat * period < 3000").select("recording_id", (F.col("beat") * F.col("period")).alias("idx")).distinct()
    return _sql.run(matching.match_metrics(360.0, 0.15), d=found, r=truth)


#: Readings of spectra at the length that each is defined for.
READINGS = {"muscle_band": (spectral.MUSCLE_BAND, 512), "drift_band": (spectral.DRIFT_BAND, 256), "mains": (spectral.MAINS, 2048)}


def _reading(text: str, nperseg: int):
    return lambda spark, sf_dir: _sql.run(text, f=pipelines.spectra(EVENTS(spark, sf_dir), 360.0, nperseg))


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_text(files.as_text(SYNTH(spark, sf_dir)))


def wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as files of 16-bit samples to the shared folder, and read again by stretches."""
    folder = f"{shared(spark)}/waves-{uuid.uuid4().hex}"
    waves.write_wfdb(SYNTH(spark, sf_dir), folder, 360.0, 1000.0)
    return waves.read(spark, folder, samples=1000).select(F.regexp_extract("recording_id", "[^/]+$", 0).alias("recording_id"), "channel", "channel_name", "idx", F.round("t", 6).alias("t"), F.round("v", 3).alias("v"), "message")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.infer_rate(text_scan(spark, sf_dir))


def _times(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in ("start", "end") else F.round(c, 3).alias(c) if c == "total" else c for c in df.columns])


def queries() -> dict:
    return {
        "welch_psd": lambda s, d: pipelines.spectra(EVENTS(s, d)).select("recording_id", "k", F.round("freq", 6).alias("freq"), F.round("p", 4).alias("p")),
        **{name: _reading(*rule) for name, rule in READINGS.items()},
        "welch_long": lambda s, d: spectral.spread(SPLIT(s, d)).select("recording_id", "k", F.round("freq", 6).alias("freq"), F.round("p", 4).alias("p")),
        "mains_tones": lambda s, d: _sql.run(spectral.MAINS, f=spectral.spread(NOISY(s, d), 360.0, 2048)),
        "percentiles_exact": lambda s, d: percentiles.exact(signals.table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], few=64).select("l_returnflag", *(F.round(F.col("percentiles")[i], 6).alias(n) for i, n in enumerate(("p05", "p50", "p95")))),
        "interval_first": _ranges(True),
        "interval_join": _ranges(False),
        "dual_path": lambda s, d: pipelines.waves(SYNTH(s, d)),
        "bandpass_zero_phase": lambda s, d: pipelines.waves(SYNTH(s, d)).select("recording_id", "idx", F.round("qrs", 5).alias("qrs")),
        "notch": lambda s, d: pipelines.waves(SYNTH(s, d)).select("recording_id", "idx", F.round("notched", 5).alias("notched")),
        "filter_long": _long(longrun.zero_phase, dsp.butter(4, *DEFAULT.qrs_band, 360.0), "qrs"),
        "notch_long": _long(longrun.zero_phase, dsp.notch(50.0, DEFAULT.notch_q, 360.0), "notched"),
        "causal_long": _long(longrun.causal, dsp.butter(2, *DEFAULT.morph_band, 360.0), "causal"),
        "r_peaks": lambda s, d: pipelines.beats(SYNTH(s, d)),
        "r_peaks_chunked": lambda s, d: pipelines.beats_chunked(EVENTS(s, d), 360.0, 2.0, 0.5),
        "peak_details": lambda s, d: pipelines.peak_details(SYNTH(s, d)),
        "ppg_peaks": lambda s, d: pipelines.beats(SYNTH(s, d), 360.0, ("pulse",)),
        "find_peaks": lambda s, d: pipelines.local_peaks(EVENTS(s, d), *PEAK_RULE),
        "detector_compare": compare,
        "ecg_pipeline": lambda s, d: pipelines.process(SYNTH(s, d)),
        "ppg_pipeline": lambda s, d: pipelines.process(SYNTH(s, d), 360.0, "ppg"),
        "emg_pipeline": lambda s, d: pipelines.process(GAPS(s, d), 360.0, "emg"),
        "bulk_pipeline": lambda s, d: pipelines.process(LINEITEM(s, d)),
        "csv_signal_scan": text_scan,
        "wave_files": wave_files,
        "fs_inference": rates,
        "edge_chunks": lambda s, d: edge.batch(SYNTH(s, d), 360.0),
        "perturbation_lab": lambda s, d: pipelines.perturbation_lab(SYNTH(s, d)),
        "event_windows": lambda s, d: _times(edge.windows(signals.table(s, d, "events"), "1 hour")),
        "event_windows_hopping": lambda s, d: _times(edge.windows(signals.table(s, d, "events"), "1 hour", "15 minutes")),
        "event_sessions": lambda s, d: _times(edge.sessions(signals.table(s, d, "events"), "30 minutes")),
        "benchmark_report": lambda s, d: files.benchmark_report(pipelines.process(SYNTH(s, d), metrics=True)),
        "runtime_metrics": lambda s, d: pipelines.process(SYNTH(s, d), metrics=True).select("recording_id", "n_samples", "processing_s", "samples_per_s", "realtime_ratio"),
        "text_report": lambda s, d: files.report(pipelines.process(SYNTH(s, d))),
    }


def oracle_sql() -> dict[str, str]:
    duck = lambda text: re.sub(r"\{(\w+)\}", r"\1", _sql.render(text, "duckdb"))
    synth, events = duck(signals.SYNTH), duck(signals.EVENTS)
    flat = oracles.detrended(synth, samples.odd(0.6, 360.0))
    return {
        "welch_psd": oracles.welch(events, 360.0, 256),
        **{name: _sql.oracle(text, f=oracles.welch(events, 360.0, n, (12, 12))) for name, (text, n) in READINGS.items()},
        "interval_first": f"SELECT p.recording_id, p.idx, n.lo, n.hi, n.note {INSIDE} QUALIFY row_number() OVER (PARTITION BY p.recording_id, p.idx ORDER BY n.lo, n.hi) = 1".replace("{p}", duck(POINTS)).replace("{n}", duck(NOTES)),
        "interval_join": f"SELECT p.recording_id, p.idx, count(n.note) AS notes, min(n.lo) AS least, max(n.hi) AS most {INSIDE} GROUP BY p.recording_id, p.idx".replace("{p}", duck(POINTS)).replace("{n}", duck(NOTES)),
        "welch_long": oracles.welch(events, 360.0, 256),
        "mains_tones": _sql.oracle(spectral.MAINS, f=oracles.welch(duck(NOISY_TEXT), 360.0, 2048, (12, 20))),
        "percentiles_exact": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))) + " FROM lineitem GROUP BY l_returnflag",
        "notch": oracles.zero_phase(synth, dsp.notch(50.0, DEFAULT.notch_q, 360.0), "notched"),
        "bandpass_zero_phase": oracles.zero_phase(flat, dsp.butter(4, *DEFAULT.qrs_band, 360.0), "qrs"),
        "filter_long": oracles.zero_phase(events, dsp.butter(4, *DEFAULT.qrs_band, 360.0), "qrs", 3),
        "notch_long": oracles.zero_phase(events, dsp.notch(50.0, DEFAULT.notch_q, 360.0), "notched", 3),
        "causal_long": oracles.causal(events, dsp.butter(2, *DEFAULT.morph_band, 360.0), "causal", 3),
        "find_peaks": oracles.peaks(events, PEAK_RULE[0], PEAK_RULE[1], repr(PEAK_RULE[2])),
        "ppg_peaks": f"SELECT recording_id, 'pulse' AS method, idx FROM ({oracles.peaks(oracles.zero_phase(flat, dsp.butter(4, *DEFAULT.qrs_band, 360.0), 'v', None), distance=int(60 / 220 * 360.0), prominence='0.3 * stddev_pop(v)')})",
        "event_windows": oracles.event_windows("1 hour", "1 hour", 1),
        "event_windows_hopping": oracles.event_windows("1 hour", "15 minutes", 4),
        "event_sessions": oracles.event_sessions("30 minutes"),
        "wave_files": f"SELECT recording_id, CAST(0 AS INTEGER) AS channel, 'ecg' AS channel_name, idx, round(idx / 360.0, 6) AS t, round(v, 3) AS v, CAST(NULL AS VARCHAR) AS message FROM ({synth})",
        "csv_signal_scan": oracles.text_scan(synth, 360.0),
        "fs_inference": oracles.rates(synth, 360.0),
    }

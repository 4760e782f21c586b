"""Signal files: delimited text, NumPy arrays, and WFDB records; and the text report.

Files are read by Spark's own readers (whole texts, binary files), so any store
that Spark reaches will do; a bad row is dropped and a bad file is a row that
says so.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: Tokens that stand for a missing sample, and headers of a time column.
MISSING = ("", "nan", "NaN", "NA", "na")
TIME_NAMES = ("time", "t", "seconds", "timestamp", "sample")
SIGNAL_KEYS, RATE_KEYS = ("ecg", "signal", "ecg_signal", "data"), ("fs", "sampling_rate", "Fs", "SR")
FACTS = "recording_id string, channel int, channel_name string, idx long, t double, v double, message string"


def as_text(signal: DataFrame, fs: float = 360.0) -> DataFrame:
    """Recordings as ``time,ecg`` texts, one row each."""
    line = F.concat_ws(",", F.format_string("%.6f", F.col("idx") / fs), F.coalesce(F.format_string("%.6f", F.col("v")), F.lit("nan")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("x")))), lambda e: e["x"]), "\n")
    return signal.groupBy("recording_id").agg(body.alias("body")).select("recording_id", F.concat(F.lit("time,ecg\n"), "body").alias("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as one text."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("recording_id"), F.col("value").alias("text"))


def parse_text(texts: DataFrame) -> DataFrame:
    """``recording_id, channel, channel_name, idx, t, v`` of delimited texts, natively.

    The delimiter is the first of comma, tab, blank and semicolon that stands in
    the first line; that line is a header if its first token is no number; blank
    lines and comments go; a row with a bad token goes.  Column 0 is the time if
    there are more columns, it rises strictly from 0 or above, and its header
    says so or it ends below a million.
    """
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    first = F.get(lines, F.lit(0))
    cut = F.when(F.contains(first, F.lit(",")), ",").when(F.contains(first, F.lit("\t")), "\t").when(F.contains(first, F.lit(" ")), " ").otherwise(";")
    df = texts.select("recording_id", lines.alias("lines"), first.alias("first"), cut.alias("cut"))
    head = F.split("first", F.col("cut"))
    df = df.withColumn("named", F.expr("try_cast(trim(split(first, cut)[0]) AS double)").isNull())
    df = df.withColumn("names", F.when(F.col("named"), F.transform(head, lambda x: F.trim(x))))
    rows = df.select("recording_id", "cut", "names", F.posexplode(F.when(F.col("named"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))).alias("line_no", "line"))
    rows = rows.filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    tokens = F.transform(F.split("line", F.col("cut")), lambda x: F.trim(x))
    rows = rows.withColumn("tokens", tokens)
    rows = rows.withColumn("values", F.expr("transform(tokens, x -> try_cast(nullif(x, '') AS double))"))
    bad = F.expr(f"exists(tokens, x -> try_cast(nullif(x, '') AS double) IS NULL AND x NOT IN {MISSING})")
    rows = rows.filter(~bad)
    order = Window.partitionBy("recording_id").orderBy("line_no")
    rows = rows.withColumn("idx", F.row_number().over(order).cast("long") - 1).withColumn("c0", F.get("values", F.lit(0))).withColumn("step", F.col("c0") - F.lag("c0").over(order))
    facts = rows.groupBy("recording_id").agg(F.min("step").alias("least"), F.min_by("c0", "idx").alias("from"), F.max_by("c0", "idx").alias("to"), F.min(F.size("values")).alias("width"), F.first("names").alias("names0"), F.count(F.lit(1)).alias("n"), F.count("c0").alias("n0"))
    timed = (F.col("width") >= 2) & (F.col("n0") == F.col("n")) & (F.col("least") > 0) & (F.col("from") >= 0) & (F.lower(F.get("names0", F.lit(0))).isin(*TIME_NAMES) | (F.col("to") < 1e6))
    facts = facts.select("recording_id", F.coalesce(timed, F.lit(False)).alias("timed"))
    out = rows.join(facts, "recording_id").select("recording_id", "names", "timed", "idx", "c0", F.posexplode("values").alias("column", "v")).filter(~F.col("timed") | (F.col("column") > 0))
    channel = F.col("column") - F.col("timed").cast("int")
    clean = F.when(~(F.isnan("v") | (F.abs("v") == float("inf"))), F.col("v"))
    return out.select("recording_id", channel.alias("channel"), F.coalesce(F.get("names", F.col("column")), F.concat(F.lit("Ch"), channel.cast("string"))).alias("channel_name"), "idx", F.when(F.col("timed"), F.col("c0")).alias("t"), clean.alias("v"))


def infer_rate(signal: DataFrame, override: float | None = None, default: float = 360.0) -> DataFrame:
    """Sampling rate of each recording: given, or from the median time step, or the default."""
    order = Window.partitionBy("recording_id", "channel").orderBy("idx")
    steps = signal.withColumn("step", F.col("t") - F.lag("t").over(order)).groupBy("recording_id").agg(F.percentile("step", F.lit(0.5)).alias("step"), F.max("idx").alias("last"))
    found = F.round(F.try_divide(F.lit(1.0), F.col("step")), 2)
    fs = F.coalesce(F.lit(override).cast("double"), found, F.lit(default))
    warning = F.when(F.col("step").isNull() & F.lit(override is None), f"sampling rate unknown, {default:.0f} Hz assumed")
    return steps.select("recording_id", fs.alias("fs"), ((F.col("last") + 1) / fs).alias("duration_s"), warning.alias("warning"))


def select_channel(signal: DataFrame, channel: int) -> DataFrame:
    """The wanted channel, or the last there is."""
    if channel < 0:
        raise ValueError("channel must not be negative")
    most = signal.groupBy("recording_id").agg(F.max("channel").alias("most"))
    return signal.join(most, "recording_id").filter(F.col("channel") == F.least(F.lit(channel), F.col("most"))).drop("most")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` and ``.npz`` files: 1-D, or 2-D with a channel per column."""
    ship(spark)

    def load(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield _array_rows(name, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, FACTS)


def _array_rows(name: str, content: bytes) -> pd.DataFrame:
    try:
        got, fs = np.load(io.BytesIO(content), allow_pickle=False), None
        if isinstance(got, np.lib.npyio.NpzFile):
            key = next((k for k in SIGNAL_KEYS if k in got.files), got.files[0])
            rate = next((k for k in RATE_KEYS if k in got.files), None)
            fs, got = (float(np.ravel(got[rate])[0]) if rate else None), got[key]
        if got.ndim not in (1, 2):
            raise ValueError(f"{got.ndim} dimensions; 1 or 2 are understood")
        x = got.astype(float).reshape(len(got), -1)
    except Exception as e:  # one unreadable file must not end the job
        return pd.DataFrame({"recording_id": [name], "channel": [None], "channel_name": [None], "idx": [None], "t": [None], "v": [None], "message": [str(e)]})
    n, c = x.shape
    v = np.where(np.isfinite(x), x, np.nan).T.ravel()
    idx = np.tile(np.arange(n), c)
    return pd.DataFrame({"recording_id": name, "channel": np.repeat(np.arange(c), n), "channel_name": [f"Ch{k}" for k in np.repeat(np.arange(c), n)], "idx": idx, "t": idx / fs if fs else None, "v": pd.Series(v).where(np.isfinite(v), None), "message": None})


def read_wfdb(spark: SparkSession, path: str) -> DataFrame:
    """WFDB records: ``.hea`` headers joined with their ``.dat`` samples (formats 16 and 212), in physical units."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_replace("path", r"\.(hea|dat)$", "")
    heads = raw.filter(F.col("path").endswith(".hea")).select(stem.alias("recording_id"), F.decode("content", F.lit("UTF-8")).alias("head"))
    data = raw.filter(F.col("path").endswith(".dat")).select(stem.alias("recording_id"), "content")

    def load(batches):
        for pdf in batches:
            for name, head, content in zip(pdf["recording_id"], pdf["head"], pdf["content"], strict=True):
                yield decode_wfdb(name, head, content)

    return heads.join(data, "recording_id").mapInPandas(load, FACTS)


def decode_wfdb(name: str, head: str, content: bytes) -> pd.DataFrame:
    lines = [x for x in head.splitlines() if x.strip() and not x.startswith("#")]
    top = lines[0].split()
    count, fs = int(top[1]), float(re.match(r"[\d.]+", top[2])[0]) if len(top) > 2 else 250.0
    specs = [x.split() for x in lines[1 : 1 + count]]
    kind = re.match(r"\d+", specs[0][1])[0]
    if kind == "16":
        flat = np.frombuffer(content, "<i2").astype(float)
    elif kind == "212":
        b = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).astype(int).reshape(-1, 3)
        flat = np.stack([b[:, 0] | ((b[:, 1] & 0x0F) << 8), b[:, 2] | ((b[:, 1] & 0xF0) << 4)], 1).ravel()
        flat = np.where(flat > 2047, flat - 4096, flat).astype(float)
    else:
        return pd.DataFrame({"recording_id": [name], "channel": [None], "channel_name": [None], "idx": [None], "t": [None], "v": [None], "message": [f"format {kind} is not understood"]})
    x = flat[: len(flat) // count * count].reshape(-1, count)
    parts = []
    for k, spec in enumerate(specs):
        m = re.match(r"([-\d.eE+]+)(?:\(([-\d]+)\))?", spec[2]) if len(spec) > 2 else None
        gain = float(m[1]) if m and float(m[1]) else 200.0
        zero = int(m[2]) if m and m[2] else int(spec[4]) if len(spec) > 4 else 0
        parts.append(pd.DataFrame({"recording_id": name, "channel": k, "channel_name": " ".join(spec[8:]) or f"Ch{k}", "idx": np.arange(len(x)), "t": np.arange(len(x)) / fs, "v": (x[:, k] - zero) / gain, "message": None}))
    return pd.concat(parts)


#: Fixed values of the WFDB annotation format: the symbol of every beat or event code.
ANNOTATION_SYMBOLS = {1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D", 22: '"', 23: "=", 24: "p", 25: "B", 26: "^", 27: "t", 28: "+", 29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(", 40: ")", 41: "r"}
ANNOTATIONS = "recording_id string, idx long, symbol string, subtype int, channel int, number int, note string, message string"


def read_annotations(spark: SparkSession, path: str, suffix: str = "atr") -> DataFrame:
    """Annotations of WFDB records, a row each; ``recording_id`` is that of ``read_wfdb``. A file that breaks off gives what it has and a row that says so."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(f".{suffix}"))
    named = raw.select(F.regexp_replace("path", rf"\.{suffix}$", "").alias("recording_id"), "content")

    def load(batches):
        for pdf in batches:
            for name, content in zip(pdf["recording_id"], pdf["content"], strict=True):
                yield decode_annotations(name, content)

    return named.mapInPandas(load, ANNOTATIONS)


def decode_annotations(name: str, content: bytes) -> pd.DataFrame:
    """Words of 16 bits: six of code and ten of time since the annotation before; codes from 59 on extend their neighbour (a long step ahead of it, fields and a note behind it). Channel and number stay until they are set again."""
    words, rows, message = np.frombuffer(content[: len(content) // 2 * 2], "<u2").tolist(), [], "file breaks off"
    time, channel, number, at = 0, 0, 0, 0
    signed = lambda x: x - 1024 if x >= 512 else x
    while at < len(words):
        code, value = words[at] >> 10, words[at] & 0x3FF
        at += 1
        if code == 0 and value == 0:
            message = None
            break
        if code == 59:  # the step is a long one: its high half first
            if at + 2 > len(words):
                break
            step = words[at] << 16 | words[at + 1]
            time += step - (1 << 32) if step >= 1 << 31 else step
            at += 2
        elif code == 63:
            if at * 2 + value > len(content):
                break
            if rows:
                rows[-1]["note"] = content[2 * at : 2 * at + value].rstrip(b"\0").decode("latin-1")
            at += (value + 1) // 2
        elif code in (60, 61, 62):
            number, channel = (signed(value) if code == 60 else number), (value if code == 62 else channel)
            if rows:
                rows[-1] |= {60: {"number": number}, 61: {"subtype": signed(value)}, 62: {"channel": channel}}[code]
        else:
            time += value
            rows.append({"recording_id": name, "idx": time, "symbol": ANNOTATION_SYMBOLS.get(code), "subtype": 0, "channel": channel, "number": number, "note": None, "message": None})
    if message:
        rows.append({"recording_id": name, "message": message})
    columns = [c.split()[0] for c in ANNOTATIONS.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("idx", "subtype", "channel", "number")})


def read_signal(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By suffix: text, ``.npy``/``.npz``, ``.dat``/``.hea``; anything else is tried as text."""
    suffix = (kind or path.rsplit(".", 1)[-1]).lower()
    if suffix in ("npy", "npz"):
        return read_arrays(spark, path)
    if suffix in ("dat", "hea", "wfdb"):
        return read_wfdb(spark, path)
    return parse_text(read_text(spark, path))


def report(results: DataFrame) -> DataFrame:
    """A plain-text report per recording, natively; ``df.write.text`` is its sink."""
    num = lambda c, unit: F.when(F.col(c).isNotNull(), F.format_string(f"%.1f {unit}", F.col(c))).otherwise("unavailable")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    lines = F.array(
        line("Recording", F.col("recording_id")), line("Modality", F.upper("modality")), line("Duration", num("duration_s", "s")), line("Signal quality", F.coalesce("signal_quality", F.lit("unavailable"))),
        line("Noise", F.coalesce("noise_type", F.lit("unavailable"))), line("Heart rate", num("heart_rate_bpm", "bpm")), line("Beats", F.col("n_beats").cast("string")), line("Rhythm", F.coalesce("rhythm_label", F.lit("unavailable"))),
        line("SNR gain", num("snr_improvement_db", "dB")), line("Pulse rate", num("pulse_rate_bpm", "bpm")), line("Warnings", F.coalesce(F.nullif(F.array_join("warnings", "; "), F.lit("")), F.lit("none"))),
    )
    return results.select("recording_id", F.array_join(lines, "\n").alias("value"))


def benchmark_report(results: DataFrame) -> DataFrame:
    """A plain-text report of a timed run (``process(..., metrics=True)``) per recording: quality, what it took, signal and alert figures."""
    known = lambda c, form: F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))).otherwise("unavailable")
    fact = lambda label, value: F.concat(F.rpad(F.lit(f"  {label}"), 28, " "), F.lit(": "), value)
    head = lambda title: F.lit(title)
    pace = F.when(F.col("realtime_ratio") < 1, "faster than real time").otherwise("slower than real time")
    lines = F.array(
        fact("recording", F.col("recording_id")), fact("duration", known("duration_s", "%.1f s")), fact("sampling rate", known("fs", "%.0f Hz")),
        head("A. Quality"), fact("signal", F.coalesce("signal_quality", F.lit("unavailable"))), fact("beats", F.col("n_beats").cast("string")), fact("rhythm", F.coalesce("rhythm_label", F.lit("unavailable"))),
        head("B. Runtime"), fact("processing time", known("processing_s", "%.4f s")), fact("samples per second", known("samples_per_s", "%.0f")), fact("real-time ratio", known("realtime_ratio", "%.4f")), fact("pace", pace),
        head("C. Signal"), fact("SNR before", known("snr_proxy_before_db", "%.1f dB")), fact("SNR after", known("snr_proxy_after_db", "%.1f dB")), fact("muscle noise", F.coalesce("emg_severity", F.lit("unavailable"))),
        head("D. Alerts"), fact("possible VT", F.coalesce(F.col("possible_vt").cast("string"), F.lit("unavailable"))), fact("possible VF", F.coalesce(F.col("possible_vf").cast("string"), F.lit("unavailable"))), fact("latency", known("detection_latency_s", "%.2f s")),
    )
    return results.select("recording_id", F.array_join(lines, "\n").alias("value"))

"""Table functions for SQL: ``SELECT * FROM detect_peaks(array, fs)`` and ``welch_psd(array, fs, nperseg)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..runtime import ship
from . import dsp


def register(spark: SparkSession) -> None:
    ship(spark)

    @udtf(returnType="idx: bigint, t_s: double, v: double")
    class DetectPeaks:
        def eval(self, v: list, fs: float):
            x = dsp.fill_gaps(np.array(v, float))
            y = dsp.bandpass(x - dsp.baseline(x, fs), (0.5, 45.0), 4, fs)
            for p in dsp.detect_beats(y, fs).tolist():
                yield p, p / fs, float(x[p])

    @udtf(returnType="freq: double, p: double")
    class WelchPsd:
        def eval(self, v: list, fs: float, nperseg: int):
            yield from zip(*(a.tolist() for a in dsp.welch(dsp.fill_gaps(np.array(v, float)), fs, nperseg)), strict=True)

    spark.udtf.register("detect_peaks", DetectPeaks)
    spark.udtf.register("welch_psd", WelchPsd)

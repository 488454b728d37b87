"""Table functions: one call gives the levels of a pyramid, the lags of a search or the bands of a filter bank."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

SHAPES = {
    "levels": StructType().add("level", IntegerType()).add("span", LongType()).add("bins", LongType()),
    "lags": StructType().add("lag", IntegerType()).add("frequency_hz", DoubleType()),
    "bands": StructType().add("band", IntegerType()).add("frequency_hz", DoubleType()),
}


@udtf
class Expansion:
    """``expansion(kind, n, low, high)``, to be joined laterally; the kind, a constant, decides the columns.

    * ``levels``: pyramid levels over n frames, bins of ``low`` frames and each level ``high`` times as wide, down to one bin;
    * ``lags``: lags of frequencies from ``high`` down to ``low`` at n frames per second;
    * ``bands``: n frequencies spaced evenly in pitch from ``low`` to ``high``.

    A null or empty size gives no rows.
    """

    @staticmethod
    def analyze(kind: AnalyzeArgument, n: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in SHAPES:
            raise ValueError(f"the kind is one of {sorted(SHAPES)}, as a constant")
        return AnalyzeResult(SHAPES[kind.value])

    def eval(self, kind, n, low, high):
        if n is None or low is None or high is None or n <= 0:
            return
        if kind == "levels":
            span, level = int(low), 0
            while True:
                bins = -(-int(n) // span)
                yield level, span, bins
                if bins <= 1:
                    return
                span, level = span * int(high), level + 1
        elif kind == "lags":
            for lag in range(int(-(-n // high)), int(n // low) + 1):
                yield lag, float(n / lag)
        else:
            step = (high / low) ** (1.0 / max(1, int(n) - 1))
            for band in range(int(n)):
                yield band, float(low * step**band)


def register_expansion(spark: SparkSession) -> None:
    spark.udtf.register("expansion", Expansion)

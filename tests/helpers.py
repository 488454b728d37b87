import numpy as np
import pyarrow as pa


def frames(spark, l, r=None, track="t"):
    r = l if r is None else r
    n = len(l)
    # Arrow keeps NaN apart from null
    return spark.createDataFrame(pa.table({
        "track_id": [track] * n, "frame_ix": np.arange(n), "l": np.asarray(l, float), "r": np.asarray(r, float)}))


def long(spark, x, track="t", ch=0):
    n = len(x)
    return spark.createDataFrame(pa.table({
        "track_id": [track] * n, "ch": pa.array([ch] * n, pa.int32()), "frame_ix": np.arange(n), "x": np.asarray(x, float)}))


def values(df, order, *cols):
    rows = df.orderBy(order).select(*cols).collect()
    return [np.array([row[i] for row in rows], float) for i in range(len(cols))]


def tone(hz, rate, seconds, amp=1.0, phase=0.0):
    t = np.arange(int(rate * seconds)) / rate
    return amp * np.sin(2 * np.pi * hz * t + phase)

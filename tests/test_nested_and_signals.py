"""Convolution shapes and values, nested leaves, kinds of files and natural order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import nested, signals


def test_convolution():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(1, 2, 5)), rng.normal(size=(2, 1, 6))
    out = signals.convolved(a, b)
    assert out.shape == (2, 2, 10)
    assert all(np.allclose(out[i, j], np.convolve(a[0, j], b[i, 0])) for i in range(2) for j in range(2))
    assert signals.convolved(a, b, tail=False).shape == (2, 2, 5)
    assert signals.early(np.ones(2000), 100).sum() == 900


def test_early_reverberation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 1.0], 1)], "x array<double>, r array<double>, s int")
    assert df.select(signals.early_reverberated(F.col("x"), F.col("r"), F.col("s"))).first()[0] == pytest.approx([0, 1, 2])


def test_nested(spark):
    df = spark.createDataFrame([([["a"], ["b", "c"]], "x_10"), ([], "x_9")], "n array<array<string>>, name string")
    assert df.select(nested.map_leaves(F.col("n"), 2, F.upper)).first()[0] == [["A"], ["B", "C"]]
    assert [r.name for r in df.orderBy(*nested.natural_order(F.col("name"))).collect()] == ["x_9", "x_10"]
    s = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("b")).alias("a")).alias("s"))
    assert s.select(nested.with_path(F.col("s"), "a.b", F.lit(5))["a"]["b"]).first()[0] == 5
    kinds = {"speech": r"CH\d", "log": None}
    assert df.select(nested.kept_by_kind(F.lit("speech"), F.lit("CH1.wav"), kinds)).first()[0]
    with pytest.raises(Exception, match="unknown kind"):
        df.select(nested.kept_by_kind(F.lit("other"), F.lit("x"), kinds)).collect()

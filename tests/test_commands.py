"""Commands, channels and names of files, and results found again by what they were made of."""

import os
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from colloquy.functions import commands, vectors
from colloquy.operators import lookups
from colloquy.plans import stages


def _one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


def test_commands_come_back(spark):
    for path in ("a.wav", "/with space/b -t wav.wav"):
        for unit, places in (("s", [("0", "16000")]), ("", [("1.25", "2.0"), ("10.0", "11")])):
            for effect in ("", "norm -0.1"):
                spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in places])
                got = _one(spark, path, lambda p: commands.parsed(vectors.trim_command(p, spans, unit, effect)))
                assert (got.path, got.unit, [tuple(i) for i in got.intervals], got.effect) == (path, unit, places, effect or None)
    got = _one(spark, "/plain.wav", commands.parsed)
    assert (got.path, got.unit, got.intervals, got.effect) == ("/plain.wav", None, [], None)
    assert _one(spark, None, commands.parsed) is None
    for bad in ("cat x |", "sox -t wav a -t wav - trim =1 |", "sox -t wav a -t wav - trim =1s =2 |", "sox -t wav a -t wav - trim |"):
        with pytest.raises(Exception, match="not a command"):
            _one(spark, bad, commands.parsed)


def test_channels(spark):
    assert tuple(_one(spark, "/a::b.wav", lambda p: commands.channel_of(commands.with_channel(p, F.lit(3))))) == ("/a::b.wav", 3)
    assert tuple(_one(spark, "/a.wav", commands.channel_of)) == ("/a.wav", None)
    for bad in ("a::[:,0:2]", "a::[0:1]", "a::"):
        with pytest.raises(Exception, match="not one channel"):
            _one(spark, bad, commands.channel_of)


def test_names(spark):
    for path in ("/d.x/a.wav", "a.tar.gz", ".hidden", "d/.hidden", "x.", "plain"):
        p = PurePosixPath(path)
        assert _one(spark, path, lambda c: commands.with_stem_end(c, "_ch")) == str(p.with_name(p.stem + "_ch" + p.suffix))
    assert _one(spark, "/a_n/b_n_n.wav", lambda c: commands.renamed(c, "_n", "!")) == "/a_n/b!!.wav"


def test_cached_by_content(spark, tmp_path):
    built = []

    def run(rows, **parameters):
        return stages.cached([rows], str(tmp_path), lambda: built.append(1) or rows.agg(F.sum("a").alias("t")), **parameters).first().t

    rows = spark.createDataFrame([(1,), (2,), (2,)], "a int")
    assert run(rows, p=1) == 5 and run(rows.orderBy(F.desc("a")).repartition(3), p=1) == 5 and len(built) == 1
    assert run(rows, p=2) == 5 and run(rows.distinct(), p=1) == 3 and run(rows.withColumn("a", F.col("a").cast("long")), p=1) == 5 and len(built) == 4
    assert run(rows.limit(0), p=1) is None and len(built) == 5
    assert len(os.listdir(tmp_path)) == 10 and sum(f.endswith(".json") for f in os.listdir(tmp_path)) == 5


def test_filled_never_multiplies_rows(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "i int, k string, v string")
    table = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    assert {r.i: r.v for r in lookups.filled(rows, table(("a", "y"), ("a", "y"), ("a", None), ("b", "p"), ("b", "q")), "k", "v").collect()} == {1: "y", 2: "x"}
    with pytest.raises(Exception, match="two values of a"):
        lookups.filled(rows, table(("a", "y"), ("a", "z")), "k", "v").collect()

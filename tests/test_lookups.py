"""Lookups in static tables and joins of line-oriented tables: misses, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import ids, vectors
from colloquy.operators import joins, lookups, reshape


def test_id_modes(spark):
    names = ["1089_session1_CH0_0S_003830_004658", "session1_CH0_0S", "overlap_ratio_30.0_sil0.1_1.0_session1_actual30.4", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(ids.canonical(F.col("n"), True), ids.short(F.col("n")), ids.canonical_by_prefix(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("session1_CH0_0S", None, None), (None, "session1_0S", "session1_CH0_0S"), (None, "session1_OV30", "session1_CH0_OV30"), (None, None, None)]


def test_translated(spark):
    table = spark.createDataFrame([("long", "s"), ("other", "t")], "a string, b string")
    rows = spark.createDataFrame([("long",), ("s",), ("x",), (None,)], "n string")
    got = lookups.translated(rows, table, "n", "o", F.lit("-")).collect()
    assert {r.n: r.o for r in got} == {"long": "s", "s": "s", "x": "-", None: "-"}
    with pytest.raises(Exception, match="unknown n"):
        lookups.translated(rows, table, "n", "o").collect()
    assert lookups.translated(rows.limit(0), table, "n", "o").count() == 0


def test_filled(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", None), (4, None, None)], "i int, k string, v string")
    table = spark.createDataFrame([("a", "y"), (None, "z")], "k string, v string")
    assert {r.i: r.v for r in lookups.filled(rows, table, "k", "v").collect()} == {1: "y", 2: "x", 3: None, 4: None}


def _tables(spark, segments, speakers):
    return spark.createDataFrame(segments, "utterance string, recording string, start string, end string"), spark.createDataFrame(speakers, "key string, value string")


def test_speaker_recordings(spark):
    segments, speakers = _tables(spark, [("u2", "S02", "10.5", "12"), ("u1", "S02", "9.47", "10.25"), ("u3", "S02", "1", "2")], [("u1", "P1"), ("u2", "P1"), ("u3", "S02_x")])
    paths = spark.createDataFrame([("S02", "a.wav")], "key string, value string")
    got = {r.key: (r.speaker, r.value) for r in lookups.speaker_recordings(segments, speakers, paths).collect()}
    assert got == {"S02-P1": ("P1", "sox -t wav a.wav -t wav - trim =9.47 =10.25 =10.5 =12 |"), "S02_x": ("S02_x", "sox -t wav a.wav -t wav - trim =1 =2 |")}
    with pytest.raises(Exception, match="without a path"):
        lookups.speaker_recordings(segments, speakers, paths.limit(0)).collect()


def test_speaker_intervals(spark):
    segments, speakers = _tables(spark, [("u1", "r", "0", "1.00003"), ("u2", "r", "0.5", "2"), ("u3", "r", "3", "3")], [("u1", "a"), ("u2", "a"), ("u3", "a")])
    assert [tuple(r) for r in lookups.speaker_intervals(segments, speakers).collect()] == [("r", "a", 0, 32000)]
    for bad in (speakers.where("key <> 'u2'"), speakers.unionByName(speakers)):
        with pytest.raises(Exception, match="not once in both tables"):
            lookups.speaker_intervals(segments, bad).collect()


def test_place_and_commands(spark):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("l"), F.array(F.struct(F.lit("1.2").alias("s"), F.lit("2.0").alias("e")), F.struct(F.lit("10.0").alias("s"), F.lit("11").alias("e"))).alias("i"))
    assert row.select(lookups.place_in(F.col("l"), F.lit("b"))).first()[0] == 1
    with pytest.raises(Exception, match="not in the list"):
        row.select(lookups.place_in(F.col("l"), F.lit("c"))).collect()
    assert row.select(vectors.trim_command(F.lit("f"), F.col("i"), "", "norm -0.1")).first()[0] == "sox -t wav f -t wav - trim =1.2 =2.0 =10.0 =11 norm -0.1 |"
    with pytest.raises(Exception, match="not sorted"):
        row.select(vectors.trim_command(F.lit("f"), F.reverse("i"))).collect()


def test_checks_that_fail(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, k int")
    assert reshape.retained(rows, F.col("k") > 0, 2).count() == 6
    with pytest.raises(ValueError, match="only 3 of 9"):
        reshape.retained(rows, F.col("k") == 0, 3)
    joins.disjoint(rows.where("k = 0"), rows.where("k = 1"), ["i"])
    with pytest.raises(ValueError, match="in both"):
        joins.disjoint(rows, rows.where("i = 4"), ["i"])
    assert sorted(tuple(r) for r in joins.first_if_equal(rows, ["k"], ["i"], ["k"]).collect()) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(Exception, match="one key differ"):
        joins.first_if_equal(rows, ["k"], ["i"], ["i"]).collect()


def test_renamed_ids(spark):
    rows = spark.createDataFrame([("a1", 1), ("a1", 2), ("b2", 3)], "k string, i int")
    assert sorted(tuple(r) for r in joins.renamed_ids(rows, "k", F.upper("k")).collect()) == [("A1", 1), ("A1", 2), ("B2", 3)]
    for bad in (F.lit("x"), F.when(F.col("k") == "b2", F.lit("q"))):
        with pytest.raises(Exception, match="no name of its own"):
            joins.renamed_ids(rows, "k", bad).collect()


def test_spans_and_channels(spark):
    rows = spark.sql("SELECT 1 AS d, map('a', array(named_struct('s', 1, 'e', 2), named_struct('s', 4, 'e', 5)), 'b', array()) AS m UNION ALL SELECT 2, NULL")
    assert sorted(tuple(r) for r in reshape.speaker_spans(rows, "m").collect()) == [(1, "a", 1, 2), (1, "a", 4, 5)]
    parts = lambda *at: spark.createDataFrame([(7, c, [float(c)]) for c in at], "k int, c int, v array<double>")
    assert reshape.stacked(parts(2, 0, 1), ["k"], "c", "v").first()["values"] == [[0.0], [1.0], [2.0]]
    for at in ((0, 2), (1, 2), (0, 0)):
        with pytest.raises(Exception, match="a channel is missing"):
            reshape.stacked(parts(*at), ["k"], "c", "v").collect()

"""Blocks of frames, table functions over segments and sliced sweeps, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks, estimates
from colloquy.operators import intervals as iv
from colloquy.operators.carried import numbered


def _frames(spark, lengths, size):
    rows = [(k, i, 100 * n + i) for n, (k, length) in enumerate(lengths.items()) for i in range(length)]
    random.Random(3).shuffle(rows)
    return blocks.blocked(spark.createDataFrame(rows, "k string, i bigint, v bigint"), ["k"], "i", "v", size)


def test_slices_equal_dense_ones(spark):
    lengths = {"a": 1, "b": 8, "c": 21, None: 9}
    packed = _frames(spark, lengths, 4)
    spans = [(k, s, s + n) for k in lengths for s in range(-6, 26, 3) for n in (1, 4, 11)] + [("a", 3, 3), ("a", None, 2)]
    cut = blocks.pieces(spark.createDataFrame(spans, "k string, s bigint, e bigint"), packed, ["k"], 4)
    got = {(r.k, r.s, r.e): r["values"] for r in blocks.stitched(cut, ["k", "s", "e"]).collect()}
    dense = {k: [100 * n + i for i in range(length)] for n, (k, length) in enumerate(lengths.items())}
    expected = {(k, s, e): [dense[k][max(0, min(i, lengths[k] - 1))] for i in range(s, e)] for k, s, e in spans if s is not None and s < e}
    assert got == expected
    assert cut.where("size(values) > 4 AND s >= 0 AND e <= 8 AND k = 'b'").count() == 0


def test_bad_blocks_raise(spark):
    frames = lambda *at: spark.createDataFrame([("a", i, i) for i in at], "k string, i bigint, v bigint")
    spans = spark.createDataFrame([("a", 0, 2)], "k string, s bigint, e bigint")
    for at, what in (((0, 2), "frame is missing"), ((0, 1, 1), "repeated"), ((0, 1, 8, 9), "block is missing"), ((), "no frames")):
        with pytest.raises(Exception, match=what):
            blocks.pieces(spans, blocks.blocked(frames(*at), ["k"], "i", "v", 4), ["k"], 4).collect()
    assert blocks.pieces(spans.limit(0), blocks.blocked(frames(0), ["k"], "i", "v", 4), ["k"], 4).count() == 0


def test_activity_slices(spark):
    rng = random.Random(5)
    spans = [(k, s, s + rng.randrange(0, 9)) for k in "ab" for s in (rng.randrange(0, 60) for _ in range(9))] * 2
    wanted = [(k, s, s + n) for k in "abc" for s in (-3, 0, 7, 50) for n in (5, 30)]
    packed = blocks.active_blocks(spark.createDataFrame(spans, "k string, s bigint, e bigint"), ["k"], 8)
    cut = blocks.pieces(spark.createDataFrame(wanted, "k string, s bigint, e bigint"), packed, ["k"], 8, missing=F.lit(False))
    got = {(r.k, r.s, r.e): r["values"] for r in blocks.stitched(cut, ["k", "s", "e"]).collect()}
    assert got == {(k, s, e): [any(a <= i < b for q, a, b in spans if q == k) for i in range(s, e)] for k, s, e in wanted}


def test_framewise_region(spark):
    rows = spark.createDataFrame([(1663110, 2623110), (0, 960000), (0, 100)], "a bigint, b bigint")
    begin, end = blocks.framewise_region(F.col("a"), F.col("b"))
    got = [tuple(r) for r in rows.select(begin, end).collect()]
    assert [e - b for b, e in got] == [1500, 1500, 1] and got[1][0] == got[2][0] == -5


def test_estimates_run_on_through_blocks(spark):
    packed = _frames(spark, {"a": 10, "b": 3}, 4)
    spans = spark.createDataFrame([("a", 1, 9), ("a", 0, 10), ("b", 0, 2)], "k string, s bigint, e bigint")
    rows = estimates.estimated(blocks.pieces(spans, packed, ["k"], 4), ["k", "s", "e"], estimates.differences, "frame bigint, value bigint").collect()
    got = {(r.k, r.s, r.frame): r.value for r in rows}
    assert got == {("a", 1, i): 1 for i in range(8)} | {("a", 0, i): 1 for i in range(1, 10)} | {("a", 0, 0): 0, ("b", 0, 0): 100, ("b", 0, 1): 1}


def _random_spans(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "x", "y", None]), rng.choice("pqr"), s, s + rng.choice([1, 2, 5, 40])) for s in (rng.randrange(-50, 200) for _ in range(150))]
    return spark.createDataFrame(rows, "k string, speaker string, s bigint, e bigint")


@pytest.mark.parametrize("within", [1, 16, 1000])
def test_sliced_sweeps_equal_whole_ones(spark, within):
    spans = _random_spans(spark, within)
    a, b = spans.where("speaker = 'p'"), spans.where("speaker = 'q'")
    same = lambda run: sorted(map(str, run(None).collect())) == sorted(map(str, run(within).collect()))
    assert same(lambda w: iv.union(spans, ["k"], within=w))
    assert same(lambda w: iv.depths(spans, ["k"], within=w, n=F.col("s")))
    assert same(lambda w: iv.exclusive(spans.where("k IS NOT NULL"), ["k"], "speaker", within=w))
    assert same(lambda w: iv.overlap(spans, ["k"], 3, within=w))
    assert same(lambda w: iv.combine([a, b], ["k"], within=w))
    assert same(lambda w: iv.subtract(a, b, ["k"], within=w))
    assert iv.union(spans.limit(0), ["k"], within=within).count() == 0


def test_sliced_sweeps_sort_no_whole_key(spark):
    """Each window over the spans themselves has the slice among its keys; those over carried rows have one row a slice."""
    plan = iv.depths(_random_spans(spark, 1), ["k"], within=16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert windows and all("_part" in w.rsplit("], [", 2)[-2] + w.rsplit("], [", 2)[-1] for w in windows)


def test_numbered(spark):
    rows = _random_spans(spark, 9).withColumn("id", F.monotonically_increasing_id())
    got = numbered(rows, ["k"], ["s", "id"], F.floor(F.col("s") / 16)).collect()
    for k in ("x", "y", None):
        of = sorted((r for r in got if r.k == k), key=lambda r: (r.s, r.id))
        assert [r.place for r in of] == list(range(len(of)))

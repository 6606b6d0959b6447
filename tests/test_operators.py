"""Golden cases and brute force for the interval, frame, splitting and text operators."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colloquy.catalogue import QUERIES
from colloquy.functions import access, ids, text, units, vectors
from colloquy.operators import frames, intervals, joins, reshape, score, splitting, stats
from colloquy.plans import report, stages
from colloquy.sources import documents, sinks, texts
from colloquy.streaming.sessions import user_sessions

CANDIDATES = [10, 100, 200, 250, 300, 310, 320, 400]


@pytest.mark.parametrize(
    "max_len, optimal, greedy, partial",
    [
        (225, [200, 320], [200, 400], [200, 320]),
        (250, [250], [250], [250]),
        (499, [250], [400], [250]),
        (500, [], [], []),
        (100, [100, 200, 300, 400], [100, 200, 300, 400], [100, 200, 300, 400]),
        (99, [10, 100, 200, 250, 320, 400], [10, 100, 200, 250, 320, 400], [10, 100, 200, 250, 320, 400]),
    ],
)
def test_splits(max_len, optimal, greedy, partial):
    found = [splitting.METHODS[m](CANDIDATES, 0, 500, max_len) for m in ("optimal", "greedy", "partial")]
    assert found == [optimal, greedy, partial]


def test_splits_without_candidates_and_beyond_them():
    for method in splitting.METHODS.values():
        assert method([], 0, 500, 225) == []
        assert method([i * 100 for i in range(20)], 0, 7000, 100) == [i * 100 for i in range(1, 20)]


def spans(spark, rows, columns="k string, s bigint, e bigint"):
    return spark.createDataFrame(rows, columns)


def dense(rows, keys=1):
    active = {}
    for *k, s, e in rows:
        for t in range(s, e):
            active.setdefault(tuple(k), {}).setdefault(t, 0)
            active[tuple(k)][t] += 1
    return active


def runs(points):
    out = []
    for t in sorted(points):
        if out and out[-1][1] == t:
            out[-1][1] = t + 1
        else:
            out.append([t, t + 1])
    return [tuple(x) for x in out]


def test_interval_algebra_equals_dense_arrays(spark):
    rng = random.Random(4)
    rows = []
    for session in "ab":
        for speaker in "xyz":
            for _ in range(12):
                s = rng.randrange(60)
                rows.append((session, speaker, s, s + rng.randrange(1, 9)))
    df = spans(spark, rows, "k string, who string, s bigint, e bigint")
    by_speaker = dense(rows)
    got = lambda d, *c: sorted(tuple(r[x] for x in (*c, "s", "e")) for r in d.collect())
    union = sorted((*k, *r) for k, p in by_speaker.items() for r in runs(p))
    assert got(intervals.union(df, ["k", "who"]), "k", "who") == union
    assert got(intervals.union(df, ["k", "who"], within=7), "k", "who") == union
    alone = []
    for k in "ab":
        for who in "xyz":
            others = set().union(*(by_speaker[k, o] for o in "xyz" if o != who))
            alone += [(k, who, *r) for r in runs(set(by_speaker[k, who]) - others)]
    assert got(intervals.exclusive(df, ["k"], "who"), "k", "who") == sorted(alone)
    both = [(k, *r) for k in "ab" for r in runs(set(by_speaker[k, "x"]) & set(by_speaker[k, "y"]))]
    pick = lambda w: df.where(F.col("who") == w).select("k", "s", "e")
    assert got(intervals.combine([pick("x"), pick("y")], ["k"]), "k") == sorted(both)
    less = [(k, *r) for k in "ab" for r in runs(set(by_speaker[k, "x"]) - set(by_speaker[k, "y"]))]
    assert got(intervals.subtract(pick("x"), pick("y"), ["k"]), "k") == sorted(less)
    free = [(k, *r) for k in "ab" for r in runs(set(range(5, 50)) - set(by_speaker[k, "x"]))]
    assert got(intervals.complement(pick("x"), ["k"], F.lit(5).cast("bigint"), F.lit(50).cast("bigint")), "k") == sorted(free)


def test_intervals_of_nothing(spark):
    none = spans(spark, [])
    assert intervals.union(none, ["k"]).count() == 0
    assert intervals.overlap(none, ["k"]).count() == 0


@pytest.mark.parametrize("signal, dilated", [("___###___###___", "__#####_#####__"), ("___####__###___", "__###########__"), ("__#__##__####__", "_#############_"), ("_#___##__#####_", "###_###########"), ("#____##__######", "##__###########")])
def test_dilation(spark, signal, dilated):
    frames_ = spark.createDataFrame([("a", i) for i, c in enumerate(signal) if c == "#"], "k string, frame bigint")
    got = sorted((r.s, r.e) for r in intervals.dilated_islands(frames_, ["k"], 3, len(signal)).collect())
    assert got == runs({i for i, c in enumerate(dilated) if c == "#"})
    rows = spark.createDataFrame([("a", i, int(c == "#")) for i, c in enumerate(signal)], "k string, frame bigint, p int")
    assert "".join("_#"[r.p] for r in frames.max_filter(rows, ["k"], 3).orderBy("frame").collect()) == dilated


@pytest.mark.parametrize("speech, silence, expected", [(3, 5, [(5, 9), (14, 19)]), (5, 5, [(14, 19)]), (3, 7, [(5, 24)]), (7, 5, []), (7, 7, [])])
def test_hysteresis(spark, speech, silence, expected):
    parts = [(0, 5, False), (5, 9, True), (9, 14, False), (14, 19, True), (19, 24, False)]
    rows = spark.createDataFrame([("a", *p) for p in parts], "k string, s bigint, e bigint, active boolean")
    assert sorted((r.s, r.e) for r in intervals.hysteresis(rows, ["k"], speech, silence).collect()) == expected


def test_tile_of_place_without_rows_for_places(spark):
    sizes = spark.createDataFrame([(n, hop) for n in (1, 9, 10, 11, 14, 24, 25, 61) for hop in (1, 2, 3, 10)], "n bigint, hop int")
    zero = F.lit(0).cast("bigint")
    for hop in (1, 2, 3, 10):
        some = sizes.where(F.col("hop") == hop)
        kept = frames.tiles(some, 10, hop, zero, F.col("n")).select("n", F.explode(F.sequence("s_ins", F.col("e_ins") - 1)).alias("place"), "s").where("s_ins < e_ins")
        placed = some.select("n", F.explode(F.sequence(zero, F.col("n") - 1)).alias("place"))
        got = placed.select("n", "place", frames.tile_of(F.col("place"), 10, hop, F.col("n")).alias("s"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))
    plan = QUERIES["tile_assign"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize(
    "stop, hop, expected",
    [
        (20, 2, [(0, 10, 0, 9, 0, 9), (2, 12, 9, 11, 7, 9), (4, 14, 11, 13, 7, 9), (6, 16, 13, 15, 7, 9), (8, 18, 15, 17, 7, 9), (10, 20, 17, 20, 7, 10)]),
        (20, 5, [(0, 10, 0, 7, 0, 7), (5, 15, 7, 12, 2, 7), (10, 20, 12, 20, 2, 10)]),
        (9, 5, [(0, 9, 0, 9, 0, 9)]),
    ],
)
def test_tiles(spark, stop, hop, expected):
    rows = frames.tiles(spark.createDataFrame([(stop,)], "n bigint"), 10, hop, F.lit(0).cast("bigint"), F.col("n"))
    assert sorted(tuple(r[c] for c in ("s", "e", "s_ins", "e_ins", "s_cut", "e_cut")) for r in rows.collect()) == expected


def test_units(spark):
    df = spark.createDataFrame([(194, 260), (304, 896), (36023, 36200)], "a bigint, b bigint")
    got = [tuple(r) for r in df.select(units.first_sample(F.col("a")), units.last_sample(F.col("b")), units.frame_of(units.first_sample(F.col("a")))).collect()]
    assert got == [(48896, 66815, 194), (77056, 229631, 304), (9221120, 9267455, 36023)]
    t = spark.createDataFrame([(Decimal("0.0000938"),)], "t decimal(18,7)")
    assert t.select(units.samples_by_float(F.col("t")), units.samples_by_decimal(F.col("t")), units.samples_by_half_even(F.col("t"))).first()[:] == (1, 1, 2)
    assert spark.range(47949, 47950).select(units.seconds(F.col("id"))).first()[0] == Decimal("2.9968125")


def test_ids(spark):
    names = {
        "overlap_ratio_40.0_sil0.1_1.0_session9_actual39.9": "session9_CH0_OV40",
        "overlap_ratio_0.0_sil0.1_0.5_session0_actual0.0": "session0_CH0_0S",
        "overlap_ratio_0.0_sil2.9_3.0_session1_actual0.0": "session1_CH0_0L",
        "session0_0L": "session0_CH0_0L",
        "0L_session1": "session1_CH0_0L",
        "session0_CH0_0L": "session0_CH0_0L",
        "1089_session1_CH0_0S_003830_004658": None,
        "session1_CH3_OV20": None,
        "session1_OV99": None,
        "overlap_ratio_15.0_sil0.1_1.0_session1_actual9.9": None,
        "something else": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", ids.canonical(F.col("n")).alias("c")).collect()} == names
    paths = spark.createDataFrame([("a/CH1.wav",), ("a/S25_U01.CH4.wav",)], "n string")
    assert [r[0] for r in paths.select(ids.channel_suffix(F.col("n"))).collect()] == ["CH1", "U01CH4"]


def test_access(spark):
    df = spark.createDataFrame([({"b": [1, 2, 3]},)], "a map<string, array<int>>")
    for path, expected in {"['b'][:2]": [1, 2], "[b][1:][:1]": [2], "['b'][::-1]": [3, 2, 1], "[b][-1]": 3, "[b][-1:]": [3], "[b][7]": None}.items():
        assert df.select(access.item(F.col("a"), path)).first()[0] == expected
    assert access.str_to_slice("[:1]") == slice(None, 1) and access.str_to_slice("::-1") == slice(None, None, -1)
    with pytest.raises(ValueError):
        access.str_to_slice("[1]")


def test_vectors(spark):
    df = spark.createDataFrame([(list(range(1, 11)),)], "a array<int>")
    cut = lambda s, e: df.select(vectors.edge_slice(F.col("a"), s, e)).first()[0]
    assert cut(3, 7) == [4, 5, 6, 7] and cut(-5, 5) == [1] * 5 + [1, 2, 3, 4, 5] and cut(5, 15) == [6, 7, 8, 9, 10] + [10] * 5
    grid = spark.range(10_000).select((F.col("id") / 9999).alias("x"))
    errors = grid.select(F.max(F.abs(vectors.inverse_mulaw(vectors.mulaw(F.col("x"))) - F.col("x"))), F.max(F.abs(vectors.eight_bit(F.col("x")) / 255 - F.col("x")))).first()
    assert errors[0] == pytest.approx(0.0108011, abs=1e-6) and errors[1] == pytest.approx(0.0019602, abs=1e-6)
    crop = df.select(vectors.random_crop(F.col("a").cast("array<double>"), 5, 3)).first()[0]
    assert len(crop) == 5 and crop == [crop[0] + i for i in range(5)]
    spans_ = df.select(F.expr("array(named_struct('s', 686956, 'e', 714157), named_struct('s', 760649, 'e', 1010729))").alias("i"))
    assert spans_.select(vectors.trim_command(F.lit("f.wav"), F.col("i"))).first()[0] == "sox -t wav f.wav -t wav - trim =686956s =714157s =760649s =1010729s |"


def test_moments_merge(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("part"), (F.col("id") * 1.5).alias("x"))
    whole = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
    merged = stats.merged_moments(stats.moments(rows.withColumn("k", F.lit(1)), F.col("x"), ["part", "k"]), ["k"]).first()
    assert (merged.mean, merged.std) == (pytest.approx(whole[0]), pytest.approx(whole[1]))


def test_joins_and_reshape(spark):
    table = spark.createDataFrame([("ab1", 5), ("ab2", 5), ("cd", 7), ("cde", 8)], "key string, value int")
    keys = spark.createDataFrame([("ab",), ("cd",), ("c",), ("zz",)], "key string")
    assert {r.key: r.value for r in joins.by_prefix(keys, table, "key", "value").collect()} == {"ab": 5, "cd": 7, "c": None, "zz": None}
    ex = spark.createDataFrame([("a", [1, 2], ["x", "y"])], "k string, n array<int>, w array<string>")
    assert [tuple(r) for r in reshape.utterances(ex, ["k"], ["n", "w"]).orderBy("ord").collect()] == [("a", 0, 1, "x"), ("a", 1, 2, "y")]
    with pytest.raises(Exception, match="differ in length"):
        reshape.utterances(ex.withColumn("n", F.array(F.lit(1))), ["k"], ["n", "w"]).collect()


def test_word_errors():
    assert score.edit_distance("a b c d".split(), "a x c".split()) == 2
    assert score.edit_distance([], ["a"]) == 1
    rng = random.Random(1)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        assert score.edit_distance(a, b) == slow(a, b)


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "text").write_text("u1 hello  world\nu2\nu1 again\n\n  u3   x\n")
    rows = texts.read(spark, str(tmp_path / "text"))
    assert {r.key: r.value for r in rows.collect()} == {"u1": "again", "u2": "", "u3": "x"}
    sinks.key_value(rows, str(tmp_path / "out"))
    assert {r.key: r.value for r in texts.key_value(spark, str(tmp_path / "out")).collect()} == {"u1": "again", "u2": "", "u3": "x"}
    (tmp_path / "segments").write_text("u1 r1 0.5 1.25\n")
    assert texts.read(spark, str(tmp_path / "segments")).first()[:] == ("u1", "r1", "0.5", "1.25")
    (tmp_path / "per_utt").write_text("u1 ref a  b\nu1 hyp a\nu1 op C D\nu1 #csid 1 0 1 0\n")
    assert texts.read(spark, str(tmp_path / "per_utt")).first()[:] == ("u1", "a b", "a", "C D", [1, 0, 1, 0])
    segs = spark.createDataFrame([("m", "1", "A", Decimal("1.5"), Decimal("2.25"), "hi you")], "session_id string, channel string, speaker string, start_time decimal(18,7), end_time decimal(18,7), words string")
    sinks.stm(segs, str(tmp_path / "stm"))
    assert texts.stm(spark, str(tmp_path / "stm")).first()[:] == segs.first()[:]
    sinks.rttm(segs.withColumn("duration", F.lit("0.75").cast("decimal(18,7)")), str(tmp_path / "rttm"))
    assert texts.rttm(spark, str(tmp_path / "rttm")).first()[:] == ("m", "A", Decimal("1.5"), Decimal("0.75"))
    with pytest.raises(ValueError):
        texts.read(spark, str(tmp_path / "unknown"))


def test_json_sources(spark, tmp_path):
    (tmp_path / "db.json").write_text('{"datasets": {"dev": {"a": {"n": 3}}, "eval": {"b": {"n": 4}}}}')
    rows = documents.database(spark, str(tmp_path / "db.json"), "STRUCT<n: INT>", ["eval"])
    assert [(r.dataset, r.example_id, r.example.n) for r in rows.collect()] == [("eval", "b", 4)]
    (tmp_path / "seg.json").write_text('[{"session_id": "S02", "speaker": "P05", "start_time": "40.60", "end_time": 43.8200001, "file": "a.wav"}]')
    seg = documents.seglst(spark, str(tmp_path / "seg.json")).first()
    assert (seg.end_time, seg.audio_path) == (Decimal("43.8200001"), "a.wav")
    tables = {"libri": spark.range(1), "other": spark.range(2)}
    assert documents.routed(tables, "libri_ch0").count() == 1 and documents.routed({"l.b": spark.range(3)}, "libri").count() == 3
    assert documents.with_paths({"a": ["{egs}/x", 3]}, egs="/e") == {"a": ["/e/x", 3]}
    configs = {"one": {"path": "{egs}/db.json", "datasets": ["dev"]}, "two": {"path": "{egs}/missing.json"}}
    chosen = documents.selected(spark, configs, ["one"], "STRUCT<n: INT>", egs=str(tmp_path))
    assert [r.example_id for r in chosen.collect()] == ["a"]
    with pytest.raises(KeyError):
        documents.routed(tables, "libri_other")


def test_stages_and_report(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert stages.materialised(spark, str(tmp_path / "t"), build).count() == 3
    assert built == [1]
    assert stages.selected(["a", "b", "c", "d"], "1-2") == ["b", "c"] and stages.selected(["a", "b"], "b,a") == ["a", "b"]
    assert report.table([{"a": 1, "b": 2}, {"a": 10, "c": 20}]).splitlines() == [" a | b |  c", " 1 | 2 |  -", "10 | - | 20"]
    assert report.shown_width("\x1b[31mab\x1b[0m") == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("Well-known, yes?!  ",), ("?.",)], "w string")
    assert [r[0] for r in df.select(text.cleaned(F.col("w"))).collect()] == ["Well known yes", None]
    assert df.select(text.squashed(F.lit(" a \t b\n"))).first()[0] == "a b"


def test_streaming_sessions(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:00'), (1, TIMESTAMP'2024-01-01 00:05:00'), (1, TIMESTAMP'2024-01-01 03:00:00'), (2, TIMESTAMP'2024-01-01 00:00:00') AS t(user_id, ts)")
    assert sorted((r.user_id, r.n_events) for r in user_sessions(rows).collect()) == [(1, 1), (1, 2), (2, 1)]
    rows.write.parquet(str(tmp_path / "in"))
    stream = user_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.user_id, r.n_events) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_segment_lists_come_back_whole(spark, tmp_path):
    """A list in each part, read again: every row, however many there are in a file."""
    rows = spark.range(0, 100, 1, 3).selectExpr("concat('s', id) AS session_id", "concat('p', id % 4) AS speaker", "CAST(id AS DECIMAL(18,7)) AS start_time", "CAST(id + 0.1234567 AS DECIMAL(18,7)) AS end_time")
    sinks.seglst(rows, f"{tmp_path}/lists")
    back = documents.seglst(spark, f"{tmp_path}/lists").select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    sinks.seglst(rows.limit(0), f"{tmp_path}/none")
    assert documents.seglst(spark, f"{tmp_path}/none").count() == 0


def test_last_of_equal_keys_over_files(spark, tmp_path):
    (tmp_path / "a").write_text("k old\n")
    (tmp_path / "b").write_text("".join(f"x{i} {i}\n" for i in range(5000)) + "k new\n")
    got = {r.key: r.value for r in texts.key_value(spark, str(tmp_path)).collect()}
    assert got["k"] == "new" and len(got) == 5001


def test_subsets_are_a_closed_table(spark):
    names = ["overlap_ratio_15.0_sil0.1_1.0_session1_actual9.9", "session1_OV99", "session1_OV20", "overlap_ratio_0.0_sil10.5_11.0_session1_actual0.0"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(ids.subset(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == [None, None, "OV20", "0L"]

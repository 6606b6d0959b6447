"""Sources and sinks of many files, renamed sessions, quoted tables, vectors of speakers, cut channels."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colloquy.functions import ids
from colloquy.operators import joins, reshape, stats
from colloquy.sources import documents, sinks, texts

A, B = (f"overlap_ratio_40.0_sil0.1_1.0_session{i}_actual39.9" for i in (1, 2))


def _rttm(*sessions):
    return "".join(f"SPEAKER {s} 1 {i}.5 2.0000625 <NA> <NA> {p} <NA> <NA>\n" for i, (s, p) in enumerate(sessions))


def test_rttm_of_many_files_under_other_names(spark, tmp_path):
    (tmp_path / "dev").write_text(_rttm((A, "8"), (A, "2")))
    (tmp_path / "eval").write_text("; no line\n\n" + _rttm((B, "8")))
    files = [str(tmp_path / n) for n in ("dev", "eval")]
    got = texts.rttm(spark, files, ids.canonical)
    assert sorted((r.session_id, r.speaker, r.start_time) for r in got.collect()) == [("session1_CH0_OV40", "2", Decimal("1.5")), ("session1_CH0_OV40", "8", Decimal("0.5")), ("session2_CH0_OV40", "8", Decimal("0.5"))]
    assert {r.session_id for r in texts.rttm(spark, files).collect()} == {A, B}


@pytest.mark.parametrize("sessions", [[(A, "1"), ("session1_CH0_OV40", "1")], [("unknown", "1")]], ids=["two of one name", "no name"])
def test_rttm_names_must_stay_apart(spark, tmp_path, sessions):
    (tmp_path / "rttm").write_text(_rttm(*sessions))
    with pytest.raises(Exception, match="no name of its own"):
        texts.rttm(spark, str(tmp_path / "rttm"), ids.canonical).collect()


def test_normalised(spark):
    rows = spark.createDataFrame([("m_CH0_a", "Well-known, yes?!"), ("m_CH0_a", "?."), ("CH0_b", None)], "session_id string, words string")
    assert [tuple(r) for r in texts.normalised(rows).collect()] == [("m_a", "Well known yes"), ("m_a", ""), ("CH0_b", "")]


def test_meeting_info(spark, tmp_path):
    header = "start_time\tend_time\tspeaker\tutterance_id\ttranscription\n"
    for meeting, line in (("m1", '1.5\t2.25\tA\tu1\t"he said ""no"" twice"\n'), ("m2", "0\t1\tB\tu2\tplain\n")):
        (tmp_path / meeting / "transcription").mkdir(parents=True)
        (tmp_path / meeting / "transcription/meeting_info.txt").write_text(header + line)
    rows = texts.meeting_info(spark, f"{tmp_path}/*/transcription/meeting_info.txt").orderBy("meeting").collect()
    assert [(r.meeting, r.start_time, r.transcription) for r in rows] == [("m1", Decimal("1.5"), 'he said "no" twice'), ("m2", 0, "plain")]
    with pytest.raises(Exception, match="no name in this path"):
        texts.meeting_info(spark, f"{tmp_path}/*/transcription/meeting_info.txt", r"/nowhere/([^/]+)$").collect()


def test_lists_of_many_datasets(spark, tmp_path):
    for name, lines in (("dev", "a 1\nb 2\na 3\n"), ("eval", "a 9\n")):
        (tmp_path / name / "ivectors").mkdir(parents=True)
        (tmp_path / name / "ivectors/online.scp").write_text(lines)
    got = texts.key_value(spark, f"{tmp_path}/*/ivectors/online.scp", r"/([^/]+)/ivectors/[^/]+$").collect()
    assert sorted((r.dataset, r.key, r["value"]) for r in got) == [("dev", "a", "3"), ("dev", "b", "2"), ("eval", "a", "9")]


def test_sorted_list_for_each_dataset(spark, tmp_path):
    rows = spark.createDataFrame([(d, k, k * 2) for d in ("x", "y") for k in "cab"], "d string, key string, value string")
    sinks.key_value(rows, f"{tmp_path}/o", dataset="d")
    for d in ("x", "y"):
        parts = sorted((tmp_path / "o" / f"dataset={d}").glob("part*"))
        assert [line for p in parts for line in p.read_text().splitlines()] == ["a aa", "b bb", "c cc"]


def test_hypotheses_bear_the_model(spark, tmp_path):
    path = sinks.hypotheses(spark.createDataFrame([("u1", "a b"), ("u2", "")], "key string, words string"), str(tmp_path), "large")
    assert path.endswith("text_hyp_large") and {r.key: r["value"] for r in texts.read(spark, path).collect()} == {"u1": "a b", "u2": ""}


def test_mix_log_and_speakers(spark, tmp_path):
    entry = lambda s, o: f'{{"speaker_id": "{s}", "path": "{s}.wav", "offset_in_samples": {o}}}'
    log = ", ".join(f'{{"output": "{n}", "t60": 0.25, "snr": 15.5, "inputs": [{", ".join(entry(s, i) for i, s in enumerate(who))}]}}' for n, who in (("two", "aba"), ("three", "abc")))
    (tmp_path / "mixlog.json").write_text(f"[{log}]")
    kept = documents.enough_speakers(documents.mix_log(spark, str(tmp_path / "mixlog.json")), F.col("inputs.speaker_id"), 2).collect()
    assert [(r.output, r.sound_decay_time, r.snr, [i.offset_in_samples for i in r.inputs]) for r in kept] == [("two", 0.25, 15.5, [0, 1, 2])]


def test_database_lines(spark, tmp_path):
    rows = spark.range(0, 60, 1, 3).selectExpr("concat('d', id % 3) AS dataset", "concat('e', id) AS example_id", "struct(id AS n, IF(id = 7, NULL, array(id, id + 1)) AS xs) AS example")
    sinks.database_lines(rows, f"{tmp_path}/db")
    read = lambda *names: documents.database(spark, f"{tmp_path}/db", "STRUCT<n: BIGINT, xs: ARRAY<BIGINT>>", list(names), lines=True)
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, rows.collect()))
    assert {r.dataset for r in read("d1").collect()} == {"d1"} and read("d1", "d2").count() == 40 and read("d9").count() == 0


def test_default_region(spark):
    rows = spark.createDataFrame([(1, 9, None), (None, 9, None), (None, None, None), (1, 9, (2, 3))], "start bigint, `end` bigint, uem struct<s: bigint, e: bigint>")
    assert [tuple(r.uem) for r in reshape.with_default_region(rows).collect()] == [(1, 9), (0, 9), (0, None), (2, 3)]


def _table(spark):
    rows = [("m", "a", 0, "/a", [1.0]), ("m", "b", 1, "/b", [2.0]), ("m", "a", 2, "/a2", [3.0]), ("n", "a", 0, "", [4.0]), ("n", "c", 1, None, [5.0])]
    return spark.createDataFrame(rows, "example_id string, speaker_id string, ord int, path string, embedding array<float>")


@pytest.mark.parametrize(
    ("example", "expected"),
    [
        (("m_ch1", "m", ["b", "a", "b"], False), ([[2.0], [3.0]], None)),
        (("m", None, ["a", "b"], False), ([[3.0], [2.0]], None)),
        (("m", None, ["a"], False), (None, "other speakers")),
        (("m", None, ["a", "b", "c"], False), (None, "other speakers")),
        (("m", None, None, False), (None, "other speakers")),
        (("x", "m", ["0", "1"], True), ([[3.0], [2.0]], None)),
        (("n", None, ["a", "c"], False), (None, "an empty path")),
        (("z", None, ["a"], True), (None, "no vectors")),
    ],
)
def test_speaker_vectors(spark, example, expected):
    rows = spark.createDataFrame([example], "example_id string, embedding_id string, speaker_id array<string>, estimate boolean")
    got = joins.speaker_vectors(rows, _table(spark), estimate=F.col("estimate")).collect()
    assert [(r.vectors, r.reason) for r in got] == [expected]


def test_auxiliary_mean_std(spark):
    flat = spark.createDataFrame([([1.0, 4.0],), ([2.0, 4.0],), ([6.0, 4.0],)], "v array<double>")
    packed = flat.agg(F.collect_list("v").alias("v"))
    expected = [(0, 3.0, pytest.approx((14 / 3) ** 0.5), 3), (1, 4.0, 0.0, 3)]
    for rows in (flat, packed):
        assert [tuple(r) for r in stats.auxiliary_mean_std(rows, "v").orderBy("dim").collect()] == expected


def test_channels_cut_other_paths(spark):
    schema = "k string, files array<string>, noise string, rir array<string>, early array<string>, per array<array<string>>"
    rows = spark.createDataFrame([("e", ["/U01.CH0.wav", "/U02.CH1.wav"], "/n", ["/r"], ["x", "y"], [["p", "q"], ["s", "t"]])], schema)
    got = reshape.explode_channels(rows, "k", "files", ids.channel_suffix, parallel=["noise", "early"], each=["rir", "per"]).orderBy("k").collect()
    assert [(r.k, r.noise, r.rir, r.early, r.per) for r in got] == [
        ("e_U01CH0", "/n::[:,0:1]", ["/r::[:,0:1]"], ["x"], [["p"], ["s"]]),
        ("e_U02CH1", "/n::[:,1:2]", ["/r::[:,1:2]"], ["y"], [["q"], ["t"]]),
    ]


def test_equal_names_of_channels_raise(spark):
    rows = spark.createDataFrame([("d1", "e", ["/a/U01.CH0.wav"]), ("d2", "e", ["/b/U01.CH0.wav"])], "d string, k string, files array<string>")
    assert reshape.explode_channels(rows, "k", "files", ids.channel_suffix, within=["d"]).count() == 2
    with pytest.raises(Exception, match="twice: e_U01CH0"):
        reshape.explode_channels(rows, "k", "files", ids.channel_suffix, within=[]).collect()
    twice = spark.createDataFrame([("e", ["/a/U01.CH0.wav", "/b/U01.CH0.wav"])], "k string, files array<string>")
    with pytest.raises(Exception, match="twice"):
        reshape.explode_channels(twice, "k", "files", ids.channel_suffix, within=[]).collect()


def test_constant_columns_collapse(spark):
    rows = spark.createDataFrame([("e", 1, "d", None), ("e", 0, "d", None), ("f", 0, "x", None)], "k string, o int, d string, n string")
    got = reshape.examples(rows, ["k"], "o", ["o"], ["d", "n"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("e", [0, 1], "d", None), ("f", [0], "x", None)]
    for other in ("y", None):
        with pytest.raises(Exception, match="d differs"):
            reshape.examples(rows.unionByName(spark.createDataFrame([("f", 1, other, None)], rows.schema)), ["k"], "o", ["o"], ["d"]).collect()

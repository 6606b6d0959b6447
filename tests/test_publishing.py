"""Guarded functions, folders that are written as a whole, backups and versions."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colloquy.operators import guarded
from colloquy.plans import stages
from colloquy.sources import publishing, sinks, texts


def _half():
    """A function that workers get whole: they can't import the tests."""

    def half(x):
        if x is None:
            raise guarded.Rejected("no number")
        if x == 5:
            raise KeyError("five")
        return None if x == 6 else [x // 2]

    return half


def test_kept_and_refused_add_up(spark, tmp_path):
    rows = spark.createDataFrame([(i, i if i % 4 else None) for i in range(40)] * 2, "i int, x int")
    path = str(tmp_path / "q")
    result = guarded.guarded(_half(), "array<int>", "x", caught=(guarded.Rejected, KeyError))
    kept, refused = guarded.quarantined(rows, result, path)
    assert kept.unionByName(refused, allowMissingColumns=True).count() == rows.count()
    assert {(r.reason, r["count"]) for r in refused.groupBy("reason").count().collect()} == {("no number", 20), ("KeyError: 'five'", 2)}
    assert {r.x: r["value"] for r in kept.collect()} == {x: None if x == 6 else [x // 2] for x in range(40) if x % 4 and x != 5}
    again = guarded.quarantined(rows.limit(0), result, path)
    assert again[0].count() == kept.count() and kept.columns == ["i", "x", "value"] and refused.columns == ["i", "x", "reason"]
    os.remove(f"{path}/_SUCCESS")
    with pytest.raises(FileExistsError):
        guarded.quarantined(rows, result, path)


def test_guarded_empty_and_uncaught(spark, tmp_path):
    rows = spark.createDataFrame([], "x int")
    result = guarded.guarded(_half(), "array<int>", "x")
    assert [df.count() for df in guarded.quarantined(rows, result, str(tmp_path / "e"))] == [0, 0]
    five = spark.createDataFrame([(5,)], "x int")
    with pytest.raises(Exception, match="five"):
        five.select(result).collect()


def test_unreadable_files_have_no_words(spark):
    def make():
        def run(paths):
            if "bad" in paths:
                raise RuntimeError("too short")
            return [f"of {p}" for p in paths]

        return run

    stages.register("picky", make)
    files = spark.createDataFrame([("a",), ("bad",), ("b",)], "f string").coalesce(1)
    assert {r.f: r.words for r in stages.transcribed(files, "f", "picky", unreadable=(RuntimeError,)).collect()} == {"a": "of a", "bad": "", "b": "of b"}
    with pytest.raises(Exception, match="too short"):
        stages.transcribed(files, "f", "picky").collect()


def _utterances(spark, n=500):
    rows = [(f"u{i:04d}", f"r{i % 7}", str(i), str(i + 1), f"s{i % 3}", None if i % 50 == 0 else f"word {i}") for i in range(n)]
    return spark.createDataFrame(rows, "utterance string, recording string, start string, end string, speaker string, words string").repartition(5)


def test_utterance_folder(spark, tmp_path):
    path = str(tmp_path / "data")
    recordings = spark.createDataFrame([(f"r{i}", f"{i}.wav") for i in range(7)], "key string, value string")
    sinks.utterance_folder(_utterances(spark), recordings, path)
    assert {"segments", "utt2spk", "spk2utt", "text", "wav.scp"} <= set(os.listdir(path)) and os.listdir(tmp_path) == ["data"]
    for name in ("segments", "utt2spk", "text", "wav.scp"):
        parts = sorted(f for f in os.listdir(f"{path}/{name}") if f.startswith("part"))
        keys = [line.split()[0] for f in parts for line in open(f"{path}/{name}/{f}")]
        assert keys == sorted(keys) and len(keys) == {"wav.scp": 7, "text": 490}.get(name, 500)
    assert {r.key: len(r["values"]) for r in texts.read(spark, f"{path}/spk2utt").collect()} == {"s0": 167, "s1": 167, "s2": 166}
    with pytest.raises(FileExistsError):
        sinks.utterance_folder(_utterances(spark, 3), recordings, path)
    twice = _utterances(spark, 3).unionByName(_utterances(spark, 1))
    for bad, what in ((twice, "twice: u0000"), (_utterances(spark, 3).withColumn("speaker", F.lit(None).cast("string")), "lacks a field")):
        with pytest.raises(Exception, match=what):
            sinks.utterance_folder(bad, recordings, str(tmp_path / "other"))
    assert not os.path.exists(tmp_path / "other")


def test_sorted_lists_are_several_parts(spark, tmp_path):
    rows = _utterances(spark).select(F.col("utterance").alias("key"), F.col("recording").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.key_value(rows, str(tmp_path / "l"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(f for f in os.listdir(tmp_path / "l") if f.startswith("part"))
    lines = [line for f in parts for line in open(tmp_path / "l" / f)]
    assert len(parts) > 1 and lines == sorted(lines) and len(lines) == 500


def test_write_if_changed(spark, tmp_path):
    path, day = str(tmp_path / "t"), datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert publishing.write_if_changed(rows, path) == ""
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}
    assert publishing.write_if_changed(rows.orderBy(F.desc("a")).repartition(3), path) is None
    assert before == {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)} and os.listdir(tmp_path) == ["t"]
    for i, changed in enumerate((rows.distinct(), rows.withColumn("a", F.col("a").cast("long")), rows.limit(0))):
        old = publishing.write_if_changed(changed, path, str(tmp_path / f"old{i}"), day)
        assert old.endswith(f"old{i}/t_2024_01_02_03_04_05") and spark.read.parquet(path).count() == changed.count()
    mine = spark.read.parquet(path).unionByName(rows.withColumn("a", F.col("a")))
    publishing.write_if_changed(mine, path, str(tmp_path / "own"), day)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "foreign").mkdir()
    with pytest.raises(FileExistsError):
        publishing.write_if_changed(rows, str(tmp_path / "foreign"))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        publishing.published(spark, root)
    assert publishing.publish(spark.range(3), root) == 1
    early = publishing.published(spark, root)
    (tmp_path / "p" / ".version-half").mkdir()
    assert publishing.publish(spark.range(5), root) == 2
    assert (early.count(), publishing.published(spark, root).count()) == (3, 5)
    with pytest.raises(FileExistsError):
        publishing.rename(spark, f"{root}/version-00000001", f"{root}/version-00000002")
    publishing.retire(spark, root, 1)
    assert publishing.versions(spark, root) == [2]
    (tmp_path / "p" / "notes").mkdir()
    for run in (lambda: publishing.publish(spark.range(1), root), lambda: publishing.published(spark, root)):
        with pytest.raises(FileExistsError, match="notes"):
            run()

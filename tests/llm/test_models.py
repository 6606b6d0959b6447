"""Operators 11 to 13 against brute force and held-out accuracy, with edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from colloquy.llm import clustering, resampling, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "den", "pol", "vim", "gest", "un", "or")]


def lloyd(rows, clusters=8, rounds=10):
    """``vec_id, cluster, distance`` with Python's whole numbers, and the centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == k]
            centroids[k] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


@pytest.mark.parametrize("kind", ["groups", "ties", "few"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "groups":
        middles = rng.normal(0, 3, (5, 64))
        rows = [(i, (middles[i % 5] + rng.normal(0, 0.05 if i % 2 else 2, 64)).tolist()) for i in range(900)]
    elif kind == "ties":
        rows = [(i % 40, [float(x) for x in rng.integers(-1, 2, 64)]) for i in range(120)] + [(7, [0.0] * 64)] * 30
    else:
        rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (2, [-1.0] * 64), (None, [0.25] * 64)]
    odd = [(90_000, None), (90_001, [1.0] * 63), (90_002, [math.nan] + [0.0] * 63), (90_003, [math.inf] * 64), (90_004, [None] + [0.0] * 63), (90_005, [])]
    rows += odd
    found, centroids = clustering.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3))
    got = found.collect()
    expected, wanted = lloyd(rows)
    assert centroids.tolist() == wanted
    order = lambda xs: sorted(xs, key=str)
    assert order((r.vec_id, r.cluster, r.distance) for r in got) == order(expected)
    assert {r.inertia for r in got} == {sum(d for _, _, d in expected)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, k, d in expected if k == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, wanted[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("scale", [50, 1 << 24])
def test_balls_give_what_single_vectors_give(scale):
    rng = np.random.default_rng(2)
    middles = rng.integers(-scale, scale, (8, 64))
    points = middles[rng.integers(0, 8, 3000)] + rng.integers(-scale // 50, scale // 50 + 1, (3000, 64))
    points[:200] = points[0]
    tree, order = clustering.build(points)
    assert (tree.points == points[order]).all() and (np.sort(order) == np.arange(3000)).all()
    exact = np.stack([((tree.points - c) ** 2).sum(1) for c in middles], 1)
    label, distance = clustering.labels_of(tree, middles)
    assert (label == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    counts, sums = clustering.sums_of(tree, middles)
    assert (counts == np.bincount(label, minlength=8)).all()
    assert (sums == np.stack([tree.points[label == k].sum(0) for k in range(8)])).all()
    balls, _, single, _ = clustering.assign(tree, middles)
    assert len(single) < 3000 and len(balls) < 300, "whole balls are assigned at once"


def drawn(docs, target, most, seed, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = [0] * 10_000, [0] * 10_000
    for table, many in ((docs, s), (target, t)):
        for _, text in table:
            for b in runs(words(text)):
                many[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        w = words(text)
        weight, h = sum(gain[b] for b in runs(w)), int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(runs(w)), weight, score, None, len(w)])
    eligible = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for place, r in enumerate(eligible[: len(eligible) * percent // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("most, percent", [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_draw_equals_brute_force(spark, most, percent):
    rng = random.Random(most)
    docs = [(i, " ".join(rng.choice(WORDS + ["ÉTÉ", "a_b", "7Up"]) for _ in range(rng.randint(0, 60)))) for i in range(-200, 200)]
    docs += [docs[3]] * 60 + [(None, docs[5][1]), (7, None), (-9_000_000_000_000_000_000, docs[8][1]), (9_000_000_000_000_000_000, docs[8][1]), (11, "日本語 " * 30)]
    target = [(i, " ".join(rng.choice(WORDS[:9]) for _ in range(30))) for i in range(20)] + [(None, None)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    got = resampling.resample(make(docs).repartition(5), make(target), most=most, percent=percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, drawn(docs, target, most, 2024, 20, percent)))


def test_last_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([5, -3, 1 << 40, -(1 << 63), (1 << 63) - 1]), rng.randint(-3, 3), rng.randint(0, 1 << 33)) for _ in range(300)]
    rows += [rows[0]] * 40
    df, order = spark.createDataFrame(rows, "a bigint, b bigint, c bigint"), sorted(rows)
    for k in (1, 2, 57, 171, 300, 339):
        bound = resampling.last_key(df, ["a", "b", "c"], k)
        up_to = [r for r in order if r[: len(bound)] <= bound]
        assert up_to[:k] == order[:k]
        assert len(up_to) == k or len(set(up_to[k - 1 :])) == 1
        assert df.where(resampling.up_to(["a", "b", "c"], bound)).count() == len(up_to)
    assert resampling.last_key(df, ["a", "b", "c"], len(rows)) == ()


BAD = ["idiot", "moron", "clown"]


def labelled_corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(BAD) if i % 8 else "grompf" + rng.choice(WORDS)
        docs.append((i, " ".join(words), "en", i))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_of_rows_not_learned_from(spark):
    docs, labels = labelled_corpus(random.Random(1), 900)
    docs += [(10_000, "you 1d10t you M.O.R.O.N tara suden", "en", 1), (10_001, "tara suden mipol", "en", 1), (10_002, None, "en", 1), (10_003, "", "en", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score bigint")
    labels = spark.createDataFrame([*labels, (10_000, None), (None, 1), (10_001, 7), (3, 0), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, labels)
    assert set(BAD) <= set(model.lexicon.words) and not set(WORDS) & set(model.lexicon.words)
    got = {r.doc_id: r.score for r in toxicity.scored(d, model).collect()}
    assert len(got) == len(docs) and all(0 <= x <= 1 for x in got.values())
    wrong = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0 and (got[i] >= 0.5) != (i % 4 == 0)]
    assert not wrong
    assert got[10_000] >= 0.5 > max(got[10_001], got[10_002], got[10_003])
    # The same text has the same score, whatever else the row says; a score doesn't depend on the run.
    again = d.selectExpr("doc_id + 1 AS doc_id", "text", "'zz' AS lang", "score")
    assert {r.doc_id - 1: r.score for r in toxicity.scored(again, toxicity.fit(d, labels)).collect()} == got


def test_toxicity_without_two_labels(spark):
    docs = spark.createDataFrame([(i, "idiot tara") for i in range(20)], "doc_id bigint, text string")
    for rows, score in (([], 0.0), ([(i, 0) for i in range(20)], 0.0), ([(i, 1) for i in range(20)], 1.0)):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert {r.score for r in toxicity.scored(docs, model).collect()} == {score}


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "clown": 1.0}, {"gromp": 3.0})
    get = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon, toxicity.Settings(), {})))
    found = get("You IDIOT! an 1d1ot, x x x x x x x grompfen clown")
    assert (found["strong_words"], found["strong_stems"], found["strongest_word"], found["strongest_stem"]) == pytest.approx((2 * 100 / 13, 100 / 13, 4.0, 3.0))
    assert found["weak_words"] == pytest.approx(300 / 13) and found["disguised_entries"] == pytest.approx(100 / 13)
    assert found["entries_near_you"] == pytest.approx(200 / 13) and found["second_person"] == pytest.approx(100 / 13)
    assert found["exclamations"] == pytest.approx(1 / 13) and found["capital_words"] == pytest.approx(1 / 13)
    assert not any(get("").values())
    assert toxicity.undisguised("1.d.1.0.7") == "idiot" and toxicity.undisguised("ssstupid") == "stupid"

"""Scores under the best assignment of speakers, against all assignments and plain sums."""

import itertools
import random
import time

import numpy as np
import pytest

from colloquy.operators import assignment, diarisation, score


def test_cheapest():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 4), (4, 4), (5, 6), (6, 6)]:
        for high in (3, 1000):
            cost = rng.integers(-high, high, (n, m)).astype(float)
            found = assignment.cheapest(cost)
            assert len(set(found)) == n
            best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert sum(cost[i, j] for i, j in enumerate(found)) == best


def timeline(ref, hyp, collar, end):
    """Every point of time by itself: speakers of both, and the best of all assignments."""
    at = lambda spans, t: {k for k, s, e in spans if s <= t < e}
    out = lambda t: any(x - collar // 2 <= t < x + collar // 2 for _, s, e in merged(ref) for x in (s, e))
    points = [(at(ref, t), at(hyp, t)) for t in range(-collar, end + collar) if not out(t)]
    names, others = sorted({k for k, _, _ in ref}), sorted({k for k, _, _ in hyp})
    total = sum(len(a) for a, _ in points)
    missed = sum(max(len(a) - len(b), 0) for a, b in points)
    false = sum(max(len(b) - len(a), 0) for a, b in points)
    padded = others + [None] * len(names)
    right = max(sum(len({m[x] for x in a if m[x]} & b) for a, b in points) for m in (dict(zip(names, p)) for p in itertools.permutations(padded, len(names))))
    return total, missed, false, sum(min(len(a), len(b)) for a, b in points) - right


def merged(spans):
    found = []
    for k, s, e in sorted(spans):
        if found and found[-1][0] == k and s <= found[-1][2]:
            found[-1][2] = max(found[-1][2], e)
        else:
            found.append([k, s, e])
    return found


@pytest.mark.parametrize("collar, width", [(0, 1000), (6, 17), (4, 5)])
def test_error_times_equal_a_timeline(spark, collar, width):
    rng = random.Random(collar)
    make = lambda names, n: [(rng.choice(names), s := rng.randint(0, 150), s + rng.randint(1, 30)) for _ in range(n)]
    sessions = {f"m{i}": (make("abc", 12), make("uvwx", 12)) for i in range(4)} | {"no_hyp": (make("ab", 4), []), "no_ref": ([], make("uv", 4))}
    rows = lambda side: [(k, *x) for k, v in sessions.items() for x in v[side]]
    df = lambda r: spark.createDataFrame(r, "session string, speaker string, s bigint, e bigint")
    got = {r.session: r for r in diarisation.error_times(df(rows(0)), df(rows(1)), ["session"], "speaker", collar=collar, width=width).collect()}
    for k, (ref, hyp) in sessions.items():
        expected = timeline(ref, hyp, collar, 200)
        r = got[k]
        assert (r.total, r.missed, r.false_alarm, r.confusion) == expected, k
        assert r.der == (sum(expected[1:]) / expected[0] if expected[0] else None)


def test_word_errors_of_sessions_equal_all_assignments(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    ref, hyp, expected = [], [], {}
    for i, (n, m) in enumerate([(1, 1), (2, 3), (3, 2), (4, 5), (5, 4), (2, 0), (0, 2)]):
        lines = [{f"{x}{k}": [say(rng.randint(0, 6)) for _ in range(3)] for k in range(many)} for x, many in (("r", n), ("h", m))]
        for rows, side in ((ref, lines[0]), (hyp, lines[1])):
            rows += [(i, turn, k, t) for k, ts in side.items() for turn, t in enumerate(ts)]
        words = [[" ".join(t).split() for t in side.values()] for side in lines]
        a, b = words[0] + [[]] * m, words[1] + [[]] * n
        expected[i] = (min(sum(score.edit_distance(x, b[j]) for x, j in zip(a, p)) for p in set(itertools.permutations(range(n + m)))) if n + m < 7 else None, sum(map(len, words[0])))
        if expected[i][0] is None:  # of nine places, the choice of partners for the smaller side is enough
            few, many = sorted(words, key=len)
            expected[i] = (min(sum(score.edit_distance(x, many[j]) for x, j in zip(few, p)) + sum(len(many[j]) for j in range(len(many)) if j not in p) for p in itertools.permutations(range(len(many)), len(few))), expected[i][1])
    df = lambda r: spark.createDataFrame(rng.sample(r, len(r)), "session int, turn int, speaker string, text string")
    got = diarisation.word_errors_of_sessions(df(ref), df(hyp), ["session"], "speaker", ["turn"], "text").collect()
    assert {r.session: (r.errors, r.length) for r in got} == expected


def test_edit_distance_of_long_lines():
    rng = random.Random(8)
    a = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    b = [*a[:9_000], "new", *a[9_003:20_000], *["other", "word"] * 5, *a[20_000:]]
    began = time.process_time()
    assert score.edit_distance(a, b) == 13 == score.edit_distance(b, a)
    assert time.process_time() - began < 4  # 0.7 s each; 5 s each row by row

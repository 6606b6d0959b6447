"""Each operator against brute force, a library or an exact round trip, with edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import bpe, components, fingerprints, jaccard_join, language, licenses, packed_matrices, packing, quality, registry, sentencepieces, substring_dedup, token_ids, word_hashes

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, piece string, length string, id string, n string"
ODD = [
    None,
    "",
    " ",
    "  two  spaces\n\nand\ttabs \r\n end ",
    "x<|endoftext|>y don't we'll",
    "日本語 テキスト 😀 é́ ½",
    "a" * 5000,
    " \x1c\x1d a\x85b  c",
    "▁a ▁ b",
    "word " * 3000,
]
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def real():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF_DIR}/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF_DIR)
    expected = db.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in expected.fetchall())


def other_tables(spark, folder, rows):
    """The tables besides documents, with nulls and columns of clashing names, or without rows."""
    labels = [(i, i % 2 if i % 5 else None, "x") for i in range(12)] + [(3, 1, "x"), (None, 1, "x")]
    spark.createDataFrame(labels if rows else [], "doc_id bigint, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    target = [(i, t, "x") for i, t in enumerate(ODD)]
    spark.createDataFrame(target if rows else [], "item_id bigint, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [float(i % 7)] * 64, "x") for i in range(20)] + [(None, [0.5] * 64, "x"), (3, None, "x"), (4, [1.0] * 63, "x")]
    spark.createDataFrame(vectors if rows else [], "vec_id bigint, embedding array<float>, cluster string").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_texts_repeated_rows_and_empty_tables(spark, tmp_path, name):
    docs = docs_of(spark, ODD + ODD[3:5])
    docs.union(docs.limit(3)).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    other_tables(spark, f"{tmp_path}/some", True)
    other_tables(spark, f"{tmp_path}/none", False)
    query = registry.queries()[name]
    some = query(spark, f"{tmp_path}/some").count()
    if name != "op9_substring_dedup" and not name.startswith("op10"):
        assert some >= len(ODD) + 5
    assert query(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows_without_an_id_do_no_harm(spark, tmp_path, name):
    docs = docs_of(spark, ["the first text of some words", None, "another text"])
    docs.union(docs.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})).write.parquet(f"{tmp_path}/documents.parquet")
    other_tables(spark, str(tmp_path), True)
    query = registry.queries()[name]
    assert query(spark, str(tmp_path)).count() >= (0 if name == "op9_substring_dedup" else 1)


def test_near_duplicates_of_rows_of_one_id(spark):
    rng = random.Random(3)
    a, b, c = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    rows = [(5, a), (5, b), (3, a), (6, c), (6, c), (7, b + " x"), (8, None), (8, ""), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, c), (3, a), (5, b), (6, c), (8, ""), (8, "")])


def test_pipeline_of_odd_texts_and_of_nothing(spark, tmp_path):
    rng = random.Random(9)
    docs = docs_of(spark, ODD + [prose(rng, 200) for _ in range(5)])
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} >= set(range(len(ODD), len(ODD) + 5))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_token_counts(spark, encode, real):
    texts = ODD + real
    got = {r.doc_id: r for r in bpe.count_tokens(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)


def test_sentencepiece(spark, real):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = ODD + real + ["".join(rng.choice("abcdeinorst ▁ \n") for _ in range(rng.randint(1, 60))) for _ in range(300)] + [" " * k for k in range(1, 20)]
    rows = sentencepieces.encode(docs_of(spark, texts))
    got = {r.doc_id: bytes(r.ids) for r in rows.collect()}
    back = {r.doc_id: r.text for r in sentencepieces.decode(rows).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert np.frombuffer(got[i], "<u4").tolist() == ids
        assert back[i] == library.decode(ids)


def test_lightest_path():
    t = sentencepieces.Transducer.__new__(sentencepieces.Transducer)
    t.score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0}
    t.lexicon = set(t.score)
    t.beginnings = {p[:i] for p in t.lexicon for i in range(1, len(p) + 1)}
    assert t.lightest_path("abc") == ["ab", "c"] and t.lightest_path("a?b") == ["a", "?", "b"]


def test_word_hashes():
    rng = random.Random(5)
    texts = [b"", b" ", b"a b c d"] + [" ".join(rng.choice(["aa", "b", "cc"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    w = word_hashes.words(texts)
    assert w.counts().tolist() == [len(t.split()) for t in texts]
    h, first = w.shingles(3)
    names: dict = {}
    for i, t in enumerate(texts):
        s = t.split()
        expected = [tuple(s[k : k + 3]) for k in range(max(1, len(s) - 2))] if s else []
        assert first[i + 1] - first[i] == len(expected)
        assert all(names.setdefault(a, x) == x for a, x in zip(expected, h[first[i] : first[i + 1]].tolist()))
    assert len(set(names.values())) == len(names)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_copies(rng):
    out = []
    for _ in range(25):
        base = prose(rng, rng.choice([3, 12, 40, 90, 300])).split()
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def linked_ids(texts, width, num, den):
    """Size of the set and smallest reachable number of each text, by brute force."""
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def joined_ids(docs, width, num, den):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(docs, width=width, num=num, den=den).collect()}


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 80, 100), (3, 50, 100)])
def test_jaccard_join(spark, width, num, den):
    texts = near_copies(random.Random(width)) + ODD
    assert joined_ids(docs_of(spark, texts), width, num, den) == linked_ids(texts, width, num, den)


@pytest.mark.parametrize("seed", [1])
def test_jaccard_join_of_a_large_group(spark, seed):
    """Copies of copies of one text, longer and shorter ones: links across the group are chains."""
    rng = random.Random(seed)
    texts = [prose(rng, 120)]
    for _ in range(150):
        w = rng.choice(texts if rng.random() < 0.7 else texts[:1]).split()
        for _ in range(rng.choice([1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1, 4])] = rng.choices([f"x{rng.randrange(9)}", "a", "b"], k=rng.choice([0, 1, 1, 2]))
        texts.append(" ".join(w))
    rng.shuffle(texts)
    assert joined_ids(docs_of(spark, texts), 3, 90, 100) == linked_ids(texts, 3, 90, 100)
    assert joined_ids(docs_of(spark, texts), 5, 80, 100) == linked_ids(texts, 5, 80, 100)


def test_jaccard_join_of_rows_of_one_id(spark):
    """Rows of one id with different texts are documents of their own; equal rows are one."""
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (5, a), (3, a), (4, b), (9, None), (9, a), (None, b)]
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (3, 3), (4, 4), (5, 3), (5, 3), (5, 4), (9, 3), (9, 9)]


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for size in (3, 9, 10, 15, 30, 80, 200, 1000, 3000):
            for _ in range(10):
                a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
                cut = rng.integers(0, len(a) * (den - num) // den + 1)
                added = int((len(a) - cut) * den // num - len(a)) if rng.random() < 0.5 else 0
                b = np.unique(np.concatenate([a[cut:], rng.integers(1, 1 << 63, max(0, added), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both < num * (len(a) + len(b) - both) or len(a) == both == len(b):
                    continue
                found = [{e: (need, set(s.tolist())) for k, e, need, s in jaccard_join.signatures([a, b], num, den) if k == i} for i in (0, 1)]
                met = [e for e in found[0] if e in found[1]]
                assert any(len(found[0][e][1] & found[1][e][1]) >= max(found[0][e][0], found[1][e][0]) for e in met), (size, cut)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def test_language_held_out(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = registry.queries()["op5_language_id"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = language.fit(docs)
    assert 0 < model.nonzero < 1
    odd = {r.doc_id: r for r in language.identify(docs_of(spark, [None, "", "12 !?", "the of and"]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred == "en"
    unlabelled = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, unlabelled).collect()} == {"und"}


def test_prediction_uses_the_text_only(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.fit(docs)
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    pick = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(d, model).collect())
    assert pick(docs) == pick(changed)


@pytest.mark.parametrize("seed", range(5))
def test_rounds_place_everything_without_overlap(seed):
    rng = random.Random(seed)
    histogram = collections.Counter(rng.choice([1, 2, 7, rng.randint(1, 64)]) for _ in range(rng.choice([0, 5, 300])))
    room = collections.defaultdict(list)
    for length, low, high, first, per, offset in packing.rounds(histogram, 64):
        for x in range(high - low):
            room[first + x // per].append((offset + x % per * length, length))
    assert sum(map(len, room.values())) == sum(histogram.values())
    for placed in room.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert len(room) <= least * 11 / 9 + 1


def test_packing(spark, encode, real):
    texts = ODD + real
    rows = packing.pack_documents(docs_of(spark, texts)).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array(encode(t) + [0], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 for r in own)
        assert all(r.length == 2048 for r in own[1:]) and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
    for placed in sequences.values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) * 11 / 9 + 1


def test_fingerprints(spark, real):
    texts = ODD + real[:60] + real[:2]
    rows = fingerprints.with_next(docs_of(spark, texts))
    got = {r.doc_id: r for r in rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i - 1) % n] or ""
        third = len(t) // 3
        assert got[i].edited == t[: len(t) - third] + following[:third]
        assert len(got[i].sketch) == min(fingerprints.SIZE, len(shingles_of_case(t)))
    same = [(i, j) for i in range(n) for j in range(i) if (texts[i] or "") == (texts[j] or "")]
    assert same and all(got[i].sketch == got[j].sketch for i, j in same)


def shingles_of_case(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates_and_merges(spark):
    rng = random.Random(8)
    base = prose(rng, 4000)
    other = " ".join(base.split()[:2000]) + " " + prose(rng, 2000)
    rows = fingerprints.fingerprint(docs_of(spark, [base, other]))
    a, b = F.col("a.sketch"), F.col("b.sketch")
    pair = rows.where("doc_id = 0").alias("a").crossJoin(rows.where("doc_id = 1").alias("b"))
    r, c, n = pair.select(fingerprints.resemblance(a, b), fingerprints.containment(a, b), fingerprints.distinct_shingles(a)).first()
    true = shingles_of_case(base), shingles_of_case(other)
    assert r == pytest.approx(len(true[0] & true[1]) / len(true[0] | true[1]), abs=0.15)
    assert c == pytest.approx(len(true[0] & true[1]) / len(true[0]), abs=0.2)
    assert n == pytest.approx(len(true[0]), rel=0.3)
    merged = fingerprints.merge_parts(rows.withColumn("k", F.lit(1)), ["k"]).first().sketch
    whole = sorted(set(pair.first()[2]) | set(pair.first()[5]))[: fingerprints.SIZE]
    assert merged == whole


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(k)) for k in range(0, 60, 3)] + ["a b\n\na b\n a b\n#$% c"]
    for r in quality.ledger(docs_of(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = [x.decode() for x in t.encode().split()]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)))


def test_policies_and_ablations(spark, real):
    rows = quality.ledger(docs_of(spark, real)).cache()
    kept = rows.where(quality.passes(F.col("failures"), "v1")).count()
    assert quality.passing(docs_of(spark, real)).count() == kept
    for r in quality.ablations(rows).collect():
        rest = quality.bits([x for x in quality.POLICIES["v1"] if x != r.rule])
        without = rows.where(F.col("failures").bitwiseAND(F.lit(rest).cast("bigint")) == 0).count()
        assert (r.n_kept, r.n_kept + r.n_only) == (kept, without)


def test_license_texts(spark):
    noise = "nothing to see here at all, just words"
    texts = [t for _, t in sorted(licenses.TEMPLATES.items())] + [f"{noise}\nreleased UNDER the mit   license!\n{noise}", noise, None]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, name in enumerate(sorted(licenses.TEMPLATES)):
        assert (got[i].license, got[i].dice) == (name, 1.0)
    k = len(licenses.TEMPLATES)
    assert (got[k].license, got[k].n_notices) == ("MIT notice", 1)
    assert [got[i].license for i in (k + 1, k + 2)] == [None, None]


def test_whole_license_documents(spark):
    """Whole licenses with a copyright line, over several lines."""
    names = sorted(licenses.FULL_TEXTS)
    texts = ["Copyright (c) 2020 A. Holder\n\n" + licenses.FULL_TEXTS[n].replace(". ", ".\n").replace(", ", ",\n") for n in names]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[i].license for i in range(len(names))] == names and all(got[i].dice >= 0.9 for i in range(len(names)))


def wrapped(text, mark, width, end=""):
    """A text as comment lines of so many words."""
    words = text.split(" ")
    return "\n".join(f"{mark} {' '.join(words[i : i + width])}{end}" for i in range(0, len(words), width))


@pytest.mark.parametrize(("mark", "end"), [("#", ""), (" *", " "), ("//", "\r"), ("<!--", " -->"), (";;;", "\n"), ("", "\n\n")])
def test_licenses_as_comments_in_code(spark, mark, end):
    """Wrapped over lines between code, one word in 30 changed, and two licenses in one text."""
    code = "def f(x):\n    return x + 1\n\nclass A:\n    pass\n" * 20
    long = [n for n in sorted(licenses.KNOWN) if licenses.anchors(licenses.KNOWN[n])]
    assert set(long) >= {"Apache-2.0", "BSD-2-Clause", "GPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense"}
    texts = [f"{code}{wrapped(licenses.KNOWN[n], mark, 7 + i, end)}\n{code}" for i, n in enumerate(long)]
    changed = [" ".join("changed" if j % 30 == 11 else w for j, w in enumerate(licenses.KNOWN[n].split(" "))) for n in long]
    texts += [f"{code}{wrapped(t, mark, 9, end)}\n{code}" for t in changed]
    texts += [f"{code}{wrapped(licenses.KNOWN['MIT'], mark, 9, end)}\n{code}{wrapped(licenses.KNOWN['GPL-3.0'], mark, 9, end)}\n{code}", code]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    k = len(long)
    assert [(got[i].license, got[i].dice) for i in range(k)] == [(n, 1.0) for n in long]
    family = lambda n: n.removesuffix(" text")
    assert [got[k + i].family for i in range(k)] == [family(n) for n in long] and all(got[k + i].dice >= 0.8 for i in range(k))
    assert (got[2 * k].license, got[2 * k].n_runs, got[2 * k + 1].license, got[2 * k + 1].n_runs) == ("MIT", 2, None, 0)


def test_anchors_alone_are_no_license(spark):
    """Openings, middles and ends among other words, at the ends of a text, side by side and many times."""
    rng = random.Random(5)
    phrases = [phrase for t in licenses.KNOWN.values() for _, phrase, _ in licenses.anchors(t)]
    texts = phrases + [f"{p} {prose(rng, 60)} {p}" for p in phrases] + [" ".join([p] * 200) for p in phrases] + [f"{prose(rng, 200)}\n{p}\n{prose(rng, 200)}" for p in phrases]
    got = licenses.scan(docs_of(spark, texts)).collect()
    assert [r.doc_id for r in got if r.license is not None or r.n_runs] == []


def test_compact_windows():
    rng = random.Random(5)
    for _ in range(150):
        n, t = rng.randint(1, 100), rng.randint(1, 12)
        h = [0] + [rng.randint(1, rng.choice([8, 1000])) for _ in range(n)] + [0]
        expected = set()
        for c in range(1, n + 1):
            low = high = c
            while h[low - 1] > h[c]:
                low -= 1
            while h[high + 1] >= h[c]:
                high += 1
            if high - low + 1 >= t:
                expected.add((low, c, high))
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(np.array(h, np.uint64), t)))) == expected


def test_substring_dedup(spark):
    rng = random.Random(7)
    passage, own = prose(rng, 80), [prose(rng, 120) for _ in range(12)]
    texts = [f"{own[i]} {passage} {own[i + 1]}" if i < 4 else own[i] for i in range(0, 12)]
    edited = passage.split()
    edited[40] = "another"
    texts[7] += " " + " ".join(edited)
    texts += [f"{prose(rng, 90)} {' '.join(passage.split()[:30])} {prose(rng, 90)}", texts[5]]
    docs = docs_of(spark, texts)
    found = substring_dedup.repeats(docs)
    rows = found.collect()
    assert {r.id for r in rows} == {1, 2, 3, 4, 7, 13}
    words = [t.split() for t in texts]
    for r in rows:
        a, b = words[r.id][r.first : r.last], words[r.source_id][r.source_first : r.source_last]
        x, y = shingles(" ".join(a), 5), shingles(" ".join(b), 5)
        assert len(a) >= 50 and (len(x & y) >= 0.8 * len(x | y))
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs, found).collect()}
    assert passage in cut[0] and not any(passage in cut[i] for i in (1, 2, 3)) and cut[13] == "" and all(cut[i] == texts[i] for i in (0, 5, 6, 8, 12))


def test_every_source_of_a_text_is_compared(spark):
    share = 0.9
    sources = [[f"s{k}_{i}" for i in range(60 if k else 200)] for k in range(25)]
    parts, own = [], 0
    for k, source in enumerate(sources):
        copy = list(source)
        if k:
            copy[29] = "changed"  # similar, not equal: functions need not agree
        parts += copy + [f"own{own + i}" for i in range(20)]
        own += 20
    texts = [" ".join([f"x{k}_{i}" for i in range(30)] + s) for k, s in enumerate(sources)] + [" ".join(parts)]
    rows = substring_dedup.repeats(docs_of(spark, texts)).collect()
    assert len({r.source_id for r in rows if r.id == 25}) >= share * 25


def test_exact_repeats_behind_unrelated_texts(spark):
    """Each passage's minima stand in phrases and in long blocks of earlier texts, several of each."""
    rng, texts, pairs = random.Random(5), [], []
    passages = [[f"q{k}_{i}" for i in range(50)] for k in range(6)]
    own = iter(f"o{i}" for i in range(10**6))
    some = lambda n: [next(own) for _ in range(n)]
    for length in (8, 16, 30, 44):
        for q in passages:
            for start in range(0, 51 - length, 3):
                texts.append(some(40) + q[start : start + length] + some(40))
    for q in passages:
        pairs.append((len(texts), len(texts) + 1))
        texts += [some(60) + q + some(60), some(rng.randrange(50, 90)) + q + some(70)]
    texts += [some(200) for _ in range(300)]
    boilerplate = some(48)
    texts += [some(60) + boilerplate + some(60) for _ in range(40)]
    found = substring_dedup.repeats(docs_of(spark, [" ".join(t) for t in texts]), similarity=0.99).collect()
    for b, c in pairs:
        assert any(r.id == c and r.source_id == b and r.last - r.first >= 50 for r in found)


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
def test_passages_with_an_edit_anywhere(kind):
    rng, wrong = random.Random(11), []
    for n in (*range(50, 72), 80, 100):
        passage = [f"p{n}_{i}" for i in range(n)]
        b = [f"b{i}" for i in range(90)] + passage + [f"c{i}" for i in range(90)]
        for k in range(n):
            edited = passage[:k] + {"changed": ["new"], "put in": ["new", passage[k]], "left out": []}[kind] + passage[k + 1 :]
            x, y = shingles(" ".join(edited), 5), shingles(" ".join(passage), 5)
            if len(edited) < 50 or len(x & y) < 0.8 * len(x | y):
                continue
            a = [f"d{i}" for i in range(70)] + edited + [f"e{i}" for i in range(70)]
            ha, hb = (word_hashes.words([" ".join(t).encode()]).shingles(5)[0] for t in (a, b))
            met = [(i, int(np.flatnonzero(hb == h)[0])) for i, h in enumerate(ha) if h in hb]
            for i, j in {met[0], met[-1], rng.choice(met)}:
                found = substring_dedup.passages(ha, hb, [(i - j, i)], 46, 0.8, False)
                good = [(s, e) for s, e, s2, e2 in found if s <= i <= e and len(set(ha[s : e + 1]) & set(hb[s2 : e2 + 1])) >= 0.8 * len(set(ha[s : e + 1]) | set(hb[s2 : e2 + 1]))]
                if len(good) != 1 or good[0][1] + 1 - good[0][0] < 46:
                    wrong.append((n, k, i))
    assert not wrong


def test_packed_matrices(spark, encode, real):
    texts = ODD + real
    rows = packed_matrices.matrices(docs_of(spark, texts), block_tokens=20_000)
    got = collections.defaultdict(list)
    for r in packed_matrices.unpacked(rows).collect():
        got[r.doc_id].append((r.start, bytes(r.ids)))
    for i, t in enumerate(texts):
        assert b"".join(x for _, x in sorted(got[i])) == np.array(encode(t) + [50256], "<u4").tobytes()
    for r in rows.collect():
        positions = np.frombuffer(r.position_ids, "<u4")
        assert len(r.input_ids) == len(r.position_ids) == 4 * 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        assert all(positions[a] == 0 and positions[b - 1] == b - a - 1 for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
    rows = packed_matrices.best_fit_decreasing(lengths, 50)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        room = [f for f in free if f >= n]
        if room:
            free.remove(min(room))
        free.append((min(room) if room else 50) - n)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths))) and len(rows) == len(free)


def test_edited_digest(spark):
    rows = registry.queries()["op7_fingerprints"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for r in rows:
        t = texts[r.doc_id]
        third = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - third] + texts[following[r.doc_id]][:third]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def covered_words(spark, texts):
    rows = substring_dedup.repeats(docs_of(spark, texts)).collect()
    places = collections.defaultdict(set)
    for r in rows:
        places[r.id].update(range(r["first"], r["last"]))
    return places


@pytest.mark.parametrize("seed, common", [(1, 30), (2, 40)])
def test_exact_repeats_with_common_words_inside(spark, seed, common):
    """Passages of 60 words, each in two texts, that all hold the same words in their middle."""
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    middle, side = fresh(common), (60 - common) // 2
    passages = [f"{fresh(side)} {middle} {fresh(60 - common - side)}" for _ in range(150)]
    texts = [f"{fresh(70)} {p} {fresh(70)}" for p in passages + passages]
    places = covered_words(spark, texts)
    assert all(len(places[i] & set(range(70, 130))) >= 48 for i in range(150, 300))
    assert sum(len(places[i]) for i in range(150)) == 0


def test_recall_of_near_repeats(spark):
    """Passages of 60 to 100 words of Jaccard similarity 0.8 or a little more, by brute force."""
    rng = random.Random(7)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    first, second, wanted = [], [], []
    for _ in range(200):
        p = fresh(rng.randrange(50, 101))
        q = list(p)
        while True:
            r = list(q)
            k = rng.randrange(len(r))
            r[k : k + rng.choice([0, 1, 1])] = fresh(rng.choice([1, 1, 2]))
            a, b = shingles(" ".join(p), 5), shingles(" ".join(r), 5)
            if len(a & b) < 0.8 * len(a | b):
                break
            q = r
        first.append(" ".join(fresh(40) + p + fresh(40)))
        second.append(" ".join(fresh(40) + q + fresh(40)))
        wanted.append(set(range(40, 40 + len(q))))
    places = covered_words(spark, first + second)
    assert sum(len(places[200 + i] & w) >= 0.8 * len(w) for i, w in enumerate(wanted)) >= 190
    assert sum(len(places[200 + i] - w) for i, w in enumerate(wanted)) < 200 * 20


def test_repeats_of_rows_of_one_id(spark):
    rng = random.Random(5)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (2, f"{a} x {b}"), (2, c), (2, c), (3, b), (4, c), (4, a), (None, a), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeats(docs)
    kept = sorted((r.doc_id or 0, r.text or "") for r in substring_dedup.without_repeats(docs, found).collect())
    assert (0, a) in kept and (1, a) in kept and (5, "") in kept
    assert [i for i, t in kept if a in t] == [0, 1]
    assert len([i for i, t in kept if b in t]) == 1
    assert len({i for i, t in kept if c in t}) == 1
    assert substring_dedup.cut_words("a b", [(10, 20)]) == "a b"


def test_reach_of_windows_may_be_bounded():
    rng = np.random.default_rng(4)
    h = np.concatenate([[0], rng.integers(1, 60, 300), [0], rng.integers(1, 1 << 60, 200), [0]]).astype(np.uint64)
    for width in (5, 46):
        left, c, right = substring_dedup.compact_windows(h, width)
        near = substring_dedup.compact_windows(h, width, width - 1)
        assert np.array_equal(c, near[1])
        assert np.array_equal(np.minimum(c - left, width - 1), np.minimum(c - near[0], width - 1))
        assert np.array_equal(np.minimum(right - c, width - 1), np.minimum(near[2] - c, width - 1))


def test_sample_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0)] * 50 + [(i, "a", f"t{i}", 0) for i in range(2, 40)] + [(1, "b", "y", 0)] * 9, "_id long, _lang string, _text string, _fold int")
    got = language.sampled(rows, language.Settings(sample=10)).collect()
    assert len(got) == 11 and len({(r._id, r._lang) for r in got}) == 11


def test_repeats_are_the_same_under_every_plan(spark):
    rng = random.Random(11)
    pool = [prose(rng, 90) for _ in range(6)]
    texts = [" ".join([prose(rng, rng.randint(0, 20)), *rng.sample(pool, 3), prose(rng, 10)]) for _ in range(18)]
    texts += [" ".join(t.split()[: 60 + 20 * k]) + " " + prose(rng, 30) for k, t in enumerate(texts[:6])]
    docs = docs_of(spark, texts)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k, None) for k in names}
    found = []
    try:
        for settings in (("-1", "-1", "4", "true", "256MB", "5", "64MB"), ("-1", "-1", "7", "false", "1KB", "1.1", "1KB"), ("10MB", "10MB", "4", "true", "256MB", "5", "64MB")):
            for k, v in zip(names, settings):
                spark.conf.set(k, v)
            found.append(sorted(map(tuple, substring_dedup.repeats(docs).drop("text_hash").collect())))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found[0]) > 40 and found[0] == found[1] == found[2]


def forms(rng, n):
    """A template of 120 words with 8 fields of 6 values each."""
    base = [f"t{i}" for i in range(120)]
    fields, texts = sorted(rng.sample(range(3, 117), 8)), []
    for _ in range(n):
        words = list(base)
        for f in fields:
            words[f] = f"v{f}x{rng.randrange(6)}"
        texts.append(" ".join(words))
    return texts


def test_forms_are_not_all_compared(spark, monkeypatch):
    seen = []
    compare = jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "compared", lambda pairs, *more: seen.append(pairs.count()) or compare(pairs, *more))
    rates = []
    for n in (300, 900):
        texts = forms(random.Random(n), n)
        seen.clear()
        got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs_of(spark, texts)).collect()}
        sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
        places = {}
        for k, s in enumerate(sets):
            places.setdefault(frozenset(s), k)
        matrix = np.zeros((n, len(set().union(*sets))), np.float32)
        numbers = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
        for k, s in enumerate(sets):
            matrix[k, [numbers[x] for x in s]] = 1
        both, size = matrix @ matrix.T, matrix.sum(1)
        linked = 100 * both >= 90 * (size[:, None] + size[None] - both)
        expected = np.arange(n)
        while True:
            least = np.where(linked, expected[None], n).min(1)
            if (least == expected).all():
                break
            expected = least
        assert [got[k] for k in range(n)] == expected.tolist()
        rates.append(sum(seen) / n)
    assert rates[1] <= 40, rates  # 450 in all pairs


def test_license_sql_has_every_template(spark):
    rng = random.Random(8)
    texts = [x for t in licenses.KNOWN.values() for x in (t, prose(rng, 30) + "\n\n" + t + "\n\n" + prose(rng, 9), t.replace(". ", ".\n"), prose(rng, 20) + "\n" + wrapped(t, "#", 8) + "\n" + prose(rng, 20), t + " " + t, t[: len(t) // 2])] + ["", prose(rng, 50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    expected = con.sql(registry.oracle_sql()["op1_license_scan"])
    got = licenses.scan(docs_of(spark, texts)).select(*expected.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected.fetchall()))
    assert {r.license for r in got} >= set(licenses.KNOWN)


def test_near_repeats_behind_a_phrase_of_many_texts(spark):
    """Pairs that share 56 shingles but one word, 36 of them in all texts, the first like no other."""
    number = iter(range(100_000))
    fresh = lambda n: [f"x{next(number)}" for _ in range(n)]
    phrase, rows = [f"c{i}" for i in range(40)], []
    rows.append((0, " ".join(fresh(60) + phrase + fresh(60))))
    for i in range(1, 60, 2):
        own = fresh(20)
        for k, last in enumerate((own, own[:9] + fresh(1) + own[10:])):
            rows.append((i + k, " ".join(fresh(40) + phrase + last + fresh(40))))
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.id, r.source_id) for r in found.collect()} == {(i + 1, i) for i in range(1, 60, 2)}


def test_signatures_are_shuffled_in_parts(spark, monkeypatch):
    """No table of signatures is written, and so none is shuffled for it, as a whole; the links are the same."""
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(60)]
    texts += [t + " end" for t in texts[:30]]
    sizes, write = [], jaccard_join.written

    def seen(df):
        done = write(df)
        if df.columns == ["node", "entry", "need", "sigs"]:
            sizes.append(("sets", done.count()))
        elif "key" in df.columns and "need" in df.columns and "found" not in df.columns:
            sizes.append(("keys", done.count()))
        return done

    monkeypatch.setattr(jaccard_join, "written", seen)
    found = sorted(map(tuple, jaccard_join.similar(docs_of(spark, texts)).collect()))
    each = {kind: [n for k, n in sizes if k == kind] for kind in ("sets", "keys")}
    assert len(each["sets"]) == jaccard_join.SET_PARTS and max(each["sets"]) < 0.5 * sum(each["sets"])
    assert max(each["keys"][: jaccard_join.KEY_PARTS]) < 0.7 * sum(each["keys"][: jaccard_join.KEY_PARTS])
    monkeypatch.setattr(jaccard_join, "SET_PARTS", 1)
    monkeypatch.setattr(jaccard_join, "KEY_PARTS", 1)
    assert sorted(map(tuple, jaccard_join.similar(docs_of(spark, texts)).collect())) == found
    assert sum(r[2] != r[0] for r in found) >= 25


def test_words_of_copies_alone_are_counted(spark):
    """Words are counted after the join with the copies, not of every text before it."""
    rng = random.Random(3)
    copy = prose(rng, 60)
    found = substring_dedup.repeats(docs_of(spark, [copy, prose(rng, 70), copy, "few words"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "regexp_extract_all" in line]  # what Spark puts for regexp_count
    assert counts and all("source_id" in line for line in counts)
    assert [tuple(r)[:6] for r in found.collect()] == [(2, 0, 60, 0, 0, 60)]


@pytest.mark.parametrize("seed", range(5))
def test_places_that_match_are_counted_alike_both_ways(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 300, 400).astype(np.int32)
    b = np.concatenate([rng.integers(0, 300, 30), a[50:170], rng.integers(0, 300, 9), a[170:330]]).astype(np.int32)
    anchors = [(i - j, i) for i in range(0, 400, 3) for j in (i - 20, i - 11, i + 40) if 0 <= j < len(b)]
    found = []
    for dense in (1, 8, 1 << 30):
        monkeypatch.setattr(substring_dedup, "DENSE", dense)
        found.append(substring_dedup.passages(a, b, anchors, 46, 0.8, False))
    assert found[0] == found[1] == found[2] and found[0]


def test_pipeline_tasks_hold_few_python_workers(spark):
    """Texts are cut once, by one worker of a task, also where the result is filtered; the ranges of the
    packing need no worker to be read; and a worker keeps no words when its task is done."""
    docs = docs_of(spark, [f"{' '.join(f'w{i}' for i in range(60))} {x}" for x in ("a", "b", "c")])
    found = substring_dedup.repeats(docs)
    cut = substring_dedup.without_repeats(docs, found).withColumn("n_chars", F.length("text")).where(F.col("text").rlike("[a-z]"))
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in cut.collect()}[1].split() == ["b"]
    packed = packing.pack_documents(docs, with_ids=False)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.piece, r.sequence_id) for r in packed.collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert packing.pack_documents(docs.limit(0), with_ids=False).count() == 0
    with token_ids.encoding() as encoder:
        assert encoder.encode("some words") and encoder.of_word
    assert not token_ids.token_ids().of_word


@pytest.mark.parametrize("seed", range(20))
def test_leads_of_windows(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 300))
    text, key, left, right = np.sort(rng.integers(0, 8, n)), *(rng.integers(0, k, n) for k in (30, 3, 4))
    expected, seen = [], set()
    for t, k, x, y in zip(text.tolist(), key.tolist(), left.tolist(), right.tolist()):
        each = [(t, k), (t, k, "left", x), (t, k, "right", y)]
        expected.append(sum(1 << bit for bit, name in enumerate(each) if name not in seen))
        seen.update(each)
    assert substring_dedup.leads(text, key, left, right).tolist() == expected


def test_first_rows_come_with_their_keys(spark, monkeypatch):
    """Rows of repeated keys are joined once, and only those that are wanted."""
    rng, tables_of = random.Random(4), []
    rows = sorted({(rng.randrange(6), rng.randrange(12) - 3, rng.randrange(40)) for _ in range(150)} | {(9, 1, 1), (8, -(2**63), 5), (8, 2**63 - 1, 0)})
    leads = {min(r for r in rows if r[:2] == kind) for kind in {r[:2] for r in rows}}
    rows = [(*r, f"x{r[2]}", r in leads, rng.random() < 0.3) for r in rows]
    rng.shuffle(rows)
    write = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df: tables_of.append(df.columns) or write(df))
    df = spark.createDataFrame(rows, "key bigint, id bigint, c int, x string, lead boolean, open boolean").repartition(5)
    for wanted in (None, "open"):
        expected = []
        for key, i, c, x, _, is_open in rows:
            of_key = sorted(r[1:4] for r in rows if r[0] == key)
            if len(of_key) > 1 and (is_open or not wanted):
                expected.append((key, i, c, x, len(of_key), *of_key[0]))
        got = substring_dedup.with_first(df, "x", lead=F.col("lead"), wanted=wanted)
        assert sorted(tuple(r) for r in got.select("key", "id", "c", "x", "many", "source_id", "s", "first_x").collect()) == sorted(expected)
    assert len(tables_of) == 4


def test_sequences_in_passages_found_are_not_joined(spark, monkeypatch):
    """Sequences that lie in passages found are sources for others, and aren't joined themselves: of 30 texts that
    share 90 words in all places but a few at most those around the other words are."""
    rng, joined = random.Random(8), []
    shared = [f"s{i}" for i in range(90)]
    half = [f"h{i}" for i in range(30)]
    some = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    texts = [some(30) + shared + some(60) + half + some(30) for _ in range(30)]
    write = substring_dedup.written

    def watched(df):
        out = write(df)
        if "s" in df.columns and "many" in df.columns:
            joined.append(out.count() if "c" in df.columns else None)
        return out

    monkeypatch.setattr(substring_dedup, "written", watched)
    found = substring_dedup.repeats(docs_of(spark, [" ".join(t) for t in texts])).collect()
    assert {r.id for r in found if r.first <= 30 and r.last >= 120 and r.source_id < r.id} == set(range(1, 30))
    assert len(joined) == 6 and joined[5] < 30 * 60

"""Operators 4 and 10 against brute force."""

import hashlib
import random

import pytest

from graphloom.llm import repeated_words, suffix_repeats
from graphloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(12)]
    out = []
    for i in range(60):
        t = rng.choice(base)
        a = rng.randint(0, len(t) // 2)
        out.append((i, " ".join(word() for _ in range(rng.randint(0, 20))) + " " + t[a : a + rng.randint(40, 600)] + "\n" + rng.choice(base)[:300]))
    out += [(60, None), (61, ""), (62, " \t\n"), (63, "ab" * 400), (64, "ab" * 300), (65, base[0]), (66, base[0]), (67, "x " * 200), (70, "one two")]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, block string").repartition(3)


def words_by_force(got, texts):
    words = {i: (t or "").encode().split() for i, t in texts}
    count: dict = {}
    for w in words.values():
        for k in range(len(w) - 34):
            key = b" ".join(w[k : k + 35])
            count[key] = count.get(key, 0) + 1
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[b" ".join(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def bytes_by_force(got, texts):
    first: dict = {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [1, 4096])
def test_words(spark, texts, hot):
    """Also with nearly every key split."""
    words_by_force({r.doc_id: r for r in repeated_words.dedup(frame(spark, texts), hot=hot).collect()}, texts)


@pytest.mark.parametrize("hot", [1, 4096])
def test_bytes(spark, texts, hot):
    bytes_by_force({r.doc_id: r for r in suffix_repeats.dedup(frame(spark, texts), hot=hot).collect()}, texts)


@pytest.mark.parametrize("name, by_force", [("op4_repeated_words", words_by_force), ("op10_suffix_repeats", bytes_by_force)])
def test_queries(spark, name, by_force):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    by_force(got, texts)
    assert "kept" not in next(iter(got.values()))


def test_hot_passages(spark):
    """A passage that a third of all documents hold, each between words of its own: its keys are split, and nothing is lost."""
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = own(60)
    texts = [(i, f"{own(12)} {passage} {own(12)}" if i % 3 == 0 else own(30)) for i in range(240)]
    words_by_force({r.doc_id: r for r in repeated_words.dedup(frame(spark, texts), hot=20).collect()}, texts)
    bytes_by_force({r.doc_id: r for r in suffix_repeats.dedup(frame(spark, texts), hot=20).collect()}, texts)


def test_words_of_one_hash(spark):
    """Two words that a polynomial modulo 2**64 cannot tell apart (Thue-Morse words) are not equal."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [(1, f"{a} {rest}"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} {rest}"), (3, "x " * 3)]
    got = repeated_words.dedup(frame(spark, texts)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_repeated_rows(spark):
    """Repeated ids, null ids and columns with the operators' own names."""
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_removed", "'x' AS kept", "2 AS block")
    n = len(text.encode())
    assert sorted(((r.doc_id or 0), r.n_removed) for r in suffix_repeats.dedup(docs).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, n), (3, 0)]
    assert sorted(((r.doc_id or 0), r.n_removed) for r in repeated_words.dedup(docs).collect()) == [(0, 0), (0, 50), (1, 50), (1, 50), (2, 50), (3, 0)]


def test_groups(spark, texts):
    """A group's occurrences have equal text and are all there are; every string that two documents hold lies in a group."""
    found: dict = {}
    for r in suffix_repeats.groups(frame(spark, texts), hot=50).collect():
        found.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    raw = {i: (t or "").encode() for i, t in texts}
    covered: dict = {}
    for (_, length), places in found.items():
        strings = {raw[d][s : s + length] for d, s in places}
        assert len(strings) == 1 and len(places) > 1 and length >= 50
        for d, s in places:
            covered.setdefault(d, set()).update(range(s, s + length - 49))
    where: dict = {}
    for i, b in raw.items():
        for k in range(len(b) - 49):
            where.setdefault(b[k : k + 50], []).append((i, k))
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            assert all(s in covered[d] for d, s in places)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_repeats.groups(none).count() == 0
    assert repeated_words.dedup(none).count() == 0 and suffix_repeats.dedup(none).count() == 0

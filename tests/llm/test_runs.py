"""Periodic runs against comparison of every text with itself at every shift."""

import random
import zlib

import numpy as np
import pytest

from triagelake.llm import queries, runs

SMALL = "/root/testdata/sf0.001"


def some_text(rng, n, kinds):
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    shape = rng.randrange(6)
    if shape == 1 and n:
        p = rng.randrange(1, n + 1)
        return [words[i % p] for i in range(n)]
    if shape == 2 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // 3
        return [words[i if i < a else a + (i - a) % p] for i in range(n)]
    if shape == 3:
        unit, words = words[: n // 7 + 1], []
        while len(words) < n:
            words += unit * rng.randrange(1, 4) + [b"s%d" % rng.randrange(9)]
    if shape == 4:  # Fibonacci words hold as many runs as words can
        a, words = [b"a"], [b"a", b"b"]
        while len(words) < n:
            a, words = words, words + a
        return words[:n]
    if shape == 5:  # and Thue-Morse words defeat weak hashes
        words = [b"a"]
        while len(words) < n:
            words = words + [b"b" if w == b"a" else b"a" for w in words]
        return words[:n]
    return words


def brute(texts, least=runs.LEAST):
    ids, cuts = runs.word_ids(texts)
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        found += [(s + a, e + a, q) for s, e, q in runs.plain(ids[a:b], least).T]
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_every_shift():
    rng, total = random.Random(1), 0
    for _ in range(300):
        texts = [some_text(rng, rng.randrange(0, 90), rng.choice([1, 2, 3, 8, 50])) for _ in range(6)]
        want = brute(texts)
        assert [tuple(r) for r in runs.all_runs(*runs.word_ids(texts)).T] == want
        total += len(want)
    assert total > 3000


def test_long_repetitive_texts():
    rng = random.Random(2)
    unit = [b"%d" % rng.randrange(5000) for _ in range(1500)]
    texts = [[b"x"] * 4000, unit * 3 + unit[:700], unit, some_text(random.Random(5), 2500, 2)]
    assert [tuple(r) for r in runs.all_runs(*runs.word_ids(texts)).T] == brute(texts)


def test_grammar_spells_the_text():
    """Every symbol stands for the same words at all of its places."""
    rng = random.Random(3)
    texts = [some_text(rng, 200, 6) for _ in range(20)]
    ids, cuts = runs.word_ids(texts)
    nodes, places, outer = runs.repair(ids, cuts, 2)
    for rule, at in places.T:
        left, middle, right = nodes[:, rule]
        assert left < middle < right and np.array_equal(ids[left:right], ids[at : at + right - left])
    assert len(set(places[0].tolist())) == nodes.shape[1]
    # A text of one word over and over needs about as many symbols as its length has bits.
    ids, cuts = runs.word_ids([[b"w"] * 1024])
    nodes, places, outer = runs.repair(ids, cuts, 2)
    assert nodes.shape[1] == 9 and outer[:-1].sum() == 2


def test_wrong_hashes_do_no_harm(monkeypatch):
    rng = random.Random(4)
    texts = [some_text(rng, 60, 3) for _ in range(40)]
    monkeypatch.setattr(runs.Extend, "same", lambda self, a, n, q: np.ones(len(a), bool))
    got = [tuple(r) for r in runs.all_runs(*runs.word_ids(texts)).T]
    assert got == brute(texts)


def test_odd_rows(spark):
    line = "a b c " * 5
    rows = [(None, line, 1, "r"), (1, None, 1, "r"), (1, "", 1, "r"), (2, " \t\n", 2, "r"), (3, line, 3, "r"), (3, line, 3, "r"),
            (4, "é x " * 12, 4, "r"), (5, "one", 5, "r"), (6, "w " * 50_000, 6, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, body string")
    got = runs.detect(df, keep=("doc_id", "body", "runs")).collect()
    told = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.body) for r in got)
    three = (15, [(0, 15, 3)], "a b c", "r")
    assert told == sorted([
        ("None", *three), ("1", 0, [], "", "r"), ("1", 0, [], "", "r"), ("2", 0, [], "", "r"), ("3", *three), ("3", *three),
        ("4", 12, [(0, 12, 1)], "é x", "r"), ("5", 1, [], "one", "r"), ("6", 50_000, [(0, 50_000, 1)], "w", "r"),
    ])
    assert runs.detect(df.limit(0)).count() == 0


def test_repeating_follows_the_rule(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in queries.repeating(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    changed = 0
    for i, text in docs.items():
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
            changed += 1
        assert got[i] == text
    assert changed > 5


@pytest.mark.parametrize("text", [None, "", "  "])
def test_rule_on_odd_texts(spark, text):
    df = spark.createDataFrame([(None, text), (8, text), *[(i, text) for i in range(40)]], "doc_id long, text string")
    assert {r.text for r in queries.repeating(df).collect()} == {text}

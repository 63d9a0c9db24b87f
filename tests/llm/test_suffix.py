"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from triagelake.llm import suffix


def brute(rows):
    """Removed bytes by the rule itself; rows are (id, text) in order of precedence."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, **options):
    got = suffix.dedup(df, **options).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)


@pytest.mark.parametrize("letters", [2, 3, 20, 250])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 5, 50, 400):
        for text in (rng.integers(1, letters, n), np.tile(rng.integers(1, letters, 7), n)[:n], np.ones(n, int)):
            text = np.r_[text, 0].astype(np.int16)
            want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
            assert suffix.suffix_array(text).tolist() == want


def test_common_prefixes():
    rng = np.random.default_rng(1)
    raw = np.r_[np.tile(rng.integers(0, 2, 60), 5), rng.integers(0, 3, 100)].astype(np.uint8)
    raw = np.r_[raw, 0].astype(np.uint8)
    array = suffix.suffix_array(np.r_[raw[:-1].astype(np.int16) + 1, 0].astype(np.int16))
    got = suffix.common_prefixes(raw, array, np.ones(len(raw), bool), 100)
    b = raw.tobytes() + b"\0" * 200
    for x, y in zip(array[:-1].tolist(), array[1:].tolist()):
        n = 0
        while n < 100 and b[x + n] == b[y + n]:
            n += 1
        assert got[y] == n


def made_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared = [some(n) for n in (20, 40, 41, 90, 300)]
    rows = []
    for i in range(60):
        parts = [some(rng.randrange(0, 60)) for _ in range(3)] + rng.sample(shared, rng.randrange(0, 4))
        if i % 7 == 0:
            parts.append("ab" * rng.randrange(10, 200))
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    for i in range(60, 80):
        t = list(rows[i - 60][1])
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    return rows + [(80, None), (81, ""), (82, "x" * 99), (83, "x" * 100), (84, "x" * 250), (85, rows[4][1]), (86, "\0" * 150 + "y"), (87, "\0" * 150 + "z")]


def test_dedup_is_brute_force(spark):
    rows = made_rows()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n_bytes int, body string")
    want = sorted(brute(rows))
    assert sum(r[2] for r in want) > 5000
    assert run(df.repartition(7)) == want
    assert run(df, shard_bytes=300) == want


def test_ends_of_a_common_passage_stay_out_of_suffix_arrays(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, others = some(260), [some(150) for _ in range(3)]
    rows = [(i, some(120) + passage + some(120) + (others[i % 3] if i % 9 == 0 else "")) for i in range(120)]
    log, whole = tmp_path / "sizes", suffix.repeated

    def logged(bodies, *rest):
        with open(log, "a") as f:
            f.write(f"{sum(map(len, bodies))}\n")
        return whole(bodies, *rest)

    compare = suffix.compare_windows.__globals__
    monkeypatch.setitem(compare, "repeated", logged)
    for common in (10, 10_000):
        monkeypatch.setattr(suffix, "COMMON", common)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert run(df, shard_bytes=3000) == sorted(brute(rows))
    # The bound is on single anchors; a shard may still hold a few of them.
    assert not log.exists() or max(map(int, log.read_text().split())) < 12_000


def test_long_texts_are_sliced_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 1 << 10)
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, long_), (2, "é" + long_[:5000] + "-" + long_[4000:]), (3, long_ * 2)]
    got = [r for r in map(tuple, sorted(_local(rows)))]
    assert got == sorted(brute(rows))


def _local(rows):
    """The steps' own functions, without tasks of their own, so that the slice is the small one."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["doc", "text_hash", "_text"])
    dealt = pa.Table.from_batches(list(suffix.anchors([batch]))).sort_by("anchor")
    found = [r for b in suffix.compare_snippets(dealt.to_batches(max_chunksize=50)) for r in b.to_pylist()]
    bodies = {i: t.encode() for i, t in rows}
    open_ = [r for r in found if r["anchor"] is not None]
    ranges = [r for r in found if r["anchor"] is None]
    if open_:
        got = suffix.repeated([bodies[r["doc"]][r["start"] : r["end"]] for r in open_], *(np.array([r[c] for r in open_]) for c in ("doc", "text_hash", "start")))
        ranges += suffix.found_places(*got).to_pylist()
    for i, b in bodies.items():
        runs = suffix.merged([r for r in ranges if r["doc"] == i])
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(b)]))
        yield i, len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(None, t), (1, t), (2, "new " * 5), (2, "new " * 5), (3, t[:150]), (3, t[:150])], "doc_id long, text string")
    got = sorted(suffix.dedup(df).collect(), key=repr)
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 300), (2, 0), (2, 0), (3, 150), (3, 150), (None, 0)]
    assert suffix.dedup(df.limit(0)).count() == 0

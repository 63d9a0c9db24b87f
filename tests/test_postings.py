"""Search by postings against all scores, with and without pruning."""

import collections
import math
import os
import random
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.operators import features, postings, retrieval
from triagelake.session import checkpoint


def brute(queries, corpus, k, exclude_self=False):
    """The k best rows of every query from all pairs."""
    count = lambda t: collections.Counter((t or "").split())
    df = collections.Counter(w for _, t in corpus for w in count(t))
    idf = {w: math.log((1 + len(corpus)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(t):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in count(t).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    rows = [(i, vector(t)) for i, t in corpus]
    out = set()
    for q, t in queries:
        mine = vector(t)
        scored = [(-round(sum(x * v.get(w, 0.0) for w, x in mine.items()), 6), i) for i, v in rows if not (exclude_self and i == q)]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def told(hits):
    return {(r.query_id, r["rank"], r.corpus_id, round(r.similarity, 6) + 0.0) for r in hits.collect()}


def frames(spark, queries, corpus):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "corpus_id long, text string").repartition(3)


@pytest.fixture(params=[(200_000, 14, 9), (0, 14, 9), (0, 4, 2)], ids=["whole", "pruned", "small tiles"])
def sizes(request, monkeypatch):
    cheap, range_, block = request.param
    monkeypatch.setattr(postings, "CHEAP", cheap)
    monkeypatch.setattr(postings, "SEED", 30)
    monkeypatch.setattr(postings, "RANGE", range_)
    monkeypatch.setattr(postings, "BLOCK", block)


def test_best_rows_are_those_of_all_pairs(spark, sizes):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    corpus = [(i * 10 % 301, text(rng.randrange(1, 40))) for i in range(301)]
    # Near copies have high floors; common words, unknown words and nothing have none.
    queries = [(i, corpus[i * 5][1] + " " + text(3)) for i in range(50)] + [(60, "w0 w1 w0"), (61, "w0"), (62, "nothing known"), (63, ""), (64, None)]
    corpus += [(1000 + i, "w399 w398") for i in range(20)] + [(2000, ""), (2001, None)]
    queries.append((65, "w399 w398"))
    asked, rows = frames(spark, queries, corpus)
    got = told(retrieval.sparse_search(asked, rows, 5, ngrams=(1, 1)))
    assert got == brute(queries, corpus, 5)
    ours = [(i, t) for i, t in corpus if i < 60]
    asked, _ = frames(spark, ours, corpus)
    assert told(retrieval.sparse_search(asked, rows, 4, ngrams=(1, 1), exclude_self=True)) == brute(ours, corpus, 4, True)


def test_few_rows_are_scored(spark, monkeypatch):
    """Pairs completed and sums formed stay the same when the corpus grows by unrelated rows."""
    monkeypatch.setattr(postings, "CHEAP", 0)
    monkeypatch.setattr(postings, "SEED", 200)
    rng = random.Random(2)
    seen = []
    for n in (1000, 4000):
        rows = [(i, " ".join([f"topic{i // 8}a", f"topic{i // 8}b", f"topic{i // 8}c", f"own{i}", f"common{rng.randrange(3)}"])) for i in range(n)]
        asked, corpus = frames(spark, rows[:80], rows)
        counts = postings.numbered_counts(asked, "query_id", "text", (1, 1), "qid")
        index = postings.build(corpus, (1, 1), features.asked_terms(counts))
        search = postings.Search(counts, index, 5)
        pairs = search.candidates()
        assert pairs.where("whole").count() == 0
        seen.append(pairs.count())
        assert told(postings.top_k(counts, index, 5)) == brute(rows[:80], rows, 5)
    assert seen[0] == seen[1] <= 80 * 16


def test_saved_index_is_joined_without_moving_it(spark, tmp_path):
    rows = [(i, f"a{i % 7} b{i % 11} c{i}") for i in range(200)]
    asked, corpus = frames(spark, [(i, t) for i, t in rows[:20]], rows)
    retrieval.save_index(corpus, str(tmp_path / "i"), (1, 1))
    index = retrieval.load_index(spark, str(tmp_path / "i"))
    assert told(retrieval.search_index(asked, index, 3, (1, 1))) == brute(rows[:20], rows, 3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = asked.select(F.explode(F.split("text", " ")).alias("term")).groupBy("term").count().join(index["terms"], "term")
        plan = plan.join(index["postings"], "tid")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(key, before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for part in ("terms", "postings"):
        at = next(i for i, line in enumerate(plan) if "FileScan" in line and postings.table_name(str(tmp_path / "i"), part) in line)
        assert "Bucketed: true" in plan[at]
        level = depth(plan[at])
        for line in reversed(plan[:at]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line, plan
                if "Join" in line:
                    break
    # Another session knows the files alone.
    for part in ("terms", "postings"):
        spark.sql(f"DROP TABLE {postings.table_name(str(tmp_path / 'i'), part)}")
    again = retrieval.load_index(spark, str(tmp_path / "i"))
    assert told(retrieval.search_index(asked, again, 3, (1, 1))) == brute(rows[:20], rows, 3)


def test_nothing_to_search(spark):
    asked, corpus = frames(spark, [(1, "a b")], [(1, "a")])
    assert retrieval.sparse_search(asked, corpus.limit(0)).count() == 0
    assert retrieval.sparse_search(asked.limit(0), corpus).count() == 0


def test_postings_are_shipped_once_for_many_blocks(spark, monkeypatch):
    """128 blocks of queries are shipped the postings as 32."""
    monkeypatch.setattr(postings, "BLOCK", 2)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=12))) for i in range(512)]
    asked, corpus = frames(spark, rows, rows)
    counts = postings.numbered_counts(asked.coalesce(1), "query_id", "text", (1, 1), "qid")
    counts = counts.withColumn("qid", F.row_number().over(Window.orderBy("qid")) - F.lit(1).cast("long"))
    index = postings.build(corpus, (1, 1), features.asked_terms(counts))
    shipped, tiled = [], postings.tiled
    monkeypatch.setattr(postings, "tiled", lambda df, run, schema: shipped.append(df.select("block", "range").distinct().count()) or tiled(df, run, schema))
    assert told(postings.top_k(counts, index, 5)) == brute(rows, rows, 5)
    assert shipped == [32]


def test_blocks_of_queries_are_searched_in_waves(spark, monkeypatch):
    """What is shipped at a time is a part of all tiles, and used counts are removed."""
    monkeypatch.setattr(postings, "BLOCK", 2)
    monkeypatch.setattr(postings, "TILES", 8)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=12))) for i in range(512)]
    asked, corpus = frames(spark, rows, rows)
    counts = postings.numbered_counts(asked.coalesce(1), "query_id", "text", (1, 1), "qid")
    counts = counts.withColumn("qid", F.row_number().over(Window.orderBy("qid")) - F.lit(1).cast("long"))
    monkeypatch.setattr(postings, "SPAN", 2)
    index = postings.build(corpus, (1, 1), features.asked_terms(counts))
    shipped, tiled = [], postings.tiled
    monkeypatch.setattr(postings, "tiled", lambda df, run, schema: shipped.append(df.select("block", "range").distinct().count()) or tiled(df, run, schema))
    hits = postings.top_k(counts, index, 5)
    assert told(hits) == brute(rows, rows, 5)
    assert len(shipped) == 4 and sum(shipped) == 32 and max(shipped) < 32


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir())))
    files = lambda: {str(p) for p in folder.rglob("shuffle_*") if f"{os.sep}blockmgr-" in str(p)}
    before = files()
    rows = checkpoint(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 9).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 9


def test_the_corpus_is_weighed_without_shuffling_its_terms(spark, monkeypatch):
    """Terms go to their task by hash, packed, whether asked or not; lengths count all of them."""
    monkeypatch.setattr(postings, "HELD", 256)
    monkeypatch.setattr(postings, "RANGE", 5)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(90)], k=rng.randrange(12)))) for i in range(150)] + [(900, None)]
    asked, corpus = frames(spark, [(1, "w1 w2 w1 unknown"), (2, "w3"), (3, "")], rows)
    plans, written = [], postings.checkpoint
    monkeypatch.setattr(postings, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    counts = postings.numbered_counts(asked, "query_id", "text", (1, 1), "qid")
    index = postings.build(corpus, (1, 1), features.asked_terms(counts))
    assert not [p for p in plans if "hashpartitioning(term" in p]
    assert {r.term: r.df for r in index["terms"].collect()} == {
        w: sum(w in (t or "").split() for _, t in rows) for w in ("w1", "w2", "w3")
    }
    hits = postings.top_k(counts, index, 5)
    assert told(hits) == brute([(1, "w1 w2 w1 unknown"), (2, "w3"), (3, "")], rows, 5)

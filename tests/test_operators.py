"""Skewed inputs, brute force checks and answer rules."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake import session
from triagelake.functions import text
from triagelake.operators import (
    evaluate, events, filters, models, postings, quality, ranks, recommend, retrieval, search, split, topics,
    unify,
)
from triagelake.sources import tables
from triagelake.streaming import jobs


def test_sequence_of_a_hot_incident(spark):
    rnd = random.Random(1)
    rows = [(i, 7 if i % 3 else i, rnd.randrange(40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, number int, at int").select(
        "id", "number", F.timestamp_seconds("at").alias("ts")
    )
    got = {r.id: (r.event_sequence, r.incident_event_count)
           for r in events.add_sequence(df, "number", "ts", "id").collect()}
    by = {}
    for i, n, at in rows:
        by.setdefault(n, []).append((at, i))
    want = {i: (s, len(v)) for v in by.values() for s, (_, i) in enumerate(sorted(v), 1)}
    assert got == want


def test_missing_time_sorts_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, 1)], "id int, k string, s long")
    df = df.select("id", "k", F.timestamp_seconds("s").alias("ts"))
    got = {r.id: r.event_sequence for r in events.add_sequence(df, "k", "ts", "id").collect()}
    assert got == {2: 1, 1: 2}
    assert [r.id for r in events.snapshot(df, "k", "ts", "id").collect()] == [1]


def test_quantiles_match_numpy(spark):
    values = [float(v) for v in np.random.default_rng(3).normal(size=501)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.1, 0.5, 0.999]))


def test_keep_first_of_many_copies(spark):
    rows = [(i, "Same  text" if i % 2 else f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    kept = [r.id for r in filters.keep_first_text(df, "t", "id").collect()]
    assert sorted(kept) == [0, 1] + list(range(2, 200, 2))


def test_split_and_folds(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(300)] + [(300, "lone")]
    df = spark.createDataFrame(rows, "id int, label string")
    got = split.stratified_split(df, "label", "id")
    sizes = {(r.label, r.is_test): r.n for r in got.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("big", True): 54, ("big", False): 216, ("small", True): 6,
                     ("small", False): 24, ("lone", False): 1}
    folded = split.folds(df, "label", "id", 5, 2)
    per = folded.where("label = 'big'").groupBy("repeat", "fold").count().collect()
    assert {r["count"] for r in per} == {54} and len(per) == 10


def test_shuffled_labels_keep_counts(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, label int")
    drawn = split.shuffled_labels(df, "label", "id", 4)
    assert drawn.select("perm", "id").distinct().count() == 360
    assert {r["count"] for r in drawn.groupBy("perm", "label").count().collect()} == {30}


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("exclude", [False, True])
def test_dense_search_matches_brute_force(spark, limit, exclude):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[::3] = x[0]  # a third are copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    q = spark.createDataFrame(rows, "query_id long, vector array<double>")
    c = spark.createDataFrame(rows, "corpus_id long, vector array<double>")
    got = search.top_k(q, c, 4, exclude, broadcast_bytes=limit,
                       query_block=100, corpus_block=150).collect()
    scores = np.round(x @ x.T, 9)
    want = set()
    for i in range(60):
        order = sorted((j for j in range(60) if not (exclude and i == j)),
                       key=lambda j: (-scores[i, j], j))[:4]
        want |= {(i, r, j) for r, j in enumerate(order, 1) if scores[i, j] >= 0}
    assert {(r.query_id, r["rank"], r.corpus_id) for r in got} == want


@pytest.mark.parametrize("cheap", [0, 1 << 20])
def test_sparse_search_matches_brute_force(spark, cheap, monkeypatch):
    monkeypatch.setattr(postings, "CHEAP", cheap)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(["common"] + rnd.choices(words, k=rnd.randrange(12))) for _ in range(50)]
    texts[10:25] = [texts[10]] * 15
    corpus = spark.createDataFrame(list(enumerate(texts)), "corpus_id long, text string")
    asked = [(0, "common w1 w2"), (1, "nothing known here"), (2, texts[10])]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = retrieval.sparse_search(queries, corpus, 5, (1, 1)).collect()
    vocabulary = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in vocabulary] for t in texts], float)
    idf = np.log((1 + 50) / (1 + (tf > 0).sum(0))) + 1

    def weigh(m):
        w = np.where(m > 0, (np.log(np.maximum(m, 1)) + 1) * idf, 0)
        n = np.linalg.norm(w, axis=1, keepdims=True)
        return w / np.where(n == 0, 1, n)

    qm = np.array([[t.split().count(w) for w in vocabulary] for _, t in asked], float)
    scores = np.round(weigh(qm) @ weigh(tf).T, 9)
    want = {(i, r, j) for i in range(3)
            for r, j in enumerate(sorted(range(50), key=lambda j: (-scores[i, j], j))[:5], 1)}
    assert {(r.query_id, r["rank"], r.corpus_id) for r in got} == want


def test_silhouette_matches_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    labels = [i % 3 for i in range(39)] + [9]
    rows = [(i, labels[i], [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, c int, v array<double>")
    got = {r.id: r.silhouette for r in topics.silhouette(df, "c", "v", "id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for i in range(40):
        own = [j for j in range(40) if labels[j] == labels[i] and j != i]
        if not own:
            assert got[i] == 0
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(40) if labels[j] == c]].mean()
                for c in set(labels) - {labels[i]})
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_per_class_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(rows, "t string, p string")
    found = {r.label: r for r in evaluate.per_class(evaluate.confusion(df, "t", "p")).collect()}
    assert found["b"].precision == pytest.approx(1 / 3) and found["b"].recall == 1
    assert found["c"].f1 == 0 and found["c"].support == 1


def test_unique_ids_are_enforced(spark):
    df = spark.createDataFrame([("a",), ("a",)], "ticket_id string")
    with pytest.raises(ValueError, match="1 duplicate"):
        unify.assert_unique_ids(df)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="project_key"):
        unify.adapt_tracker(spark.createDataFrame([("1", "t")], "id string, corpus_clean string"))


# --- answers -----------------------------------------------------------------

HITS = ("query_id long, rank int, corpus_id long, similarity double, weak boolean, "
        "ticket_id string, description string, category string, priority string, "
        "resolution string, source string")


def hit(rank, similarity, resolution, ticket="A", query=1):
    return (query, rank, rank, similarity, similarity < 0.45, ticket, "d", "c", "P1", resolution, "s")


def answer(spark, hits, description="cannot open the portal link"):
    tickets = spark.createDataFrame([(1, description)], "query_id long, description string").select(
        "*",
        recommend.unavailable("category").alias("category"),
        recommend.unavailable("priority").alias("priority"),
        F.array().cast("array<string>").alias("model_errors"),
    )
    return recommend.recommend(tickets, spark.createDataFrame(hits, HITS))


def test_steps_are_deduplicated_over_hits(spark):
    rows = answer(spark, [
        hit(1, 0.9, "clear the browser cache. clear the browser cache."),
        hit(2, 0.8, "Clear the browser cache!", "B"),
    ]).first()
    assert [s.text for s in rows.steps] == ["clear the browser cache"]
    assert "1 historical" in rows.explanation


def test_no_resolution_no_steps(spark):
    rows = answer(spark, [hit(1, 0.9, None)]).first()
    assert rows.steps == [] and any("actionable" in w for w in rows.warnings)


def test_weak_hits_never_give_steps(spark):
    df = answer(spark, [hit(1, 0.3, "clear the browser cache now please")])
    row = df.first()
    assert row.steps == [] and any("weak" in w for w in row.warnings)
    gate = recommend.grounding_gate(df).first()
    assert gate.route == "retrieval" and "strong enough" in gate.reason


def test_short_ticket_has_error_and_stable_columns(spark):
    df = answer(spark, [hit(1, 0.9, "clear the browser cache now")], "IE")
    row = df.first()
    assert row.error and row.similar == []
    for column in ("category", "priority", "similar", "steps", "explanation", "source", "warnings"):
        assert column in df.columns


GOOD = ('{"steps": ["Clear the cache.", "Add the URL."], "explanation": "e", '
        '"evidence_quality": "moderate", "caveats": ["omits the error message"]}')


@pytest.mark.parametrize(
    "response, failure, source, warning",
    [
        (GOOD, None, "llm", "Not a verified fix"),
        (None, "429 rate limit exceeded", "retrieval", "rate limit"),
        ("I'm sorry, I can't help with that.", None, "retrieval", "no JSON object"),
    ],
)
def test_generated_answers(spark, response, failure, source, warning):
    df = answer(spark, [hit(1, 0.9, "clear the browser cache now")])
    given = spark.createDataFrame(
        [(1, response, failure)], "query_id long, response string, failure string"
    )
    row = recommend.merge_generated(df, given).first()
    assert row.source == source and any(warning in w for w in row.warnings)
    if source == "llm":
        assert len(row.steps) == 2 and row.evidence_quality == "moderate"
        assert any("omits the error message" in w for w in row.warnings)


def test_missing_generated_answer(spark):
    df = answer(spark, [hit(1, 0.9, "clear the browser cache now")])
    none = spark.createDataFrame([], "query_id long, response string, failure string")
    row = recommend.merge_generated(df, none, "key not set").first()
    assert row.source == "retrieval" and any("key not set" in w for w in row.warnings)


# --- models and streams ------------------------------------------------------

def test_missing_and_damaged_models(spark, tmp_path):
    docs = spark.createDataFrame([(1, "vpn keeps dropping")], "id long, text string")
    gone = models.predict_saved(spark, str(tmp_path / "no"), docs, "id", "text", "priority").first()
    assert gone.label is None and gone.uncertain and "not found" in gone.error
    bad = tmp_path / "bad" / "meta"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"this is not a model")
    row = models.predict_saved(spark, str(tmp_path / "bad"), docs, "id", "text", "category").first()
    assert row.label is None and row.uncertain and row.error


def test_optional_table(spark, tmp_path):
    assert tables.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(i, i % 4, 1_700_000_000 + (i * 37) % 500) for i in range(60)] + [(5, 1, 1_700_000_185)]
    df = spark.createDataFrame(rows, "event_id long, number int, at long").select(
        "event_id", "number", F.timestamp_seconds("at").alias("ts")
    )
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(6).write.parquet(source)
    stream = jobs.read_stream(spark, source, df.schema, files_per_batch=2)
    jobs.latest_states(stream, "number", "ts", "event_id", sink, str(tmp_path / "st")).awaitTermination()
    got = jobs.read_latest(spark, sink, df.schema, "number", "ts", "event_id")
    want = events.snapshot(df, "number", "ts", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_of_one_file_or_many(spark, tmp_path, files):
    table = str(tmp_path / "in" / "documents.parquet")
    df = spark.range(20).withColumn("text", F.concat(F.lit("t"), "id"))
    df.repartition(files).write.parquet(table)
    if files == 1:  # the table is a file itself
        (part,) = (tmp_path / "in" / "documents.parquet").glob("part-*")
        table = str(tmp_path / "one" / "documents.parquet")
        (tmp_path / "one").mkdir()
        part.rename(table)
    folder = table.rsplit("/", 1)[0]
    spark.range(5).write.parquet(f"{folder}/labels.parquet")
    stream = jobs.read_stream(spark, folder, df.schema, "documents.parquet")
    sink = str(tmp_path / "sink")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "st"))
    writer.trigger(availableNow=True).start(sink).awaitTermination()
    assert sorted(spark.read.parquet(sink).collect()) == sorted(df.collect())


def test_stream_keeps_late_events(spark, tmp_path):
    """One file per trigger, and an incident whose only event is 30 days late."""
    day = 86_400
    parts = [[(1, 1, 40 * day), (2, 2, 41 * day)], [(3, 1, 42 * day)], [(4, 3, 12 * day), (3, 1, 42 * day)]]
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "event_id long, number int, at long").select(
            "event_id", "number", F.timestamp_seconds("at").alias("ts")
        )
        df.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        next((tmp_path / f"part{i}").glob("part-*.parquet")).rename(source / f"{i}.parquet")
    stream = jobs.read_stream(spark, str(source), df.schema, files_per_batch=1)
    jobs.latest_states(stream, "number", "ts", "event_id", sink, str(tmp_path / "st")).awaitTermination()
    got = jobs.read_latest(spark, sink, df.schema, "number", "ts", "event_id").collect()
    assert sorted((r.number, r.event_id) for r in got) == [(1, 3), (2, 2), (3, 4)]


def test_many_labels_are_stripped_as_few_are(spark):
    labels = ["vpn", "VPN client", "c++", "a.b", "#tag", "++", "über maß", None] + [f"l{i} x{i % 7}" for i in range(3000)]
    texts = [
        "The VPN-12 and vpn client-3, vpnx xvpn", "c++ a.b axb A.B-1", "x#tag #tag", "a++b", "ÜBER MASS über maß-9.",
        "l17 x3 l17 x4 l2999 x3-5", "", None, "the vpn, vpn vpn",
    ]
    df = spark.createDataFrame([(i, labels[i % len(labels)], texts[i % len(texts)]) for i in range(len(labels))], "id int, label string, t string")
    one = {r.id: r.t for r in filters.strip_labels(df, "t", "label", pattern_labels=10_000).collect()}
    assert {r.id: r.t for r in filters.strip_labels(df, "t", "label", pattern_labels=5).collect()} == one
    assert one[0] == "The and , vpnx xvpn"


def test_content_of_null_text_is_empty_either_way(spark):
    df = spark.createDataFrame([("a", None), ("b", "Fixed the thing today. Regards all of you")], "key string, r string")
    found = spark.createDataFrame([("regards all of you",)], "key string")
    for limit in (0, 100):
        rows = {r.key: r for r in quality.extract_content(df, "r", found, inline_keys=limit).collect()}
        assert rows["a"].resolution_content == "" and rows["a"].content_words == 0
        assert rows["b"].resolution_content == "Fixed the thing today"


def test_content_and_labels_with_repeated_ids_and_clashing_names(spark):
    rows = [
        (1, "Own words of one here. Regards all of you", "a", 1, "p", "vpn"), (1, "Own words of two here. Regards all of you", "b", 2, "q", "vpn"),
        (None, "Third text has words. Regards all of you", "c", 3, None, "mail"), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, r string, _text string, _row int, _probe string, _known string")
    found = spark.createDataFrame([("regards all of you",)], "key string")
    want = sorted(str((*row, c)) for row, c in zip(rows, ["Own words of one here", "Own words of two here", "Third text has words", ""]))
    for limit in (0, 100):
        got = quality.extract_content(df, "r", found, inline_keys=limit)
        assert got.columns == [*df.columns, "resolution_content", "content_words"]
        assert sorted(str(tuple(r[:-1])) for r in got.collect()) == want
    labels = df.withColumnsRenamed({"_row": "text", "_probe": "pattern"}).withColumn("r", F.concat("r", F.lit(" VPN-3 mail")))
    want = sorted(str((i, r and r, t, n, q, k)) for i, r, t, n, q, k in rows)
    for limit in (0, 100):
        got = filters.strip_labels(labels, "r", "_known", pattern_labels=limit)
        assert got.columns == labels.columns and sorted(str(tuple(r)) for r in got.collect()) == want


def test_zero_vectors_stay_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    assert {r.id: r.v for r in topics.unit(df, "v").collect()} == {1: [0.0, 0.0], 2: [0.6, 0.8]}


def test_no_task_emits_more_than_k_rows_per_query(spark):
    rows = [(f"d{i:03}", [float(i), 1.0]) for i in range(400)]
    corpus = spark.createDataFrame(rows, "corpus_id string, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i)]) for i in range(20)], "query_id string, vector array<double>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        assert search._broadcast_search(queries, corpus, 5, False).count() <= 20 * 5 * 2
        got = search.top_k(queries, corpus, 2).collect()
    finally:
        spark.conf.set(key, before)
    assert {(r.query_id, r["rank"], r.corpus_id) for r in got} == {(f"q{i}", n, f"d{400 - n}") for i in range(20) for n in (1, 2)}
    blocks = search.top_k(queries, corpus, 2, broadcast_bytes=0, query_block=10, corpus_block=100).collect()
    assert sorted(blocks) == sorted(got)


def test_a_tile_has_many_blocks_of_queries(spark):
    """A corpus row is shipped once for all the blocks that a task may hold, and queries once per part."""
    x = np.random.default_rng(2).normal(size=(300, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    queries, corpus = (spark.createDataFrame(rows, f"{c}_id long, vector array<double>") for c in ("query", "corpus"))
    moved = search.shipped(queries, corpus, 20, 20)
    assert moved.where("side = 1").count() == 300 and moved.where("side = 0").count() <= 300 * search.TASKS
    got = search.top_k(queries, corpus, 3, True, -1.0, broadcast_bytes=0, query_block=20, corpus_block=20).collect()
    want = search.top_k(queries, corpus, 3, True, -1.0).collect()
    assert sorted(got) == sorted(want) and len(got) == 900


def test_vocabulary_is_numbered_without_gaps(spark):
    terms = spark.range(60_000).select(F.concat(F.lit("t"), "id").alias("term"), F.lit(1.0).alias("idf"))
    got = sorted(r.ix for r in models.indexed_vocabulary(terms).collect())
    assert got == list(range(60_000))


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "yarn", "spark.app.id": "x"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Session.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///steps/"})
    assert session.new_dir(Session(), "a").startswith("hdfs:///steps/a-")


def test_cleanup_removes_the_steps(spark):
    import pathlib

    path = pathlib.Path(session.new_dir(spark, "step"))
    spark.range(3).write.parquet(str(path))
    assert path.exists() and session.cleanup(spark) >= 1 and not path.exists()


def test_permutations_ship_a_vector_once(spark, monkeypatch):
    """Scores of all shuffles as by hand, from one tile per block of vectors."""
    monkeypatch.setattr(split, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(75, 3))
    labels = [None if i == 5 else "abc"[i % 7 % 3] for i in range(75)]
    df = spark.createDataFrame([(i, labels[i], [float(v) for v in x[i]]) for i in range(75)], "id int, label string, v array<double>")
    written, checkpoint = [], session.checkpoint
    monkeypatch.setattr(evaluate, "checkpoint", lambda d: written.append(checkpoint(d)) or written[-1])
    got = {r.perm: r.f1_macro for r in evaluate.permutation_scores(df, "id", "label", "v", permutations=4).collect()}
    assert [d.count() for d in written if "x" in d.columns] == [5]
    ids = [i for i in range(75) if labels[i]]
    order = lambda salt: sorted(ids, key=lambda i: (hashlib.md5(f"{salt}-{i}".encode()).hexdigest(), i))
    base = order(42)
    for perm in range(5):
        mine = [labels[i] for i in (order(f"42-{perm}") if perm else base)]
        fold = [mine[:r].count(mine[r]) % 5 for r in range(len(base))]
        hits = []
        for r, i in enumerate(base):
            rows = [s for s in range(len(base)) if fold[s] != fold[r]]
            far = {c: ((x[i] - x[[base[s] for s in rows if mine[s] == c]].mean(axis=0)) ** 2).sum() for c in "abc"}
            hits.append(min("abc", key=far.get))
        f1 = [2 * sum(a == b == c for a, b in zip(mine, hits)) / (mine.count(c) + hits.count(c)) for c in "abc"]
        assert abs(got[perm] - sum(f1) / 3) < 1e-9
    drawn = {(r.perm, r.id): r.label for r in split.shuffled_labels(df, "label", "id", 2).collect()}
    assert drawn == {(p, i): labels[j] for p in (1, 2) for i, j in zip(base, order(f"42-{p}"))}


def test_content_forms_each_key_once(spark):
    """As splitting the joined first sentences again, with one key per sentence."""
    rng = random.Random(3)
    words = ["one", "Σας", "two three", "don't", "...", "!", "ΟΔΟΣ", "hello", "best regards", "x\x1cy", "a_b", "?!", "é́t"]
    gaps = [" ", ". ", ".\n", "\n", " \n ", " ", ".\x85", "!  ", "\r\n", "?\xa0", ".", "​", "  "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(25))) for _ in range(300)] + [None, "", " 　 "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, r string")
    found = spark.createDataFrame([("one",), ("two three hello",), ("two three",)], "key string")
    again = F.filter(text.sentences(F.col("t")), lambda s: ~text.sentence_key(s).isin("one", "two three hello", "two three"))
    kept = F.filter(F.transform(again, lambda s: text.trim_edges(s)), lambda s: F.regexp_count(s, F.lit(r"(?U)\S+")) >= 2)
    want = quality.dedupe_sentences(df, "r", "t").select("id", F.coalesce(F.array_join(kept, " "), F.lit("")).alias("c"))
    want = want.select("id", "c", F.regexp_count("c", F.lit(r"(?U)\S+")).cast("long")).collect()
    assert any(r.c for r in want)
    for limit in (0, 100):
        got = quality.extract_content(df, "r", found, min_words=2, inline_keys=limit)
        assert sorted(got.select("id", "resolution_content", "content_words").collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    space = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    seen = spark.createDataFrame([(c + "a" + c,) for c in space], "c string").select(
        text.trim_ws(F.col("c")).alias("new"), F.regexp_replace("c", r"(?U)^\s+|\s+$", "").alias("old")
    )
    assert seen.where("new <> old").count() == 0

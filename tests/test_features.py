"""Terms counted some rows at a time."""

import numpy as np
from pyspark.sql import functions as F

from triagelake.operators import features


def test_terms_are_counted_a_few_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(features, "COUNTED", 3)
    rows = [(i, None if i == 4 else [f"w{j % 3}" for j in range(i)]) for i in range(11)]
    df = spark.createDataFrame(rows, "id long, terms array<string>").coalesce(1)
    got = {r.id: {c.term: c.tf for c in r.counts} for r in features.term_counts(df, "id").collect()}
    assert got == {i: {w: t.count(w) for w in t or []} for i, t in rows}


def test_hashed_terms_are_the_hashes_of_the_counted_terms(spark):
    """Odd texts too: none, blank, beyond 31 bytes, beyond ASCII, a word that meets itself."""
    rows = [(1, None), (2, " "), (3, "İstanbul ÄÖ " + "x" * 100 + " " + "y" * 31 + " zz" * 5), (4, "日本語 日本語 a b the cc"), (5, "cc")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    for ngrams in ((1, 1), (1, 2)):
        counts = features.term_counts(features.with_terms(df, "text", ngrams), "id")
        hashes = counts.select("id", F.transform("counts", lambda c: F.xxhash64(c["term"])).alias("h"), F.col("counts.tf").alias("tf"))
        want = {r.id: sorted(zip(r.h, r.tf)) for r in hashes.collect()}
        found = features.hashed_terms(df, "id", "text", ngrams).collect()
        assert {r.id: sorted(zip(np.frombuffer(r.h, np.int64), np.frombuffer(r.tf, np.int32))) for r in found} == want

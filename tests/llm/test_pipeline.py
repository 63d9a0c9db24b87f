"""The pipeline's stages against brute force, and the guard around the subpackage."""

import collections
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_plain import brute_join, spans_by_re
from triagelake.llm import decontaminate

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of the last."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_one_another(stages):
    for df in stages[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)
    counts = [df.count() for df in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[3] == counts[4]


def test_quality_stage_follows_the_labels(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()
    kept = rows(stages[1])
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in labels)
    assert right >= 0.97 * len(labels)


def test_join_stage_keeps_the_least_of_each_group(stages):
    before = rows(stages[1])
    want = {int(c) for _, _, c in brute_join([(i, r.text) for i, r in before.items()])}
    assert set(rows(stages[2])) == want


def test_decontamination_stage_drops_what_leaks(spark, stages):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    before, after = rows(stages[2]), rows(stages[3])
    whole = {i for i, r in before.items() for b in benchmark.collect() if b.text.lower() in r.text.lower()}
    lost = set(before) - set(after)
    assert whole <= lost and lost == {r.doc_id for r in decontaminate.leaks(stages[2], benchmark).collect()}
    assert all(after[i] == before[i] for i in after)


def test_secrets_stage_masks_the_spans(stages):
    before, after = rows(stages[3]), rows(stages[4])
    for i, r in before.items():
        out, at = "", 0
        for start, _, end in spans_by_re(r.text):
            if start >= at:
                out += r.text[at:start] + "[secret]"
            at = max(at, end)
        assert after[i].text == out + r.text[at:] and after[i].n_chars == len(after[i].text)


def test_packing_stage_holds_every_document_once(stages):
    lengths, bins = collections.Counter(), collections.defaultdict(list)
    for r in stages[5].collect():
        assert r.start == lengths[r.doc_id] or r.piece > 0
        lengths[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(lengths) == set(rows(stages[4]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_rows_pass(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x y", None, "a", 3), (2, "x y", None, "a", 3), (None, "token=abcdefgh1", "en", "b", 15)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, spans string"
    for part in (odd, []):
        docs = spark.createDataFrame([(*r, 1, "s") for r in part], schema)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert sorted(repr(r.doc_id) for r in got) == (["1", "2", "None", "None"] if part else [])


def test_null_ids_with_near_copies(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text), (2**60 + 1, text + " a"), (2**60 + 3, "b " + text), (None, "c " + text), (None, "quite another text with words of its own")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.join_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in kept) == [repr(2**60 + 1), "None"]
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted({repr(r.doc_id) for r in docs.collect()}) == [repr(2**60 + 1), "None"]


def test_no_other_module_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("*.py"), *root.glob("triagelake/**/*.py"), *root.glob("tests/*.py")]:
        if path.parent.name != "llm" and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"triagelake[.]llm|import llm|corpus_pipeline", path.read_text()), path

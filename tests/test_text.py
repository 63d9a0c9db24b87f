"""Text expressions on edge inputs."""

import pytest
from pyspark.sql import functions as F

from triagelake.functions import text
from triagelake.operators import cleaning, filters, quality
from triagelake.operators.features import term_counts, with_terms


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("value", ["", "   ", "\n\t  ", None])
def test_blank_ticket_is_rejected(spark, value):
    found = one(spark, value, text.gate)
    assert found.clean_text is None and found.error


@pytest.mark.parametrize("value", ["IE", "vpn", "help me"])
def test_short_ticket_is_rejected(spark, value):
    assert "short" in one(spark, value, text.gate).error.lower()


def test_minimum_ticket_is_accepted(spark):
    found = one(spark, "vpn keeps dropping", text.gate)
    assert found.error is None and found.clean_text == "vpn keeps dropping"


def test_long_ticket_is_cut(spark):
    found = one(spark, "word " * 5000, text.gate)
    assert len(found.clean_text.split()) == 2000 and found.truncated


@pytest.mark.parametrize(
    "value",
    [
        "ticket with emoji 🔥🔥 and unicode ünïcödé",
        "<script>alert('xss')</script> cannot login",
        "'; DROP TABLE tickets; -- cannot open link",
        "\x00\x01 null bytes in the description",
    ],
)
def test_hostile_ticket_is_handled(spark, value):
    found = one(spark, value, text.gate)
    assert found.clean_text is not None or found.error is not None


@pytest.mark.parametrize(
    "sentence, expected",
    [
        ("please try to clear the browser cache and try to login", True),
        ("can you check if the url is added to the trusted sites?", True),
        ("we will check and get back to you", False),
        ("kindly be informed that your ticket has been assigned", False),
        ("please consider this ticket as closed", False),
        ("we are waiting for your kind feedback", False),
        ("ok", False),
    ],
)
def test_actionable(spark, sentence, expected):
    assert one(spark, sentence, lambda c: text.is_actionable(c)) is expected


def test_unicode_whitespace(spark):
    assert one(spark, " a b \n", text.collapse_ws) == "a b"
    assert one(spark, " a b \n", text.word_count) == 2
    assert one(spark, "   ", text.collapse_ws) is None
    assert one(spark, "", text.word_count) == 0


def test_edges_and_keys(spark):
    assert one(spark, "Dears, printer is down, best regards ph_user", text.trim_edges) == (
        "printer is down"
    )
    assert one(spark, "Hidden files show. thanks and regards", text.trim_edges) == (
        "Hidden files show"
    )
    assert one(spark, "Clear: the Cache!", text.sentence_key) == "clear the cache"
    assert one(spark, "Clear: the Cache!", text.step_key) == "clear the cache"


def test_json_recovery(spark):
    answer = 'Here you go:\n```json\n{"steps": ["a"], "explanation": "b"}\n```'
    schema = "steps array<string>, explanation string"
    assert one(spark, answer, lambda c: text.recover_json(c, schema)).steps == ["a"]
    assert one(spark, "I cannot help", lambda c: text.recover_json(c, schema)) is None


def test_label_stripping_prefers_long_labels(spark):
    rows = [("see AMBARI-12 and AMBARI_X-3, not ambarix", "AMBARI"), ("x", "AMBARI_X")]
    df = spark.createDataFrame(rows, "text string, label string")
    found = filters.strip_labels(df, "text", "label").first().text
    assert found == "see and , not ambarix"


def test_dedupe_keeps_first_and_order(spark):
    df = spark.createDataFrame([("B one. A two. b ONE! ... A two.",)], "raw string")
    assert quality.dedupe_sentences(df, "raw", "t").first().t == "B one. A two."


def test_strict_content_drops_greeted_boilerplate(spark):
    rows = [(i, f"Hello, your ticket is open now. fix number {i} was made") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, r string")
    found = quality.boilerplate(df, "r", 0.5)
    assert [r.key for r in found.collect()] == ["your ticket is open now"]
    loose = quality.extract_content(df, "r", found).where("id = 1").first()
    strict = quality.extract_content(df, "r", found, strict=True).where("id = 1").first()
    assert loose.resolution_content == "your ticket is open now fix number 1 was made"
    assert strict.resolution_content == "fix number 1 was made"


@pytest.mark.parametrize("inline_keys", [0, 2000])
def test_content_is_the_same_joined_or_inline(spark, inline_keys):
    rows = [(i, f"same words come here. own words of {i}. same words come here.") for i in range(6)]
    df = spark.createDataFrame(rows, "id int, r string")
    found = quality.boilerplate(df, "r", 0.9)
    got = quality.extract_content(df, "r", found, inline_keys=inline_keys)
    assert {r.id: r.resolution_content for r in got.collect()} == {
        i: f"own words of {i}" for i in range(6)
    }


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "Disk full, the disk FULL again"), (2, "x")], "id int, t string")
    rows = term_counts(with_terms(df, "t", (1, 2), stop_words=("the", "again")), "id").collect()
    got = {r.id: {c.term: c.tf for c in r.counts} for r in rows}
    assert got[1] == {"disk": 2, "full": 2, "disk full": 2, "full disk": 1}
    assert got[2] == {}


def test_issue_pass(spark):
    rows = [
        (" 1 ", "High", "2016-04-02 12:20:21+00:00", "2016-04-02 13:20:21.500000+00:00", -3.0),
        ("2", "blocker", "2016-04-02 12:20:21+00:00", "2016-04-01 12:20:21+00:00", 4.0),
        ("3", "n/a", "soon", None, None),
        ("3", "n/a", "soon", None, None),
    ]
    df = spark.createDataFrame(
        rows, "ID string, Issue_Priority string, issue_created string, "
        "issue_resolution_date string, wf_total double"
    )
    got = {r.id: r for r in cleaning.clean_issues(df).collect()}
    assert len(got) == 3
    assert got["1"].priority_normalized == "P2" and got["2"].priority_normalized == "P1"
    assert abs(got["1"].resolution_time_hours - 1.000139) < 1e-6
    assert got["1"].wf_total is None and got["1"].has_negative_workflow_value
    assert got["2"].resolution_time_hours is None and got["2"].invalid_resolution_chronology
    assert got["3"].issue_priority is None and got["3"].invalid_resolution_chronology is False

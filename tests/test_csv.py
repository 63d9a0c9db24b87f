"""CSV read in ranges against the reader of whole files."""

import csv as plain
import random

import pytest

from triagelake.sources import csv, tables

SCHEMA = "id long, t string, u string, x double"


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "70", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        out = plain.writer(f, lineterminator=end)
        out.writerow(["id", "t\nwith break", "u", "x"])
        out.writerows(rows)


def some_rows(rng, n):
    parts = ["a", "word ", '"', '""', "\n", "\n\n", ",", "é", "line\nline", " ", "1"]
    field = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
    return [(i, field(), field(), rng.choice(["", "1.5", "7"])) for i in range(n)]


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_equal_whole_files(spark, tmp_path, small_ranges, end):
    rng = random.Random(3)
    for k in range(3):
        write(tmp_path / f"{k}.csv", some_rows(rng, 60), end)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("id,t,u,x\n")
    (tmp_path / "open.csv").write_text('id,t,u,x\n5,"no end of line",b,2')
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert csv.inside(csv.lines(spark, str(tmp_path))).count() > 100
    got = tables.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.count() == 181 and got.schema == whole.schema
    assert told(got) == told(whole)


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "x\n" * 500 + '"' + "y\n" * 500
    write(tmp_path / "a.csv", [(1, long, "u", ""), (2, "t", long, "3")])
    got = {r.id: (r.t, r.u, r.x) for r in tables.read_csv(spark, str(tmp_path), SCHEMA).collect()}
    assert got == {1: (long, "u", None), 2: ("t", long, 3.0)}


def test_options_of_quotes_read_whole_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t,u,x\n1,'a\nb',c,2\n")
    assert tables.read_csv(spark, str(tmp_path), SCHEMA, quote="'").first().t == "a\nb"

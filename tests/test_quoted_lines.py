"""Files with quoted line breaks, read in splits, against Spark's multi-line reader."""

import random

import pytest

from bazaarlens.sources import csv_files as ingest

FIELDS = ["", "a", "bc d", '"q"', '"x\ny"', '"\n\n"', '"a ""b"" c"', '"""\n"""', '""', '"p,\nq"', 'in 5" disk', "é", '"line ""one\ntwo"""', '"\n"",""\n"']


@pytest.fixture
def splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("form", [("\n", "utf-8"), ("\r\n", "latin-1")])
def test_same_rows_as_one_task(spark, splits, tmp_path, seed, form):
    rng = random.Random(seed)
    end, encoding = form
    lines = ['n,"head\nof b",c'] + [",".join([str(k), *rng.choices(FIELDS, k=rng.choice([2, 2, 2, 1, 3]))]) for k in range(80)] + ["", "80,z,z"]
    path = tmp_path / "x.csv"
    path.write_bytes(end.join(line.replace("\n", end) for line in lines).encode(encoding))
    profile = ingest.profile_file(spark, str(path))
    assert profile.multiline
    got = ingest.read_raw(spark, str(path), profile)
    reader = spark.read.option("header", True).option("sep", ",").option("encoding", profile.encoding).option("quote", '"').option("escape", '"')
    expected = reader.option("multiLine", True).csv(str(path))
    assert got.columns == expected.columns and rows(got) == rows(expected)


def test_splits_are_read_apart(spark, splits, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("k,v\n" + "".join(f"{k},plain\n" for k in range(500)) + '500,"two\nlines"\n')
    df = ingest.read_raw(spark, str(path), ingest.profile_file(spark, str(path)))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert df.count() == 501 and df.where("k = 500").first()["v"] == "two\nlines"
    assert "Scan text" in df._jdf.queryExecution().toString() and "Scan csv" not in df._jdf.queryExecution().executedPlan().toString()


def test_record_over_many_splits(spark, splits, tmp_path):
    long = "word\n" * 300
    path = tmp_path / "x.csv"
    path.write_text(f'k,v\n1,"{long}"\n2,b\n3,"{long}"\n')
    df = ingest.read_raw(spark, str(path), ingest.FileProfile("UTF-8", ",", True))
    assert {r["k"]: r["v"] for r in df.collect()} == {"1": long, "2": "b", "3": long}


def test_header_alone(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('"k\nl",v\n')
    df = ingest.read_raw(spark, str(path), ingest.FileProfile("UTF-8", ",", True))
    assert df.columns == ["k\nl", "v"] and df.count() == 0

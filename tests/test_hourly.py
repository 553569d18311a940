"""The hourly archive: lines and files, filters that choose files, names that would leave it, and lost tasks."""

import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from tidewatch.plans import scratch
from tidewatch.sources import hourly

S = 1_000_000
BASE = 1_704_067_200 * S
SCHEMA = "seq long, recv_t long, source string, station string, body string"


def files(path):
    return sorted(os.path.relpath(os.path.join(at, f), path) for at, _, names in os.walk(path) for f in names if f.endswith(".gz"))


@pytest.fixture
def path(spark):
    return scratch.new_path(spark, "hourly").removeprefix("file://").removeprefix("file:")


def test_lines_and_files(spark, path):
    rows = [(0, BASE + 1, "udp:ab", "s", "one\r\n"), (1, BASE + 3600 * S, "udp:ab", None, "two\tx"), (2, BASE + S // 2, "kystverket", "k", "a\nb"), (3, BASE + 2, "udp:ab", "s", None)]
    hourly.write(spark.createDataFrame(rows, SCHEMA), path)
    found = files(path)
    assert [f.split(".")[0] for f in found] == ["feeder/udp/ab/2024/01/01/00", "feeder/udp/ab/2024/01/01/01", "nlod/kystverket/2024/01/01/00"]
    with gzip.open(os.path.join(path, found[0]), "rt") as lines:
        assert lines.read() == "2024-01-01T00:00:00.000001Z\ts\tone\n2024-01-01T00:00:00.000002Z\ts\t\n"
    got = sorted(map(tuple, hourly.read(spark, path).collect()), key=lambda r: r[3])
    assert got == [
        ("feeder", "udp:ab", "2024-01-01 00", BASE + 1, "s", "one"), ("feeder", "udp:ab", "2024-01-01 00", BASE + 2, "s", ""), ("nlod", "kystverket", "2024-01-01 00", BASE + S // 2, "k", "a b"), ("feeder", "udp:ab", "2024-01-01 01", BASE + 3600 * S, "", "two\tx"),
    ]
    # further writes add, and nothing is left of the writing
    hourly.write(spark.createDataFrame(rows[:1], SCHEMA), path)
    assert hourly.read(spark, path).count() == 5 and not [x for x in os.listdir(path) if x.startswith("_")]


def test_filters_choose_files(spark, path):
    rows = [(h * 3 + k, BASE + h * 3600 * S + k, s, "x", str(h)) for h in range(30) for k, s in enumerate(("udp:ab", "http:a", "aishub"))]
    hourly.write(spark.createDataFrame(rows, SCHEMA), path)
    archive = hourly.read(spark, path)
    parts = lambda df: df.rdd.getNumPartitions()
    assert len(files(path)) >= 90 and parts(archive) == -(-len(files(path)) // hourly.BUNDLE_FILES)
    one = archive.where((F.col("source") == "udp:ab") & (F.col("hour") == "2024-01-02 03"))
    assert parts(one) == 1 and [r.body for r in one.collect()] == ["27"]
    few = archive.where(F.col("license").isin("aishub") & (F.col("hour") >= "2024-01-02 00") & (F.col("body") != "25"))
    assert sorted(r.body for r in few.collect()) == ["24", "26", "27", "28", "29"]
    # what isn't about a file is left to Spark
    reader, other = hourly._Reader(path), EqualTo(("body",), "25")
    assert list(reader.pushFilters([In(("license",), ("aishub",)), GreaterThanOrEqual(("hour",), "2024-01-02 00"), other])) == [other]
    assert [(f.source, f.hour) for f in reader.chosen()] == [("aishub", f"2024-01-02 {h:02d}") for h in range(6)]
    assert archive.where("hour > '2025'").count() == 0


def test_names_that_would_leave(spark, path):
    rows = [(i, BASE, s, "x", "b") for i, s in enumerate(["../up", "udp:..", "udp:a/b", ":x", "", None, "a:.:b", "a\\b", "fine"])] + [(99, None, "fine", "x", "b")]
    hourly.write(spark.createDataFrame(rows, SCHEMA), path)
    assert [r.source for r in hourly.read(spark, path).collect()] == ["fine"] and len(files(os.path.dirname(path))) >= 1
    assert {f.split("/")[1] for f in files(path)} == {"fine"}


def test_broken_files_and_an_empty_archive(spark, path):
    assert hourly.read(spark, path).count() == 0
    os.makedirs(f"{path}/nlod/kystverket/2024/01/01")
    with open(f"{path}/nlod/kystverket/2024/01/01/05.gz", "wb") as out:
        # two members, as an appending writer leaves them
        out.write(gzip.compress(b"2024-01-01T05:00:00Z\ts\ta\njunk\n2024-13-01T05:00:00Z\ts\tx\n") + gzip.compress(b"2024-01-01T05:00:01.5Z\ts\tb\n"))
    assert sorted((r.body, r.recv_t - BASE) for r in hourly.read(spark, path).collect()) == [("a", 5 * 3600 * S), ("b", 5 * 3600 * S + 3 * S // 2)]


def test_failed_write_leaves_nothing(spark, path):
    bad = spark.createDataFrame([(0, BASE, "a", "x", "b")], SCHEMA).withColumn("body", F.when(F.col("seq") == 0, F.raise_error(F.lit("no")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        hourly.write(bad, path)
    assert files(path) == []

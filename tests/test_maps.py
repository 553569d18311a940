"""Tiles, the clustered table and the SQL surface against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import sql
from tidewatch.operators import tiles
from tidewatch.plans import scratch
from tidewatch.sources import positions


def points(n=500):
    rng = random.Random(4)
    return [(i % 7, i * 600_000_000, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(n)] + [(1, 5, 90.0, 180.0), (1, 6, -90.0, -180.0), (2, 7, None, 3.0), (2, 8, 91.0, 3.0), (3, None, 0.0, 0.0)]


def plain_tile(lat, lon, zoom):
    n, phi = 1 << zoom, math.radians(max(-85.05112878, min(85.05112878, lat)))
    hold = lambda v: max(0, min(n - 1, math.floor(v)))
    return hold((lon + 180) / 360 * n), hold((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)


def test_pyramid(spark):
    want, vessels = Counter(), {}
    for mmsi, _, lat, lon in points():
        if lat is not None and abs(lat) <= 90:
            for zoom in range(6):
                at = (zoom, *plain_tile(lat, lon, zoom))
                want[at] += 1
                vessels.setdefault(at, set()).add(mmsi)
    got = tiles.pyramid(spark.createDataFrame(points(), "mmsi int, t long, lat double, lon double"), 5).collect()
    assert {(r.zoom, r.x, r.y): (r.n, r.vessels) for r in got} == {k: (n, len(vessels[k])) for k, n in want.items()}
    keys = {(r.zoom, r.x, r.y): r.key for r in got}
    assert all(len(k) == z for (z, _, _), k in keys.items()) and all(keys[z - 1, x // 2, y // 2] == k[:-1] for (z, x, y), k in keys.items() if z)


def test_z_key(spark):
    df = spark.createDataFrame([(a, b, c) for a in range(4) for b in range(4) for c in range(4)], "a int, b int, c int")
    for r in df.withColumn("z", positions.z_key(F.col("a"), F.col("b"), F.col("c"), bits=2)).collect():
        assert f"{r.z:06b}" == "".join(f"{x:02b}"[k] for k in range(2) for x in (r.a, r.b, r.c))


def test_clustered_table_reads_the_box(spark):
    path = scratch.new_path(spark, "positions")
    rows = points()
    positions.write(spark.createDataFrame(rows, "mmsi int, t long, lat double, lon double"), path)
    held = [r for r in rows if r[1] is not None and r[2] is not None and abs(r[2]) <= 90]
    for boxes, since, until in (([(10.0, 10.0, 40.0, 60.0)], None, None), ([(10.0, 10.0, 40.0, 60.0), (-90.0, -180.0, -60.0, 180.0)], 86_400_000_000, 2 * 86_400_000_000), (None, None, 10_000), ([(0.0, 0.0, 0.0, 0.0)], None, None), ([], None, None)):
        got = positions.read(spark, path, boxes, since, until)
        want = [r for r in held if (boxes is None or any(a <= r[2] <= c and b <= r[3] <= d for a, b, c, d in boxes)) and (since is None or r[1] >= since) and (until is None or r[1] <= until)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    one = positions.read(spark, path, [(10.0, 10.0, 40.0, 44.0)], 0, 86_399_000_000)
    every = positions.read(spark, path)
    scanned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one.collect()
    assert "PartitionFilters: [isnotnull(day" in scanned(one) and "cell" in scanned(one)
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).collect()}
    assert 0 < len(files(one)) < len(files(every)) / 20


@pytest.mark.parametrize("rows", [0, 1])
def test_sql_functions(spark, rows):
    sql.register(spark)
    line, damaged, other = "!AIVDM,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*23", "!AIVDM,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*24", "$GPGLL,1*4D"
    spark.createDataFrame([(1, line), (2, damaged), (3, other), (4, None), (5, "")][: 5 * rows], "seq long, sentence string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT *, variant_get(parse_json(body), '$.Timestamp', 'int') AS second FROM ais_decode(TABLE(some_lines))").collect()
    assert [(r.seq, r.msg_type, r.mmsi, round(r.lat, 6), round(r.lon, 6), r.second) for r in got] == [(1, "PositionReport", 227006760, 49.475577, 0.13138, 14)][:rows]
    one = spark.sql("SELECT nmea_checksum('AIVDM,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0') AS c, ais_unsigned(ais_bits('13HOI:0P0000VOHLCnHQKwvL05Ip', 0), 8, 30) AS m, length(ais_bits('13w', 2)) AS n, round(geo_nm(60, 10, 61, 10), 2) AS d, geo_in_box(1, 2, 0, 0, 1, 2) AS b").first()
    assert tuple(one) == ("23", 227006760, 16, 60.04, True)

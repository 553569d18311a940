"""Bodies are read once and told field by field without a step for each field that any type has."""

from pyspark.sql import functions as F

from tidewatch import catalog_messages
from tidewatch.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_read_once(spark):
    made = spark.range(3).select(F.col("id").alias("seq"), F.col("id").alias("recv_t"), F.format_string('{"Message": {"PositionReport": {"UserID": %d, "Sog": 1.5}}, "MessageType": "PositionReport"}', F.col("id")).alias("body"))
    got = feeds.whole_envelopes(made)
    assert _plan(got).count("from_json") == 1
    assert [(r.seq, r.mmsi) for r in got.orderBy("seq").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_fields_of_a_body_as_rows(spark):
    body = '{"Sog": 1.5, "Valid": true, "Raim": false, "UserID": 7, "Eta": {"Month": 3, "Other": 1}, "Destinations": {"0": {"DestinationID": 4, "Sequenceinteger": null}, "1": {}}, "Spare": {}, "Name": "12", "Text": null, "nonsense": 1}'
    rows = spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "seq long, body string").select("seq", F.parse_json("body").alias("body"))
    told = catalog_messages._spelled(rows)
    # nothing in the plan grows with the number of fields that there are
    assert "variant_get" not in _plan(told)
    want = {(1, "Sog", 1.5, None), (1, "Raim", None, "false"), (1, "Eta.Month", 3.0, None), (1, "Destinations.0.DestinationID", 4.0, None), (1, "Name", None, "12")}
    assert {tuple(r) for r in told.collect()} == want

"""Equal boxes are met once, however many subscriptions or claims have them."""

from tidewatch.operators import subscribe

BOX = "min_lat double, min_lon double, max_lat double, max_lon double"


def test_fan_out_totals_of_many_equal_boxes(spark, monkeypatch):
    met = []
    whole = subscribe.fan_out
    monkeypatch.setattr(subscribe, "fan_out", lambda e, b: met.append(whole(e, b)) or met[-1])
    points = [(i, i % 3, i % 10.0, 5.0) for i in range(100)]
    # 500 of one box, 500 of the same two in either order, one twice told, one that holds nothing, one of the whole world
    boxes = [(s, 0.0, 0.0, 4.0, 6.0) for s in range(500)] + [(s, *b) for s in range(500, 1000) for b in ((0.0, 0.0, 2.0, 6.0), (1.0, 4.0, 3.0, 9.0))[:: 1 if s % 2 else -1]]
    boxes += [(1000, 0.0, 0.0, 4.0, 6.0), (1000, 0.0, 0.0, 4.0, 6.0), (1001, 50.0, 50.0, 51.0, 51.0), (1002, -90.0, -180.0, 90.0, 180.0)]
    got = {r.sub: tuple(r)[1:] for r in subscribe.fan_out_totals(spark.createDataFrame(points, "seq long, mmsi long, lat double, lon double"), spark.createDataFrame(boxes, f"sub long, {BOX}")).collect()}
    want = {s: (50, 0, 3) for s in [*range(500), 1000]} | {s: (40, 0, 3) for s in range(500, 1000)} | {1002: (100, 0, 3)}
    assert got == want
    assert met[0].count() == 50 + 40 + 100


def test_claims_around_many_equal_boxes(spark, monkeypatch):
    met = []
    whole = subscribe.boxes_within
    monkeypatch.setattr(subscribe, "boxes_within", lambda a, c: met.append(whole(a, c)) or met[-1])
    asked = [(s, 0.0, 0.0, 1.0, 1.0) for s in range(300)] + [(300, 5.0, 5.0, 6.0, 6.0), (300, 0.0, 0.0, 1.0, 1.0), (301, 80.0, 80.0, 81.0, 81.0)]
    claims = [(c, -1.0, -1.0, 19.0, 39.0) for c in range(200)] + [(200, 0.0, 0.0, 1.0, 1.0), (201, 0.5, 0.0, 3.0, 3.0), (202, -90.0, -180.0, 70.0, 180.0)]
    got = {r.sub: r.claims for r in subscribe.claims_around(spark.createDataFrame(asked, f"sub long, {BOX}"), spark.createDataFrame(claims, f"claim long, {BOX}")).collect()}
    assert got == {s: 202 for s in range(300)} | {300: 202 + 201}
    assert met[0].count() == 3 + 2

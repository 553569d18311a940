"""Feed adapters: what arrives from elsewhere, as rows of receptions or of fields. All of them are projections; bad input gives no row or a null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.sources import codec

# Fixed values of the feeds' formats.
BODY_LIMIT, FRAME_LIMIT = 1 << 20, 1000
LOCATION = "struct<time:bigint,sog:double,cog:double,navStat:int,rot:int,posAcc:boolean,raim:boolean,heading:int,lon:double,lat:double>"
METADATA = "struct<timestamp:bigint,destination:string,name:string,draught:int,eta:bigint,posType:int,refA:int,refB:int,refC:int,refD:int,callSign:string,imo:bigint,type:int>"
ENVELOPE = "struct<MessageType:string,MetaData:struct<MMSI:bigint,time_utc:string>,Message:map<string,struct<UserID:bigint,Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:int,NavigationalStatus:int,Name:string,Type:int>>>"
FRAME = "struct<type:string,nmea:array<string>,replay:boolean>"
PGNS = {129038: 3, 129039: 18, 129041: 21, 129794: 5, 129809: 24, 129810: 24}


def lines_of(body: Column) -> Column:
    """Lines of a body that aren't blank."""
    return F.filter(F.transform(F.split(body, "\n"), C.trimmed), lambda x: x != "")


def datagrams(received: DataFrame, salt: bytes) -> DataFrame:
    """One row per line of a datagram (seq, ip, body). The sender is named by a keyed hash of its address."""
    source = F.concat(F.lit("udp:"), F.substring(C.hmac_sha256(salt, F.col("ip")), 1, 12))
    return received.select("seq", source.alias("source"), F.explode(lines_of(F.col("body"))).alias("line"))


def status(body: Column, limit: int = BODY_LIMIT) -> Column:
    return F.when(F.octet_length(body) > limit, 413).otherwise(202)


def http_bodies(bodies: DataFrame, limit: int = BODY_LIMIT) -> DataFrame:
    """Lines of request bodies (seq, sub, body): a JSON envelope if the body starts with a brace, else plain lines; too long bodies have none."""
    kind = "struct<msgs:array<struct<nmea:array<string>,rxtime:string>>>"
    fits = bodies.where(status(F.col("body"), limit) == 202).withColumn("source", F.concat(F.lit("http:"), "sub"))
    is_json = C.trimmed(F.col("body")).startswith("{")
    plain = F.array(F.struct(lines_of(F.col("body")).alias("nmea"), F.lit(None).cast("string").alias("rxtime")))
    told = fits.select("seq", "source", F.explode(F.when(is_json, F.from_json("body", kind)["msgs"]).otherwise(plain)).alias("m"))
    return told.select("seq", "source", F.unix_micros(F.try_to_timestamp("m.rxtime", F.lit("yyyyMMddHHmmss"))).alias("source_t"), F.explode("m.nmea").alias("line"))


def frames(sent: DataFrame, most: int = FRAME_LIMIT) -> DataFrame:
    """Publish frames (seq, body): ``accepted``, the first ``most`` sentences, and ``buffered``; other frames have none."""
    f = F.from_json("body", FRAME)
    return sent.withColumn("__f", f).where(F.col("__f.type") == "publish").select("seq", F.slice(F.coalesce("__f.nmea", F.array().cast("array<string>")), 1, most).alias("accepted"), F.coalesce("__f.replay", F.lit(False)).alias("buffered"))


def acknowledgement(accepted: Column) -> Column:
    return F.to_json(F.struct(F.lit("ack").alias("type"), F.size(accepted).alias("n")))


def topics(received: DataFrame) -> DataFrame:
    """seq, recv_t, mmsi, kind, body of topic messages (seq, recv_t, topic, body); topics of another form are left out."""
    part = F.split("topic", "/")
    mmsi = part[1].try_cast("long")
    return received.where((F.size(part) == 3) & mmsi.isNotNull()).select("seq", "recv_t", mmsi.alias("mmsi"), part[2].alias("kind"), "body")


def near(told: Column, recv: Column) -> Column:
    """A time told by the sender, if it is within the skew of the time of receipt, else the latter."""
    return F.coalesce(F.when(F.abs(told - recv) <= C.SKEW_US, told), recv)


def readable(body: Column) -> Column:
    return F.get_json_object(body, "$").isNotNull()


def locations(told: DataFrame) -> DataFrame:
    """seq, mmsi, t and fields of location messages, by the names of a position report."""
    rows = told.where((F.col("kind") == "location") & readable(F.col("body"))).withColumn("x", F.from_json("body", LOCATION))
    return rows.select("seq", "mmsi", near(F.col("x.time") * 1_000_000, F.col("recv_t")).alias("t"), "x.lat", "x.lon", "x.sog", "x.cog", "x.heading", F.col("x.navStat").alias("nav_status"), "x.rot", F.col("x.posAcc").cast("int").alias("accuracy"), F.col("x.raim").cast("int").alias("raim"), (F.col("x.time") % 60).alias("second"))


def metadata(told: DataFrame) -> DataFrame:
    """seq, mmsi, t and fields of metadata messages, by the names of a static report."""
    rows = told.where((F.col("kind") == "metadata") & readable(F.col("body"))).withColumn("x", F.from_json("body", METADATA))
    eta = [c.alias(n) for n, c in C.eta_fields(F.col("x.eta")).items()]
    return rows.select("seq", "mmsi", near(F.col("x.timestamp") * 1000, F.col("recv_t")).alias("t"), "x.name", F.col("x.callSign").alias("callsign"), "x.imo", F.col("x.type").alias("ship_type"), "x.destination", (F.col("x.draught") / 10).alias("draught"), F.col("x.refA").alias("to_bow"), F.col("x.refB").alias("to_stern"), F.col("x.refC").alias("to_port"), F.col("x.refD").alias("to_starboard"), F.col("x.posType").alias("fix"), *eta)


def envelopes(received: DataFrame) -> DataFrame:
    """seq, msg_type, mmsi, t and fields of decoded envelopes (seq, recv_t, body) of the types that are carried."""
    rows = received.withColumn("x", F.from_json("body", ENVELOPE)).withColumn("m", F.try_element_at("x.Message", "x.MessageType"))
    rows = rows.where(F.col("x.MessageType").isin(*codec.NAMES) & F.col("m").isNotNull())
    return rows.select("seq", F.col("x.MessageType").alias("msg_type"), F.col("m.UserID").alias("mmsi"), near(C.go_time_us(F.col("x.MetaData.time_utc")), F.col("recv_t")).alias("t"), F.col("m.Latitude").alias("lat"), F.col("m.Longitude").alias("lon"), F.col("m.Sog").alias("sog"), F.col("m.Cog").alias("cog"), F.col("m.TrueHeading").alias("heading"), F.col("m.NavigationalStatus").alias("nav_status"), F.col("m.Name").alias("name"), F.col("m.Type").alias("ship_type"))


def whole_envelopes(received: DataFrame) -> DataFrame:
    """seq, msg_type, mmsi, t and ``body``, the message itself as VARIANT, of envelopes (seq, recv_t, body); those that can't be read
    or are of a type that isn't carried are left out."""
    shape = "struct<MessageType:string,MetaData:struct<time_utc:string>,Message:map<string,variant>>"
    # as the rows of a generator, a text is read once: conditions on what it holds would each read it again
    rows = received.select("*", F.explode(F.array(F.from_json("body", shape))).alias("x")).where(F.col("x.MessageType").isin(*codec.NAMES))
    rows = rows.select("*", F.explode(F.array(F.try_element_at("x.Message", "x.MessageType"))).alias("m")).where(F.col("m").isNotNull() & F.schema_of_variant("m").startswith("OBJECT"))
    return rows.select("seq", F.col("x.MessageType").alias("msg_type"), F.try_variant_get("m", "$.UserID", "long").alias("mmsi"), near(C.go_time_us(F.col("x.MetaData.time_utc")), F.col("recv_t")).alias("t"), F.col("m").alias("body"))


def row_time(told: Column, now: Column) -> Column:
    """Seconds of a row of a snapshot, whatever their skew; now if they can't be read or aren't positive."""
    seconds = told.try_cast("long")
    return F.coalesce(F.when(seconds > 0, seconds * 1_000_000), now)


def unlike_last(bodies: DataFrame) -> DataFrame:
    """Polls (source, seq, body) whose body isn't that of the source's poll before."""
    from pyspark.sql import Window

    digest = F.sha2("body", 256)
    return bodies.withColumn("__last", F.lag(digest).over(Window.partitionBy("source").orderBy("seq"))).where(~digest.eqNullSafe(F.col("__last"))).drop("__last")


def paced(rows: DataFrame, poll: str, start: Column, budget_us: int) -> DataFrame:
    """Rows of a poll with emit_t: the i-th of n is told at i/n of the budget after ``start``."""
    from pyspark.sql import Window

    w = Window.partitionBy(poll)
    i, n = F.row_number().over(w.orderBy("seq")) - 1, F.count("*").over(w)
    return rows.withColumns({"__i": i, "__n": n}).withColumn("emit_t", start + F.floor(F.lit(budget_us) * F.col("__i") / F.col("__n"))).drop("__i", "__n")


def static_changes(rows: DataFrame) -> DataFrame:
    """Rows with a name or an IMO number whose static fields differ from the vessel's last such row."""
    from pyspark.sql import Window

    told = rows.where((F.coalesce("name", F.lit("")) != "") | (F.coalesce("imo", F.lit(0)) != 0)).withColumn("fingerprint", C.fingerprint("name", "callsign", "imo", "ship_type", "destination"))
    last = F.lag("fingerprint").over(Window.partitionBy("mmsi").orderBy("seq"))
    return told.withColumn("__last", last).where(~F.col("fingerprint").eqNullSafe(F.col("__last"))).drop("__last")


def bus_messages(rows: DataFrame) -> DataFrame:
    """Messages of a boat's bus (pgn, mmsi and fields in SI units) in a report's units; other PGNs and rows without an MMSI are left out."""
    types = F.create_map(*(F.lit(x) for kv in PGNS.items() for x in kv))
    degrees = lambda c: C.round_half_up(F.degrees(F.col(c)))
    sizes = C.dimensions(F.col("bow"), F.col("length"), F.col("starboard"), F.col("beam"))
    return rows.where(F.col("pgn").isin(*PGNS) & (F.col("mmsi") > 0)).select("seq", F.element_at(types, F.col("pgn").cast("int")).alias("type"), "mmsi", (F.col("sog") * C.KNOTS).alias("sog"), degrees("cog").alias("cog"), degrees("heading").alias("heading"), C.rot_indicated(F.degrees("rot") * 60).alias("rot"), *(c.alias(n) for n, c in sizes.items()))


def bus_sentences(lines: DataFrame) -> DataFrame:
    """Lines of a bus that carry messages, without a TAG block, and whether they are of the own ship."""
    bare = F.regexp_replace("line", r"^\\[^\\]*\\", "")
    return lines.where(bare.rlike(r"^![A-Z0-9]{2}VD[MO],")).withColumns({"own": bare.rlike(r"^![A-Z0-9]{2}VDO,"), "line": bare})


def tagged(line: Column, station: Column, t_ms: Column) -> Column:
    """A line with a TAG block of the station (if any) and the time, unless it has one."""
    body = F.concat_ws(",", F.concat(F.lit("s:"), F.nullif(station, F.lit(""))), F.concat(F.lit("c:"), t_ms.cast("string")))
    return F.when(line.startswith("\\"), line).otherwise(F.concat(F.lit("\\"), body, F.lit("*"), C.checksum(body), F.lit("\\"), line))

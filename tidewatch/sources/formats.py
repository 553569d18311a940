"""Sources and sinks: receptions in their wire forms, and the archive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import fragments
from tidewatch.sources import codec


#: A sentence of the two kinds that carry messages: talker, kind, fragments, number, sequence id, channel, payload, fill bits, checksum.
SENTENCE = r"^[!$][A-Za-z0-9]{2}(VDM|VDO),[1-9],[1-9],[0-9]?,[^,*]*,[^,*]*,[0-5]\*[0-9A-Fa-f]{2}$"


def sentences(events: DataFrame) -> DataFrame:
    """Receptions: one TAG-prefixed sentence per position event."""
    fields = {"mmsi": F.col("mmsi"), "lat": F.col("lat"), "lon": F.col("lon"), "sog": F.least(F.col("sog"), F.lit(102.2))}
    tag = F.concat(F.lit("s:"), C.tag_safe(F.col("station")), F.lit(",c:"), F.floor(F.col("t") / 1000).cast("string"))
    coded = codec.encoded(events, 1, fields, F.when(F.col("seq") % 2 == 0, "A").otherwise("B"), tag=tag)
    return coded.select("seq", "source", "station", F.col("t").alias("recv_t"), F.col("nmea")[0].alias("body"))


_BLANKS = " \t\n\x0b\x0c\r"
_FIELDS = "".join(f"(?P<f{i}>[^,]*)" + ("" if i == 7 else ",") for i in range(1, 8))
_PARSED = "tag_s string, tag_c string, talker string, kind string, total int, num int, seqid string, channel string, payload string, fill int, line string, ok boolean, outcome string"


def _picked(texts: pa.Array, pattern: str) -> pa.Array:
    """The pattern's group ``x`` in each text; empty where it doesn't match."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(texts, pattern), "x"), "")


def _read_lines(lines: pa.Array) -> list[pa.Array]:
    """The columns of ``_PARSED`` for trimmed lines, all of them at a time."""
    lines = pc.replace_substring_regex(lines, r"^(.*[!$][^!$*]*\*[^!$]{2}),[^!$]*$", r"\1")
    tag = _picked(lines, r"^\\(?P<x>[^\\]*)\\")
    bare = pc.replace_substring_regex(lines, r"^\\[^\\]*\\", "")
    told, text = _picked(bare, r"^[!$](?P<x>[^*]*)\*[0-9A-Fa-f]{2}$"), _picked(tag, r"^(?P<x>[^*]*)")
    summed = lambda of, whole: pc.equal(codec.xor_digits(of), pc.utf8_upper(pc.utf8_slice_codeunits(whole, -2)))
    sound = pc.and_(pc.and_(pc.not_equal(told, ""), summed(told, bare)), pc.or_(pc.equal(tag, ""), summed(text, tag)))
    ok = pc.and_(sound, pc.match_substring_regex(bare, SENTENCE))
    kind = pc.utf8_slice_codeunits(_picked(told, "^(?P<x>[^,]*)"), -3)
    outcome = pc.case_when(pc.make_struct(ok, pc.and_(sound, pc.invert(pc.is_in(kind, pa.array(["VDM", "VDO"]))))), pa.scalar("ok"), pa.scalar("ignored"), pa.scalar("parse_err"))
    found = pc.extract_regex(pc.if_else(ok, told, pa.scalar(None, told.type)), f"^{_FIELDS}$")
    f = lambda i: pc.struct_field(found, f"f{i}")
    whole = lambda i: pc.cast(f(i), pa.int32())
    tagged = lambda key: pc.replace_with_mask(x := _picked(text, f"(?:^|,){key}:(?P<x>[^,]*)"), pc.equal(x, ""), pa.scalar(None, x.type))
    return [tagged("s"), tagged("c"), pc.utf8_slice_codeunits(f(1), 0, 2), pc.utf8_slice_codeunits(f(1), -3), whole(2), whole(3), f(4), f(5), f(6), whole(7), lines, ok, outcome]


def parse(receptions: DataFrame) -> DataFrame:
    """TAG fields and sentence fields of each reception that isn't blank; whatever can't be read makes no row fail.

    ``outcome``: ok, ignored (a sentence of another kind) or parse_err. ``ok`` is the same as a
    flag; sentence fields are null where it is false. Lines are read and summed a batch at a time.
    """
    names = [c.split()[0] for c in _PARSED.split(", ")]
    own = [c for c in receptions.columns if c not in (*names, "tag_t")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in receptions.select(*own).dtypes), _PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.utf8_trim(batch.column("body").cast(pa.string()), characters=_BLANKS)
            told = pc.fill_null(pc.not_equal(lines, ""), False)
            rows, lines = batch.filter(told), lines.filter(told)
            yield pa.RecordBatch.from_arrays([*rows.columns, *_read_lines(lines)], names=[*own, *names])

    read = receptions.select(*own).mapInArrow(run, schema)
    return read.withColumn("tag_t", C.tag_time_us(F.col("tag_c").try_cast("long"))).select(*own, "tag_s", "tag_t", *names[2:])


def decode(parsed: DataFrame, number: int) -> DataFrame:
    """Messages of one type: the common fields and the type's own, nulls where a message is too short."""
    own = [n for n, *_ in codec.LAYOUTS[number]] + ([n for part in codec._STATIC for n, *_ in part] if number == 24 else [])
    rows = codec.decoded(parsed.where("ok"), own).where(F.col("type") == number)
    return rows.select("seq", "tag_s", "tag_t", "channel", "type", "repeat", "mmsi", *own)


def decode_positions(parsed: DataFrame) -> DataFrame:
    """Position reports of types 1 to 3 in one sentence; other types have other layouts and give no row."""
    whole = parsed.where("ok" if "total" not in parsed.columns else "ok and total = 1")
    rows = codec.decoded(whole, ["sog", "lon", "lat"]).where(F.col("type").between(1, 3))
    return rows.select("seq", "tag_s", "tag_t", "channel", "type", "mmsi", "sog", "lon", "lat")


def assemble(parsed: DataFrame) -> DataFrame:
    """Whole messages of parsed sentences: those in one sentence, and those whose fragments came one after another.

    ``nmea`` holds the lines, and the other columns are the last fragment's.
    """
    kept = [c for c in parsed.columns if c not in ("line", "num", "payload")]
    single = parsed.where("total = 1").select(*kept, "payload", F.array("line").alias("nmea"))
    return single.unionByName(fragments.whole_messages(parsed))


def http_envelopes(bodies: DataFrame, sub: str) -> DataFrame:
    """Lines of JSON receive envelopes; an unreadable time counts as none."""
    kind = "struct<msgs:array<struct<nmea:array<string>,rxtime:string>>>"
    msgs = bodies.select("seq", F.explode(F.from_json("body", kind)["msgs"]).alias("m"))
    return msgs.select("seq", F.lit(f"http:{sub}").alias("source"), F.unix_micros(F.try_to_timestamp("m.rxtime", F.lit("yyyyMMddHHmmss"))).alias("source_t"), F.explode("m.nmea").alias("line"))


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """Rows of polls whose position is not 0 and whose time differs from the vessel's last such row."""
    from pyspark.sql import Window

    real = rows.where((F.col("lat") != 0) & (F.col("lon") != 0))
    last = F.lag("time").over(Window.partitionBy("mmsi").orderBy("seq"))
    return real.withColumn("last", last).where(~F.col("time").eqNullSafe(F.coalesce("last", F.lit("")))).drop("last")


def snapshot_rows(bodies: DataFrame) -> DataFrame:
    """Rows of poll bodies ``[{"ERROR": false}, [row, ...]]``, in degrees, knots and metres; an error body has none.

    ``time`` is the row's own text; where bodies have a recv_t, ``t`` is it as microseconds, or recv_t if it can't be read.
    """
    row = "array<struct<MMSI:bigint,SEQ:bigint,TIME:string,LATITUDE:bigint,LONGITUDE:bigint,COG:bigint,SOG:bigint,HEADING:int,ROT:int,NAVSTAT:int,IMO:bigint,NAME:string,CALLSIGN:string,TYPE:int,A:int,B:int,C:int,D:int,DRAUGHT:int,DEST:string,ETA:bigint>>"
    fine = bodies.where(F.coalesce(F.get_json_object("body", "$[0].ERROR"), F.lit("false")) != "true")
    own = [c for c in ("recv_t",) if c in bodies.columns]
    rows = fine.select(*own, F.explode(F.from_json(F.get_json_object("body", "$[1]"), row)).alias("r"))
    eta = [c.alias(n) for n, c in C.eta_fields(F.col("r.ETA")).items()]
    told = rows.select(
        *own, F.col("r.SEQ").alias("seq"), F.col("r.MMSI").alias("mmsi"), F.col("r.TIME").alias("time"), (F.col("r.LATITUDE") / 600000).alias("lat"), (F.col("r.LONGITUDE") / 600000).alias("lon"), (F.col("r.COG") / 10).alias("cog"), (F.col("r.SOG") / 10).alias("sog"),
        F.col("r.HEADING").alias("heading"), F.col("r.ROT").alias("rot"), F.col("r.NAVSTAT").alias("nav_status"), F.col("r.IMO").alias("imo"), F.col("r.NAME").alias("name"), F.col("r.CALLSIGN").alias("callsign"), F.col("r.TYPE").alias("ship_type"),
        F.col("r.A").alias("to_bow"), F.col("r.B").alias("to_stern"), F.col("r.C").alias("to_port"), F.col("r.D").alias("to_starboard"), (F.col("r.DRAUGHT") / 10).alias("draught"), F.col("r.DEST").alias("destination"), *eta,
    )
    seconds = F.col("time").try_cast("long")
    return told.withColumn("t", F.coalesce(F.when(seconds > 0, seconds * 1_000_000), F.col("recv_t"))) if own else told


def write_archive(receptions: DataFrame, path: str) -> None:
    """Lossless archive by licence, source and day, sorted by hour; rows are dealt out by these, large days over several files."""
    at = F.timestamp_micros("recv_t")
    parted = receptions.select(
        C.license_of(F.col("source")).alias("license"), F.replace("source", F.lit(":"), F.lit("/")).alias("feed"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.hour(at).alias("hour"), "seq", "recv_t", "source", "station", "body"
    )
    parted = parted.hint("rebalance", "license", "feed", "day").sortWithinPartitions("license", "feed", "day", "hour", "seq")
    parted.write.mode("overwrite").partitionBy("license", "feed", "day").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

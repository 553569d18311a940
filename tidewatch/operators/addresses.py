"""Internet addresses of both families as 128-bit numbers, and the blocks that hold them by longest prefix.

An address is a text of 32 hexadecimal digits; one of the older family stands behind the prefix that maps
it into the newer. So a block is a prefix of such a text's bits, and a table of blocks of any size is
matched by an equi-join: an address is looked up under its prefix of each length that occurs among the blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the address formats.
MAPPED, BITS = "00000000000000000000ffff", 128
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _v4(text: Column) -> Column:
    """Eight digits of an address of four numbers; null if it isn't one. A leading zero isn't allowed."""
    parts = [F.regexp_extract(text, _V4, i) for i in range(1, 5)]
    fine = text.rlike(_V4) & ~text.rlike(r"(^|\.)0\d")
    for p in parts:
        fine &= F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    return F.when(fine, F.concat(*(F.lpad(F.lower(F.hex(p.try_cast("long"))), 2, "0") for p in parts)))


def digits(text: Column) -> Column:
    """32 hexadecimal digits of an address; null if it isn't one (a zone isn't allowed)."""
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def six(low: Column) -> Column:
        return _let(F.split(low, "::"), lambda halves: _let(groups(halves[0]), lambda head: _let(F.when(F.size(halves) == 2, groups(halves[1])).otherwise(F.array().cast("array<string>")), lambda tail: filled(low, F.size(halves), head, tail))))

    def filled(low: Column, halves: Column, head: Column, tail: Column) -> Column:
        gap = 8 - F.size(head) - F.size(tail)
        every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail)
        # :: stands for one group at least
        shaped = low.contains(":") & ((halves == 1) & (gap == 0) | (halves == 2) & (gap >= 1))
        return F.when(shaped, _let(every, lambda x: F.when(F.forall(x, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(x, lambda g: F.lpad(g, 4, "0")), ""))))

    # the last 32 bits may be written as four numbers
    tail = F.regexp_extract(text, r"(?:^|:)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    spelled = _let(_v4(tail), lambda four: F.concat(F.regexp_replace(text, r"\d{1,3}(?:\.\d{1,3}){3}$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))
    return F.coalesce(F.concat(F.lit(MAPPED), _v4(text)), six(F.lower(F.when(tail == "", text).otherwise(spelled))))


def _prefix(of: Column, length: Column) -> Column:
    """The first bits of 32 digits, as whole digits and the bits of the next."""
    whole = F.floor(length / 4).cast("int")
    rest = (length % 4).cast("int")
    next_ = F.conv(F.substring(of, whole + 1, F.lit(1)), 16, 2)
    return F.concat(F.substring(of, F.lit(1), whole), F.lit("/"), F.when(rest == 0, "").otherwise(F.substring(F.lpad(next_, 4, "0"), F.lit(1), rest)))


def blocks(text: Column) -> Column:
    """{length, prefix} of a block such as ``10.1.0.0/16`` or ``2001:db8::/32``, or of one address; null if it can't be read.

    A block of the newer family doesn't hold mapped addresses of the older, nor one of the older any of the newer, unless it is that one.
    """
    address = F.substring_index(text, "/", 1)
    told = F.when(text.contains("/"), F.when(text.rlike(r"^[^/]+/(0|[1-9]\d{0,2})$"), F.substring_index(text, "/", -1).try_cast("int")))
    older = _v4(address).isNotNull()
    length = F.when(~text.contains("/"), BITS).when(older, F.when(told <= 32, told + 96)).otherwise(F.when(told <= BITS, told))
    return _let(digits(address), lambda whole: _let(length, lambda n: F.when(whole.isNotNull() & n.isNotNull(), F.struct(n.alias("length"), _prefix(whole, n).alias("prefix")))))


def in_block(address: Column, block: Column) -> Column:
    """Whether an address lies in a block; false if either can't be read."""
    return _let(digits(address), lambda of: _let(blocks(block), lambda b: F.coalesce((_prefix(of, b["length"]) == b["prefix"]) & _family(of, b["length"], block), F.lit(False))))


def _family(of: Column, length: Column, block: Column) -> Column:
    """A short prefix of the newer family could hold the mapped ones, but isn't meant to."""
    return ~(of.startswith(MAPPED) & (length < 96) & block.contains(":"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a value as the rows of a generator: it is worked out once a row, also if a condition on it could be pushed below."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def longest_match(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``asked`` (id, ip) that lie in a block of their id's in ``table`` (id, cidr), each with the longest such block.

    The lengths that occur, 129 at most, are read; every address is looked up once for each of them. Rows are dealt out before
    they are read, as a small file of many texts is one task.
    """
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = _once(table.select("id", F.explode(F.array("cidr")).alias("cidr")).repartition(tasks), "b", blocks(F.col("cidr")))
    filed = blocked.where("b is not null").select("id", "cidr", "b.length", "b.prefix")
    lengths = [r[0] for r in filed.select("length").distinct().collect()]
    if not lengths:
        return asked.select("id", "ip", F.lit(None).cast("string").alias("cidr")).where(F.lit(False))
    read = _once(asked.select("id", F.explode(F.array("ip")).alias("ip")).repartition(tasks), "__d", digits(F.col("ip")))
    at = read.where("__d is not null").withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    met = _once(at, "prefix", _prefix(F.col("__d"), F.col("length"))).join(filed, ["id", "length", "prefix"]).where(_family(F.col("__d"), F.col("length"), F.col("cidr")))
    first = F.row_number().over(Window.partitionBy("id", "ip").orderBy(F.desc("length"), "cidr"))
    return met.withColumn("__k", first).where("__k = 1").select("id", "ip", "cidr")

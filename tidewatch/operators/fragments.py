"""Messages in several sentences: the fragments of a station's messages put together.

A station's sentences are numbered as they arrive. A first fragment opens a message of its
(fragments in all, sequence id, channel, kind, talker), in place of one that was open; the next
fragment of an open message is taken, any other fragment is dropped; a message that
took no fragment for more than ``FORGET`` of its station's sentences is forgotten. A whole message has the columns of
its last fragment.

As a message reaches back a limited number of sentences, a station's sentences are cut into
blocks that each begin with the tail of the block before: a busy station is spread over tasks.
The stream form, in ``tidewatch.streaming.fragments``, takes the same steps and keeps open messages as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the protocol's readers: sentences after which an open message is forgotten, and most fragments.
FORGET, MOST_FRAGMENTS = 32, 9
#: Sentences of a block; those that the next block has to know of; and arrival numbers over which sentences are counted in one task.
BLOCK, TAIL, SPAN = 50_000, (MOST_FRAGMENTS - 1) * FORGET, 65_536
KEY = ("total", "seqid", "channel", "kind", "talker")

#: Of an open message: the sentence that it took last, and the payloads and lines so far.
Open = tuple[int, list[str], list[str]]


def step(opened: dict[tuple, Open], key: tuple, n: int, total: int | None, num: int | None, payload: str | None, line: str | None) -> tuple[list[str], list[str]] | None:
    """Takes a fragment, the station's ``n``-th sentence, into the open messages; payloads and lines of the message that it completes."""
    if num == 1:
        opened[key] = (n, [payload or ""], [line or ""])
        return None
    held = opened.get(key)
    if held is None or num is None or n - held[0] > FORGET or num != len(held[1]) + 1:
        if held is not None and n - held[0] > FORGET:
            del opened[key]
        return None
    payloads, lines = [*held[1], payload or ""], [*held[2], line or ""]
    if num == total:
        del opened[key]
        return payloads, lines
    opened[key] = (n, payloads, lines)
    return None


def numbered(sentences: DataFrame) -> DataFrame:
    """Adds ``__n``, the number of a sentence (station, seq) among its station's: counted within spans of seq, with the sentences before a span carried in."""
    rows = sentences.withColumn("__span", F.floor(F.col("seq") / SPAN))
    counts = rows.groupBy("station", "__span").agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy("station").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select(F.col("station").alias("__station"), F.col("__span").alias("__at"), before.alias("__before"))
    own = rows.withColumn("__k", F.row_number().over(Window.partitionBy("station", "__span").orderBy("seq")))
    joined = own.join(carried, F.col("station").eqNullSafe(F.col("__station")) & F.col("__span").eqNullSafe(F.col("__at")))
    return joined.withColumn("__n", F.col("__before") + F.col("__k") - 1).drop("__span", "__k", "__station", "__at", "__before")


def whole_messages(sentences: DataFrame) -> DataFrame:
    """Messages of more than one fragment of parsed sentences (station, seq, talker, kind, total, num, seqid, channel, payload, line and others).

    ``payload`` is the joined one and ``nmea`` holds the lines; the rest is the last fragment's, without num and line.
    Rows without a station are of one station. Sentences of one fragment only count.
    """
    own = [c for c in sentences.columns if c not in ("station", "seq")]
    several = F.col("total") > 1
    # all sentences are numbered, but only fragments bring their columns along
    slim = sentences.select("station", "seq", several.alias("__several"), F.when(several, F.struct(*own)).alias("__x"))
    told = numbered(slim).where("__several").select("station", "seq", "__n", "__x.*")
    place = F.floor(F.col("__n") / BLOCK)
    also = F.col("__n") % BLOCK >= BLOCK - TAIL
    told = told.withColumn("__block", F.explode(F.when(also, F.array(place, place + 1)).otherwise(F.array(place)))).withColumn("__tail", F.col("__block") > place)
    kept = [c for c in ("station", "seq", *own) if c not in ("num", "line", "payload")]
    kinds = dict(sentences.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "payload string, nmea array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, opened = None, {}
        for batch in batches:
            ended, payloads, lines = [], [], []
            columns = zip(*(batch.column(c).to_pylist() for c in ("station", "__block", "__tail", "__n", "total", "num", "payload", "line", *KEY)), strict=True)
            for i, (station, block, tail, n, total, num, payload, line, *key) in enumerate(columns):
                if place != (station, block):
                    place, opened = (station, block), {}
                got = step(opened, tuple(key), n, total, num, payload, line)
                # what ends in the tail was told by the block before
                if got is not None and not tail:
                    ended.append(i)
                    payloads.append("".join(got[0]))
                    lines.append(got[1])
                if len(opened) > 4 * FORGET:
                    opened = {k: x for k, x in opened.items() if n - x[0] <= FORGET}
            rows = batch.take(pa.array(ended, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(payloads, pa.string()), pa.array(lines, pa.list_(pa.string()))], names=[*kept, "payload", "nmea"])

    return told.repartition("station", "__block").sortWithinPartitions("station", "__block", "__n").mapInArrow(run, schema)

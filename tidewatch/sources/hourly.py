"""The hourly archive as a Spark data source: gzipped lines under licence, source and hour.

A reception is a line of its time, station and body with tabs between, in
``licence/source parts/yyyy/mm/dd/hh[.task].gz``. The reader lists the files, takes those that the filters on license, source and hour
allow, and gives a task some of them, or one if it is large. The writer's tasks write beside the archive, and the driver
moves their files to their places when all are whole, so a lost task leaves nothing behind. Further writes add files.

Defined results: a source with a part that is empty, ``.`` or ``..``, or with a path's separator in it, could leave the archive, and its rows are refused and counted;
rows without a time or source are refused too; a line break inside a body becomes a space, those at its end go; lines that can't be read give no row.
"""

from __future__ import annotations

import gzip
import logging
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidewatch.functions import columns as C

SCHEMA = "license string, source string, hour string, recv_t long, station string, body string"
NAME = "hourly_archive"
#: Compressed bytes, and small files, that one task reads at most; a larger file is one task's.
BUNDLE_BYTES, BUNDLE_FILES = 32 << 20, 64
_FILE = re.compile(r"(?P<license>[^/]+)/(?P<feed>.+)/(?P<y>\d{4})/(?P<m>\d\d)/(?P<d>\d\d)/(?P<h>\d\d)(\.[^/]*)?\.gz")
_TIME = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?Z")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class _File:
    path: str
    license: str
    source: str
    hour: str
    size: int


@dataclass
class _Bundle(InputPartition):
    """Files that one task reads."""

    files: list[_File]


@dataclass
class _Written(WriterCommitMessage):
    #: (where it was written, where it belongs)
    files: list[tuple[str, str]]
    refused: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def written_time(t: int) -> str:
    """Microseconds as the archive writes them, without trailing zeros of a fraction."""
    whole, fraction = divmod(t, 1_000_000)
    at = (_EPOCH + timedelta(seconds=whole)).strftime("%Y-%m-%dT%H:%M:%S")
    return at + (f".{fraction:06d}".rstrip("0") if fraction else "") + "Z"


def read_time(text: str) -> int | None:
    found = _TIME.fullmatch(text)
    if not found:
        return None
    try:
        at = datetime.fromisoformat(found[1] + "+00:00")
    except ValueError:
        return None
    return (at - _EPOCH) // timedelta(microseconds=1) + int((found[2] or "0").ljust(9, "0")[:6])


def inside(source: str | None) -> bool:
    """Whether a source names a place in the archive."""
    return bool(source) and all(p not in ("", ".", "..") and "/" not in p and "\\" not in p and "\0" not in p for p in source.split(":"))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("license",), ("source",), ("hour",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def chosen(self) -> list[_File]:
        """The files that the filters allow."""
        store, root = _open(self.path)
        root = root.rstrip("/")
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            found = _FILE.fullmatch(info.path[len(root) + 1 :]) if info.type == fs.FileType.File else None
            if found and not found["license"].startswith("_"):
                file = _File(info.path, found["license"], found["feed"].replace("/", ":"), f"{found['y']}-{found['m']}-{found['d']} {found['h']}", info.size)
                if all(_TESTS[kind](getattr(file, name), value) for name, kind, value in self.tests):
                    out.append(file)
        return sorted(out, key=lambda f: f.path)

    def partitions(self) -> list[_Bundle]:
        out, held, size = [], [], 0
        for file in self.chosen():
            if held and (size + file.size > BUNDLE_BYTES or len(held) == BUNDLE_FILES):
                out.append(_Bundle(held))
                held, size = [], 0
            held.append(file)
            size += file.size
        return [*out, _Bundle(held)]

    def read(self, partition: _Bundle) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for file in partition.files:
            # one after another, compressed members are one stream
            with store.open_input_stream(file.path, compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8", errors="replace", newline="\n") as lines:
                for line in lines:
                    parts = line.rstrip("\r\n").split("\t", 2)
                    t = read_time(parts[0]) if len(parts) == 3 else None
                    if t is not None:
                        yield file.license, file.source, file.hour, t, parts[1], parts[2]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        from pyspark import TaskContext

        store, root = _open(self.path)
        task = f"{self.job[:8]}-{TaskContext.get().taskAttemptId()}"
        files, refused, open_ = [], 0, None
        for row in iterator:
            if row.recv_t is None or not inside(row.source):
                refused += 1
                continue
            hour = (_EPOCH + timedelta(seconds=row.recv_t // 1_000_000)).strftime("%Y/%m/%d/%H")
            place = f"{row.license}/{row.source.replace(':', '/')}/{hour}"
            if open_ is None or open_[0] != place:
                # rows come sorted by place, so one file is open at a time
                if open_ is not None:
                    open_[1].close()
                    open_[2].close()
                at = f"{root}/_writing-{self.job}/{task}/{len(files)}.gz"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                raw = store.open_output_stream(at, compression=None)
                open_ = place, gzip.open(raw, "wb", compresslevel=6), raw
                files.append((at, f"{root}/{place}.{task}-{len(files)}.gz"))
            body = (row.body or "").rstrip("\r\n").replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
            open_[1].write(f"{written_time(row.recv_t)}\t{row.station or ''}\t{body}\n".encode())
        if open_ is not None:
            open_[1].close()
            open_[2].close()
        return _Written(files, refused)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        done = [m for m in messages if m is not None]
        for at, place in (f for m in done for f in m.files):
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            store.move(at, place)
        self._clear(store, root)
        refused = sum(m.refused for m in done)
        if refused:
            logging.getLogger(__name__).warning("%d receptions refused: no time, or a source that names no place in the archive", refused)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        own = f"{root}/_writing-{self.job}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class HourlyArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("an archive is only added to")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HourlyArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(receptions: DataFrame, path: str) -> None:
    """Adds receptions (seq, recv_t in microseconds, source, station, body): dealt out by licence, source and hour, the hour's lines in order."""
    spark = receptions.sparkSession
    register(spark)
    hour = F.date_format(F.timestamp_micros("recv_t"), "yyyy-MM-dd HH")
    rows = receptions.select(C.license_of(F.col("source")).alias("license"), "source", hour.alias("hour"), "recv_t", "station", "body", "seq")
    # an hour with very many lines is split over tasks, each with a file of its own
    dealt = rows.hint("rebalance", "license", "source", "hour").sortWithinPartitions("license", "source", "hour", "seq").drop("seq")
    dealt.write.format(NAME).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Receptions of an archive; filters on license, source and hour (``2024-01-02 03``) choose the files."""
    register(spark)
    return spark.read.format(NAME).option("path", path).load()

"""The lake's files as a Spark data source that prunes what it opens, with a writer that commits.

``spark.read.format("barlake").load(root)`` plans a partition for each file of
``timeframe=…/symbol=…`` folders that the pushed filters leave: equality and IN on
timeframe and symbol choose folders, bounds on timestamp choose files by the years
in their names and row groups by their statistics. All of these are then applied
to the rows, so Spark filters no more. Files that Spark wrote into the lake, whose
names tell no year, are read too.

``df.write.format("barlake").mode("append").save(root)`` writes files under
``_staged/<job>``, which no reader looks at, and moves them into place when all
tasks have succeeded; a job that fails deletes its folder. ``mode("overwrite")`` replaces
the symbols' folders that the job wrote. Tasks write a file for each run of one
symbol and year, so ``write_bars`` deals and sorts the bars first.

Root is a path that Arrow's file systems reach, the same from all executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from barlume.sources.contract import FIELDS, check_timeframe

SCHEMA = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, timeframe string"
_ARROW = pa.schema([("symbol", pa.string()), ("timestamp", pa.timestamp("us", "UTC")), *((f, pa.float64()) for f in FIELDS), ("timeframe", pa.string())])
_STORED = pa.schema([_ARROW.field(n) for n in ("timestamp", *FIELDS)])
_FOLDER = re.compile(r"timeframe=([^/]*)/symbol=([^/]*)/([^/]*\.parquet)\Z")
_YEAR = re.compile(r"year(\d{4})-")
_LOW, _HIGH = datetime(1, 1, 2, tzinfo=timezone.utc), datetime(9999, 12, 30, tzinfo=timezone.utc)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", path))


def _utc(x: datetime) -> datetime:
    return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)


@dataclass
class Wanted:
    """What pushed filters leave; None: any. Bounds are inclusive."""

    symbols: set[str] | None = None
    timeframes: set[str] | None = None
    low: datetime = _LOW
    high: datetime = _HIGH
    exact: list[tuple[str, datetime]] = field(default_factory=list)  # strict bounds

    def take(self, f: Filter) -> bool:
        """Whether the filter is understood, and so applied by this source."""
        if isinstance(f, IsNotNull):
            return f.attribute in (("symbol",), ("timeframe",))
        if len(f.attribute) != 1:
            return False
        name, value = f.attribute[0], f.value
        if name in ("symbol", "timeframe") and isinstance(f, EqualTo | In):
            found = {value} if isinstance(f, EqualTo) else set(value)
            if not all(isinstance(v, str) for v in found):
                return False
            kept = f"{name}s"
            setattr(self, kept, found if getattr(self, kept) is None else found & getattr(self, kept))
            return True
        if name != "timestamp" or not isinstance(value, datetime) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        at = _utc(value)
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, at)
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = min(self.high, at)
        if isinstance(f, GreaterThan | LessThan):
            self.exact.append((">" if isinstance(f, GreaterThan) else "<", at))
        return True

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if (self.low, self.high) == (_LOW, _HIGH):
            return batch
        t, at = batch.column("timestamp"), lambda x: pa.scalar(x, pa.timestamp("us", "UTC"))
        keep = pc.and_(pc.greater_equal(t, at(self.low)), pc.less_equal(t, at(self.high)))
        for sign, x in self.exact:
            keep = pc.and_(keep, pc.greater(t, at(x)) if sign == ">" else pc.less(t, at(x)))
        return batch.filter(keep)

    def group(self, group: pq.RowGroupMetaData, column: int) -> bool:
        s = group.column(column).statistics
        return not (s and s.has_min_max) or _utc(s.min) <= self.high and _utc(s.max) >= self.low


class LakeFile(InputPartition):
    def __init__(self, path: str, timeframe: str, symbol: str) -> None:
        self.path, self.timeframe, self.symbol = path, timeframe, symbol


class LakeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.wanted = root, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def _folders(self, store: fs.FileSystem, at: str, name: str, wanted: set[str] | None) -> list[str]:
        if wanted is not None:  # no listing of the others
            found = store.get_file_info([f"{at}/{name}={quote(w, safe=' ')}" for w in sorted(wanted)])
        else:
            found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(i.path for i in found if i.type == fs.FileType.Directory and i.base_name.startswith(f"{name}="))

    def partitions(self) -> list[LakeFile]:
        store, at = _store(self.root)
        out = []
        for frame in self._folders(store, at, "timeframe", self.wanted.timeframes):
            for folder in self._folders(store, frame, "symbol", self.wanted.symbols):
                for info in store.get_file_info(fs.FileSelector(folder)):
                    m, year = _FOLDER.search(info.path), _YEAR.match(info.base_name)
                    if m and (not year or self.wanted.low.year <= int(year[1]) <= self.wanted.high.year):
                        out.append(LakeFile(info.path, unquote(m[1]), unquote(m[2])))
        return out

    def read(self, partition: LakeFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, LakeFile):  # Spark asks for one empty partition where there are none
            return
        store, _ = _store(self.root)
        with store.open_input_file(partition.path) as source:
            file = pq.ParquetFile(source)
            column = file.schema_arrow.names.index("timestamp")
            groups = [g for g in range(file.num_row_groups) if self.wanted.group(file.metadata.row_group(g), column)]
            for batch in file.iter_batches(row_groups=groups, columns=_STORED.names) if groups else ():
                batch = self.wanted.rows(batch.cast(_STORED) if batch.schema != _STORED else batch)
                own = {"symbol": pa.array([partition.symbol] * len(batch)), "timeframe": pa.array([partition.timeframe] * len(batch))}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in _ARROW.names], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]  # below the staging folder, which has the lake's layout


class LakeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, timeframe: str, overwrite: bool) -> None:
        self.root, self.timeframe, self.overwrite, self.job = root, check_timeframe(timeframe), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.root)
        files: list[str] = []
        key, writer = None, None
        try:
            for batch in batches:
                missing = [n for n in ("symbol", "timestamp", *FIELDS) if n not in batch.schema.names]
                if missing:
                    raise ValueError(f"missing columns {missing}")
                if batch.column("symbol").null_count or batch.column("timestamp").null_count:
                    raise ValueError("a bar without symbol or timestamp")
                years = pc.year(batch.column("timestamp").cast(pa.timestamp("us", "UTC"))).to_pylist()
                keys = list(zip(batch.column("symbol").to_pylist(), years, strict=True))
                edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if keys[a] != key:
                        if writer:
                            writer.close()
                        key = keys[a]
                        name = f"timeframe={self.timeframe}/symbol={quote(key[0], safe=' ')}/year{key[1]:04d}-{uuid.uuid4().hex}.parquet"
                        store.create_dir(f"{at}/_staged/{self.job}/{name.rpartition('/')[0]}")
                        writer = pq.ParquetWriter(f"{at}/_staged/{self.job}/{name}", _STORED, filesystem=store)
                        files.append(name)
                    writer.write_batch(pa.RecordBatch.from_arrays([batch.column(n).slice(a, b - a).cast(_STORED.field(n).type) for n in _STORED.names], schema=_STORED))
        finally:
            if writer:
                writer.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves what successful tasks wrote; files of other attempts go with the staging folder."""
        store, at = _store(self.root)
        files = [f for m in messages if m for f in m.files]
        folders = {f.rpartition("/")[0] for f in files}
        before = [i.path for d in sorted(folders) if self.overwrite for i in store.get_file_info(fs.FileSelector(f"{at}/{d}", allow_not_found=True)) if i.base_name.endswith(".parquet")]
        for d in sorted(folders):
            store.create_dir(f"{at}/{d}")
        for f in files:
            store.move(f"{at}/_staged/{self.job}/{f}", f"{at}/{f}")
        for path in before:  # the new bars are there before the old ones go
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.root)
        if store.get_file_info(f"{at}/_staged/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_staged/{self.job}")
        left = store.get_file_info(f"{at}/_staged")
        if left.type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{at}/_staged")):
            store.delete_dir(f"{at}/_staged")


class LakeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barlake"

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a lake needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> LakeReader:
        return LakeReader(self._root())

    def writer(self, schema, overwrite: bool) -> LakeWriter:
        return LakeWriter(self._root(), self.options.get("timeframe", "1d"), overwrite)


def register(spark: SparkSession) -> None:
    """Enters the source into a session, in which Python sources may take filters from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LakeDataSource)


def write_bars(bars: DataFrame, root: str, timeframe: str = "1d", mode: str = "append") -> None:
    """Bars, dealt by symbol and year and sorted, so that a task writes few files."""
    year = F.year("timestamp")
    rows = bars.select("symbol", "timestamp", *FIELDS).repartition("symbol", year).sortWithinPartitions("symbol", "timestamp")
    rows.write.format("barlake").option("timeframe", timeframe).mode(mode).save(root)

"""What the training-data operators share: tables, shared folders, Arrow maps.

Every operator selects the columns it needs by name before it does anything
else, so further columns, whatever their names, never clash with its own.
"""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)



def _numerals() -> str:
    """What the standard module takes for word characters, though they are neither letters nor decimal digits, as a class. The last stand below U+20000."""
    found = [c for c in range(128, 0x20000) if chr(c).isalnum() and unicodedata.category(chr(c)) in ("No", "Nl")]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


#: A run of letters, as the Unicode property has them: no digits, and no numerals like the half or the Roman eight.
LETTERS = re.compile(f"[^\\W\\d_{_numerals()}]+")

#: Texts are gathered up to so many characters before a vectorised pass.
CHUNK_CHARS = 2_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a folder under the warehouse on a
    cluster, and a temporary one in local mode (tests).
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not at:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        at = tempfile.mkdtemp(prefix="barlume-shared-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_barlume"
        _OWN[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes those that no later plan reads; the caller names them. The
    rest, which lazy results may still read, goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def hash_below(share: float, column: str, salt: int) -> Column:
    """True for about ``share`` of the values of ``column``, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; a null text is the empty one."""
    return [x or "" for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text_column: str, chars: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """Record batches gathered to tables of bounded text, cut where one batch holds more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        weight = max(1, batch.column(batch.schema.get_field_index(text_column)).nbytes)
        parts = max(1, -(-weight // chars))
        step = max(1, -(-batch.num_rows // parts))
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            held.append(piece)
            size += weight * piece.num_rows // batch.num_rows
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Table], pa.Table]],
    schema: str,
    text_column: str = "text",
    chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Apply a table-to-table function to bounded chunks of a DataFrame, without a shuffle.

    ``make`` runs once per task and returns the function, so that per-task
    state (caches, compiled patterns) is built there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for chunk in chunks(batches, text_column, chars):
            yield from work(chunk).to_batches()
            del chunk
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_column: str = "text") -> DataFrame:
    """Keep the rows whose text a Python judge keeps; columns stay as they are, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for chunk in chunks(batches, text_column):
            keep = pa.array(judge(texts_of(chunk.column(text_column))), pa.bool_())
            yield from chunk.filter(keep).to_batches()
            del chunk
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)

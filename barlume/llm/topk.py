"""Exact top-k search by no-random-access aggregation.

Candidates are dealt into blocks, one task each. In a block each dimension has
its list of candidates sorted by value; a query reads it from the end that its
own component favours. Lists are read sequentially, in stretches, for a batch of
queries at once: each entry that is read adds to its candidate's partial scores
and marks the list as met. After a stretch a candidate's lower bound is its
partial score with the last value of each list that it was not met in, and its
upper bound the same with the value that is next to be read there. Candidates
whose upper bound is below the k-th best lower bound are outsiders. Reading
stops when at most twice k candidates, or a sixteenth of the block, can qualify
for a query on average, or the lists end; then the final scores of those are
resolved. Blocks' results are merged by rank.

A block holds up to ``block_rows`` candidates, fewer where the table is small,
so that all cores have work; queries stream through it in batches, as the
narrowest integers that hold them, so memory does not grow with the input.

Edge cases: vectors that are null or hold a null or non-finite component, and
rows without an id, take no part. Every row is a candidate, also where rows
repeat an id, with the same or another vector; every row whose id is asked for is
a query of its own, and only that row itself isn't its candidate. Vectors of
different lengths are compared over their common components. Ties go to smaller
ids. An empty table gives an empty result; further columns are not read. Scores
are exact: sums are float32 where they stay below 2**24, float64 below 2**53,
else 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch

BLOCK_ROWS, LEAST_ROWS, BATCH = 32768, 1024, 64
#: Where reading pauses for bounds, in eighths of the lists.
STRETCHES = (4, 6, 7, 8)
#: For each byte of bits, which of its eight lists have not been read.
_UNSET = 1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integers, short ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), flat.dtype if len(flat) else np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _exact(most: int):
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class SortedLists:
    """The candidates of a block, with a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((rows, ids))  # so that of equal scores the first place has the smallest id
        self.rows, self.ids, self.values = rows[order], ids[order], values[order].astype(np.int64)
        self.by_row = np.argsort(self.rows)
        self.down = np.argsort(-self.values, 0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.values, self.down, 0)  # what is read, from the largest to the smallest
        self.read = 0  # entries, by both ends
        self.most = int(np.abs(self.values).max(initial=0))
        self._typed: dict = {}

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self._typed:
            self._typed[kind] = self.values.astype(kind), self.sorted.astype(kind)
        return self._typed[kind]

    def _own(self, query_rows: np.ndarray) -> np.ndarray:
        """The place of each query's own row, or -1."""
        n = len(self.rows)
        at = np.minimum(np.searchsorted(self.rows, query_rows, sorter=self.by_row), n - 1)
        return np.where(self.rows[self.by_row[at]] == query_rows, self.by_row[at], -1)

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, candidates' ids, scores) of up to k best for each query.

        ``low`` [candidates, queries] starts at the worst score that the lists allow and
        gains what each entry is better than its list's last one as the entry is read, so
        it is the lower bound. What unread lists can add at most comes from the bits of
        lists that a candidate was met in, eight lists a look-up.
        """
        n, dims = self.values.shape
        width = min(dims, queries.shape[1])
        q = np.zeros((dims, len(queries)), np.int64)
        q[:width] = queries[:, :width].T
        kind = _exact(4 * self.most * int(np.abs(q).max(initial=0)) * max(1, dims))
        x, lists = self._as(kind)
        q = q.astype(kind)
        never = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
        ends = ((np.maximum(q, 0), self.down, lists), (np.minimum(q, 0), self.down[::-1], lists[::-1]))  # a query reads each list from its better end
        low = np.zeros((n, q.shape[1]), kind) + sum(lists[-1] @ weight for weight, _, lists in ends)
        met = [np.zeros((-(-dims // 8), n), np.uint8) for _ in ends]
        own = self._own(query_rows)
        mine = np.flatnonzero(own >= 0)
        able, depth = np.ones(low.shape, bool), 0
        for stop in dict.fromkeys(-(-n * s // 8) for s in STRETCHES):
            for (weight, ids, lists), bits in zip(ends, met, strict=True):
                for j in np.flatnonzero(weight.any(1)).tolist():
                    at = ids[depth:stop, j]  # no candidate twice in one list
                    low[at] += (lists[depth:stop, j] - lists[-1, j])[:, None] * weight[j]
                    bits[j // 8, at] |= np.uint8(1 << j % 8)
            self.read += 2 * (stop - depth) * dims
            depth = stop
            low[own[mine], mine] = never
            bar = np.partition(low, n - k, 0)[n - k] if n > k else np.full(q.shape[1], never)
            high = low if depth == n else self._upper(low, ends, met, depth)
            able = (high >= bar) & (low > never)
            if np.count_nonzero(able) <= max(2 * k, n // 16) * q.shape[1]:
                break
        for c in range(q.shape[1]):
            at = np.flatnonzero(able[:, c])
            score = low[at, c] if depth == n else x[at] @ q[:, c]  # the final scores of those that can qualify
            best = np.argsort(-score, kind="stable")[:k]
            yield c, self.ids[at[best]], score[best].astype(np.int64)

    @staticmethod
    def _upper(low: np.ndarray, ends: tuple, met: list[np.ndarray], depth: int) -> np.ndarray:
        """Upper bounds: lists that a candidate was not met in give the entry at ``depth`` at best."""
        high = low.copy()
        for (weight, _, lists), bits in zip(ends, met, strict=True):
            more = (lists[depth] - lists[-1])[:, None] * weight  # the next entry against the last
            for b, seen in enumerate(bits):
                eight = more[8 * b : 8 * b + 8]
                high += (_UNSET[:, : len(eight)].astype(low.dtype) @ eight)[seen]
        return high


def to_integers(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component, for the rows that take part.

    Rows get numbers, which hold as the table is written.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(sound)
    whole = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return Scratch(df.sparkSession, "topk").put(whole, "vectors")


def _dealt(spark: SparkSession, n: int) -> list[int]:
    """n keys, one for each of n partitions of a shuffle by hash."""
    found = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).groupBy("at").agg(F.min("key").alias("key")).collect()
    keys = {r["at"]: r["key"] for r in found}
    spare = iter(range(40 * n + 200, 41 * n + 200))  # a partition that no key met stays empty, a key of its own goes elsewhere
    return [keys[i] if i in keys else next(spare) for i in range(n)]


def nra_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by integer inner product.

    Both inputs have columns row, vec_id and v (array of long), as ``to_integers`` makes them.
    """
    spark = vectors.sparkSession
    size = F.array_max(F.transform("v", lambda x: F.greatest(x, -x)))
    n, most = vectors.agg(F.count("*"), F.max(size)).first()
    size_each = min(block_rows, max(LEAST_ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // size_each))
    kind = "smallint" if (most or 0) < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    keys = F.array(*map(F.lit, _dealt(spark, blocks)))
    narrow = F.col("v").cast(f"array<{kind}>").alias("v")
    held = vectors.select(F.get(keys, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).alias("block"), F.lit(False).alias("asks"), "row", "vec_id", narrow)
    asked = queries.select(F.explode(keys).alias("block"), F.lit(True).alias("asks"), "row", "vec_id", narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, lists = None, [], None

        def answer(rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(ids), BATCH):
                found = list(lists.search(rows[start : start + BATCH], v[start : start + BATCH], k))
                at = np.concatenate([np.full(len(c), start + i) for i, c, _ in found])
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(rows[at]), "query_id": pa.array(ids[at]), "vec_id": pa.array(np.concatenate([c for _, c, _ in found])), "score": pa.array(np.concatenate([s for _, _, s in found])),
                })

        def gathered() -> SortedLists:
            width = max(m.shape[1] for _, _, m in parts)
            return SortedLists(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in parts]))

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(part):
                    continue
                piece = batch.slice(int(part[0]), len(part))
                rows, ids, v = piece.column(2).to_numpy(), piece.column(3).to_numpy(), _matrix(piece.column(4))
                b, asks = divmod(int(key[part[0]]), 2)
                if b != block:
                    block, parts, lists = b, [], None
                if not asks:
                    parts.append((rows, ids, v))
                    continue
                if parts:
                    lists, parts = gathered(), []
                if lists is not None:
                    yield from answer(rows, ids, v)

    found = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles (64-bit hashes). Two documents link where
their sets' Jaccard similarity reaches a bound; the result is each document's
connected component.

1. Texts with the same set form a class (128-bit fingerprint), so copies are
   never paired. A class has a number of its own; which doc_ids hold it is
   looked at in the end only, so a doc_id may hold several.
2. Inverted lists. Two sets of n and m shingles link where they share T of
   them, T = ceil(s (n + m) / (1 + s)). DivideSkip splits the lists of a set's
   shingles into long ones, at most T - 1, which it only probes, and short ones,
   in one of which at least every partner must stand. Here shingles are ordered
   by an estimate of how many documents hold them (two hash rows of counters of
   a fixed size, filled from all documents; any estimate gives a valid order),
   and the index holds each set in its short lists: those of its first
   n - ceil(s n) + 1 shingles. Lists are sorted by (shingle, size, class) and dealt out by ranges of
   all three, so the list of a frequent shingle is split over tasks.
3. Search, in two rounds. First each set is tried against a few neighbours
   from its lists: the one before it by size and, of two size bins, the one
   whose own lists are longest, which is near to most others. Then, exactly,
   against all others of its lists that aren't yet in its component and pass the
   positional filter (at the first shingle that two sets share, what is left of
   both still holds the overlap that they need). Links between members of one
   component change no result, so nothing is lost, and large groups of near
   copies aren't paired out.
4. A search takes one probe and its candidates, in blocks of about 256, with
   their whole sets: DivideSkip sets the longest lists of the block apart,
   heap-merges the short ones with skips (MergeSkip), probes the long ones by
   binary search, and keeps candidates that reach the required overlap T.

Texts go along compressed, once a round for the classes and once for each
candidate pair. No step keeps a whole list in one task: pairs of a set with many candidates
are dealt into blocks by a hash, list statistics and star steps are
aggregated before the shuffle and joined back, where adaptive execution splits
a hot key.

Edge cases: a null or empty text, or one of white space, has no shingles and
links with nothing; its component is its own doc_id. A row without doc_id is
returned with its count and a null component, and links with nothing. Rows that
repeat a doc_id with other texts link it by all of them; each row has its own
count, all have one component. An empty table gives an empty table. Further
columns, whatever their names, are not read (``keep_one`` returns them).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import WORD_PATTERN, Scratch, map_texts
from barlume.llm.graph import connected_components

SIGN_SCHEMA = "doc_id long, digest binary, n_shingles long, set_key binary, prefix array<long>, central int, packed binary"
LIST_SCHEMA = "shingle long, class long, n int, place int, central int, near array<struct<class:long,central:int>>"
#: Counters: two rows of 2**ROW_BITS, summed and sent in parts.
ROW_BITS, PARTS = 21, 64
BLOCK = 256
#: Rows of the sorted lists that are looked at together.
LIST_ROWS = 500_000
MU = 0.01
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return shingles_of((text or "").encode("utf-8", "surrogatepass"), words)


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """The same of a text in UTF-8; bytes.lower and bytes.split know ASCII only."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(code))
    with np.errstate(over="ignore"):
        h = code[: len(code) - size + 1] + np.uint64(size)
        for k in range(1, size):
            h = (h ^ h >> np.uint64(29)) * _MULTIPLY + code[k : len(code) - size + 1 + k]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _cells(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << ROW_BITS) - 1)
    return (found & mask).astype(np.int64), (found >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def count_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """log2 of the number of documents behind each counter, [2, 2**ROW_BITS] of uint8: 4 MB at any input size."""
    size = (2 << ROW_BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << ROW_BITS), np.int64)
        held: list[np.ndarray] = []

        def pour() -> None:
            for row, at in zip(table, _cells(np.concatenate(held)), strict=True):
                row += np.bincount(at, minlength=len(row))
            held.clear()

        size_held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, words))
                size_held += len(held[-1])
                if size_held > 1_000_000:
                    pour()
                    size_held = 0
        if held:
            pour()
        if table.any():
            kind = next(k for k in (np.uint8, np.uint16, np.uint32) if table.max() <= np.iinfo(k).max)
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "data": [pack(x.astype(kind).tobytes()) for x in table.reshape(PARTS, size)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = unpack(data.as_buffer())
                total[part] = total.get(part, 0) + np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // size]).astype(np.int64)
        for part, sums in total.items():
            logs = np.floor(np.log2(np.maximum(1, sums))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [logs.tobytes()]})

    schema = "part int, data binary"
    out = np.zeros((PARTS, size), np.uint8)
    for row in docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[row["part"]] = np.frombuffer(row["data"], np.uint8)
    return out.reshape(2, 1 << ROW_BITS)


def sign(docs: DataFrame, words: int, num: int, den: int, logs: np.ndarray) -> DataFrame:
    """Per row of (doc_id, digest, text): both, the size of its set, the set's fingerprint, its prefix in the global order,

    how many others its lists hold (eighths of a logarithm), the compressed text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def make():
        low, high = shared.value
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress

        def work(chunk: pa.Table) -> pa.Table:
            n, keys, prefix, ends, central, packed = [], [], [], [0], [], []
            for text in chunk.column("text").to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                if len(found):
                    a, b = _cells(found)
                    held = np.minimum(low[a], high[b])
                    first = np.lexsort((found, held))[: len(found) + num * len(found) // -den + 1]
                    prefix.append(found[first].view(np.int64))
                    keys.append(set_key(found))
                    central.append(int(8 * np.log2(np.exp2(held[first].astype(float)).sum())))
                    packed.append(pack(text.encode("utf-8", "surrogatepass")))
                else:
                    for column, value in ((keys, None), (packed, None), (central, 0), (prefix, np.zeros(0, np.int64))):
                        column.append(value)
                ends.append(ends[-1] + len(prefix[-1]))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            return pa.table({
                "doc_id": chunk.column("doc_id"), "digest": chunk.column("digest"), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()),
                "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), "central": pa.array(central, pa.int32()), "packed": pa.array(packed, pa.binary()),
            })

        return work

    return map_texts(docs.select("doc_id", "digest", "text"), make, SIGN_SCHEMA)


def inverted_lists(classes: DataFrame, num: int, den: int) -> DataFrame:
    """The short lists that hold two classes or more, with each member's neighbours for the first round.

    Tasks look at stretches of the sorted lists; the first and the last row of a
    stretch stay even where they stand alone, as their list may go on next door.
    """
    rows = classes.select("class", "n_shingles", "central", F.posexplode("prefix").alias("place", "shingle"))
    rows = rows.select("shingle", "class", F.col("n_shingles").cast("int").alias("n"), "place", "central")
    base = float(np.log(den / num))

    def look(table: pa.Table) -> pa.RecordBatch:
        shingle, ids, n, place, central = (table.column(c).to_numpy() for c in ("shingle", "class", "n", "place", "central"))
        size = len(shingle)
        new = np.concatenate(([True], shingle[1:] != shingle[:-1]))
        lone = new & np.concatenate((new[1:], [True]))
        lone[[0, -1]] = False
        at = np.arange(size)
        others = [np.where(new, at, at - 1)]
        for shift in (0.0, 0.5):  # the most central one of each bin; of equals the smallest class
            bin_ = np.floor(np.log(n) / base + shift).astype(np.int64)
            begin = np.flatnonzero(new | np.concatenate(([True], bin_[1:] != bin_[:-1])))
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, size)))
            order = np.lexsort((ids, -central, group))
            others.append(order[begin][group])
        other = np.stack(others, 1)
        other[:, 2] = np.where(other[:, 2] == other[:, 1], at, other[:, 2])
        m, q, k, r = n[other].astype(np.int64), place[other], n[:, None].astype(np.int64), place[:, None]
        fits = (other != at[:, None]) & ((num + den) * np.minimum(k - r, m - q) >= num * (k + m)) & (den * np.minimum(k, m) >= num * np.maximum(k, m))
        keep = ~lone
        fits = fits[keep]
        near = other[keep][fits]
        found = pa.StructArray.from_arrays([pa.array(ids[near]), pa.array(central[near])], ["class", "central"])
        ends = np.concatenate(([0], np.cumsum(fits.sum(1)))).astype(np.int32)
        cols = {"shingle": shingle, "class": ids, "n": n, "place": place, "central": central}
        return pa.RecordBatch.from_pydict({k: pa.array(v[keep]) for k, v in cols.items()} | {"near": pa.ListArray.from_arrays(pa.array(ends), found)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= LIST_ROWS:
                yield look(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield look(pa.Table.from_batches(held))

    return rows.repartitionByRange("shingle", "n", "class").sortWithinPartitions("shingle", "n", "class").mapInArrow(run, LIST_SCHEMA)


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(id, number of lists) of the ids in at least ``t`` of the sorted lists: heap merge that skips what can't reach t."""
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    place = [0] * len(lists)
    while len(heap) >= t:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t:
            yield least, len(popped)
            target = least + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = max(heap[0][0], least + 1)
        for i in popped:
            place[i] = bisect_left(lists[i], target, place[i])
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))


def divide_skip(lists: list[list[int]], t: int, mu: float = MU) -> dict[int, int]:
    """The ids in at least ``t`` of the sorted lists, with their counts."""
    if t < 1 or len(lists) < t:
        return {}
    lists = sorted(lists, key=len, reverse=True)
    apart = min(t - 1, int(t / (mu * log2(max(2, len(lists[0]))) + 1)))
    long, short = lists[:apart], lists[apart:]
    out = {}
    for x, n in merge_skip(short, t - apart):
        for other in long:
            k = bisect_left(other, x)
            n += k < len(other) and other[k] == x
        if n >= t:
            out[x] = n
    return out


def search(probe: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """The places of the sets whose Jaccard similarity with the probe is at least num / den."""
    need = [-(-num * (len(probe) + len(s)) // (num + den)) for s in sets]
    lists: defaultdict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sets):
        at = np.searchsorted(probe, s)
        at[at == len(probe)] = 0
        for k in at[probe[at] == s].tolist() if len(probe) else []:
            lists[k].append(i)
    found = divide_skip(list(lists.values()), min(need, default=1))
    return sorted(i for i, n in found.items() if n >= need[i])


def verify(classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs of classes (a, b) that link. ``a`` is the probe: the side with more candidates, as far as is known."""
    many = scratch.put(pairs.groupBy("a").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK), f"many-{name}")
    blocks = pairs.join(many, "a", "left").select("a", "b", F.when(F.col("held").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("held") / BLOCK))).cast("int").alias("block"))
    probes = blocks.groupBy("a", "block").agg(F.lit(False).alias("tried")).select(F.col("a").alias("class"), "a", "block", "tried")
    wanted = blocks.select(F.col("b").alias("class"), "a", "block", F.lit(True).alias("tried")).unionByName(probes)
    rows = classes.select("class", "packed").join(wanted.hint("merge"), "class").select("a", "block", "tried", "class", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, probe, ids, sets = None, None, [], []
        unpack = zstandard.ZstdDecompressor().decompress

        def links() -> pa.RecordBatch:
            hits = search(probe, sets, num, den)
            return pa.RecordBatch.from_pydict({"a": pa.array([at[0]] * len(hits), pa.int64()), "b": pa.array([ids[i] for i in hits], pa.int64())})

        for batch in batches:
            for a, block, tried, one, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles_of(unpack(packed), words)
                if (a, block) != at:
                    if ids:
                        yield links()
                    at, probe, ids, sets = (a, block), None, [], []
                if tried:
                    ids.append(one)
                    sets.append(found)
                else:  # comes first, as it isn't tried
                    probe = found
        if ids:
            yield links()

    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "tried").mapInArrow(run, "a long, b long")


def _directed(a: str, b: str) -> list:
    """Columns a and b of a pair: the more central class asks; of equals the smaller."""
    ask = F.expr(f"{a}_central > {b}_central OR {a}_central = {b}_central AND {a} < {b}")
    return [F.when(ask, F.col(a)).otherwise(F.col(b)).alias("a"), F.when(ask, F.col(b)).otherwise(F.col(a)).alias("b")]


def classes_and_roots(docs: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Rows: doc_id, digest, n_shingles, set_key (null without shingles). Classes: set_key, root, the same number for all classes that links tie together.

    ``docs`` has doc_id, digest and text.
    """
    signed = scratch.put(sign(docs, words, num, den, count_shingles(docs, words)), "signed")
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "central", "prefix", "packed")]
    classes = scratch.put(signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(*same).withColumn("class", F.monotonically_increasing_id()), "classes")
    rows = scratch.put(signed.select("doc_id", "digest", "n_shingles", "set_key"), "rows")
    scratch.drop("signed")  # the classes have texts and prefixes once
    lists = scratch.put(inverted_lists(classes, num, den), "lists")
    near = lists.select("class", F.col("central").alias("class_central"), F.explode("near").alias("o")).select("class", "class_central", F.col("o.class").alias("other"), F.col("o.central").alias("other_central"))
    tried = scratch.put(near.select(*_directed("class", "other")).distinct(), "tried")
    links = scratch.put(verify(classes, tried, words, num, den, scratch, "tried"), "links")
    joined = connected_components(links, scratch, "first")

    # all pairs in a list across the components found so far
    # the joins over lists are alike at every size: merged, so that a hot key can be split
    sets = lists.drop("near").join(joined.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    sets = scratch.put(sets, "sets")
    scratch.drop("lists")
    open_ = scratch.put(sets.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle"), "open")
    mixed = scratch.put(sets.join(open_.hint("merge"), "shingle", "left_semi"), "mixed")
    scratch.drop("sets", "open")
    other = mixed.select("shingle", F.col("class").alias("other"), F.col("n").alias("o_n"), F.col("place").alias("o_place"), F.col("central").alias("other_central"), F.col("root").alias("o_root"))
    mine = mixed.withColumnRenamed("central", "class_central")
    fits = f"{num + den} * least(n - place, o_n - o_place) >= {num} * (n + o_n) AND {den} * least(n, o_n) >= {num} * greatest(n, o_n)"
    across = mine.join(other.hint("merge"), "shingle").filter(f"class < other AND root <> o_root AND {fits}").select(*_directed("class", "other")).distinct()
    rest = scratch.put(across.join(tried, ["a", "b"], "left_anti"), "rest")
    more = scratch.put(verify(classes, rest, words, num, den, scratch, "rest"), "more")
    star = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = connected_components(star.unionByName(more), scratch, "second")
    roots = classes.select("set_key", "class").join(joined.withColumnRenamed("node", "class"), "class", "left").select("set_key", F.coalesce("root", "class").alias("root"))
    roots = scratch.put(roots, "roots")
    scratch.drop("classes", "mixed", "tried", "many-tried", "many-rest", "rest", "links", "more")
    return rows, roots


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; linked where den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"), F.col("text").alias("own"))
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "digest", "text")
    signed, roots = classes_and_roots(named, words, num, den, scratch)
    held = signed.filter("set_key IS NOT NULL").select("doc_id", "set_key").distinct().join(roots, "set_key").select("doc_id", "root")
    least = scratch.put(held.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    of = scratch.put(held.join(least, "root").select("doc_id", "least").distinct(), "of")
    found = of.groupBy("doc_id").agg(F.min("least").alias("component_id"))
    # a doc_id with several texts ties their components together
    bridges = scratch.put(of.join(found, "doc_id").filter("least <> component_id").select(F.col("component_id").alias("a"), F.col("least").alias("b")).distinct(), "bridges")
    if not bridges.isEmpty():
        tied = connected_components(bridges, scratch, "tied").select(F.col("node").alias("component_id"), "root")
        found = found.join(tied, "component_id", "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    nameless = map_texts(docs.filter("doc_id IS NULL").select("own"), lambda: lambda t: pa.table({"n_shingles": pa.array([len(shingles(x, words)) for x in t.column("own").to_pylist()], pa.int64())}), "n_shingles long", "own")
    null = F.lit(None).cast("long")
    return out.unionByName(nameless.select(null.alias("doc_id"), "n_shingles", null.alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies and, of each component, the one with the smallest doc_id.

    All columns stay. A document is a doc_id with a text (told by its md5): of equal
    ones one remains, and other texts under the same doc_id, or texts without one,
    stay or go by their own links. Those without doc_id stand behind the others; of
    them, all that have no shingles remain.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    key = F.struct(F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    signed, roots = classes_and_roots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text"), words, num, den, scratch)
    named = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "digest")
    best = signed.filter("set_key IS NOT NULL").join(roots, "set_key").groupBy("root").agg(F.min(named).alias("best")).select("best.id", "best.digest")
    bare = signed.filter("set_key IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "digest").distinct()
    kept = best.unionByName(bare).select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("last"), "digest")
    # the row goes along as one value, so its columns cannot clash with these
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).select("row", F.coalesce("key.id", F.lit(0)).alias("id"), F.col("key.id").isNull().alias("last"), "key.digest")
    at = ["id", "last", "digest"]
    chosen = rows.join(kept, at, "left_semi").dropDuplicates(at).select("row.*")
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD_PATTERN)))


def components_sql(table: str = "documents", words: int = 4, num: int = 85, den: int = 100) -> str:
    """The same result in DuckDB SQL: all pairs that share a shingle, then reachability. For small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {words - 1}), ' '))) END AS s FROM w),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS t FROM s WHERE doc_id IS NOT NULL),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT doc_id, doc_id AS root FROM s UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s LEFT JOIN least USING (doc_id)"""

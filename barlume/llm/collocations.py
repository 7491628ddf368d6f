"""Phrase collocation mining: phrases that are said far more often than their parts would make them.

1. Texts are split into pieces at punctuation; pieces alike in language and words
   become one with a multiplicity, added up before the shuffle.
2. A task turns its pieces into weighted word sequences, first of one word, then of
   two, then of three, adds up those of a chunk, and deals them to buckets by the
   hash of their words, packed as columns with a dictionary of words.
3. For each bucket duckdb adds up the weights. It streams the rows in and spills
   beyond its memory limit, so a bucket may be larger than memory. A phrase's parts
   count as often as the phrase at least, so what is under the least count is needed
   no more, and only sequences whose parts reach it are dealt out a word further on:
   a task knows those by a filter of bits, of bounded size, that passes all of them
   and a few others (all, where a corpus has far more frequent words than bits).
4. Each candidate asks for the counts of its parts: requests are shuffled to the
   counts, answers back to the candidates. Requests for a frequent word can be split
   over tasks, since a count is one row.
5. A candidate inside a longer one that is at least ``inside`` percent as frequent is
   dropped, and each language's best stay: best of each of many parts first, so that
   no task sorts a language.

duckdb spills into the shared folder, or where that is no plain path into a folder
that Spark names for its own spills; a task's spill goes with it.

Edge cases: a null or empty text has no pieces; a null language is ``und``; repeated
rows count each time; a text without punctuation is one piece of any length; ties go
by the order of the contract, so results are the same in every run; an empty table
gives an empty result; further columns are not read. Sums of weights are exact up to
2**63, products in decimals of 38 digits.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, chunks, shared_dir

ENDS = r"[.,;:!?\x0A-\x0D]"
LEAST, INSIDE, TOP, WORDS = 10, 50, 2000, 3
#: Buckets for each shuffle partition; characters of a chunk; what duckdb holds before it spills; parts of a language that are ranked first.
BUCKETS_EACH, CHARS, MEMORY, PARTS = 2, 4_000_000, "256MB", 64
#: Bits of a filter at most: 16 MB, sent to every executor.
FILTER_BITS = 1 << 27
_COUNTS = "lang string, phrase string, n_words int, f long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of a language, their words parted by one space, and how often each occurs."""
    parts = F.explode(F.split(F.translate("text", _UPPER, _LOWER), ENDS)).alias("piece")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), parts).select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece"))
    return rows.filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbours part ways."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _summed(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns (codes under 2**31) and the sums of their weights."""
    if not len(weights):
        return columns, weights
    if len(columns) * int(max(c.max() for c in columns)).bit_length() <= 63:
        bits = int(max(c.max() for c in columns)).bit_length()
        key = reduce(lambda k, c: k << bits | c, columns[1:], columns[0].astype(np.int64))
        if (weights == 1).all():
            key = np.sort(key)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums = np.diff(np.concatenate((first, [len(key)])))
        else:
            order = np.argsort(key, kind="stable")
            key, weights = key[order], weights[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums = np.add.reduceat(weights, first)
        key = key[first]
        return [key >> bits * (len(columns) - 1 - i) & (1 << bits) - 1 for i in range(len(columns))], sums
    order = np.lexsort(columns[::-1])
    columns, weights = [c[order] for c in columns], weights[order]
    first = np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))))
    return [c[first] for c in columns], np.add.reduceat(weights, first)


class Told:
    """The words of a chunk's pieces as codes. A code is a word of a language, so a sequence's language is its first word's."""

    def __init__(self, langs: pa.Array, texts: pa.Array, m: np.ndarray) -> None:
        split = pc.split_pattern(texts, " ")
        sizes = np.diff(split.offsets.to_numpy())
        word, lang = split.flatten().dictionary_encode(), langs.dictionary_encode()
        spoken = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)
        both = word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + spoken
        known, self.code = np.unique(both, return_inverse=True)
        self.words, self.tongues = word.dictionary.take(pa.array(known // len(lang.dictionary))), lang.dictionary.take(pa.array(known % len(lang.dictionary)))
        self.weight, self.piece = np.repeat(m, sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.hashes = word_hashes(self.words, self.tongues)
        self.langs, self.every = lang.dictionary, np.zeros(len(lang.dictionary), np.int64)
        np.add.at(self.every, spoken, self.weight)

    def sequences(self, n: int, able: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct sequences of n words and their weights; those of ``able`` parts, where filters of shorter ones are given."""
        at = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)
        if able and n > 1:
            good = passes(able[0], self.hashes)[self.code]
            for k in range(n):
                at = at[good[at + k]]
        for size in range(2, n) if len(able) > 1 else ():
            for k in range(n - size + 1):
                at = at[passes(able[size - 1], self.hash([self.code[at + k + i] for i in range(size)]))]
        return _summed([self.code[at + k] for k in range(n)], self.weight[at])

    def hash(self, codes: list[np.ndarray]) -> np.ndarray:
        return chained([self.hashes[c] for c in codes])


def _string_hashes(values: pa.Array) -> np.ndarray:
    """64 bits of each string, the same in every task: a polynomial over its bytes, mixed."""
    values = pa.concat_arrays([values]).cast(pa.large_binary()) if not isinstance(values, pa.ChunkedArray) else values.combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    sizes = np.diff(ends)
    if not len(values) or not sizes.any():
        return _mixed(sizes.astype(np.uint64))
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    some = np.flatnonzero(sizes)
    starts = ends[:-1] - ends[0]
    out = np.zeros(len(values), np.uint64)
    out[some] = np.add.reduceat(data * power[np.arange(len(data)) - np.repeat(starts, sizes)], starts[some])
    return _mixed(out)


def word_hashes(words: pa.Array, tongues: pa.Array) -> np.ndarray:
    lang = tongues.dictionary_encode()
    return _mixed(_string_hashes(words) ^ _string_hashes(lang.dictionary)[lang.indices.to_numpy()] * np.uint64(0xD6E8FEB86659FD93))


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """The hash of sequences by those of their words."""
    return reduce(lambda h, x: _mixed(h * np.uint64(0xD6E8FEB86659FD93) ^ x), hashes)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _filter(known: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of all phrases of a table, 32 to a phrase where that's within ``FILTER_BITS``: none is missed, some others pass."""
    bits = 64
    while bits < min(FILTER_BITS, 32 * known.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column("phrase"), " ").flatten()
                each = word_hashes(words, batch.column("lang").take(pa.array(np.repeat(np.arange(batch.num_rows), n))))
                at = chained([each[k::n] for k in range(n)]) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_pydict({"at": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    found = known.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def _spill_folder(shared: str) -> str:
    plain = shared.removeprefix("file://") if shared.startswith("file:") else shared
    plain = plain if "://" not in plain else os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", ".")).split(",")[0]
    return f"{plain}/spill-{uuid.uuid4().hex}"


def counts(distinct: DataFrame, scratch: Scratch, least: int, words: int = WORDS, buckets: int | None = None, memory: str = MEMORY) -> DataFrame:
    """(lang, phrase, n_words, f) of every sequence with f >= ``least``; phrase '' has a language's word occurrences."""
    distinct = scratch.put(distinct, "pieces")
    able: list[np.ndarray] = []
    levels = []
    for n in range(1, words + 1):
        levels.append(scratch.put(_level(distinct, n, able, least, buckets, memory), f"counts{n}"))
        if least > 1 and n < words:
            able.append(_filter(levels[-1].filter("n_words > 0"), n))
    scratch.drop("pieces")
    return reduce(DataFrame.unionByName, levels)


def _level(distinct: DataFrame, n: int, able: list[np.ndarray], least: int, buckets: int | None, memory: str) -> DataFrame:
    """The counts of sequences of n words."""
    spark = distinct.sparkSession
    buckets = buckets or BUCKETS_EACH * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared, sent = shared_dir(spark), spark.sparkContext.broadcast(able)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "piece", CHARS):
            texts, langs = (chunk.column(c).combine_chunks() for c in ("piece", "lang"))
            told = Told(langs, texts, chunk.column("m").to_numpy())
            codes, f = told.sequences(n, sent.value)
            own = (told.hash(codes) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(own[order])) + 1, [len(own)])) if len(own) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                at = order[a:b]
                yield _packed(int(own[at[0]]), n, [c[at] for c in codes], f[at], told)
            for k in range(len(told.langs) if n == 1 else 0):
                yield _packed(int(_string_hashes(told.langs)[k] % np.uint64(buckets)), 0, [np.array([k])], told.every[k : k + 1], told)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])

        def bucket(first: pa.RecordBatch, rest: Iterator[tuple[int, int, bytes]], own: int, after: list) -> Iterator[pa.RecordBatch]:
            yield first
            for b, n, packed in rest:
                if b != own:
                    after.append((b, n, packed))
                    return
                yield _unpacked(n, packed, schema)

        rows = ((b, n, packed) for batch in batches for b, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        spill = _spill_folder(shared)
        try:
            head = next(rows, None)
            while head:
                after: list = []
                con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
                con.register("stream", pa.RecordBatchReader.from_batches(schema, bucket(_unpacked(*head[1:], schema), rows, head[0], after)))
                told = con.execute(f"SELECT lang, phrase, n_words, sum(f)::BIGINT AS f FROM stream GROUP BY ALL HAVING sum(f) >= {int(least)} OR phrase = ''")
                yield from told.to_arrow_reader(65536)
                con.close()
                head = after[0] if after else next(rows, None)
        finally:
            shutil.rmtree(spill, ignore_errors=True)

    packed = distinct.select("lang", "piece", "m").mapInArrow(pack, "bucket int, n_words int, packed binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, _COUNTS)


def _packed(bucket: int, n: int, codes: list[np.ndarray], f: np.ndarray, told: Told) -> pa.RecordBatch:
    """One row: the sequences of a bucket, words by their place in a lexicon of its own, compressed."""
    if n == 0:
        parts = [pa.record_batch({"lang": told.langs.take(pa.array(codes[0])), "f": f})]
    else:
        used, place = np.unique(np.concatenate(codes), return_inverse=True)
        place = place.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).reshape(n, -1)
        narrow = np.uint8 if f.max() < 256 else np.int64
        lexicon = {"word": told.words.take(pa.array(used)), "lang": told.tongues.take(pa.array(used)).dictionary_encode()}
        parts = [pa.record_batch({**{f"w{k}": place[k] for k in range(n)}, "f": f.astype(narrow)}), pa.record_batch(lexicon)]
    out = []
    for part in parts:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(part)
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n_words": pa.array([n], pa.int32()), "packed": [len(out[0]).to_bytes(8, "little") + b"".join(out)]})


def _unpacked(n: int, packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    size = int.from_bytes(packed[:8], "little")
    rows = pa.ipc.open_stream(packed[8 : 8 + size]).read_next_batch()
    if n == 0:
        return pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([""] * len(rows)), pa.array(np.zeros(len(rows), np.int32)), rows.column("f")], schema=schema)
    lexicon = pa.ipc.open_stream(packed[8 + size :]).read_next_batch()
    words = [lexicon.column("word").take(rows.column(k)) for k in range(n)]
    phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
    return pa.RecordBatch.from_arrays([lexicon.column("lang").take(rows.column(0)).dictionary_decode(), phrase, pa.array(np.full(len(rows), n, np.int32)), rows.column("f").cast(pa.int64())], schema=schema)


#: floor(1000000 a a / (l r)), exactly.
SCORE = "CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000BD DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each candidate by its lowest-scoring cut, of equal scores the first."""
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    ask = lambda cut, side, first, n: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), part(first, n).alias("part"))
    two, three = [ask(1, 0, 1, 1), ask(1, 1, 2, 1)], [ask(1, 0, 1, 1), ask(1, 1, 2, 2), ask(2, 0, 1, 2), ask(2, 1, 3, 1)]
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.when(F.col("n_words") == 2, F.array(*two)).otherwise(F.array(*three))).alias("x")).select("lang", "phrase", "a", "x.*")
    answers = asked.join(known.select("lang", F.col("phrase").alias("part"), "f").hint("merge"), ["lang", "part"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    cuts = answers.groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r")).withColumn("score", F.expr(SCORE))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buckets: int | None = None, memory: str = MEMORY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to three words; see the module."""
    known = counts(pieces(docs), Scratch(docs.sparkSession, "collocations"), least, WORDS, buckets, memory)
    total = known.filter("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = known.filter("n_words > 0")
    candidates = known.filter("n_words > 1")
    # the longest candidates ask for the two-word phrases that they begin and end with
    words = F.split("phrase", " ")
    ends = F.explode(F.array(*(F.array_join(F.slice(words, k, 2), " ") for k in (1, 2)))).alias("phrase")
    longer = known.filter("n_words = 3").select("lang", ends, F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored(candidates, known).join(longer.hint("merge"), ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {int(inside)} * a")
    order = (F.desc("score"), F.desc("a"), "phrase")
    first = Window.partitionBy("lang", "part").orderBy(*order)
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).drop("part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", *(F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")))


def collocations_sql(least: int = LEAST, inside: int = INSIDE, top: int = TOP, docs: str = "documents") -> str:
    """DuckDB SQL for ``collocations``."""
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '{ENDS}')) AS piece FROM {docs}),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i : i + k - 1] AS w, k FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM s, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, w, k, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (SELECT c.lang, c.w, c.k, c.f AS a, t.cut, l.f AS l, r.f AS r, 1000000 * c.f * c.f // (l.f * r.f) AS score
  FROM f c JOIN (VALUES (1), (2)) t(cut) ON t.cut < c.k JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : t.cut] JOIN f r ON r.lang = c.lang AND r.w = c.w[t.cut + 1 : c.k]
  WHERE c.k > 1 AND c.f >= {least}),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
longer AS (SELECT lang, w, max(f) AS f FROM (SELECT lang, w[1:2] AS w, f FROM f WHERE k = 3 AND f >= {least} UNION ALL SELECT lang, w[2:3], f FROM f WHERE k = 3 AND f >= {least}) GROUP BY ALL),
kept AS (SELECT low.*, {part(1, 3)} AS phrase FROM (SELECT low.* FROM low LEFT JOIN longer o ON o.lang = low.lang AND o.w = low.w WHERE o.f IS NULL OR 100 * o.f < {inside} * low.a) low)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= {top}"""

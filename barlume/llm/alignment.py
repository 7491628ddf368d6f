"""Cross-tokenizer alignment by a postings cogroup.

Each text is encoded by two vocabularies, A (byte-level) and B (pieces). The byte
offsets at which a token of either ends cut both into groups; the two tokens that
end there are a link. What an id pair counts is how many links of the whole corpus
hold it; per B id the highest count is its best.

1. One pass over the texts encodes them, groups their tokens and writes, for each
   chunk of documents, the documents' own figures, its postings (for each bucket of
   B ids one row: pair, document, multiplicity) and the sums of its pairs, added up
   over as many chunks of the task as fit a bound.
2. Sums are added up by pair, the best by B id: rows by pair, never by occurrence.
3. Postings and counts meet in a cogroup by B's bucket: a sorted stream, which
   spills, has a bucket's counts first and then its postings, so a task holds the
   counts of one bucket and one row of postings. A bucket with more postings than
   others is dealt over several tasks, each with the bucket's counts, so neither a
   frequent id nor a frequent pair stands in one task. What a row adds to its
   documents goes out as one row.
4. These are added up by document, a chunk's documents at a time.

Edge cases: texts that are null or empty, or whose tokens' bytes aren't the text's
(B drops or folds something), have no tokens: zeros and an empty digest; strings
of special tokens are plain text; each row is a document of its own, whatever its
id, and repeated rows count each time; texts of any length are read whole; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, chunks, texts_of
from barlume.llm.vocabularies import byte_level, pieces

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OWN = "doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, sha array<string>"
_CODED = f"chunk long, bucket int, pair array<long>, doc array<int>, m array<int>, sum_pair array<long>, sum_m array<long>, {_OWN}"
#: Buckets of B ids; links of a cogroup task at most, about; characters of a chunk; pairs that a task adds up before it writes them.
BUCKETS, TASK_POSTINGS, CHARS, HELD_PAIRS = 64, 4_000_000, 1_000_000, 1_000_000
_SHIFT = np.int64(32)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


class Aligner:
    """Two vocabularies, and the groups and links of texts in them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = byte_level(a_path, False), pieces(b_path)
        ends = lambda n, marks: [f"{i}{mark}" for mark in marks for i in range(n)]
        self._names = ends(len(self.a.entries), ",|") + ends(len(self.b.entries), ",;")

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bounds of both sides, without the texts that either doesn't give back."""
        fa, ba = self.a.encode([f" {t}" if t else "" for t in texts])
        fb, bb = self.b.encode(texts)
        sound = []
        for i, t in enumerate(texts):
            plain = f" {t}".encode()
            same = bool(t) and int(self.a.sizes[fa[ba[i] : ba[i + 1]]].sum()) == len(plain)  # A's entries are runs of the text's own bytes
            sound.append(same and b"".join(map(self.b.entries.__getitem__, fb[bb[i] : bb[i + 1]].tolist())) == plain)
        if not all(sound):
            good = np.array(sound, bool)
            fa, fb = fa[np.repeat(good, np.diff(ba))], fb[np.repeat(good, np.diff(bb))]
            ba, bb = (np.concatenate(([0], np.cumsum(np.where(good, np.diff(x), 0)))) for x in (ba, bb))
        return fa, ba, fb, bb

    def align(self, texts: list[str]) -> tuple[dict, np.ndarray, np.ndarray]:
        """Figures of the texts (n_a, n_b, n_links, sha); of each link its pair (B id, A id as one number) and its text."""
        fa, ba, fb, bb = self._coded(texts)
        ea, eb = np.cumsum(self.a.sizes[fa]), np.cumsum(self.b.sizes[fb])
        at = np.searchsorted(eb, ea)  # entries hold a byte at least, so ends rise
        ia = np.flatnonzero(eb[np.minimum(at, max(0, len(eb) - 1))] == ea) if len(eb) else np.zeros(0, np.int64)
        ib = at[ia]
        doc = np.searchsorted(ba[1:], ia, "right")
        # the order of the digest: a group's A tokens, then its B tokens
        past_a, past_b = np.concatenate(([0], ia + 1)), np.concatenate(([0], ib + 1))
        place_a = np.arange(len(fa)) + past_b[np.searchsorted(ia, np.arange(len(fa)))]
        place_b = np.arange(len(fb)) + past_a[1:][np.searchsorted(ib, np.arange(len(fb)))] if len(ib) else np.zeros(0, np.int64)
        n, base = len(self.a.entries), 2 * len(self.a.entries)
        name = np.empty(len(fa) + len(fb), np.int64)
        kind = fa.astype(np.int64)
        kind[ia] += n
        name[place_a] = kind
        kind = fb.astype(np.int64) + base
        kind[ib] += len(self.b.entries)
        name[place_b] = kind
        shas = []
        for i in range(len(texts)):
            own = name[ba[i] + bb[i] : ba[i + 1] + bb[i + 1]].tolist()
            shas.append(hashlib.sha256("".join(map(self._names.__getitem__, own))[:-1].encode()).hexdigest() if own else "")
        figures = {"n_a": np.diff(ba), "n_b": np.diff(bb), "n_links": np.bincount(doc, minlength=len(texts)), "sha": shas}
        return figures, fb[ib].astype(np.int64) << _SHIFT | fa[ia], doc


def _sums(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the values of each (its number without values)."""
    if values is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)]))) if values is None else np.add.reduceat(values, first) if len(keys) else values


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _code(docs: DataFrame, paths: tuple[str, str], buckets: int) -> DataFrame:
    names = [x.split(" ")[0] for x in _CODED.split(", ")]
    schema = pa.schema([(x.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}[x.split(" ")[1]]) for x in _CODED.split(", ")])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, schema.field(k).type) for k in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(*paths), TaskContext.get().partitionId() << 32
        held_pair, held_m = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            return batch(1, sum_pair=_lists(held_pair, np.array([0, len(held_pair)]), pa.int64()), sum_m=_lists(held_m, np.array([0, len(held_m)]), pa.int64()))

        for chunk in chunks(batches, "text", CHARS):
            number += 1
            figures, pair, doc = aligner.align(texts_of(chunk.column("text")))
            one = lambda x, kind=None: pa.array([x], pa.list_(kind or pa.int64()))
            yield batch(1, chunk=pa.array([number]), doc_id=one(chunk.column("doc_id").to_pylist()), **{k: one(figures[k]) for k in ("n_a", "n_b", "n_links")}, sha=one(figures["sha"], pa.string()))
            if not len(pair):
                continue
            # postings: distinct (bucket, document, pair) with multiplicity, one row a bucket
            order = np.lexsort((pair, doc, (pair >> _SHIFT) % buckets))
            p, d = pair[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]))))
            m = np.diff(np.concatenate((first, [len(p)])))
            p, d = p[first], d[first]
            b = (p >> _SHIFT) % buckets
            cut = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
            rows = len(cut) - 1
            yield batch(rows, chunk=pa.array(np.full(rows, number)), bucket=pa.array(b[cut[:-1]], pa.int32()), pair=_lists(p, cut, pa.int64()), doc=_lists(d, cut, pa.int32()), m=_lists(m, cut, pa.int32()))
            new_pair, new_m = _sums(p, m)
            held_pair, held_m = _sums(np.concatenate((held_pair, new_pair)), np.concatenate((held_m, new_m)))
            if len(held_pair) >= HELD_PAIRS:
                yield sums()
                held_pair, held_m = held_pair[:0], held_m[:0]
        if len(held_pair):
            yield sums()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CODED)


def pair_counts(coded: DataFrame) -> DataFrame:
    """(b, pair, n, best): what each id pair counts in the whole corpus, and whether that's its B id's highest."""
    each = coded.filter("sum_pair IS NOT NULL").select(F.explode(F.arrays_zip("sum_pair", "sum_m")).alias("x")).select(F.col("x.sum_pair").alias("pair"), F.col("x.sum_m").alias("m"))
    counts = each.groupBy("pair").agg(F.sum("m").alias("n")).withColumn("b", F.shiftright("pair", 32).cast("int"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _contributions(coded: DataFrame, counts: DataFrame, buckets: int, task_postings: int) -> DataFrame:
    """(chunk, doc, best, total): what each row of postings adds to its documents."""
    postings = coded.filter("pair IS NOT NULL").select("chunk", "bucket", "pair", "doc", "m")
    sizes = {r["bucket"]: r["n"] for r in postings.groupBy("bucket").agg(F.sum(F.size("pair")).alias("n")).collect()}  # a row a bucket
    parts = F.array(*(F.lit(max(1, -(-sizes.get(k, 0) // task_postings))) for k in range(buckets)))
    of = lambda k: F.get(parts, F.col(k))
    rows = postings.select("bucket", F.pmod(F.xxhash64("chunk"), of("bucket")).cast("int").alias("part"), F.lit(1).alias("kind"), "chunk", "pair", "doc", "m", F.lit(None).cast("array<long>").alias("n"), F.lit(None).cast("array<boolean>").alias("best"))
    own = counts.withColumn("bucket", F.pmod("b", F.lit(buckets))).groupBy("bucket", F.pmod(F.xxhash64("pair"), F.lit(32)).alias("slice"))
    packed = own.agg(F.collect_list(F.struct("pair", "n", "best")).alias("x")).select("bucket", F.col("x.pair").alias("pair"), F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    tables = packed.select("bucket", F.explode(F.sequence(F.lit(0), of("bucket") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "pair", F.lit(None).cast("array<int>").alias("doc"), F.lit(None).cast("array<int>").alias("m"), "n", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n, best, group = [], None, None, None, None
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "kind")), strict=True))
            out: dict[str, list] = {"chunk": [], "doc": [], "best": [], "total": []}
            for i, (b, part, kind) in enumerate(where):
                if (b, part) != group:
                    group, held, key = (b, part), [], None
                values = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                if kind == 0:
                    held.append((values("pair"), values("n"), values("best")))
                    continue
                if key is None:
                    key, n, best = (np.concatenate(x) for x in zip(*held, strict=True))
                    order, held = np.argsort(key), []
                    key, n, best = key[order], n[order], best[order]
                at, doc, m = np.searchsorted(key, values("pair")), values("doc"), values("m").astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))  # postings are ordered by document
                out["chunk"].append(batch.column("chunk")[i].as_py())
                out["doc"].append(doc[first])
                out["best"].append(np.add.reduceat(m * best[at], first))
                out["total"].append(np.add.reduceat(m * n[at], first))
            if out["chunk"]:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(out["chunk"], pa.int64()), "doc": pa.array(out["doc"], pa.list_(pa.int32())), "best": pa.array(out["best"], pa.list_(pa.int64())), "total": pa.array(out["total"], pa.list_(pa.int64()))})

    spread = rows.unionByName(tables).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return spread.mapInArrow(run, "chunk long, doc array<int>, best array<long>, total array<long>")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, buckets: int = BUCKETS, task_postings: int = TASK_POSTINGS) -> DataFrame:
    """One row per document: its tokens, groups and links, and what its links count in the whole corpus; see the module."""
    scratch = Scratch(docs.sparkSession, "alignment")
    coded = scratch.put(_code(docs, paths or default_paths(), buckets), "coded")
    added = _contributions(coded, pair_counts(coded), buckets, task_postings)
    own = coded.filter("doc_id IS NOT NULL").select("chunk", F.lit(0).alias("kind"), "doc_id", "n_a", "n_b", "n_links", "sha")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("doc", "array<int>"), ("best", "array<long>"), ("total", "array<long>"))]
    lacks = [F.lit(None).cast("array<string>" if c == "sha" else "array<long>").alias(c) for c in ("doc_id", "n_a", "n_b", "n_links", "sha")]
    both = own.select("*", *none).unionByName(added.select("chunk", F.lit(1).alias("kind"), *lacks, "doc", "best", "total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, total = None, None, None

        def done() -> pa.RecordBatch:
            values = lambda c: held.column(c)[0].values
            return pa.RecordBatch.from_pydict({
                "doc_id": values("doc_id"), "n_a": values("n_a"), "n_b": values("n_b"), "n_groups": values("n_links"), "n_links": values("n_links"),
                "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": values("sha"),
            })

        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if held is not None:
                        yield done()
                    held = batch.slice(i, 1)
                    best, total = (np.zeros(len(held.column("doc_id")[0]), np.int64) for _ in "ab")
                else:
                    at = batch.column("doc")[i].values.to_numpy()
                    best[at] += batch.column("best")[i].values.to_numpy()
                    total[at] += batch.column("total")[i].values.to_numpy()
        if held is not None:
            yield done()

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, SCHEMA)

"""Packed token files, cross-tokenizer alignment and phrase collocations against plain counterparts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.fs as fs
import pytest

from barlume.llm import alignment, collocations, token_files
from barlume.llm.common import Scratch
from barlume.llm.vocabularies import byte_level, pieces
from tests.conftest import DATA
from tests.llm.conftest import DOCS

SF = DATA / "sf0.001"
ODD = [
    "", " ", "  two  spaces ", "a<|endoftext|>b", "<s>x</s>", "tab\tand\nline", "▁mark", "ﬁne ½ Ⅷ", "日本語のテキスト", "\u0000nul", "ends ", "naïve café's don't  we'll", "x" * 30_000, " " * 9000 + "y",
    "𝔘𝔫𝔦 😀 🏳️‍🌈", "͸\U0001dfcd new", "é é",
]


def odd(spark, more=()):
    rows = [(i, t, "xx", "s", 0, 1.0, 2, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id", None, None, 0, 1.0, 2, "x", "y"), (3, None, "xx", None, 0, 1.0, 2, "x", "y"), *more]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- vocabularies

def test_byte_level_ids_are_the_library_s():
    for special in (True, False):
        own = byte_level(token_files.default_path(), special)
        rng = random.Random(4)
        bits = ["a", "the", " ", "  ", "\n", "'s", "'", "1", "²", "é", "<|endoftext|>", "\x85", "\xa0", "　", "ひ", "!", "\x1c", "½"]
        texts = ODD + [f"a{c}1{c} {c}b !{c}" for c in map(chr, range(0x3000)) if c] + ["".join(rng.choice([*bits, chr(rng.randrange(32, 0xD7FF))]) for _ in range(rng.randrange(15))) for _ in range(500)]
        flat, at = own.encode(texts)
        want = [x.ids for x in own.library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


# --- token files

@pytest.mark.parametrize("bits", [1, 3, 8, 11, 15, 16, 17, 20, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000, 20_001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        for a in {0, n // 3, max(0, n - 2)}:
            assert (token_files.unpack(data, bits, a, n - a) == ids[a:]).all()


@pytest.mark.parametrize("bits", [11, 16, 17])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 1 << bits, n).astype(np.uint32)) for i, n in enumerate([0, 5, 64, 63, 1, 500, 0, 3])]
    writer = token_files.FileWriter(fs.LocalFileSystem().open_output_stream(f"{tmp_path}/a"), bits, block=64)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader = token_files.FileReader(fs.LocalFileSystem().open_input_file(f"{tmp_path}/a"))
    whole = np.concatenate([x for _, x in docs])
    assert reader.n_ids == len(whole) and reader.null.tolist() == [True] + [False] * 7 and reader.doc_ids.tolist() == list(range(8))
    assert all((reader.document(i) == ids).all() for i, (_, ids) in enumerate(docs))
    for a, b in ((0, len(whole)), (63, 65), (64, 128), (100, 100), (17, 400)):
        assert (reader.tokens(a, b) == whole[a:b]).all()
    for most in (1, 70, 10_000):
        assert [(i, j) for i, j, _ in reader.stretches(most)][-1][1] == 8 and (np.concatenate([x for *_, x in reader.stretches(most)]) == whole).all()
    with pytest.raises(Exception):
        (tmp_path / "b").write_bytes(b"x" * 100)
        token_files.FileReader(fs.LocalFileSystem().open_input_file(f"{tmp_path}/b"))


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_token_files_against_library(spark, shards):
    more = [(9, f"same id {k}", "xx", "s", 0, 1.0, 2, "x", "y") for k in range(40)] + [(500 + k, "copy of a row", "xx", "s", 0, 1.0, 2, "x", "y") for k in range(20)]
    docs = odd(spark, more)
    written = token_files.write(docs, Scratch(spark, "t"), shards=shards, block=32)
    found = token_files.read(written).collect()
    library = byte_level(token_files.default_path(), True).library
    plain = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")) for r in docs.collect()), key=lambda x: x[:2])
    rows = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i if known else None for known, i, _ in plain]
    assert [r["start"] for r in rows] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in rows])[:-1])).tolist()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((i if known and i else -1, len(x), zlib.crc32(x.tobytes())) for known, i, x in plain)
    assert written.count > shards // 2  # the rows of one id span several files


def test_token_files_empty(spark, none):
    assert token_files.read(token_files.write(none, Scratch(spark, "t"))).collect() == []


def test_token_files_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = token_files.read(token_files.write(docs, Scratch(spark, "t"))).collect()
    library = byte_level(token_files.default_path(), True).library
    at = 0
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows) == docs.count()
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        f = found[r["doc_id"]]
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# --- alignment

def plain_alignment(rows: list[tuple]) -> list[tuple]:
    """The contract's result by loops."""
    a_path, b_path = alignment.default_paths()
    a, b = byte_level(a_path, False), pieces(b_path)
    per, count = [], Counter()
    for doc, text in rows:
        ia = a.library.encode(f" {text}", add_special_tokens=False).ids if text else []
        ib = b.library.encode(text, num_threads=1) if text else []
        if not text or any(b"".join(side.entries[i] for i in ids) != f" {text}".encode() for side, ids in ((a, ia), (b, ib))):
            ia, ib = [], []
        ends = lambda side, ids: {sum(len(side.entries[x]) for x in ids[: k + 1]): k for k in range(len(ids))} if len(ids) < 300 else dict(zip(np.cumsum([len(side.entries[x]) for x in ids]).tolist(), range(len(ids)), strict=True))
        ea, eb = ends(a, ia), ends(b, ib)
        both = sorted(set(ea) & set(eb))
        links, groups, pa_, pb_ = [], [], 0, 0
        for e in both:
            links.append((ia[ea[e]], ib[eb[e]]))
            groups.append(",".join(map(str, ia[pa_ : ea[e] + 1])) + "|" + ",".join(map(str, ib[pb_ : eb[e] + 1])))
            pa_, pb_ = ea[e] + 1, eb[e] + 1
        count.update(links)
        per.append((doc, len(ia), len(ib), groups, links))
    best: dict[int, int] = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (doc, na, nb, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for doc, na, nb, g, links in per
    ]


@pytest.mark.parametrize(("buckets", "task"), [(64, 4_000_000), (3, 50)])
def test_alignment_against_loops(spark, docs, buckets, task):
    all_docs = odd(spark).unionByName(docs)
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect()]
    found = [tuple(r) for r in alignment.align(all_docs, buckets=buckets, task_postings=task).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(found, key=key) == sorted(plain_alignment(rows), key=key)


def test_alignment_of_tables(spark, none):
    assert alignment.align(none).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, alignment.align(docs).collect())) == sorted(plain_alignment(rows))


# --- collocations

def plain_collocations(rows: list[tuple], least: int = 10, inside: int = 50, top: int = 2000) -> list[tuple]:
    """The contract's result by loops."""
    f: dict[str, Counter] = {}
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        n = sum(v for k, v in own.items() if len(k) == 1)
        candidates = {k: v for k, v in own.items() if len(k) > 1 and v >= least}
        kept = []
        for k, a in candidates.items():
            cuts = [(1_000_000 * a * a // (own[k[:c]] * own[k[c:]]), c) for c in range(1, len(k))]
            score, c = min(cuts)
            if not any(len(o) == 3 and k in (o[:2], o[1:]) and 100 * v >= inside * a for o, v in candidates.items()) or len(k) == 3:
                kept.append((-score, -a, " ".join(k).encode(), own[k[:c]], own[k[c:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def said(spark, n: int = 400, long: int = 4000):
    rng = random.Random(9)
    stems = "Ab cd é ef gh" .split()
    texts = []
    for i in range(n):
        text = "".join(rng.choice(stems) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(0, 25)))
        texts.append((i, text, rng.choice(["xx", "yy", None, "und"]), "s", 0, 1.0, 2, "x", "y"))
    texts += [(None, None, "xx", "s", 0, 1.0, 2, "x", "y"), (1, "", None, "s", 0, 1.0, 2, "x", "y"), (2, " ".join(rng.choice(stems) for _ in range(long)), "yy", "s", 0, 1.0, 2, "x", "y"), *texts[:30]]
    return spark.createDataFrame(texts, DOCS).repartition(4)


@pytest.mark.parametrize(("least", "inside", "top", "buckets"), [(10, 50, 2000, None), (3, 50, 7, 2), (2, 80, 2000, 5)])
def test_collocations_against_loops(spark, least, inside, top, buckets):
    docs = said(spark)
    found = collocations.collocations(docs, least, inside, top, buckets).collect()
    assert sorted(map(tuple, found)) == plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], least, inside, top)


def test_collocations_spill(spark):
    """More distinct phrases than duckdb may hold."""
    words = spark.range(15_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), k -> concat('w', pmod(hash(id, k), 100000), repeat('x', 12)))) AS text", "'xx' AS lang")
    distinct = collocations.pieces(words)
    plenty, little = (collocations.counts(distinct, Scratch(spark, "t"), 1, 2, buckets=1, memory=m).groupBy("n_words").agg({"f": "sum", "phrase": "count"}).collect() for m in ("4GB", "20MB"))
    assert sorted(plenty) == sorted(little) and len(plenty) == 3


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_000, 3_000_000_000_007, 5_123_456_789_012
    rows = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{collocations.SCORE} AS score").first()
    assert rows["score"] == 1_000_000 * a * a // (left * right)


def test_collocations_sql(spark, none):
    assert collocations.collocations(none).collect() == []
    found = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    told = c.sql(collocations.collocations_sql())
    assert told.columns == found.columns and sorted(told.fetchall()) == sorted(map(tuple, found.collect()))

"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlume.llm import jaccard as J
from tests.llm.conftest import DOCS, rows, words

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    """Shingles without hashing."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    found = [w for w in low.split(" ") if w]
    if not found:
        return set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else {tuple(found)}


def components(table: list[tuple], k: int, num: int, den: int) -> dict:
    """{doc_id: (shingles of its first row, component)} by comparing all rows with all."""
    sets = [(i, shingle_set(text, k)) for i, text, *_ in table if i is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if i != j and a and b and den * both >= num * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(a), find(i)) for i, a in reversed(sets)}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_against_all_pairs(spark, docs, k, num, den):
    found = J.jaccard_components(docs, k, num, den).collect()
    assert len(found) == docs.count()
    want = components(rows(), k, num, den)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_large_near_copy_group(spark):
    """Near copies of near copies, more than a block of them, half of them too far from all others."""
    rng = random.Random(4)
    base = words(rng, 100).split(" ")
    table = []
    for i in range(400):
        mine = list(base)
        for k in range(rng.choice([0, 1, 1, 2, 5])):
            mine[rng.randrange(100)] = f"neu{i}x{k}"
        table.append((i, " ".join(mine), "xx", "s0", 1, 1.0, 2, "x", "y"))
    df = spark.createDataFrame(table, DOCS)
    want = components(table, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()} == want
    assert len({c for _, c in want.values()}) > 50


def test_sql_says_the_same():
    table = [r[:2] for r in rows() if r[0] not in (203, 204)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", table[:-2])  # without the repeated rows
    found = {r[0]: (r[1], r[2]) for r in c.sql(J.components_sql()).fetchall() if r[0] is not None}
    assert found == components(table, 4, 85, 100)


def test_a_doc_id_with_several_texts_links_by_all_of_them(spark):
    rng = random.Random(6)
    a, b, c, d, e = (words(rng, 40) for _ in range(5))
    tables = [
        [(1, a), (5, a), (1, b), (7, b)],
        [(9, a), (9, b), (8, b), (8, c), (7, c), (7, d), (6, d), (6, e), (5, e), (4, None), (4, a), (3, "x"), (3, None), (3, "x y"), (None, a), (None, e)],
    ]
    for table in tables:
        want = components(table, 4, 85, 100)
        found = J.jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted((i, len(shingle_set(t, 4)), want[i][1]) for i, t in table if i is not None)
        c_ = duckdb.connect()
        c_.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c_.executemany("INSERT INTO documents VALUES (?, ?)", table)
        assert Counter(map(tuple, found)) == Counter((i, n, None if i is None else comp) for i, n, comp in c_.sql(J.components_sql()).fetchall())
        kept = J.keep_one(spark.createDataFrame(table, "doc_id long, text string"), 4, 85, 100)
        texts = {t for _, t in table if t}
        assert texts == {r["text"] for r in kept.collect() if r["text"]}  # none without a copy is lost


def test_lists_split_over_many_tasks(spark, docs):
    """The same components where the lists are cut at every few rows."""
    before, rows_ = J.LIST_ROWS, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    J.LIST_ROWS = 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        want = components(rows(), 4, 85, 100)
        assert {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect() if r["doc_id"] is not None} == {i: c for i, (_, c) in want.items()}
    finally:
        J.LIST_ROWS = before
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)


def test_keep_one(spark, docs, none):
    kept = J.keep_one(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    want = components(rows(), 5, 80, 100)
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, c in want.values()})
    assert kept.filter("doc_id IS NULL").count() == 1
    assert J.keep_one(none).count() == 0 and J.jaccard_components(none).count() == 0


def test_keep_one_knows_rows_by_their_texts(spark):
    rng = random.Random(5)
    a, b, c, d, e = (words(rng, 40) for _ in range(5))
    table = [
        (1, a), (2, a + " neu"), (2, b), (3, c), (3, d), (3, d), (4, d + " neu"), (None, e), (None, e), (None, e + " neu"), (None, c), (None, None), (None, ""), (5, None), (6, ""),
    ]
    kept = [tuple(r) for r in J.keep_one(spark.createDataFrame(table, "doc_id long, text string")).collect()]
    e_kept = [t for i, t in kept if i is None and t]
    assert len(e_kept) == 1 and e_kept[0] in (e, e + " neu")
    want = [(1, a), (2, b), (3, c), (3, d), (None, None), (None, ""), (5, None), (6, "")]
    assert sorted(map(str, kept)) == sorted(map(str, [*want, (None, e_kept[0])]))


@given(st.lists(st.sets(st.integers(0, 8)), min_size=1, max_size=9), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_divide_skip_counts(lists, t):
    lists = [sorted(x) for x in lists if x]
    count = Counter(x for part in lists for x in part)
    want = {x: n for x, n in count.items() if n >= t}
    assert J.divide_skip(lists, t) == want
    assert dict(J.merge_skip(lists, t)) == want


def test_shingles_know_ascii_only():
    assert len(J.shingles("A b c d", 4)) == 1 and (J.shingles("A B C D", 4) == J.shingles("a b c d", 4)).all()
    assert (J.shingles("Ä b c d", 4) != J.shingles("ä b c d", 4)).all()
    assert (J.shingles("a b c", 4) != J.shingles("a b c", 4)).all()
    assert len(J.shingles("a b", 4)) == 1 and (J.shingles("a b", 4) != J.shingles("a b a b", 4)).all()
    assert len(J.shingles(None, 4)) == len(J.shingles(" \n", 4)) == 0

"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; its mean repetition rate is
the share times the mixture's size over the source's documents. A hash of
seed and doc_id gives each document a number u in [0, 1); its number of copies
is the inverse of the Poisson distribution at u. Each document is exploded by
its count and the copies are dealt out and sorted by a hash of their own: a
global shuffle, the same after every re-run of a lost task.

DataFrame functions only. Rates are joined by broadcast where the counted
number of sources is small, else over salted keys, so a source with a third of
all rows is no hot key.

Edge cases: rows without a source are a source of their own (given weights
name it by None); a null doc_id hashes as the empty text; a null or empty text
is copied like any other; repeated rows get equal counts; an empty table gives
an empty mixture; sources without a given weight get ``default_weight``. Rows
without a doc_id, or with the same one, share a shuffle key; they are dealt out
by their contents too. Further columns go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch

MAX_BROADCAST_SOURCES, SALTS = 10_000, 64


def hashed(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with u < CDF(k), by a fold over k up to the mean and twelve deviations and forty.

    The terms are kept as logarithms, so large means do not underflow.
    """
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("cdf"), F.when(F.exp(-mean) <= u, 1).otherwise(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(mean / k)
        cdf = s["cdf"] + F.exp(log)
        return F.struct(log.alias("log"), cdf.alias("cdf"), F.when(cdf <= u, k + 1).otherwise(s["n"]).alias("n"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["n"]).otherwise(0)


def rates(docs: DataFrame, weights: dict[str | None, float] | None, size: float, temperature: float, default_weight: float) -> tuple[DataFrame, int]:
    """(source, mean) of each source and how many there are. Without weights shares go with counts ** temperature."""
    counts = Scratch(docs.sparkSession, "mixing").put(docs.groupBy("source").agg(F.count("*").alias("n")), "counts")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(float(default_weight))
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), float(w)).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    rows, total, sources = counts.agg(F.sum("n"), F.sum("weight"), F.count("*")).first()
    mean = F.col("weight") / F.lit(float(total or 0) or 1.0) * F.lit(size * float(rows or 0)) / F.col("n")
    return counts.select("source", mean.alias("mean")), sources


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float = 1.0, temperature: float = 0.5, default_weight: float = 0.0, seed: int = 1) -> DataFrame:
    """The copies of the documents: all their columns, then copies, replica (from 1) and shuffle_key, in shuffled order.

    ``size`` is the mixture's expected number of rows as a multiple of the
    input's. Own columns of those three names are replaced.
    """
    table, sources = rates(docs.select("source"), weights, size, temperature, default_weight)
    # rows that share an id, or have none, draw by their texts; the draw is made here, once, not in every step of the inverse
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit(""))
    # the document goes along as one value, so its columns cannot clash with these
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key.alias("key"))
    held = held.select("doc", "key", (hashed(F.lit(str(seed)), F.col("key")) / F.lit(float(1 << 52))).alias("u"))
    if sources <= MAX_BROADCAST_SOURCES:
        rated = held.join(F.broadcast(table), F.col("doc.source").eqNullSafe(F.col("source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = held.join(salted, F.col("doc.source").eqNullSafe(F.col("source")) & (F.pmod(F.xxhash64("doc.doc_id"), F.lit(SALTS)) == F.col("salt")))
    copied = rated.select("doc", "key", poisson_inverse(F.col("u"), F.col("mean")).cast("long").alias("copies")).filter("copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    keyed = copied.withColumn("shuffle_key", hashed(F.lit(str(seed)), F.col("key"), F.col("replica").cast("string")))
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("copies", "replica", "shuffle_key")]
    hashable = [F.col(f"doc.`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    return keyed.repartition("shuffle_key", F.xxhash64(*hashable)).sortWithinPartitions("shuffle_key").select(*kept, "copies", "replica", "shuffle_key")


def mix_sql(table: str = "documents", size: float = 1.0, temperature: float = 0.5, seed: int = 1) -> str:
    """The same mixture in DuckDB SQL."""
    doc = "coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))"
    draw = lambda text: f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
means AS (SELECT source, pow(n::DOUBLE, {temperature!r}::DOUBLE) / sum(pow(n::DOUBLE, {temperature!r}::DOUBLE)) OVER () * ({size!r}::DOUBLE * sum(n) OVER ()) / n AS mean FROM counts),
steps AS (SELECT source, mean, k, -mean + coalesce(sum(CASE WHEN k > 0 THEN ln(mean / k) END) OVER (PARTITION BY source ORDER BY k), 0) AS lp
          FROM means, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 40) AS BIGINT) + 1)) AS r(k)),
cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
drawn AS (SELECT *, row_number() OVER () AS r, {draw(f"'{seed}:' || {doc}")} / {float(1 << 52)!r}::DOUBLE AS u FROM {table}),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r, count(*) AS copies
            FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copies, replica, {draw(f"'{seed}:' || {doc} || ':' || replica")} AS shuffle_key
FROM counted, unnest(range(1, copies + 1)) AS r(replica)"""

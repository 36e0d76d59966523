"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies, so that the sources' sizes in
characters reach the target weights. The expected copies are prefix-summed
within the source, one random offset a source is added, and a document is
emitted once for every integer that its interval crosses: each gets the floor
or the ceiling of its expectation, and each source its total to within one.

Documents are ordered by a hash of the id. The prefix sum has two levels: sums
of (source, bucket), where a bucket has the hashes that begin alike, then the
rows within a bucket. The number of buckets follows the number of rows and
doesn't change the result. A large source is therefore spread over all tasks,
and each row is shuffled once. The whole part of an expectation is added to
every document of its source; only the fractions are summed up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._frames import fresh, quoted

UNIT = 1_000_000_000
SEED = 17
#: Rows that a bucket may have if all are of one source, about.
BUCKET_ROWS = 20_000
#: Copies of a document that one step of the expansion makes.
STEP = 65_536
#: Weight of sources that are not listed, and the listed ones.
DEFAULT_WEIGHT = 1
WEIGHTS = {"src0": 4}


def _place(ident: Column) -> Column:
    """First 32 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, int] = WEIGHTS,
    default_weight: int = DEFAULT_WEIGHT,
    seed: int = SEED,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
    copy: str | None = "copy",
) -> DataFrame:
    """Rows of docs, repeated or left out so that the sources' characters reach the weights.

    The output has as many characters as the input, in expectation. Column copy
    counts a document's copies from 1 (None: no such column; a column of that
    name in docs makes it ``_copy``). Null source is a source of its own with
    the default weight. Null and empty texts count no characters but are drawn
    like the others of their source; a source without any characters is left
    out. Repeated rows are drawn one by one; of rows with the same id and text
    any may come first. Weights are whole numbers, 0 leaves a source out.
    """
    key, bucket, place, whole, part, start, copies, steps = fresh(docs, "key", "bucket", "place", "whole", "part", "start", "copies", "steps")
    label = F.col(quoted(source)).cast("string")
    bits = min(32, max(12, (docs.count() // BUCKET_ROWS).bit_length()))
    with_key = docs.withColumns({key: F.when(label.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), label)), place: _place(F.col(quoted(ident)))}).withColumn(
        bucket, F.shiftright(place, 32 - bits)
    )
    weight = F.lit(default_weight)
    for name, w in weights.items():
        weight = F.when(F.col("k") == F.lit("s" + name), F.lit(w)).otherwise(weight)
    cells = (
        with_key.select(F.col(key).alias("k"), F.col(bucket).alias("b"), F.coalesce(F.length(quoted(text)), F.lit(0)).cast("bigint").alias("size"))
        .groupBy("k", "b")
        .agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    )
    sources = cells.groupBy("k").agg(F.sum("size").alias("size")).withColumn("w", weight.cast("bigint")).where("size > 0 AND w > 0")
    every = Window.partitionBy()
    wide = lambda c: f"cast({c} as decimal(19,0))"
    rates = (
        sources.withColumns({"all_size": F.sum("size").over(every), "all_w": F.sum("w").over(every)})
        .withColumns({"up": F.expr(f"{wide('all_size')} * {wide('w')}"), "down": F.expr(f"{wide('all_w')} * {wide('size')}")})
        .select(
            "k",
            F.expr("up div down").alias(whole),
            F.expr(f"(cast(up % down as decimal(28,0)) * cast({UNIT} as decimal(10,0))) div down").alias(part),
            F.expr(f"(cast(conv(substr(md5(concat('{int(seed)}|', k)), 1, 8), 16, 10) as bigint) * {UNIT}) div 4294967296").alias("u"),
        )
    )
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.join(rates, "k")
        .withColumn("sum", F.coalesce(F.sum(F.col("rows").cast("decimal(38,0)") * F.col(part)).over(before), F.lit(0).cast("decimal(38,0)")))
        .select(F.col("k").alias(key), F.col("b").alias(bucket), whole, part, F.expr(f"cast((sum + u) % {UNIT} as bigint)").alias(start))
    )
    within = Window.partitionBy(key, bucket).orderBy(place, *[F.col(quoted(c)).asc_nulls_last() for c in dict.fromkeys((ident, text))])
    upto = F.col(start) + F.sum(part).over(within.rowsBetween(Window.unboundedPreceding, 0))
    drawn = (
        with_key.join(starts, [key, bucket])
        .withColumn(copies, upto)
        .withColumn(copies, F.expr(f"{whole} + {copies} div {UNIT} - ({copies} - {part}) div {UNIT}"))
        .where(F.col(copies) > 0)
    )
    kept = [F.col(quoted(c)) for c in docs.columns]
    # in two steps, so that no row holds a list of all copies
    some = drawn.select(*kept, copies, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(copies) - 1).cast("bigint"), F.lit(STEP).cast("bigint"))).alias(steps))
    many = F.explode(F.sequence(F.col(steps) + 1, F.least(F.col(copies), F.col(steps) + STEP)))
    if copy is None:
        return some.select(*kept, many.alias(copies)).drop(copies)
    return some.select(*kept, many.alias(*fresh(docs, copy)))


_CASES = " ".join(f"WHEN k = 's{name}' THEN {w}" for name, w in WEIGHTS.items())
ORACLE = f"""
WITH d AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS b
  FROM documents),
s AS (SELECT k, CAST(sum(length(coalesce(text, ''))) AS HUGEINT) AS size, CASE {_CASES} ELSE {DEFAULT_WEIGHT} END AS w FROM d GROUP BY k),
r AS (
  SELECT k, (CAST(sum(size) OVER () AS HUGEINT) * w * {UNIT}) // (CAST(sum(w) OVER () AS HUGEINT) * size) AS units,
         (CAST('0x' || substr(md5('{SEED}|' || k), 1, 8) AS BIGINT) * {UNIT}) // 4294967296 AS u
  FROM s WHERE size > 0 AND w > 0),
p AS (
  SELECT d.*, units, u + CAST(sum(units) OVER (PARTITION BY k ORDER BY b, doc_id NULLS LAST, text NULLS LAST ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS upto
  FROM d JOIN r USING (k)),
c AS (SELECT *, upto // {UNIT} - (upto - units) // {UNIT} AS copies FROM p)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS BIGINT) AS copy
FROM (SELECT *, unnest(generate_series(1, CAST(copies AS BIGINT))) AS i FROM c WHERE copies > 0)
"""

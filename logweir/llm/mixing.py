"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source has a target in words. Every document is taken floor(target / size of the source) times for certain;
the rest of the target is one Pareto order sample of the source's documents with unequal inclusion odds. The
inclusion probability of a document grows with its size, size / scale and at most 1, where the scale is solved so
that the expected words are the rest of the target exactly; documents of the scale or more are certain. A
document's rank is random odds divided by inclusion odds, and documents are taken in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import WORD, cut, fresh, uniform

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words; no document is taken more than CAP times.
SHARE = 1.5
CAP = 2
#: Slices of a source by rank; only the slice in which the target is met is put in order.
SLICES = 4096


def word_count(text: "F.Column") -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): share of all words, dealt by weight, no source above cap times its size.

    The level at which capped sources stop is the largest quotient (budget left) / (weight left) over the
    sources in ascending order of cap / weight. The windows see one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    ratio = F.col("source_size") * cap / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        totals.withColumn("level", level)
        .withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.max("level").over(every) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def draw_key(key: str, text: str) -> "F.Column":
    """What a document's random number is made from."""
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def inclusion_scales(counts: DataFrame) -> DataFrame:
    """(source, scale) from (source, rest, size, n): the size from which documents are certain.

    With sizes in descending order, let all larger ones be certain: the scale is the sum of the squares of the
    others over the words still wanted. The first size that such a scale is not below settles it. A window
    sees a source's distinct sizes.
    """
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("decimal(10,0)") * F.col("size").cast("decimal(10,0)") * F.col("n").cast("decimal(10,0)")
    left = F.col("rest") - F.coalesce(F.sum(words).over(larger), F.lit(0))
    scale = F.sum(squares.cast("decimal(28,0)")).over(others).cast("double") / left
    found = counts.filter((F.col("size") > 0) & (F.col("rest") > 0)).select("source", "size", left.alias("left"), scale.alias("scale"))
    return found.filter((F.col("left") > 0) & (F.col("scale") >= F.col("size"))).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def pareto_rank(size: "F.Column", scale: "F.Column", u: "F.Column") -> "F.Column":
    """Random odds over inclusion odds: 0 for certain documents, null for those of no words or where nothing is sampled."""
    chance = size / scale
    return F.when((size > 0) & scale.isNotNull(), F.when(chance >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (chance / (1 - chance))))


def measured(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    own = draw_key(key, text)
    return docs.select(own.alias("draw"), F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), uniform(own, seed).alias("u"))


def mixing_plan(rows: DataFrame) -> DataFrame:
    """One row a source: source_size, target, whole (certain copies), scale, and where the sample ends.

    The sample takes all documents before (end_rank, end_draw) in order of rank and draw key, and of the
    repeated rows at that place the first end_copies. Only the slice of ranks in which the target is met is put
    in order, so a source with most of the rows is summed in many parts and ordered in a small one.
    """
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    wanted = targets.select(F.col("source").alias("of"), "rest")
    scales = inclusion_scales(counts.join(wanted, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    scales = scales.select(F.col("source").alias("of"), "scale")
    targets = cut(targets.join(scales, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))
    ranked = with_ranks(rows, targets).filter("rank is not null")
    # certain documents fit into the rest as a whole and are a slice of their own
    slice_ = F.when(F.col("rank") == 0, F.lit(-1)).otherwise(F.least(F.lit(SLICES - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES))).cast("int")
    ranked = ranked.withColumn("slice", slice_)
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = slices.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    last = last.groupBy("source").agg(F.min_by(F.struct("slice", "before"), "slice").alias("at")).select(F.col("source").alias("of"), "at.slice", "at.before")
    within = ranked.withColumnRenamed("slice", "own").join(last, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("slice")))
    units = within.groupBy("source", "before", "rest", "rank", "draw", "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    ends = units.filter(F.col("ahead") + F.col("size") * F.col("n") > F.col("rest"))
    copies = F.floor((F.col("rest") - F.col("ahead")) / F.col("size") + 0.5).cast("long")
    ends = ends.groupBy("source").agg(F.min(F.struct("rank", "draw", copies.alias("copies"))).alias("end"))
    ends = ends.select(F.col("source").alias("of"), F.col("end.rank").alias("end_rank"), F.col("end.draw").alias("end_draw"), F.col("end.copies").alias("end_copies"))
    return cut(targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))


def with_ranks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's columns of the plan, and rank."""
    side = plan.withColumnRenamed("source", "of")
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("rank", pareto_rank(F.col("size"), F.col("scale"), F.col("u")))


def sampled() -> "F.Column":
    """1 where the row stands before the end of its source's sample, null at the end itself, else 0. Without an end nothing is left out."""
    before = (F.col("rank") < F.col("end_rank")) | ((F.col("rank") == F.col("end_rank")) & (F.col("draw") < F.col("end_draw")))
    at_end = (F.col("rank") == F.col("end_rank")) & (F.col("draw") == F.col("end_draw"))
    return F.when(F.col("rank").isNull(), 0).when(F.col("end_rank").isNull() | before, 1).when(~at_end, 0)


def pareto_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix:") -> DataFrame:
    """(draw, doc_id, source, size, source_size, target, copies) of each row of docs: it is in the mix 0, 1 or 2 times.

    A source's words in the mix differ from its target by half a document at most. The random numbers depend
    on the key and the text, so reruns agree.

    Null or empty text: size 0, taken for no words. Null source: a source of its own, last. Repeated rows
    draw the same number and follow one another; each counts. A null key draws by its text. An empty table
    gives no rows. Other columns of docs are kept out and may have any names.
    """
    rows = cut(measured(docs, key, text, source, seed))
    joined = with_ranks(rows, mixing_plan(rows)).withColumn("sampled", sampled())
    # repeated rows at the end of a sample: as many of them as still fit
    end = joined.filter("sampled is null").withColumn("nth", F.row_number().over(Window.partitionBy("draw").orderBy("size")))
    end = end.withColumn("sampled", (F.col("nth") <= F.col("end_copies")).cast("int")).drop("nth")
    out = joined.filter("sampled is not null").unionByName(end)
    return out.select("draw", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("sampled")).cast("long").alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix:") -> DataFrame:
    """The mix itself: the rows of docs, each as often as pareto_mix takes it.

    Rows are decided where they stand, against one row a source, so texts are not moved. Of repeated rows at
    the end of a sample, one is taken for those that fit.
    """
    plan = mixing_plan(cut(measured(docs, key, text, source, seed)))
    row, n = fresh("row", docs.columns), fresh("copies", docs.columns)
    whole_row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(row))
    own = whole_row.select(row, draw_key(f"{row}.{key}", f"{row}.{text}").alias("draw"), F.col(f"{row}.{source}").alias("source"), word_count(F.col(f"{row}.{text}")).alias("size"))
    joined = with_ranks(own.withColumn("u", uniform(F.col("draw"), seed)), plan).withColumn("sampled", sampled())
    certain = joined.select(row, (F.col("whole") + F.coalesce("sampled", F.lit(0))).cast("int").alias(n))
    end = joined.filter("sampled is null and end_copies > 0").dropDuplicates(["draw"]).select(row, F.col("end_copies").cast("int").alias(n))
    every = certain.filter(F.col(n) > 0).unionByName(end)
    return every.select(row, F.explode(F.sequence(F.lit(1), F.col(n)))).select(f"{row}.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same in SQL. Equal sizes, targets, odds and random numbers give equal samples.
OP5_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS draw,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM r GROUP BY source),
l AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(CAST(sum(source_size * 2) OVER (ORDER BY source_size * 2 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
      / CAST(sum(weight) OVER (ORDER BY source_size * 2 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM t),
g AS (SELECT source, source_size, least(CAST(source_size * 2 AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
x AS (SELECT *, target - whole * source_size AS rest FROM w),
c AS (SELECT r.source, r.size, x.rest, count(*) AS n FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source WHERE r.size > 0 AND x.rest > 0 GROUP BY 1, 2, 3),
s AS (SELECT source, size,
    rest - coalesce(CAST(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS wanted,
    CAST(sum(CAST(size AS HUGEINT) * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares FROM c),
z AS (SELECT source, max_by(squares / wanted, size) AS scale FROM s WHERE wanted > 0 AND squares / wanted >= size GROUP BY source),
o AS (
  SELECT r.*, x.source_size, x.target, x.whole, x.rest, CASE WHEN r.size > 0 AND z.scale IS NOT NULL THEN CASE WHEN r.size / z.scale >= 1 THEN CAST(0 AS DOUBLE)
      ELSE (u / (1 - u)) / ((r.size / z.scale) / (1 - r.size / z.scale)) END END AS rank
  FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source LEFT JOIN z ON r.source IS NOT DISTINCT FROM z.source),
m AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rank, draw ROWS UNBOUNDED PRECEDING) AS DOUBLE) - size / 2.0 AS middle FROM o WHERE rank IS NOT NULL)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
UNION ALL SELECT doc_id, size, source_size, target, CAST(size * whole AS BIGINT) FROM o WHERE rank IS NULL
"""

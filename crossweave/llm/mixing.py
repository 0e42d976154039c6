"""Mixing sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: A document's draw is the first 13 hexadecimal digits of an MD5, 52 bits.
DRAW_BITS = 52


def word_count(text: str = "text"):
    """Number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int = 0, doc_id: str = "doc_id"):
    """A number in [0, 1) for each document id, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**DRAW_BITS))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Sources in order of code points, null last, get the weights in turn. The targets fill `share` of
    all sizes in proportion to the weights, none above `most` times its source's size: a source is
    full at the level most * size / weight, so with the sources in order of that level the common
    level is the first at which the words left for the others, by weight, do not exceed it. The
    window over all sources sees one row for each source, after the aggregate."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("common", F.col("left") / F.col("open"))
    ranked = ranked.withColumn("common", F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "source", "common"))).over(whole)["common"])
    # where no level is low enough (share over most), every source is full
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: (doc_id, [keep], size, source_size, target, rate, copies, taken).

    rate is target / source_size; a document is taken floor(rate) times, and once more if its draw is
    under the fraction. Null text has size 0; a null source is a source; documents of size 0 have
    their source's rate; a source whose sizes are all 0 has rate 0. Rows with the same id draw alike.
    An empty table gives no rows, and columns besides doc_id, text, source and `keep` are not read; of
    `keep`, names that the result has itself are left out.

    The table of sources comes from an aggregate with map-side combine; no row of a hot source is
    dealt by its source: documents join it by a broadcast below the session's size limit, and else
    with adaptive splitting of the large key."""
    keep = tuple(k for k in keep if k not in ("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", "goal_source"))
    sized = docs.select("doc_id", "source", *[F.col(k) for k in keep], word_count().alias("size"))
    goals = source_targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", "goal_source")
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("goal_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    joined = joined.withColumn("copies", copies.cast("long"))
    return joined.select("doc_id", *keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, columns: tuple[str, ...], **options) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it, with the given columns."""
    packed = docs.select("doc_id", "text", "source", F.struct(*columns).alias("row_of_mix"))
    taken = mix(packed, keep=("row_of_mix",), **options).where("copies > 0")
    return taken.select("row_of_mix", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row_of_mix.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM sizes),
leveled AS (SELECT *, cap / weight AS level FROM ranked),
open AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)
      - coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / ((SELECT sum(weight) FROM leveled)
      - coalesce(sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS common
  FROM leveled),
chosen AS (SELECT common FROM open WHERE common <= level ORDER BY level, source ASC NULLS LAST LIMIT 1),
goals AS (SELECT source, source_size, coalesce(least(cap, (SELECT common FROM chosen) * weight), cap) AS target FROM open),
rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, rate,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM rated
"""

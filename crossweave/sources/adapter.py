"""The given tables as the engine's tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.components import shared_folder
from crossweave.functions.dates import iso_week
from crossweave.operators import axes as ax
from crossweave.operators import index as ix
from crossweave.operators import keywords as kw
from crossweave.operators import score as sc
from crossweave.operators import search_index as si
from crossweave.operators import trend as tr
from crossweave.operators import vectors as ve
from crossweave.sources.sinks import overwrite_index

#: Vocabulary, labels and weights that the queries use.
AXES = {"ai": ["this", "than", "erth"], "bigdata": ["from", "thing", "attion"], "smallbiz": ["with", "eron", "thre"]}
LABELS = {"ai": "AI", "bigdata": "Data", "smallbiz": "Shops"}
COUNT_WEIGHT = {1: 0.5, 2: 3.0, 3: 8.0}
AXIS_WEIGHT = {"ai": 1.0, "bigdata": 1.2, "smallbiz": 1.2}
NOW = "2024-03-20 00:00:00"
COLLECTED = "2024-04-01 00:00:00"
WEEK = "2024-W12"
MIN_DF = 10
WEEKS_BACK = 4
#: Endings that stand for organisations' in this corpus of invented words.
ORG_ENDINGS = ("tion", "ment")


class Tables:
    """The engine's tables over a folder of landed snapshots, which do not change.

    Narrow tables that many answers are read from (axes, scores, keywords, the index) are written once
    to the shared folder and read from there; tables with whole texts are plans over the landed ones."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.index_path = f"{shared_folder(spark)}/crossweave-index-{uuid.uuid4().hex}"

    def stored(self, name: str, table: DataFrame, by: str | None = None) -> DataFrame:
        """An index table, made anew and read back."""
        overwrite_index({name: table}, self.index_path, {name: by} if by else None)
        return self.spark.read.schema(table.schema).parquet(f"{self.index_path}/{name}").select(*table.columns)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        d = self.raw("documents")
        at = F.timestamp_add("HOUR", F.expr("cast(doc_id * 37 % 2016 as int)"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
        rows = d.select(F.col("doc_id").alias("id"), "source", F.col("doc_id").cast("string").alias("source_id"), F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("summary"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), at.alias("published_at"), F.lit(COLLECTED).cast("timestamp").alias("collected_at"))
        return rows.withColumn("published_week", iso_week("published_at"))

    @cached_property
    def item_axes(self) -> DataFrame:
        return self.stored("item_axes", ax.item_axes(self.base, AXES))

    @cached_property
    def matches(self) -> DataFrame:
        return ax.axis_match(self.base, AXES)

    @cached_property
    def scored(self) -> DataFrame:
        return sc.cross_score(self.base, self.item_axes, COUNT_WEIGHT, AXIS_WEIGHT)

    @cached_property
    def facts(self) -> DataFrame:
        """The items without their summaries, which are most of the text: with score; kept where an item has an axis; without relevance."""
        marked = self.base.drop("summary").join(self.scored.select("id", "cross_score", "n_axes"), "id")
        kept = (F.col("n_axes") > 0).alias("kept")
        insight = F.when(F.col("id") % 7 == 0, F.concat(F.lit("▸ 확인 필요: "), F.col("source"), F.lit(" — "), F.col("source_id"), F.lit("\nnote"))).when(F.col("id") % 5 == 0, "note")
        model = F.when(F.col("id") % 35 == 0, "manual").when((F.col("id") % 7 == 0) | (F.col("id") % 5 == 0), "m1")
        columns = [c for c in self.base.columns if c != "summary"]
        return self.stored("facts", marked.select(*columns, "cross_score", kept, F.lit(None).cast("double").alias("relevance"), insight.alias("insight"), model.alias("insight_model"), F.lit(None).cast("timestamp").alias("insight_at")))

    @cached_property
    def items(self) -> DataFrame:
        """The facts with the summaries."""
        more = [c for c in self.facts.columns if c not in self.base.columns]
        return self.facts.join(self.base.select("id", "summary"), "id").select(*self.base.columns, *more)

    @cached_property
    def texts(self) -> si.TextIndex:
        """Titles and summaries by ranges of ids, and the postings of their trigrams."""
        rows, bounds = si.parted(self.base)
        return si.TextIndex(self.stored("text_grams", si.postings(self.base), "folder"), self.stored("item_texts", rows, "part"), bounds)

    @cached_property
    def ranked_items(self) -> DataFrame:
        """Items with the relevance of those that have a vector."""
        return self.facts.drop("relevance").join(self.relevance, "id", "left")

    @cached_property
    def tokens(self) -> DataFrame:
        return kw.token_keywords(self.base)

    @cached_property
    def lists(self) -> DataFrame:
        """(item_id, week, keywords)"""
        return self.stored("item_keywords", kw.keyword_lists(self.base))

    @cached_property
    def keywords(self) -> DataFrame:
        """(item_id, keyword, week), told from the lists."""
        return ix.listed(self.lists)

    @cached_property
    def kw_week(self) -> DataFrame:
        return self.stored("kw_week", ix.kw_week(self.lists, self.facts), "week")

    @cached_property
    def kw_df(self) -> DataFrame:
        return self.stored("kw_df", ix.kw_df(self.lists))

    @cached_property
    def weeks(self) -> DataFrame:
        return tr.week_dimension(self.spark, WEEK, WEEKS_BACK)

    @cached_property
    def rising(self) -> DataFrame:
        return tr.rising_keywords(self.kw_week, self.facts, self.weeks)

    @cached_property
    def pair_counts(self) -> tuple[DataFrame, DataFrame]:
        """Counted pairs of keywords as numbers, and the numbers' keywords; counted where they are read, as a table of them
        is many times as large as what they are counted from."""
        return ix.pair_counts(self.keywords, self.kw_df, MIN_DF)

    @cached_property
    def cooccurrence(self) -> DataFrame:
        return ix.named_pairs(*self.pair_counts)

    @cached_property
    def kw_neighbor(self) -> DataFrame:
        return self.stored("kw_neighbor", ix.strongest_neighbors(self.keywords, self.kw_df, min_df=MIN_DF))

    @cached_property
    def kw_meta(self) -> DataFrame:
        return self.stored("kw_meta", ix.kw_meta(self.lists, self.kw_df, self.item_axes, MIN_DF))

    def is_org(self, keyword: str = "keyword"):
        return kw.is_org(keyword, ORG_ENDINGS, 5)

    @cached_property
    def kw_item(self) -> DataFrame:
        return self.stored("kw_item", ix.kw_item(self.lists, self.kw_df, self.is_org()))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    @cached_property
    def item_vectors(self) -> DataFrame:
        return self.vectors.join(self.base.select("id"), "id", "left_semi")

    @cached_property
    def relevance(self) -> DataFrame:
        seeds = self.raw("embeddings").select("embedding", "label")
        return ve.contrast_relevance(self.item_vectors, seeds.where("label = 0"), seeds.where("label = 1"))

    @cached_property
    def sources(self) -> DataFrame:
        """(source, regulatory, live, days): src0 is regulatory, even numbers are live and look back 14 days, others 7."""
        number = F.substring("source", 4, 9).cast("int")
        return self.raw("documents").select("source").where("source is not null").distinct().select("source", (F.col("source") == "src0").alias("regulatory"), (number % 2 == 0).alias("live"), F.when(number % 2 == 0, 14).otherwise(7).alias("days"))

    @cached_property
    def labels(self) -> DataFrame:
        """(id, label, kept): the quality label against the filter's decision."""
        rows = self.raw("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
        return rows.join(self.facts.select("id", "kept"), "id")

    @cached_property
    def digests(self) -> DataFrame:
        """(week, lead, body) of every other week: what a first run would have stored."""
        n = self.facts.where("kept").groupBy(F.col("published_week").alias("week")).agg(F.count("*").alias("n"), F.max("cross_score").alias("best"))
        even = F.substring("week", 7, 2).cast("int") % 2 == 0
        return n.where(even).select("week", F.concat(F.lit("lead "), "week").alias("lead"), F.create_map(F.lit("total_kept"), F.col("n").cast("string"), F.lit("tasks"), F.lit("kept")).alias("body"))

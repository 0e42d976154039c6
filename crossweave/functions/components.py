"""Connected components of an undirected graph."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where that is unset a local session gets a temporary
    one; on a cluster it is an error, as executors would write to folders that no other sees."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.crossweave.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="crossweave-scratch-")
        spark.conf.set("spark.crossweave.scratch", base)
    return base


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted as each of them ends, on all executors, instead of when the
    driver's garbage is next collected. A plan that is run again after that makes its shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table in the folder of spark.checkpoint.dir that all executors share, read back: cuts the lineage; `options` are the writer's.

    What its shuffles left on the executors' disks goes once the table is written, so that a job of many
    steps takes the disk of its largest step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crossweave-{uuid.uuid4().hex}/{name}"
    with shuffles_end_here(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_files(folder: str, rows: int = 16) -> Iterator[pa.RecordBatch]:
    """The rows of a folder of Parquet files under the shared folder, read by a task, a few at a time; none if it is not there."""
    files, root = fs.FileSystem.from_uri(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(rows)


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of edges between a and b: every node but the roots tied to the least node that the edges lead to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a star forest: every node tied to the least node that the task's edges lead to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    hi, lo = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    node, root = star_forest(hi, lo)
    yield pa.record_batch([pa.array(node), pa.array(root)], names=["hi", "lo"])


def _told(now: DataFrame) -> Row:
    """Number of edges, a sum of their hashes, and how many upper ends they have."""
    with shuffles_end_here(now.sparkSession):
        return now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.count_distinct("hi")).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of an edge is connected with; ids are longs.

    Rounds until nothing changes: each task first joins up its own edges, then every node's larger
    neighbours are tied to its least neighbour, then its smaller ones. Least neighbours come from an
    aggregate with map-side combine and a join that can split hot nodes; a task holds its share of
    the edges, and the number of rounds grows with the logarithm of the size."""
    kind = "hi long, lo long"
    # edges that Python code makes are written first, so that a task never holds two Python workers
    now = settle(edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).where("hi <> lo"), "edges")
    now = settle(now.mapInArrow(_forest, kind), "edges")
    state = _told(now)
    while state[0]:
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        tied = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        joined = tied.select("hi", F.col("m").alias("lo")).union(tied.select("lo", "m")).where("hi <> lo").distinct()
        now = settle(joined.mapInArrow(_forest, kind).distinct(), "edges")
        after = _told(now)
        if after == state and after[0] == after[2]:
            break
        state = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo"), F.col("lo")).distinct())

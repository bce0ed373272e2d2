"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes stripped from line ends and separating words: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch, so that a worker holds few whole texts at once. A setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) >= 10000:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="foreopen-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from the files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the cluster keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*spent: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned and that nothing still to be computed reads."""
    for df in spent:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(a long, b long)``; returns ``(node, root)`` for every linked node.

    Each round points a node to the neighbour (or itself) of least random rank and contracts the links to the chosen
    nodes, so that the links shrink by a constant factor a round whatever the shape of the graph (long chains too).
    A hub costs one pre-aggregated minimum, never a list. ``root`` is one arbitrary node of the component.
    Empty input gives an empty table; self links and repeated links are allowed.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("node"), rank("b").alias("m")).union(edges.select(F.col("b").alias("node"), rank("a").alias("m")))
        step = both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("m", F.struct(F.xxhash64(F.lit(turn), "node").alias("r"), F.col("node").alias("v")))["v"].alias("root"))
        step = cut(step)
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("last"))
        whole = whole.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return whole

"""Helpers that several operators use: shared scratch tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


#: Rows that go to a Python worker at once, where the session doesn't say: texts can be long, and workers' memory is small.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the checkout that the driver uses; send them few rows at a time, where the session doesn't say how many."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if batch not in spark.conf.getAll:
        spark.conf.set(batch, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of this machine, if all runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, computes once, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that is broadcast, at most.
FEW = 400_000


def few(df: DataFrame, counted: DataFrame) -> DataFrame:
    """``df``, to be broadcast if ``counted`` has few rows; beyond, it is joined by a shuffle."""
    return F.broadcast(df) if counted.limit(FEW + 1).count() <= FEW else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a unique number as column ``name``, which is the same whenever the result is read.

    Rows of Parquet files are numbered by their file and their place in it, so
    nothing is copied; any other table is written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):  # nodes that neither repeat nor join rows
        plan = plan.children().head()
    path, index, number = spare(docs, "file", "index", "number")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    except AnalysisException:
        placed = None
    if placed is None or plan.nodeName() != "LogicalRelation":
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = placed.select(path).distinct().select(path, F.row_number().over(Window.orderBy(path)).alias(number))  # a row a file
    files = cut(files, "files")
    row = F.shiftleft(F.col(number).cast("long"), 40).bitwiseOR(F.col(index))
    return placed.join(few(files, files), path).select(*(placed[c] for c in docs.columns), row.alias(name))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() has written."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component being the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, so that rounds grow with the logarithm of the diameter.  Each round's
    edges go to the shared folder.  An empty edge table gives no rows.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    count, total = now.agg(F.count("*"), digest).first()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u join the least of u's surroundings
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its lower neighbours join the least of them
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = cut(small, "edges")
        new_count, new_total = new.agg(F.count("*"), digest).first()
        discard(now)
        now, done = new, (new_count, new_total) == (count, total)
        count, total = new_count, new_total
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Session helpers shared by every operator: reading tables, cutting lineage, sizing sides."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in rows, that a caller may mark for broadcast after counting it.
BROADCAST_ROWS = 50_000


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _own
    if _own is None:
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own = "file://" + folder
    return _own


_own: str | None = None


class Workspace:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    A table that a later one has replaced is removed with drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, mode: str = "overwrite", **counts) -> tuple[DataFrame, dict]:
        """Writes df once and returns it as read back, with the named aggregates of the written rows."""
        path, seen = f"{self.root}/{name}", None
        if counts:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        schema = df.schema
        df.write.mode(mode).parquet(path)
        return self.spark.read.schema(schema).parquet(path), (seen.get if seen else {})

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions to keep all cores busy with work that costs much more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)


def positions(df: DataFrame, order: list, into: str = "position", within: list[str] | None = None) -> DataFrame:
    """df with the 1-based position of each row in a total order, without bringing the rows into one task.

    Rows are range-partitioned and written once; each range is numbered on its own and moved by the
    sizes of the ranges before it. With within, positions count anew in each group of those columns, and
    a group of any size is spread over ranges.
    """
    order = [*(within or []), *order]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33))
    ranged, _ = Workspace(df.sparkSession).write(ranged, "ranged")
    if not within:
        sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
        before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
        return ranged.join(F.broadcast(before), "_range").withColumn(into, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_g{i}") for i, c in enumerate(within)]
    names = [f"_g{i}" for i in range(len(within))]
    ranged = ranged.select("*", *keys)
    # a row for each group and range it lies in
    sizes = ranged.groupBy(*names, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select(*names, "_range", (F.sum("_n").over(Window.partitionBy(*names).orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_before"))
    return ranged.join(before, [*names, "_range"]).withColumn(into, F.col("_before") + F.col("_at") + 1).drop(*names, "_range", "_at", "_before")


def blank(c):
    """True for null and for text of white space only."""
    return c.isNull() | (F.regexp_replace(c, r"\s+", "") == "")


def tidy_key(c):
    """A key without case and outer white space; null where blank."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


_shipped: set = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: once per application, as a zip in the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/skein-code-{uuid.uuid4().hex}/skein.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)

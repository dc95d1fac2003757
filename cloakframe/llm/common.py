"""What the training-data operators share: the shared folder, lineage cuts, distributed prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def _removed_at_exit(base: str) -> None:
    """The application's own folder goes when it ends; a job that is killed leaves it behind."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, in a folder that is removed when the application ends.

    Where that is unset, a temporary folder serves on one machine (local[...]); on a cluster, whose executors don't share
    such folders, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/cloakframe/{spark.sparkContext.applicationId}"
    _removed_at_exit(own)
    return f"{own}/{uuid.uuid4().hex}"


def unused(name: str, *dfs: DataFrame) -> str:
    """The name, made longer until none of the tables has such a column (in any case)."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(df: DataFrame, order: list, value: str, out: str, within: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows in the order (of the same `within`, if given).

    Rows are range-partitioned by (within, order), so that a key with a third of all rows spreads over many tasks;
    only one total per partition (and key in it) meets in one place, never the rows. `order` must be total: rows that
    tie in it may fall in either order.
    """
    # Range bounds are sampled: the cut must be kept, or a second run could number partitions in another way.
    keys = ([within] if within else []) + order
    laid = written(df.repartitionByRange(parts(df.sparkSession), *keys).withColumn("_pid", F.spark_partition_id()))
    by = ["_pid"] + ([within] if within else [])
    sums = laid.groupBy(*by).agg(F.sum(value).alias("_sum"))
    if within:
        before = Window.partitionBy(within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_pid").alias("_p"), *([F.col(within).alias("_w")] if within else []), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    on = F.col("_pid") == F.col("_p")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_w"))
    local = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One total per partition and key at most: far fewer rows than the data, and the broadcast threshold still decides.
    got = laid.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(sums, on)
    return got.withColumn(out, F.col("_local") + F.col("_base")).drop("_pid", "_p", "_w", "_local", "_base", "_sum")


#: Distinct links that one task may hold: 8 MB of ids.
ONE_TASK = 1 << 19


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over (u, v) rows: (node, comp) of all nodes but the smallest of each component."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    roots = [find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of (a, b) links of longs: rows (node, comp), comp the smallest node reachable, for all but those smallest.

    Up to one_task distinct links, a fixed bound, are joined in one task. Beyond it:
    alternating large-star and small-star steps; each keeps one row per link at most and shuffles by node, after partial
    minima, so that a hub's links never have to meet in one task uncombined. Links and labels stay distributed; the
    driver sees only whether anything changed. Both ways give the same rows. Should `rounds` not do, it is an error.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if e.count() <= one_task:
        return written(e.coalesce(1).mapInArrow(_union, "node bigint, comp bigint"))
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        e = written(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components haven't converged in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp"))

"""Sweeps over time: running sums in range partitions, what is live at a moment, busy stretches, ordered folds of bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def running(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `by` up to and with this one, in `order`, which must be total.

    Rows lie in range partitions of (by, order), so that a key with a third of all rows spreads over many tasks. Each
    partition sums up its own rows; what stood before is one total per partition and key, of which only a key's own meet.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Range bounds come from a sample: the cut is written, so that a task that runs again finds the same one.
    laid = written(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.groupBy("_part", *by).agg(F.sum(value).alias("_total"))
    # A key in one partition only needs nothing from another.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], F.sum("_total").over(before).alias("_base")).filter("_base is not null")
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    got = laid.withColumn("_own", F.sum(value).over(own)).join(base, on, "left")
    return got.withColumn(out, F.col("_own") + F.coalesce("_base", F.lit(0))).drop("_part", "_p", "_own", "_base", *[f"_b_{c}" for c in by])


def live_at(moments: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """moments (by, at) with live: how many spans (by, starts, ends) of the same key hold that moment: starts <= at < ends.

    One sweep: starts count up, ends down, and a moment reads the running sum; no moment meets the spans. starts may be null
    for spans without a beginning. Repeated moments give a row each; keys without spans have none live.
    """
    far = F.lit("0001-01-01").cast("timestamp")
    up = spans.filter(F.col("starts").isNull() | (F.col("starts") < F.col("ends"))).select(*by, F.coalesce("starts", far).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"))
    down = spans.filter(F.col("starts").isNull() | (F.col("starts") < F.col("ends"))).select(*by, F.col("ends").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    # Steps of one moment become one, so that the order is total; a moment is read after its steps.
    steps = up.unionByName(down).groupBy(*by, "at", "kind").agg(F.sum("step").alias("step"))
    asked = moments.select(*by, "at").distinct().select(*by, "at", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("step"))
    swept = running(steps.unionByName(asked), by, ["at", "kind"], "step", "live").filter("kind = 1").select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("at").alias("_s_at"), "live")
    on = F.col("at") == F.col("_s_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return moments.join(swept, on).drop("_s_at", *[f"_s_{c}" for c in by])


def folded_in_order(df: DataFrame, by: list[str], order: list, out: str, start: Callable[[], Any], step: Callable[[Any, dict], Iterator[tuple]], end: Callable[[Any], Iterator[tuple]] | None = None) -> DataFrame:
    """A fold over each key's rows in order: step(state, row) gives the rows of the key so far that are done, end(state) the rest.

    Rows come as dicts; given rows hold by's values and then those of `out`, a schema. Rows stream through a sorted
    partition, so that a task holds one key's state and never a key's rows. For what no window can say: sums that start
    anew, choices that depend on earlier choices.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), out])
    names = [*by, *(part.split()[0].strip("`") for part in out.split(", "))]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = list(to_arrow_schema(StructType.fromDDL(schema)).types)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in stream:
            rows = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in by)
                if now is None or key != now:
                    if now is not None and end:
                        rows += [(*now, *r) for r in end(state)]
                    now, state = key, start()
                rows += [(*key, *r) for r in step(state, row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if now is not None and end and (rows := [(*now, *r) for r in end(state)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)

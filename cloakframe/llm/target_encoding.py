"""Target encoding in time order: each row's categories as rates over earlier rows of other folds, by divide and conquer over time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table, written

#: Folds of the query; the prior's weight, and the first prior, of a million.
FOLDS, WEIGHT, FIRST = 5, 50, 500_000
#: Probes of a node of the recursion that meet its left half's totals in one place, as a power of two.
PROBE_BITS = 10
#: Levels of the recursion in one round of joins.
LEVELS = 4
#: Leaves of a file of what leaves tell.
LEAVES = 1 << 16


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal to each other. The first one differs."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def _leaf(folds: int, value: pa.Array, time: np.ndarray, fold: np.ndarray, n: np.ndarray, s: np.ndarray):
    """A leaf's rows, in order of value and time: their counts within it, and what the leaf tells others.

    Returns (n, s, part, ends): the leaf's earlier rows of the same value and of other folds; which base the row needs besides
    (0 none, as its value begins in the leaf; 1 all of the value before the leaf; 2 that without the row's own moment);
    and (first of last value, first of its last moment).
    """
    new = _changes(value)
    moment = new | np.concatenate(([True], time[1:] != time[:-1]))
    at = np.arange(len(time))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    now = np.maximum.accumulate(np.where(moment, at, 0))
    out = []
    for x in (n, s):
        each = np.zeros((folds, len(x) + 1), dtype=np.int64)
        each[fold, at + 1] = x
        each = np.cumsum(each, axis=1)
        every = each.sum(axis=0)
        out.append(every[now] - every[begin] - each[fold, now] + each[fold, begin])
    part = np.where(begin > 0, 0, np.where(now > 0, 1, 2)).astype(np.int64)
    return out[0], out[1], part, (int(begin[-1]), int(now[-1]))


def _per_fold(folds: int, fold: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[int]:
    out = np.zeros((2, folds), dtype=np.int64)
    np.add.at(out[0], fold, n)
    np.add.at(out[1], fold, s)
    return out.ravel().tolist()


def _text(column: pa.Array, i: int) -> str:
    v = column[i].as_py()
    return "" if v is None else f"={v}"


def _leaves(rows: DataFrame, key: str, time: str, fold: str, n: str, s: str, apart: list[str], folds: int) -> tuple[DataFrame, DataFrame]:
    """The rows in the key's merged time order, leaf by leaf, with what _leaf() gives; and a row for each leaf with what it tells others.

    Rows are range-partitioned by key, time and what tells rows apart, so that a key, or a moment of it, with a third of
    all rows spreads over many tasks. A leaf is an Arrow batch of the sorted partition: a fixed number of rows.
    """
    from pyspark import TaskContext

    laid = rows.repartitionByRange(parts(rows.sparkSession), key, time, *apart).sortWithinPartitions(key, time)
    names = laid.columns
    summary = pa.struct([("first", pa.string()), ("first_time", pa.int64()), ("last", pa.string()), ("last_time", pa.int64()), ("every", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(names, batch.columns))
            t = column[time].cast(pa.int64()).to_numpy()
            f, cn, cs = (column[c].to_numpy().astype(np.int64) for c in (fold, n, s))
            value = column[key]
            got_n, got_s, part, (begin, now) = _leaf(folds, value, t, f, cn, cs)
            told = [None] * (batch.num_rows - 1) + [{
                "first": _text(value, 0), "first_time": int(t[0]), "last": _text(value, len(t) - 1), "last_time": int(t[-1]),
                "every": _per_fold(folds, f[begin:], cn[begin:], cs[begin:]), "tail": _per_fold(folds, f[now:], cn[now:], cs[now:]),
            }]
            leaf = ((pid << 32) + k << 2) + part  # leaf and part in one column, as all of them move with the rows
            k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(got_n), pa.array(got_s), pa.array(told, summary)], names=[*names, f"{key}_leaf", f"{key}_n", f"{key}_s", f"{key}_told"])

    more = f"`{key}_leaf` bigint, `{key}_n` bigint, `{key}_s` bigint, `{key}_told` struct<first:string,first_time:bigint,last:string,last_time:bigint,every:array<bigint>,tail:array<bigint>>"
    got = written(laid.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema) + ", " + more), "snappy")
    told = got.filter(F.col(f"{key}_told").isNotNull()).select(F.lit(key).alias("key"), F.shiftright(f"{key}_leaf", 2).alias("leaf"), f"{key}_told.*")
    return got.drop(f"{key}_told"), told


def earlier_leaves(told: DataFrame, folds: int) -> DataFrame:
    """(key, leaf, whole, before): per fold, the counts of all other folds' rows of the leaf's first value in earlier leaves; before
    leaves out those of the leaf's first moment. told: key, leaf and the summaries of _leaves().

    Divide and conquer over the leaves' positions, which are in order of time: at each level a node's left half is
    summed up per key value and fold, and joined by the probes of its right half; what all levels give is added up.
    A node's probes meet in blocks of 2**PROBE_BITS, so that no key gathers more. There are as many levels as the positions
    have bits; a round of joins takes LEVELS of them.
    """
    top = told.agg(F.max(F.col("leaf").bitwiseAND(F.lit((1 << 32) - 1))), F.max(F.shiftright("leaf", 32)), F.count("*")).first()
    low, high = (int(x or 0).bit_length() for x in top[:2])
    pos = F.shiftleft(F.shiftright("leaf", 32), low).bitwiseOR(F.col("leaf").bitwiseAND(F.lit((1 << low) - 1)))
    t = written(told.withColumn("pos", pos).coalesce(1 + top[2] // LEAVES))
    sums = [f"c{i}" for i in range(2 * folds)]
    split = lambda c: [F.col(c)[i].alias(s) for i, s in enumerate(sums)]
    history = t.select("key", F.col("last").alias("v"), F.lit(None).cast("bigint").alias("tie"), "pos", *split("every"))
    history = history.unionByName(t.select("key", F.col("last").alias("v"), F.col("last_time").alias("tie"), "pos", *split("tail")))
    probes = t.select("key", "leaf", F.col("first").alias("v"), F.explode(F.array(F.lit(None).cast("bigint"), F.col("first_time"))).alias("tie"), "pos")
    found = []
    for first in range(0, low + high, LEVELS):
        levels = F.explode(F.array(*[F.lit(k) for k in range(first, min(first + LEVELS, low + high))]))
        half = F.expr("shiftright(pos, level) & 1")
        left = history.withColumn("level", levels).filter(half == 0).groupBy("key", "v", "tie", "level", F.expr("shiftright(pos, level + 1)").alias("node")).agg(*[F.sum(c).alias(c) for c in sums])
        left = left.withColumn("block", F.explode(F.expr(f"sequence(0L, shiftleft(1L, greatest(level - {PROBE_BITS}, 0)) - 1)")))
        left = left.select(*[F.col(c).alias(f"l_{c}") for c in ("key", "v", "tie", "level", "node", "block")], *sums)
        right = probes.withColumn("level", levels).filter(half == 1).withColumn("node", F.expr("shiftright(pos, level + 1)")).withColumn("block", F.expr(f"shiftright(pos & (shiftleft(1L, level) - 1), {PROBE_BITS})"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in ("key", "v", "tie", "level", "node", "block")])
        found.append(right.join(left.hint("merge"), on).select("key", "leaf", "tie", *sums))
    if not found:
        found = [probes.filter("false").select("key", "leaf", "tie", *[F.lit(0).cast("bigint").alias(c) for c in sums])]
    all_ = reduce(DataFrame.unionByName, found)
    whole, same = ([F.coalesce(F.sum(F.when(F.col("tie").isNull() if w else F.col("tie").isNotNull(), F.col(c))), F.lit(0)).alias(f"{'w' if w else 'e'}_{c}") for c in sums] for w in (True, False))
    got = all_.groupBy("key", "leaf").agg(*whole, *same)

    def others(f: int, value) -> Column:
        pick = lambda base: reduce(lambda a, b: a + b, [value(base + i) for i in range(folds) if i != f], F.lit(0).cast("bigint"))
        return F.struct(pick(0).alias("n"), pick(folds).alias("s"))

    w, b = (lambda i: F.col(f"w_c{i}")), (lambda i: F.col(f"w_c{i}") - F.col(f"e_c{i}"))
    return written(got.select("key", "leaf", F.array(*[others(f, w) for f in range(folds)]).alias("whole"), F.array(*[others(f, b) for f in range(folds)]).alias("before")))


def history(rows: DataFrame, keys: list[str], time: str, fold: str, n: str, s: str, apart: list[str], folds: int = FOLDS, keep: list[str] | None = None) -> DataFrame:
    """rows, or their columns `keep`, with <key>_n and <key>_s for each key: the sums of n and s over rows of the same key value, of another fold and strictly
    earlier.

    time is a timestamp or a whole number without nulls, fold 0 to folds - 1, n and s are long; null key values are one value;
    `apart` names columns that tell rows apart, by which ties spread. Each key's rows are put in its own merged time
    order; a leaf of that order counts its own rows, and the recursion over leaves, see earlier_leaves(), the rest. rows
    must have no other columns named <key>_leaf, _told, _n or _s. No rows give no rows.
    """
    keep = rows.columns if keep is None else keep
    told, last = [], [*keys, time, *apart]
    for i, key in enumerate(keys):
        rows, one = _leaves(rows, key, time, fold, n, s, apart, folds)
        told.append(one)
        # What no later step needs doesn't move on.
        rows = rows.drop(*[c for c in last if c not in keep and (i == len(keys) - 1 or c not in (*keys[i + 1 :], time, *apart))])
    base = earlier_leaves(reduce(DataFrame.unionByName, told), folds)
    for key in keys:
        b = base.filter(F.col("key") == key).select(F.col("leaf").alias("b_leaf"), "whole", "before").hint("shuffle_hash")
        rows = rows.join(b, F.shiftright(f"{key}_leaf", 2) == F.col("b_leaf"), "left")
        part = F.col(f"{key}_leaf").bitwiseAND(F.lit(3))
        more = F.when(part == 1, F.col("whole")).when(part == 2, F.col("before"))[F.col(fold).cast("int")]
        rows = rows.withColumns({f"{key}_{c}": F.col(f"{key}_{c}") + F.coalesce(more[c], F.lit(0)) for c in ("n", "s")}).drop("b_leaf", "whole", "before", f"{key}_leaf")
    return rows.select(*keep, *[f"{key}_{c}" for key in keys for c in ("n", "s")])


def rate(key: str, prior: Column) -> Column:
    """The prior where nothing is known, else the smoothed rate of a million, rounded down, from <key>_n and <key>_s."""
    n, s = F.col(f"{key}_n"), F.col(f"{key}_s")
    return F.when(n < 1, prior).otherwise(F.call_function("div", 1_000_000 * s + WEIGHT * prior, n + WEIGHT))


def _lookup(rows: DataFrame, key: str, dims: DataFrame, dim_key: str, value: str) -> DataFrame:
    """rows with the dims' value of their key, null where that is unknown. The least value, should an id have several."""
    d = written(dims.filter(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias("_id")).agg(F.min(value).alias(value)))
    return rows.join(d.hint("shuffle_hash"), F.col(key) == F.col("_id"), "left").drop("_id")


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Per sale_id, item_id and vendor_id of the lines with a sale and a time: n_lines, n_returned, and of the ids the
    history's lines and the rate of returned ones, smoothed towards the kind's, nation's or segment's, and those towards
    the whole history's: item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate.

    Null item and client ids are -1, an ordinary id; a null vendor id is a value of its own; null and unknown kinds,
    nations and segments are one value each. Lines without a sale or a time are left out; repeated lines count. A sale_id
    on several rows of sales is several sales. A null flag isn't returned. Other columns aren't read; no lines give no rows.

    Lines are summed up per sale, item and vendor before anything else, so that a sale with a third of all lines is as many
    rows as it has pairs; what depends on the sale alone (the whole history, segment and client) is counted over sales. A
    hot id's joins are left to adaptive execution, which splits them; nothing is broadcast, whatever its size.
    """
    own = lines.filter(F.col("sale_id").isNotNull()).groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "vendor_id")
    own = written(own.agg(F.count("*").alias("n_lines"), F.count_if(F.coalesce(F.col("flag") == "returned", F.lit(False))).alias("n_returned")))
    whole = own.groupBy(F.col("sale_id").alias("w_sale")).agg(F.sum("n_lines").alias("lines"), F.sum("n_returned").alias("returned"))
    fold = (F.crc32(F.col("sale_id").cast("string")) % FOLDS).cast("int")
    s = sales.filter(F.col("sold_at").isNotNull()).select("sale_id", F.coalesce("client_id", F.lit(-1)).alias("client_id"), "sold_at", fold.alias("fold"))
    s = s.join(whole.hint("shuffle_hash"), F.col("sale_id") == F.col("w_sale")).drop("w_sale")
    s = _lookup(s, "client_id", clients, "client_id", "segment").withColumn("any", F.lit(0))
    s = history(written(s), ["any", "segment", "client_id"], "sold_at", "fold", "lines", "returned", ["sale_id"], keep=["sale_id", "sold_at", "fold"])
    s = s.withColumn("any_rate", rate("any", F.lit(FIRST).cast("bigint")))
    s = s.withColumn("client_rate", rate("client_id", rate("segment", F.col("any_rate"))))
    s = s.select(F.col("sale_id").alias("s_sale"), "sold_at", "fold", "any_rate", F.col("client_id_n").alias("client_n"), "client_rate")
    x = own.join(written(s).hint("shuffle_hash"), F.col("sale_id") == F.col("s_sale")).drop("s_sale")
    x = _lookup(x, "item_id", items, "item_id", "kind")
    x = _lookup(x, "vendor_id", vendors, "vendor_id", "nation_id")
    ids = ["sale_id", "item_id", "vendor_id"]
    x = history(written(x), ["kind", "nation_id", "item_id", "vendor_id"], "sold_at", "fold", "n_lines", "n_returned", ids, keep=[*ids, "n_lines", "n_returned", "any_rate", "client_n", "client_rate"])
    x = x.withColumn("item_rate", rate("item_id", rate("kind", F.col("any_rate")))).withColumn("vendor_rate", rate("vendor_id", rate("nation_id", F.col("any_rate"))))
    return x.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", F.col("item_id_n").alias("item_n"), "item_rate", F.col("vendor_id_n").alias("vendor_n"), "vendor_rate", "client_n", "client_rate")


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sale_lines; see encode()."""
    return encode(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def _sql_rate(key: str, prior: str) -> str:
    return f"case when {key}_n < 1 then {prior} else (1000000 * {key}_s + {WEIGHT} * {prior}) // ({key}_n + {WEIGHT}) end"


_OTHER = ", ".join(
    f"coalesce(sum({x}) over (partition by {v} {w}), 0)::bigint - coalesce(sum({x}) over (partition by {v}, fold {w}), 0)::bigint as {k}_{c}"
    for k, v in (("any", "1"), ("kind", "kind"), ("item", "item_id"), ("nation", "nation_id"), ("vendor", "vendor_id"), ("segment", "segment"), ("client", "client_id"))
    for c, x in (("n", "1"), ("s", "returned"))
    for w in ("order by t range between unbounded preceding and interval 1 microsecond preceding",)
)
OP11_SQL = f"""
with crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as steps),
f as (select sale_id, coalesce(client_id, -1) client_id, sold_at t,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(sale_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) % {FOLDS} as fold
  from sales, crc where sold_at is not null),
l as (select l.sale_id, coalesce(l.item_id, -1) item_id, l.vendor_id, f.client_id, f.t, f.fold, coalesce(flag = 'returned', false)::int returned
  from sale_lines l join f on l.sale_id = f.sale_id),
d as (select l.*, i.kind, v.nation_id, c.segment from l left join items i on l.item_id = i.item_id left join vendors v on l.vendor_id = v.vendor_id left join clients c on l.client_id = c.client_id),
h as (select *, {_OTHER} from d),
a as (select *, {_sql_rate("any", str(FIRST))} any_rate from h),
p as (select *, {_sql_rate("kind", "any_rate")} kind_rate, {_sql_rate("nation", "any_rate")} nation_rate, {_sql_rate("segment", "any_rate")} segment_rate from a),
r as (select *, {_sql_rate("item", "kind_rate")} item_rate, {_sql_rate("vendor", "nation_rate")} vendor_rate, {_sql_rate("client", "segment_rate")} client_rate from p)
select sale_id, item_id, vendor_id, count(*) as n_lines, sum(returned)::bigint as n_returned, min(item_n)::bigint as item_n, min(item_rate)::bigint as item_rate,
  min(vendor_n)::bigint as vendor_n, min(vendor_rate)::bigint as vendor_rate, min(client_n)::bigint as client_n, min(client_rate)::bigint as client_rate
from r group by sale_id, item_id, vendor_id
"""

"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prefix_sums, table, unused, written

#: Weights of the sources in ascending order of code points (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
#: The shuffle's seed.
SEED = 17


def n_words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    All sizes together are shared by weight; a target stops at `most` times its source's size and the excess is shared
    by weight among the others until none is above: min(weight * level, most * size) at the one level where the targets
    add up. In ascending order of most * size / weight, the sources before the level stop; the level is where the rest of
    the budget over the rest of the weight is at most the next such ratio. One row per source: that table, not the
    documents, is ordered in one place.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("stop", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.max(F.when(F.col("rest") / F.col("rest_w") <= F.col("stop") / F.col("weight"), F.col("rest") / F.col("rest_w"))).over(every))
    return s.select("source", "source_size", "weight", F.least("stop", F.coalesce(F.col("weight") * F.col("level"), F.col("stop"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id_col, size, source, source_size, target, taken (words, repeats counted).

    Each source's documents are shuffled by a hash of the id (ties: the id itself, the text's hash). A document's virtual
    finish time is the source's words up to its end, over the source's target; a source whose target exceeds its size is
    queued again, up to `most` times. All queued documents are sorted by finish time over the whole table and taken while
    their words stay within the total budget (the sum of all sizes). Whole documents only, so that a source's words come
    within about a document of its target; reruns agree.

    Null texts have size 0; documents of size 0 are never taken (taken 0). The null source is a source of its own. Rows
    are told apart by id and text; rows equal in both are queued as copies beside each other and share what is taken in
    equal parts as whole words allow. Null ids are allowed. Other columns aren't read. No rows give no rows.

    Only (id, source, size, hash) leave the scan. Cumulative sums are taken in range partitions, with one total per
    partition and source, so that a source with a third of all rows spreads over the tasks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _hash(F.col(text_col)).alias("th"))
    # Equal rows become one with a count, before any shuffle of them by key.
    rows = written(rows.groupBy("id", "source", "size", "th").agg(F.count("*").alias("n")))
    goal = written(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    queue = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "th")))
    queue = queue.withColumn("all", F.col("size") * F.col("n"))
    queue = prefix_sums(queue, ["h", "id", "th"], "all", "start", within="source")
    g = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    queue = queue.join(g, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    # A round of the queue beyond the target can't finish in time; one more than the target needs is kept for the cut.
    rounds = F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) + 1).cast("int")
    queued = queue.filter("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"))
    end = F.col("round") * F.col("source_size") + F.col("start") + F.col("all")
    queued = queued.withColumn("finish", end / F.col("target")).filter("finish <= 2 or start = 0")
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    run = prefix_sums(queued.select("id", "source", "th", "all", "finish", "round"), ["finish", "source", "id", "th", "round"], "all", "sent")
    total = budget.first()[0] or 0
    took = run.filter(F.col("sent") + F.col("all") <= total).groupBy("id", "source", "th").agg(F.sum("all").alias("took"))
    took = took.select(F.col("id").alias("t_id"), F.col("source").alias("t_source"), F.col("th").alias("t_th"), "took")
    got = queue.join(took, F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("th") == F.col("t_th")), "left")
    each = (F.coalesce("took", F.lit(0)) / F.col("n")).cast("long")
    return got.select("id", "th", "source", "size", "source_size", "target", each.alias("taken"), "n")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each row of documents, copies of a row apart; see mix()."""
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.explode(F.array_repeat(F.struct("id", "size", "source_size", "target", "taken"), F.col("n").cast("int"))).alias("r")).select(F.col("r.id").alias("doc_id"), "r.size", "r.source_size", "r.target", "r.taken")


OP4_SQL = f"""
with r as (select id, source, size, th, count(*) n, size * count(*) whole, md5('{SEED}|' || coalesce(id::varchar, '') || '|' || th) h
  from (select doc_id id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size, md5(coalesce(text, '')) th from documents) group by id, source, size, th),
a as (select source, sum(whole)::bigint source_size from r group by 1),
b as (select *, list_extract([{', '.join(f'{float(w)}::double' for w in WEIGHTS)}], ((row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)} + 1)::int) weight, {MOST} * source_size::double stop from a),
c as (select *, sum(source_size) over () - coalesce(sum(stop) over w, 0) rest, sum(weight) over () - coalesce(sum(weight) over w, 0) rest_w
  from b window w as (order by stop / weight, source is null, source rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, least(stop, coalesce(weight * max(case when rest / rest_w <= stop / weight then rest / rest_w end) over (), stop)) target from c),
q as (select r.*, g.source_size, g.target, coalesce(sum(whole) over (partition by r.source order by h, id nulls first, th rows between unbounded preceding and 1 preceding), 0) start_
  from r join g on r.source is not distinct from g.source),
u as (select *, unnest(range(least({MOST}, floor(target / greatest(source_size, 1)) + 1)::int)) round_ from q where size > 0 and target > 0),
f as (select *, (round_ * source_size + start_ + whole) / target finish from u),
k as (select *, coalesce(sum(whole) over (order by finish, source nulls first, id nulls first, th, round_ rows between unbounded preceding and 1 preceding), 0) sent from f where finish <= 2 or start_ = 0),
t as (select id, source, th, sum(whole) took from k where sent + whole <= (select sum(source_size) from a) group by 1, 2, 3),
o as (select q.id, q.size, q.source_size, q.target, (coalesce(took, 0) // q.n)::bigint taken, unnest(range(q.n)) from q left join t on q.id is not distinct from t.id and q.source is not distinct from t.source and q.th = t.th)
select id as doc_id, size, source_size, target, taken from o
"""


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the mix takes, as many times as it takes them, with the columns of docs, whatever their names.

    Rows equal in id, source and text share what is taken in equal parts as whole words allow; null and empty texts are
    never taken; null sources are one source, null ids are allowed. No rows give no rows.
    """
    i, source, th, times, copy = (unused(f"_mix_{x}", docs) for x in ("id", "source", "th", "times", "copy"))
    got = mix(docs).filter("taken > 0").select(F.col("id").alias(i), F.col("source").alias(source), F.col("th").alias(th), (F.col("taken") / F.col("size")).cast("int").alias(times))
    on = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(source)) & (_hash(F.col("text")) == F.col(th))
    taken = docs.join(got, on)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])

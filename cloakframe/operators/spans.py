"""Span operators: detection, merging, islands, tokens, redaction, interval joins.

Spans are rows (doc_id, page, start, end, field_type, level, subcategory, detector, reason, ord); pages are rows
(doc_id, page, text). Every shuffle is by (doc_id, page) or a finer key, so a group is a page; long pages get bins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..functions.detectors import GATES, REGISTRY
from . import grid, sweep

SPAN = "page int, start int, end int, field_type string, level string, subcategory string, detector string, reason string, ord int"


def detect(pages: DataFrame, names: Iterable[str] = ("contacts",), extra: dict[str, Callable] | None = None, text_col: str = "text") -> DataFrame:
    """All spans of the named detectors, with ord their order within the page: detector by detector, left to right.

    Texts in which no gate of the named detectors matches never leave the JVM.
    """
    names = list(names)
    run = [(extra or {}).get(n) or REGISTRY[n] for n in names]
    kind = pages.schema["doc_id"].dataType.simpleString()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 3 + [pa.string()] * 5 + [pa.int32()]
        for b in stream:
            docs, rows = [], []
            for doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    found = [(page, *s, i) for i, s in enumerate(s for d in run for s in d(text))]
                    rows += found
                    docs += [doc] * len(found)
            cols = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.types[0]), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "page", "start", "end", "field_type", "level", "subcategory", "detector", "reason", "ord"])

    texts = pages.select("doc_id", F.col("page").cast("int"), text_col)
    if all(n in GATES and n not in (extra or {}) for n in names):
        texts = texts.filter(reduce(or_, [F.col(text_col).rlike(GATES[n]) for n in names]))
    return texts.mapInArrow(batches, f"doc_id {kind}, {SPAN}")


def label_spans(model: DataFrame, pages: DataFrame) -> DataFrame:
    """A model's spans (doc_id, page, start, end, label, text, ord) as common spans.

    An unknown label, a range outside the page or a text that isn't the page's slice fails the query.
    """
    j = model.withColumnRenamed("text", "claimed").join(pages, ["doc_id", "page"], "left")
    pick = lambda i: exprs.mapped({k: v[i] for k, v in fixed.MODEL_LABELS.items()}, F.col("label"))
    good = exprs.valid_span(F.col("text"), F.col("start"), F.col("end")) & (exprs.slice_of(F.col("text"), F.col("start"), F.col("end")) == F.col("claimed")) & pick(0).isNotNull()
    kind = F.when(F.coalesce(good, F.lit(False)), pick(0)).otherwise(F.raise_error(F.lit("model spans do not match the page text")))
    return j.select("doc_id", "page", "start", "end", kind.alias("field_type"), pick(1).alias("level"), pick(2).alias("subcategory"), F.lit("model").alias("detector"), F.concat(F.lit("Model found "), F.replace(kind, F.lit("_"), F.lit(" "))).alias("reason"), "ord")


def merge_duplicates(spans: DataFrame) -> DataFrame:
    """One row per (doc_id, page, start, end, field_type): levels in order of first detection, detectors joined by " + ",
    reasons appended unless contained already, the first subcategory; public gives way to protected levels."""
    items = F.array_sort(F.collect_list(F.struct("ord", "level", "detector", "reason", "subcategory")))
    g = spans.groupBy("doc_id", "page", "start", "end", "field_type").agg(items.alias("i"))
    reason = F.aggregate("i", F.lit(""), lambda a, x: F.when(a == "", x["reason"]).when(F.contains(a, x["reason"]), a).otherwise(F.concat(a, F.lit(" "), x["reason"])))
    levels = F.array_distinct(F.transform("i", lambda x: x["level"]))
    return g.select("doc_id", "page", "start", "end", "field_type", exprs.levels_kept(levels).alias("levels"), F.array_join(F.array_distinct(F.transform("i", lambda x: x["detector"])), " + ").alias("detector"), reason.alias("reason"), F.col("i")[0]["subcategory"].alias("subcategory"), F.col("i")[0]["ord"].alias("ord"))


def classify(merged: DataFrame, pages: DataFrame, role: str = "", goal: str = "", retain: list[str] | None = None) -> DataFrame:
    """Findings: ids, the text, excerpts, default selection and suggestion."""
    j = merged.join(pages, ["doc_id", "page"])
    s, e, t = F.col("start"), F.col("end"), F.col("text")
    birth = exprs.birth_near(t, s, e)
    before, after = exprs.excerpts(t, s, e)
    kept = F.array(*[F.lit(x) for x in retain or []]).cast("array<string>")
    return j.select("doc_id", "page", "start", "end", "field_type", "levels", "detector", "reason", "subcategory", exprs.slice_of(t, s, e).alias("original_text"), exprs.finding_id(F.col("doc_id"), F.col("page"), s, e, F.col("field_type")).alias("finding_id"), exprs.entity_id(F.col("doc_id"), F.col("field_type"), exprs.slice_of(t, s, e)).alias("entity_id"), before.alias("excerpt_before"), after.alias("excerpt_after"), exprs.selected_by_default(F.col("field_type"), F.col("subcategory"), birth).alias("selected"), exprs.suggestion(F.col("field_type"), birth, F.lit(role), F.lit(goal), kept).alias("suggestion"))


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping spans as one: (doc_id, page, start, end, field_type, n). Spans that only touch stay apart; the type is
    that of a member with the island's own extent (the first by name), else "text"."""
    order = Window.partitionBy("doc_id", "page").orderBy("start", F.desc("end"), "field_type")
    w = spans.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("new", (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int"))
    w = w.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = w.groupBy("doc_id", "page", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_list(F.struct("start", "end", "field_type")).alias("m"))
    outer = F.array_min(F.transform(F.filter("m", lambda x: (x["start"] == F.col("start")) & (x["end"] == F.col("end"))), lambda x: x["field_type"]))
    return g.select("doc_id", "page", "start", "end", F.coalesce(outer, F.lit("text")).alias("field_type"), F.size("m").alias("n"))


def number_tokens(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds prefix, key and token to (doc_id, field_type, original_text, ord): numbers in order of first mention per document
    and prefix, so people and companies with equal texts share one. Tokens of `known` (doc_id, prefix, key, number) stay."""
    m = mentions.withColumn("prefix", exprs.token_prefix(F.col("field_type"))).withColumn("key", exprs.token_key(F.col("original_text")))
    first = m.groupBy("doc_id", "prefix", "key").agg(F.min("ord").alias("first"))
    if known is not None:
        top = known.groupBy("doc_id", "prefix").agg(F.max("number").alias("top"))
        first = first.join(known.select("doc_id", "prefix", "key"), ["doc_id", "prefix", "key"], "left_anti").join(top, ["doc_id", "prefix"], "left")
    else:
        first = first.withColumn("top", F.lit(0))
    order = Window.partitionBy("doc_id", "prefix").orderBy("first", "key")
    numbers = first.select("doc_id", "prefix", "key", (F.coalesce("top", F.lit(0)) + F.row_number().over(order)).alias("number"))
    if known is not None:
        numbers = numbers.unionByName(known.select("doc_id", "prefix", "key", "number"))
    return m.join(numbers, ["doc_id", "prefix", "key"]).withColumn("token", exprs.token_text(F.col("prefix"), F.col("number")))


def redact(pages: DataFrame, replaced: DataFrame) -> DataFrame:
    """Pages with each island (doc_id, page, start, end, label) replaced; islands must not overlap. A null label is [REDACTED].

    A page's islands are put between its pieces in one pass, in the length of the page.
    """
    g = replaced.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("s"))
    j = pages.join(g, ["doc_id", "page"], "left").select("doc_id", "page", "text", "s")
    kinds = {f.name: f.dataType.simpleString() for f in j.schema}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            texts = []
            for text, islands_ in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if text is not None and islands_:
                    parts, last = [], 0
                    for x in islands_:
                        parts += [text[last : x["start"]], "[REDACTED]" if x["label"] is None else x["label"]]
                        last = x["end"]
                    text = "".join([*parts, text[last:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "page", "text"])

    return j.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, text string")


def joined_pages(pages: DataFrame) -> DataFrame:
    """One text per document, pages in order with a blank line between."""
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return g.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def fold_export(spans: DataFrame) -> DataFrame:
    """The plain export's merge of (doc_id, page, start, end, entity_id, replacement): overlapping spans become one, which
    keeps its replacement only while each joined span is of the first one's entity, else [REDACTED]."""
    place = F.struct("start", (-F.col("end")).alias("o"), "entity_id", F.coalesce("replacement", F.lit("[REDACTED]")).alias("r"))
    # Rows are sorted by all that they hold, once: nothing lies beside the place.
    order = Window.partitionBy("doc_id", "page").orderBy("place")
    w = spans.select("doc_id", "page", place.alias("place"))
    end = -F.col("place.o")
    w = w.withColumn("reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("new", (F.col("reach").isNull() | (F.col("place.start") >= F.col("reach"))).cast("int"))
    w = w.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entity = F.col("place.entity_id")
    same = (F.min(entity) == F.max(entity)) & (F.count(entity) == F.count("*"))
    g = w.groupBy("doc_id", "page", "island").agg(F.min("place").alias("first"), F.max(end).alias("end"), ((F.count("*") == 1) | F.coalesce(same, F.lit(False))).alias("one"))
    return g.select("doc_id", "page", "first.start", "end", F.when(F.col("one"), F.col("first.r")).otherwise(F.lit("[REDACTED]")).alias("label"))


def longest_first(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a page the longest, then the leftmost, then the first by ord: a greedy choice, folded per page.

    The kept spans of a page don't overlap, so a new one only has to be held against its two neighbours among them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}

    def step(kept: tuple[list, list], row: dict) -> Iterator[tuple]:
        starts, ends = kept
        s, e = row["start"], row["end"]
        k = bisect_right(starts, s)
        if (k and s < ends[k - 1] and e > starts[k - 1]) or (k < len(starts) and e > starts[k]):
            return
        if s < e:  # an empty span hides nothing
            starts.insert(k, s)
            ends.insert(k, e)
        yield s, e, row["ord"]

    some = spans.select("doc_id", "page", "start", "end", "ord")
    out = f"start {kinds['start']}, end {kinds['end']}, ord {kinds['ord']}"
    return sweep.folded_in_order(some, ["doc_id", "page"], [F.col("start") - F.col("end"), "start", "ord"], out, lambda: ([], []), step)


def overlap_join(left: DataFrame, right: DataFrame, how: str, inside: bool, bin_size: int = 4096) -> DataFrame:
    """Joins spans of a page that overlap (inside: left lies in right); right's columns start and end are o_start and o_end.

    Both sides meet by (doc_id, page, bin) as an equi join; a pair is taken in the first bin that both touch, so that
    pages of any length give pairs once. For semi and anti joins a left span tests all its bins.
    """
    cond = (F.col("start") >= F.col("o_start")) & (F.col("end") <= F.col("o_end")) if inside else (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start"))
    bins = lambda s, e: F.sequence((F.col(s) / bin_size).cast("int"), (F.greatest(F.col(e) - 1, F.col(s)) / bin_size).cast("int"))
    r = right.withColumn("o_bin", F.explode(bins("o_start", "o_end"))).withColumnsRenamed({"doc_id": "o_doc_id", "page": "o_page"})
    on = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & (F.col("bin") == F.col("o_bin")) & cond
    if how in ("left_semi", "left_anti") and inside:
        # An enclosing span touches the bin of the inner one's start.
        return left.withColumn("bin", (F.col("start") / bin_size).cast("int")).join(r, on, how).drop("bin")
    l = left.withColumn("bin", F.explode(bins("start", "end")))
    once = F.col("bin") == F.greatest((F.col("start") / bin_size).cast("int"), (F.col("o_start") / bin_size).cast("int"))
    return l.join(r, on & once, "inner").drop("bin", "o_bin", "o_doc_id", "o_page")


def extend_dates(partial: DataFrame, complete: DataFrame) -> DataFrame:
    """Model dates inside a complete rule date take its extent; of several, the first by ord. `complete` has o_start, o_end, o_ord."""
    keys = ["doc_id", "page", "start", "end", "ord"]
    best = overlap_join(partial.select(*keys), complete, "inner", inside=True).groupBy(*keys).agg(F.min_by(F.struct("o_start", "o_end"), "o_ord").alias("o"))
    return partial.join(best, keys, "left").withColumn("new_start", F.coalesce("o.o_start", "start")).withColumn("new_end", F.coalesce("o.o_end", "end")).drop("o")


def coverage(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """full, partial or missed for each target span: whether one span covers it, or any overlaps it."""
    hit = overlap_join(targets, spans, "inner", inside=False)
    keys = ["doc_id", "page", "start", "end"]
    best = hit.groupBy(*keys).agg(F.max(((F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))).cast("int")).alias("full"))
    return targets.join(best, keys, "left").withColumn("coverage", F.when(F.col("full") == 1, "full").when(F.col("full") == 0, "partial").otherwise("missed")).drop("full")


def subtract(spans: DataFrame, holes: DataFrame) -> DataFrame:
    """What is left of each span without the holes (doc_id, page, o_start, o_end), as rows.

    Before each hole, and before the span's end, lies a piece that begins where the holes so far have ended.
    """
    keys = ["doc_id", "page", "start", "end"]
    each = spans.select(*keys).distinct()
    cut = overlap_join(each, holes, "inner", inside=False).select(*keys, "o_start", "o_end")
    cut = cut.unionByName(each.select(*keys, F.col("end").alias("o_start"), F.col("end").alias("o_end")))
    order = Window.partitionBy(*keys).orderBy("o_start", "o_end")
    cut = cut.withColumn("a", F.greatest("start", F.max("o_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))).withColumn("b", F.least("o_start", "end"))
    pieces = cut.filter("a < b").select(*keys, "a", "b")
    return spans.join(pieces, keys).withColumns({"start": F.col("a"), "end": F.col("b")}).drop("a", "b")


def smallest_region(findings: DataFrame, regions: DataFrame, slack: float = 2.0) -> DataFrame:
    """Adds region_label: that of the smallest region with the centres of all the finding's boxes (array of x0, y0, x1, y1)."""
    r = regions.select("doc_id", "page", F.col("label").alias("r_label"), "x0", "y0", "x1", "y1")
    inside = F.forall("boxes", lambda b: ((b["x0"] + b["x1"]) / 2).between(F.col("x0") - slack, F.col("x1") + slack) & ((b["y0"] + b["y1"]) / 2).between(F.col("y0") - slack, F.col("y1") + slack))
    first = lambda a, b: (F.col("boxes")[0][a] + F.col("boxes")[0][b]) / 2
    centres = findings.filter(F.size("boxes") > 0).select("doc_id", "page", "finding_id", "boxes", first("x0", "x1").alias("x"), first("y0", "y1").alias("y"))
    hit = grid.in_boxes(centres, r, ["doc_id", "page"], slack).filter(inside)
    best = hit.groupBy("finding_id").agg(F.min(F.struct(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), "r_label")).alias("b"))
    return findings.join(best, "finding_id", "left").withColumn("region_label", F.col("b.r_label")).drop("b")


def line_boxes(chars: DataFrame) -> DataFrame:
    """One rectangle per (finding_id, line) around the boxes of its characters that aren't blank."""
    return chars.filter(~exprs.blank(F.col("char"))).groupBy("finding_id", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

"""Review operators: propagation, remembered terms, decisions, quality edits, packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..functions.matching import Prepared, fold, term_index
from ..sources.tables import written
from . import sweep


def folded(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the folded text (NFKC, full case folding, punctuation, white space), which no built-in function gives."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            i = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else fold(t) for t in b.column(i).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string")


def seeds(findings: DataFrame) -> DataFrame:
    """What of a document's findings is looked for again in it: model hits of 3 to 200 characters that aren't weak, one per
    folded text and type, the last one's values at the first one's place. findings: doc_id, ord, original_text, key, field_type, detector, signal."""
    ok = F.col("detector").rlike("(^| )(model|ner/)") & (F.col("signal") != "weak") & F.length("original_text").between(3, 200)
    return findings.filter(ok).groupBy("doc_id", "key", "field_type").agg(F.max_by("original_text", "ord").alias("term"), F.min("ord").alias("ord"))


def match_terms(pages: DataFrame, terms: DataFrame, fuzzy: bool = True, on: str = "doc_id") -> DataFrame:
    """Matches of each page's own terms: pages (doc_id, page, text), terms (doc_id, term, field_type); rows (doc_id, page, term, field_type, start, end, how).

    Terms meet their document's pages by an equi join, gathered into one list a document, which is indexed once for its
    pages; a page is folded and looked through once, whatever the number of terms.
    """
    listed = terms.groupBy(on).agg(F.array_sort(F.collect_set(F.struct("term", "field_type"))).alias("terms"))
    j = pages.join(listed, on).select("doc_id", "page", "text", "terms")
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = []
            for doc, page, text, ts in zip(*(c.to_pylist() for c in b.columns)):
                key = tuple((t["term"], t["field_type"]) for t in ts)
                rows += [(doc, page, *key[k], *hit) for k, *hit in term_index(key, fuzzy).find(Prepared(text or ""))]
            types = [b.schema.types[0], b.schema.types[1], pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc_id", "page", "term", "field_type", "start", "end", "how"])

    page_kind = pages.schema["page"].dataType.simpleString()
    return j.mapInArrow(run, f"doc_id {kind}, page {page_kind}, term string, field_type string, start int, end int, how string")


#: Terms of a list that goes with the plan, at most.
MOST_TERMS = 50_000


def match_common_terms(pages: DataFrame, terms: list[str], field_type: str = "confidential_term", fuzzy: bool = True) -> DataFrame:
    """Matches of one list of at most MOST_TERMS terms, sent with the plan, on every page; longer ones are for match_terms()."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} terms: give them as a table to match_terms()")
    kind = pages.schema["doc_id"].dataType.simpleString()
    key = tuple((t, field_type) for t in terms)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = []
            for doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(doc, page, terms[k], *hit) for k, *hit in term_index(key, fuzzy).find(Prepared(text or ""))]
            types = [b.schema.types[0], pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=["doc_id", "page", "term", "start", "end", "how"])

    return pages.select("doc_id", F.col("page").cast("int"), "text").mapInArrow(run, f"doc_id {kind}, page int, term string, start int, end int, how string")


def in_scope(documents: DataFrame, memory: DataFrame) -> DataFrame:
    """Approved remembered people and companies of each document's organisation, for its review set or for all ("*").

    documents: doc_id, org, review_set; memory: m_org, m_set, state, term, field_type.
    """
    m = memory.filter((F.col("state") == "approved") & F.col("field_type").isin("person_name", "organisation_name"))
    return documents.join(m, (F.col("org") == F.col("m_org")) & ((F.col("m_set") == F.col("review_set")) | (F.col("m_set") == "*")))


#: Terms that an organisation may have remembered.
MOST_REMEMBERED = 500


def remember(memory: DataFrame, new: DataFrame, most: int | None = None) -> DataFrame:
    """Upserts terms (org, key, field_type, review_set, levels, at): a known term gets the union of its levels, old ones first.

    most: where new terms bring an organisation beyond so many (MOST_REMEMBERED in production), the query fails.
    """
    keys = ["org", "key", "field_type", "review_set"]
    both = memory.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    # One row per term and level, summed up before rows meet, however often a term was taught.
    each = both.select(*keys, "o", "at", "levels", F.posexplode_outer("levels").alias("pos", "level"))
    per = each.groupBy(*keys, "level").agg(F.min(F.struct("o", "at", "levels", "pos")).alias("first"), F.max(F.struct("o", "at", "levels")).alias("last"))
    known = F.when(F.col("level").isNotNull(), F.struct("first", "level"))
    g = per.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("i"), F.max("last").alias("last"), F.min("first.o").alias("first"))
    if most is not None:
        held = g.groupBy("org").agg(F.count("*").alias("held"), F.max("first").alias("some_new"))
        kind = F.when((F.col("held") > most) & (F.col("some_new") == 1), F.raise_error(F.lit("too many remembered terms of an organisation")).cast(g.schema["key"].dataType)).otherwise(F.col("key"))
        g = g.join(held, "org").withColumn("key", kind)
    return g.select(*keys, F.transform("i", lambda x: x["level"]).alias("levels"), F.col("last.at").alias("at"))


def human_protected(status, signal, detector):
    """Decided by a person, approved, or from a person's own terms; approximate matches (-fuzzy) don't count."""
    return (status != "unreviewed") | (signal == "approved") | F.arrays_overlap(F.split(detector, r" \+ "), F.array(*map(F.lit, fixed.APPROVED_SOURCES)))


def carry_forward(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Decisions of prior (doc_id, page, start, end, field_type, selected, status; protected ones only) on fresh findings.

    The same place takes over whether any prior there was selected; the same place and type takes the prior row itself;
    priors whose place and type don't come again are added.
    """
    place = ["doc_id", "page", "start", "end"]
    there = prior.groupBy(*place).agg(F.max("selected").alias("any"))
    f = fresh.join(there, place, "left").withColumns({"selected": F.coalesce("any", "selected"), "status": F.when(F.col("any").isNull(), F.col("status")).when(F.col("any"), "confirmed_remove").otherwise("confirmed_keep")}).drop("any")
    keys = [*place, "field_type"]
    p = prior.select(*keys, F.col("selected").alias("p_selected"), F.col("status").alias("p_status"), F.lit(True).alias("p"))
    return f.withColumn("f", F.lit(True)).join(p, keys, "full_outer").select(*keys, F.when(F.col("p"), F.col("p_selected")).otherwise(F.col("selected")).alias("selected"), F.when(F.col("p"), F.col("p_status")).otherwise(F.col("status")).alias("status"), F.col("f").isNull().alias("carried"))


def apply_changes(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Model changes (finding_id, action) on findings (finding_id, selected, protected): remove and review select, keep
    unselects; protected findings are left and counted."""
    j = findings.join(changes, "finding_id", "left")
    return j.withColumn("selected", F.when(F.col("action").isNull() | F.col("protected"), F.col("selected")).otherwise(F.col("action") != "keep")).withColumn("outcome", F.when(F.col("action").isNull(), "unchanged").when(F.col("protected"), "protected").otherwise("changed"))


def new_additions(additions: DataFrame, findings: DataFrame) -> DataFrame:
    """Additions not yet there by place and type; where people decided on the exact place, their choice holds, and remove
    wins over keep. findings: doc_id, page, start, end, field_type, finding_id, selected, protected."""
    place = ["doc_id", "page", "start", "end"]
    fresh = additions.join(findings, [*place, "field_type"], "left_anti")
    chosen = findings.filter("protected").groupBy(*place).agg(F.max("selected").alias("any"), (F.min("selected") != F.max("selected")).alias("conflict"), F.array_join(F.array_sort(F.collect_list("finding_id")), ",").alias("ids"))
    return fresh.join(chosen, place, "left").withColumn("selected", F.coalesce("any", F.col("action") != "keep")).withColumn("conflict", F.coalesce("conflict", F.lit(False))).drop("any")


#: --- fixed values: types and detectors that a kept public span may unselect inside it ---
FRAGMENT_TYPES = ["person_name", "organisation_name", "date", "case_reference", "other"]
MACHINE_SOURCES = r"^(model|quality|legal-rule|date-rule|legal-reference|legal-reference-rule|document-match|document-repeat|ner/.*)$"


def reconcile_keeps(findings: DataFrame, kept: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Unselects machine-found fragments inside kept public companies and citations. findings: doc_id, page, start, end,
    field_type, finding_id, detector, selected, protected; kept: doc_id, page, o_start, o_end, o_id (public ones only).

    explicit: finding_ids that the check itself asks to protect, which stay as they are. inside_of is the enclosing
    finding; suggestion, reason and detector, where findings have them, say so.
    """
    return marked_inside(findings, fragments(findings, kept, explicit))


def fragments(findings: DataFrame, kept: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """The findings that reconcile_keeps() unselects: finding_id, inside_of. Written."""
    from .spans import overlap_join

    machine = F.forall(F.split("detector", r" \+ "), lambda s: s.rlike(MACHINE_SOURCES))
    can = findings.filter(F.col("selected") & ~F.col("protected") & F.col("field_type").isin(FRAGMENT_TYPES) & machine)
    if explicit is not None:
        can = can.join(explicit.select("finding_id"), "finding_id", "left_anti")
    place = ["doc_id", "page", "start", "end", "finding_id"]
    # Few as a rule: written, so that Spark knows their number and need not move all findings to them.
    return written(overlap_join(can.select(*place), kept, "inner", inside=True).filter("o_id <> finding_id").groupBy("finding_id").agg(F.max("o_id").alias("inside_of")))


def marked_inside(findings: DataFrame, hit: DataFrame) -> DataFrame:
    """Findings with what fragments() found: unselected, and inside_of, the enclosing one."""
    hits = F.col("inside_of").isNotNull()
    told = {"selected": F.col("selected") & ~hits}
    if "suggestion" in findings.columns:
        told["suggestion"] = F.when(hits, "keep").otherwise(F.col("suggestion"))
    if "reason" in findings.columns:
        told["reason"] = F.when(hits, F.concat(F.lit("Inside a public text that the check keeps: "), "inside_of")).otherwise(F.col("reason"))
    sources = F.split("detector", r" \+ ")
    told["detector"] = F.when(hits & ~F.array_contains(sources, "quality"), F.concat("detector", F.lit(" + quality"))).otherwise(F.col("detector"))
    return findings.join(hit, "finding_id", "left").withColumns(told)


def learned(findings: DataFrame, taught: DataFrame, kept: DataFrame) -> DataFrame:
    """After terms are learned: their mentions are confirmed to go, the listed others to stay. findings: doc_id, finding_id,
    key, field_type, selected, status; taught: doc_id, key, field_type; kept: doc_id, finding_id."""
    t = taught.select("doc_id", "key", "field_type", F.lit(True).alias("taught")).distinct()
    k = kept.select("doc_id", "finding_id", F.lit(True).alias("kept")).distinct()
    same, keep = F.coalesce("taught", F.lit(False)), F.coalesce("kept", F.lit(False))
    # Terms and kept ones, one row a key, are held by a task; the many findings stream past them unsorted.
    findings = findings.join(t.hint("shuffle_hash"), ["doc_id", "key", "field_type"], "left").join(k.hint("shuffle_hash"), ["doc_id", "finding_id"], "left")
    return findings.withColumns({"selected": F.when(same, True).when(keep, False).otherwise(F.col("selected")), "status": F.when(same, "confirmed_remove").when(keep, "confirmed_keep").otherwise(F.col("status"))}).drop("taught", "kept")


def check_acknowledged(sent: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """The blocks sent (doc_id, id), if each was acknowledged (doc_id, id) exactly once and no other was; else the query fails."""
    back = acknowledged.groupBy("doc_id", "id").agg(F.count("*").alias("times"))
    j = sent.withColumn("sent", F.lit(True)).join(back, ["doc_id", "id"], "full_outer")
    ok = F.coalesce(F.col("sent") & (F.col("times") == 1), F.lit(False))
    return j.select("doc_id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("the check did not acknowledge every text block once"))).alias("id"))


def quotes(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """The place of each quoted n-th occurrence: blocks (block, text), spans (block, quote, occurrence); start is null for
    an unknown block, a missing occurrence, or part of a number."""
    j = spans.join(blocks, "block", "left")
    # Lengths of what stands before each occurrence, from the pieces between them.
    parts = F.split("text", F.concat(F.lit(r"\Q"), F.col("quote"), F.lit(r"\E")), -1)
    before = F.aggregate(F.slice(parts, F.lit(1), F.col("occurrence")), F.lit(0), lambda a, x: a + F.length(x)) + (F.col("occurrence") - 1) * F.length("quote")
    found = F.col("text").isNotNull() & (F.length("quote") > 0) & (F.size(parts) > F.col("occurrence"))
    j = j.withColumn("at", F.when(found, before))
    head, tail = F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + F.length("quote") + 1, F.lit(1))
    part = (F.col("quote").rlike(r"^\d") & head.rlike(r"\d[.,]?$")) | (F.col("quote").rlike(r"\d$") & tail.rlike(r"^\d"))
    return j.withColumn("start", F.when(~part, F.col("at"))).withColumn("end", F.col("start") + F.length("quote")).drop("at")


def blocks(paragraphs: DataFrame, size: int = 2500) -> DataFrame:
    """Paragraphs (doc_id, page, begin, text[, offsets]) in pieces of at most `size` characters, each cut before the last
    blank that it could hold (at `size` where there is none): (doc_id, page, n, id, begin, block[, offsets]).

    n numbers a document's pieces in order of page and paragraph; id is P<page>B<n>; begin is where the piece starts in its
    paragraph, and its offsets lead back to the page.
    """
    kind = paragraphs.schema["doc_id"].dataType.simpleString()
    cut = re.compile(rf"(?s)(?:.{{1,{size}}}\Z|(.{{1,{size - 1}}})(?= )|.{{{size}}})")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = [(doc, page, first, m.start(), m.group()) for doc, page, first, text in zip(*(c.to_pylist() for c in b.columns)) for m in cut.finditer(text or "")]
            types = [b.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["doc_id", "page", "first", "begin", "block"])

    page = F.col("page").cast("int")
    parts = paragraphs.select("doc_id", page, F.col("begin").cast("int").alias("first"), "text").mapInArrow(run, f"doc_id {kind}, page int, first int, begin int, block string")
    if "offsets" in paragraphs.columns:
        own = paragraphs.select("doc_id", page.alias("page"), F.col("begin").cast("int").alias("first"), F.col("offsets").alias("o"))
        parts = parts.join(own, ["doc_id", "page", "first"]).withColumn("offsets", F.slice("o", F.col("begin") + 1, F.length("block"))).drop("o")
    order = Window.partitionBy("doc_id").orderBy("page", "first", "begin")
    n = parts.withColumn("n", F.row_number().over(order)).withColumn("id", F.concat(F.lit("P"), "page", F.lit("B"), "n"))
    return n.select("doc_id", "page", "n", "id", "begin", "block", *(["offsets"] if "offsets" in parts.columns else []))


def json_size(blocks: DataFrame) -> DataFrame:
    """Adds size, the characters of {"id", "page", "text"} as JSON with a blank after each comma and colon, for pack()."""
    text = F.to_json(F.struct(F.col("block").alias("t")))
    # {"t":"..."} has 8 characters beside the escaped text; the whole has 32 beside id, page and text.
    return blocks.withColumn("size", (F.length(text) - 8 + F.length("id") + F.length(F.col("page").cast("string")) + 32).cast("bigint"))


def pack(items: DataFrame, budget: int = 16_000) -> DataFrame:
    """Adds batch (from 0) to (doc_id, ord, size): in order, a new batch where the next item would exceed the budget.

    The sum starts anew with each batch, which no window sum does: a document's items stream past two numbers.
    """

    def step(state: list[int], row: dict) -> Iterator[tuple]:
        if state[1] > 0 and state[1] + row["size"] > budget:
            state[:] = [state[0] + 1, 0]
        state[1] += row["size"]
        yield row["ord"], row["size"], state[0]

    return sweep.folded_in_order(items.select("doc_id", "ord", "size"), ["doc_id"], ["ord", "size"], "ord bigint, size bigint, batch int", lambda: [0, 0], step)


def groups(findings: DataFrame, mode: str = "category") -> DataFrame:
    """Review groups with their mentions, entities, selected and unreviewed ones, by sort key."""
    g = findings.withColumn("group_key", exprs.review_group(F.col("field_type"), F.col("levels"), F.col("signal"), mode))
    return g.groupBy("group_key").agg(F.count("*").alias("mentions"), F.count_distinct("entity_id").alias("entities"), F.count_if("selected").alias("selected"), F.count_if(F.col("status") == "unreviewed").alias("unreviewed"))


def toggle_equivalent(findings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selects (or not) all mentions that equal a chosen one but for case and punctuation. chosen: doc_id, eq_key, to."""
    f = findings.withColumn("eq_key", exprs.equivalent_key(F.col("original_text")))
    return f.join(chosen, ["doc_id", "eq_key"], "left").withColumn("selected", F.coalesce("to", "selected")).drop("to")


def last_events(events: DataFrame, n: int, by: str) -> DataFrame:
    """The last n events of each key, by at and then seq."""
    order = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("seq"))
    return events.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")

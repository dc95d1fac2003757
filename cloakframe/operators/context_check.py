"""The context check as one flow: blocks in batches are sent, quotations come back, are verified, and change a document as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.tables import written
from . import analysis, layout, quality, review

#: Characters of a block, of a batch as JSON, and of the document's beginning that goes with each batch.
BLOCK, BATCH, CONTEXT, CONTEXT_PAGES = 2500, 16_000, 1800, 2
ANSWER = "reviewed array<string>, spans array<struct<block:string,quote:string,occurrence:int,kind:string,action:string>>"
QUOTE_LENGTH = (2, 2500)
ACTIONS = ["hide", "review"]


def whole_pages(pages: DataFrame) -> DataFrame:
    """Pages without layout as paragraphs of one each, as layout.paragraphs() gives them; empty pages have none."""
    n = F.length("text")
    return pages.filter(n > 0).select("doc_id", "page", F.lit(0).alias("begin"), "text", F.sequence(F.lit(0), n - 1).alias("offsets"))


def to_send(pages: DataFrame, paragraphs: DataFrame | None = None, org: str = "", model: str = "", policy: str = "", role: str = "", goal: str = "", block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Blocks with their batch: doc_id, page, id, block, offsets, batch, context, batch_key.

    Paragraphs (pages as they are, by default) are cut into blocks of at most `block` characters, which fill batches of at most
    `batch` characters of JSON in order; context is the beginning of the document, from its first pages. batch_key is the
    hash of all that an answer depends on, so that stored answers can be looked up before anything is sent.
    """
    parts = review.json_size(review.blocks(whole_pages(pages) if paragraphs is None else paragraphs, block))
    packed = review.pack(parts.select("doc_id", F.col("n").cast("bigint").alias("ord"), "size"), batch).select(F.col("doc_id").alias("k_doc"), "ord", "batch")
    parts = parts.join(packed, (F.col("doc_id") == F.col("k_doc")) & (F.col("n") == F.col("ord"))).drop("k_doc", "ord")
    first = pages.filter(F.col("page") <= CONTEXT_PAGES).groupBy(F.col("doc_id").alias("c_doc")).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    first = first.select("c_doc", F.substring(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), 1, CONTEXT).alias("context"))
    items = F.array_sort(F.collect_list(F.struct("n", "id", "page", "block")))
    told = parts.groupBy(F.col("doc_id").alias("b_doc"), F.col("batch").alias("b_batch")).agg(F.to_json(F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["page"].alias("page"), x["block"].alias("text")))).alias("blocks"))
    j = parts.join(first, F.col("doc_id") == F.col("c_doc"), "left").join(told, (F.col("doc_id") == F.col("b_doc")) & (F.col("batch") == F.col("b_batch")))
    key = F.sha2(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (("policy", policy), ("model", model), ("org", org), ("role", role), ("goal", goal))], "context", "blocks")), 256)
    return j.select("doc_id", "page", "n", "id", "block", "offsets", "batch", F.coalesce("context", F.lit("")).alias("context"), key.alias("batch_key"))


def verified(sent: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, quotes) of answers (doc_id, batch, reviewed, spans) to sent blocks.

    batches: doc_id, batch, outcome: ok, or the first reason against the answer: no_answer, not_acknowledged (each block of the
    batch once, and no other), unknown_block, bad_quote (too short or long, no such action or kind, no occurrence from 1 on),
    unverified_quotation (not in its block so many times), part_of_number. quotes: doc_id, page, id, kind, action, start, end
    within the block, of all quotations that hold.
    """
    key = ["doc_id", "batch"]
    a = answers.groupBy(*key).agg(F.count("*").alias("times"), F.any_value("reviewed").alias("reviewed"), F.any_value("spans").alias("spans"))
    want = sent.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    j = want.join(a, key, "left")
    ok = F.coalesce((F.col("times") == 1) & (F.array_sort("reviewed") == F.col("ids")), F.lit(False))
    each = j.select(*key, F.explode("spans").alias("s")).select(*key, "s.*")
    b = sent.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("batch").cast("string"), "id").alias("block"), F.col("block").alias("text"), "page", "id")
    named = each.withColumn("block", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("batch").cast("string"), "block"))
    usable = F.length("quote").between(*QUOTE_LENGTH) & (F.col("occurrence") >= 1) & F.col("action").isin(ACTIONS) & F.col("kind").isin([*fixed.REDACTION_CATEGORY, "other"])
    q = review.quotes(b, named.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("occurrence", F.greatest("occurrence", F.lit(1))))
    there = F.size(F.split("text", F.concat(F.lit(r"\Q"), F.col("quote"), F.lit(r"\E")), -1)) > F.col("occurrence")
    fault = F.when(F.col("text").isNull(), "1unknown_block").when(~F.col("usable"), "2bad_quote").when(~there, "3unverified_quotation").when(F.col("start").isNull(), "4part_of_number")
    q = written(q.withColumn("fault", fault).select(*key, "page", "id", "kind", "action", "start", "end", "fault"))
    worst = q.filter("fault is not null").groupBy(*key).agg(F.substring(F.min("fault"), 2, 40).alias("fault"))
    out = j.select(*key, F.when(F.col("times").isNull(), "no_answer").when(~ok, "not_acknowledged").alias("refused")).join(worst, key, "left")
    return out.select(*key, F.coalesce("refused", "fault", F.lit("ok")).alias("outcome")), q.filter("fault is null").drop("fault")


def levels_of(kind: Column) -> Column:
    """The level that a quotation's kind protects."""
    return F.array(F.when(kind.isin(fixed.SECRET_KINDS), fixed.SECRECY).otherwise(fixed.PRIVATE))


def check(pages: DataFrame, findings: DataFrame, answers: DataFrame, repaired: DataFrame | None = None, paragraphs: DataFrame | None = None, sent: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, changes, additions) of a context check, the last two for analysis.quality_edits().

    pages: doc_id, page, text; findings: doc_id, page, start, end, field_type, levels, finding_id; answers: doc_id, batch and
    ANSWER; repaired: second answers, which count for the batches whose first one doesn't hold. outcomes: doc_id, outcome
    (ok or the first batch's reason), batches, repaired. A document with a batch that doesn't hold keeps its findings
    unchanged, with no addition: nothing is applied until every batch of it holds.

    Quotations lead back to ranges on the page; those of health lose ordinary dates, as layout.trim_health() says. Each finding that the
    blocks cover takes the action of the quotation with its place and type, else keep.
    """
    sent = written(sent if sent is not None else to_send(pages, paragraphs))
    outcomes, quotes = verified(sent, answers)
    outcomes = outcomes.withColumn("repaired", F.lit(False))
    if repaired is not None:
        bad = outcomes.filter("outcome <> 'ok'").select("doc_id", "batch")
        again = repaired.join(bad, ["doc_id", "batch"], "left_semi")
        second, more = verified(sent.join(bad, ["doc_id", "batch"], "left_semi"), again)
        quotes = quotes.join(bad, ["doc_id", "batch"], "left_anti").unionByName(more)
        outcomes = outcomes.filter("outcome = 'ok'").unionByName(second.withColumn("repaired", F.col("outcome") == "ok"))
    told = outcomes.groupBy("doc_id").agg(F.min(F.when(F.col("outcome") != "ok", F.struct("batch", "outcome"))).alias("worst"), F.count("*").alias("batches"), F.count_if("repaired").alias("repaired"))
    told = written(told.select("doc_id", F.coalesce("worst.outcome", F.lit("ok")).alias("outcome"), "batches", "repaired"))
    good = told.filter("outcome = 'ok'").select("doc_id")
    text = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.col("text").alias("page_text")).join(good, "doc_id", "left_semi")
    blocks = sent.join(good, "doc_id", "left_semi").select("doc_id", "page", "id", "offsets").join(text, ["doc_id", "page"])
    q = quotes.join(blocks, ["doc_id", "page", "id"]).withColumn("q", F.monotonically_increasing_id())
    q = written(q.select("doc_id", "page", "q", "kind", "action", "start", "end", "offsets", "page_text"))
    ranges = layout.page_ranges(q.select(F.col("q").alias("id"), "start", "end", "offsets", "page_text"))
    act = F.when(F.col("action") == "hide", "remove").otherwise("review")
    found = q.select("doc_id", "page", "q", F.col("kind").alias("field_type"), act.alias("action")).join(ranges, F.col("q") == F.col("id")).select("doc_id", "page", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "field_type", "action")
    found = written(found.groupBy("doc_id", "page", "start", "end", "field_type").agg(F.min("action").alias("action")))
    dates = found.filter(F.col("field_type").isin("date", "birth_date")).select("doc_id", "page", "start", "end")
    plain = text.withColumnRenamed("page_text", "text")
    health = layout.trim_health(found.filter("field_type = 'medical_information'"), plain, dates)
    quoted = written(found.filter("field_type <> 'medical_information'").unionByName(health.select(*found.columns)).dropDuplicates(["doc_id", "page", "start", "end", "field_type"]))
    everywhere = layout.page_ranges(blocks.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string"), "id").alias("id"), F.lit(0).alias("start"), F.size("offsets").alias("end"), "offsets", "page_text"))
    at = blocks.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string"), "id").alias("b_id"), "doc_id", "page")
    extents = everywhere.join(at, F.col("id") == F.col("b_id")).select("doc_id", "page", "start", "end")
    mine = findings.join(good, "doc_id", "left_semi")
    actions = quality.decide(quality.covered(mine, extents, plain), quoted)
    quote_levels = F.col("action") != "keep"
    changes = actions.select("doc_id", "finding_id", "action", "field_type", F.when(quote_levels, levels_of(F.col("field_type"))).otherwise(F.col("levels")).alias("levels"), F.when(quote_levels, F.lit("Quoted by the context check.")).otherwise(F.lit("The context check quotes nothing here.")).alias("reason"))
    additions = quoted.select("doc_id", "page", "start", "end", "field_type", levels_of(F.col("field_type")).alias("levels"), "action", F.concat(F.lit("Context check: "), F.replace("field_type", F.lit("_"), F.lit(" "))).alias("reason"))
    return told, changes, additions


def apply(findings: DataFrame, pages: DataFrame, answers: DataFrame, repaired: DataFrame | None = None, paragraphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings after the check, each document's counts, outcomes); documents whose check doesn't hold stay as they are."""
    told, changes, additions = check(pages, findings, answers, repaired, paragraphs)
    after, counts = analysis.quality_edits(findings, written(changes), written(additions))
    return after, counts, told




def usage(outcomes: DataFrame, used: DataFrame) -> DataFrame:
    """Per document: what its batches used (doc_id, batch, counters as further columns), summed, with batches and those that were asked twice.
    used may have several rows a batch, one a call; a batch whose answer was stored has none."""
    counters = [c for c in used.columns if c not in ("doc_id", "batch")]
    calls = used.groupBy("doc_id", "batch").agg(*[F.sum(c).alias(c) for c in counters], F.count("*").alias("calls"))
    per = calls.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counters], F.count_if(F.col("calls") > 1).alias("asked_twice"))
    j = outcomes.select("doc_id", "batches").join(per, "doc_id", "left")
    return j.select("doc_id", "batches", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*counters, "asked_twice")])

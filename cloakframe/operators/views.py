"""What readers see of documents, and what the review page asks of them: token-only views, reveals, selections, page reads, closing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from . import sharing

#: Characters that a person's selection must have to be a term.
SELECTION_LENGTH = (2, 200)
#: Documents that a store holds open at a time, and seconds that an unused one stays open.
MOST_OPEN, OPEN_SECONDS = 8, 1800
#: Runs open at a time, seconds of a run and of an identity in it.
MOST_RUNS, RUN_SECONDS, IDENTITY_SECONDS = 20, 7200, 1800


def token_view(mentions: DataFrame) -> DataFrame:
    """A document's tokens with their levels, never a value, as one row: doc_id, fields. mentions: doc_id, token, levels."""
    m = mentions.groupBy("doc_id", "token").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("levels")))).alias("levels"))
    return m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", "levels"))).alias("fields"))


def document_views(requests: DataFrame, documents: DataFrame, assignments: DataFrame, mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """request_id, outcome, fields and text for requests (request_id, doc_id, user_id, user_org) to see documents in tokens.

    documents: doc_id, org, shared (whether it may be assigned at all); assignments: doc_id, user_id; mentions: see token_view();
    texts: doc_id, text with tokens in place of values. outcome is allowed or the first reason: unknown_document,
    other_organisation, not_assigned (an unshared document is its organisation's curator's alone). Only allowed requests
    get fields and text, and neither holds an original.
    """
    a = assignments.select("doc_id", "user_id").distinct().withColumn("assigned", F.lit(True))
    j = requests.join(documents, "doc_id", "left").join(a, ["doc_id", "user_id"], "left")
    mine = F.coalesce("assigned", F.lit(False)) & F.coalesce("shared", F.lit(False)) | (F.col("user_id") == "curator")
    outcome = F.when(F.col("org").isNull(), "unknown_document").when(~F.col("user_org").eqNullSafe(F.col("org")), "other_organisation").when(~mine, "not_assigned").otherwise("allowed")
    j = j.withColumn("outcome", outcome)
    shown = j.filter("outcome = 'allowed'").select("request_id", "doc_id").join(token_view(mentions), "doc_id", "left").join(texts.select("doc_id", "text"), "doc_id", "left").drop("doc_id")
    none = F.array().cast("array<struct<token:string,levels:array<string>>>")
    return j.select("request_id", "outcome").join(shown, "request_id", "left").withColumn("fields", F.when(F.col("outcome") == "allowed", F.coalesce("fields", none)))


def reveal_sets(findings: DataFrame, focused: DataFrame) -> DataFrame:
    """(doc_id, reveal_ids): all mentions of the value of each document's focused finding (doc_id, finding_id), equal but for case and
    punctuation; a document without a known focused finding has no row."""
    f = findings.select("doc_id", "finding_id", exprs.equivalent_key(F.col("original_text")).alias("k"))
    key = f.join(focused.select("doc_id", "finding_id").distinct(), ["doc_id", "finding_id"], "left_semi").select("doc_id", "k").distinct()
    return f.join(key, ["doc_id", "k"], "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list("finding_id")).alias("reveal_ids"))


def selected_texts(selections: DataFrame, pages: DataFrame) -> DataFrame:
    """selections (doc_id, page, a, b, in code points) with text, what they hold without blanks around it, and usable, whether a term
    may be made of it. A selection of blanks, of nothing, or of an unknown page has no text and isn't usable."""
    j = selections.join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"], "left")
    held = F.regexp_replace(F.substring(F.col("page_text"), F.greatest(F.col("a"), F.lit(0)) + 1, F.greatest(F.col("b") - F.greatest(F.col("a"), F.lit(0)), F.lit(0))), r"(?U)^\s+|\s+$", "")
    j = j.withColumn("text", F.when(F.length(held) > 0, held)).drop("page_text")
    return j.withColumn("usable", F.coalesce(F.length("text").between(*SELECTION_LENGTH), F.lit(False)))


def page_reads(requests: DataFrame, pages: DataFrame, paragraphs: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """request_id, text, paragraphs (in order of their first character) and regions of pages asked for (request_id, doc_id, page)."""
    key = ["doc_id", "page"]
    j = requests.join(pages.select(*key, "text"), key, "left")
    for name, table, order in (("paragraphs", paragraphs, F.struct("begin", "text")), ("regions", regions, F.struct("y0", "x0", "x1", "y1", "label", "text"))):
        if table is not None:
            j = j.join(table.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias(name)), key, "left")
    return j


def policy(spark: SparkSession) -> DataFrame:
    """The policy as a table: field_type, token_prefix, category, colour, for every type with a category, and the rest as Other."""
    t = spark.createDataFrame([(k,) for k in [*fixed.REDACTION_CATEGORY, "other"]], "field_type string")
    category = exprs.redaction_category(F.col("field_type"))
    return t.select("field_type", exprs.token_prefix(F.col("field_type")).alias("token_prefix"), category.alias("category"), exprs.mapped(fixed.CATEGORY_COLOUR, category).alias("colour"))


def sample(catalogue: DataFrame, name: str, by: str = "run") -> DataFrame:
    """The saved example of that name; an unknown one fails the query."""
    there = catalogue.withColumn("_there", F.lit(True)).filter(F.col(by) == F.lit(name))
    asked = catalogue.sparkSession.range(1).select(F.lit(name).alias("_asked"))
    j = asked.join(there, F.col("_asked") == F.col(by), "left")
    known = F.when(F.col("_there"), F.col(by)).otherwise(F.raise_error(F.lit(f"there is no example {name}")))
    return j.withColumn(by, known).drop("_asked", "_there")


def closed(table: DataFrame, documents: DataFrame) -> DataFrame:
    """A table of documents without those that were closed (doc_id); see sources.versions.compact() to let them go for good."""
    return table.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def opened(uploads: DataFrame, most: int = MOST_OPEN, seconds: int = OPEN_SECONDS) -> DataFrame:
    """uploads (store, doc_id, at, seq) with admitted: whether fewer than `most` documents of the store were open, in order; each stays
    open for `seconds`."""
    spark = uploads.sparkSession
    none = spark.createDataFrame([], f"store {uploads.schema['store'].dataType.simpleString()}, expires_at timestamp")
    asked = uploads.select("store", F.col("doc_id").cast("string").alias("request_id"), "at", "seq", F.lit(seconds).alias("ttl"))
    return sharing.admit(asked, none, most).select("store", F.col("request_id").alias("doc_id"), "at", "seq", F.col("issued").alias("admitted"))


def identities(runs: DataFrame, asked: DataFrame, seconds: int = IDENTITY_SECONDS) -> DataFrame:
    """Identities asked for (run_id, user_id, at) in runs (run_id, run_org, run_expires): token, organisation and end, or the reason.

    An identity ends with its run at the latest. A user that isn't one of the known ones, and a run that has ended or isn't
    known, gets none. Outsiders are of another organisation.
    """
    j = asked.join(runs, "run_id", "left")
    end = F.least("run_expires", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
    outcome = F.when(~F.coalesce(F.col("run_expires") > F.col("at"), F.lit(False)), "no_run").when(~F.col("user_id").isin(fixed.USERS), "unknown_user").otherwise("issued")
    ok: Column = F.col("outcome") == "issued"
    org = F.when(F.col("user_id") == "outsider", F.concat("run_org", F.lit("-other"))).otherwise(F.col("run_org"))
    j = j.withColumn("outcome", outcome)
    return j.select("run_id", "user_id", "at", "outcome", F.when(ok, F.sha2(F.concat_ws("|", "run_id", "user_id", F.col("at").cast("string"), F.uuid()), 256)).alias("token"), F.when(ok, org).alias("user_org"), F.when(ok, end).alias("session_expires"))

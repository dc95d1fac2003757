"""Quality checks and exports: coverage by blocks, decisions by quote, overlays, gates, search, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .spans import islands, overlap_join

#: Kinds whose quotes concern the matter rather than a person (fixed values).
MATTER_KINDS = ["organisation_name", "case_reference", "business_secret", "legal_content", "firm_record", "confidential_term"]
LEVELS = [fixed.PUBLIC, fixed.PRIVATE, fixed.SECRECY]


def quote_levels(kind: Column) -> Column:
    return F.array(F.when(kind.isin(MATTER_KINDS), fixed.SECRECY).otherwise(fixed.PRIVATE))


def valid_levels(levels: Column) -> Column:
    """One level at least, known ones only, and public only alone."""
    known = F.forall(levels, lambda x: x.isin(LEVELS))
    return F.coalesce((F.size(levels) > 0) & known & ((F.size(levels) == 1) | ~F.array_contains(levels, fixed.PUBLIC)), F.lit(False))


def covered(findings: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings all of whose characters, blanks and hyphens aside, lie in blocks (doc_id, page, start, end).

    Blocks become islands, so a finding is cut by a few gaps at most; what is left must be blanks and hyphens.
    """
    from .spans import subtract

    holes = islands(blocks.withColumn("field_type", F.lit("b"))).select("doc_id", "page", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    left = subtract(findings.select("doc_id", "page", "start", "end", "finding_id"), holes).join(pages, ["doc_id", "page"])
    open_ = left.filter(F.regexp_replace(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), r"(?U)[\s\-­]", "") != "")
    return findings.join(open_.select("finding_id").distinct(), "finding_id", "left_anti")


def decide(findings: DataFrame, quoted: DataFrame) -> DataFrame:
    """Adds action: that of the quote with the finding's place and type, else keep. quoted: doc_id, page, start, end, field_type, action."""
    return findings.join(quoted, ["doc_id", "page", "start", "end", "field_type"], "left").withColumn("action", F.coalesce("action", F.lit("keep")))


def candidates_of(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that start within a block (doc_id, page, block, first, last)."""
    b = blocks.withColumnsRenamed({"doc_id": "b_doc", "page": "b_page"})
    return findings.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & F.col("start").between(F.col("first"), F.col("last"))).drop("b_doc", "b_page")


def overlay(fresh: DataFrame, old: DataFrame, fields: list[str]) -> DataFrame:
    """Quality-checked rows of `old` over a rerun's findings by id: their fields win, and those that didn't come again are added."""
    o = old.select("finding_id", *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("is_old"))
    j = fresh.join(o, "finding_id", "full_outer")
    return j.select("finding_id", *[F.when(F.col("is_old"), F.col(f"o_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def export_gate(documents: DataFrame, pages: DataFrame, selected: DataFrame, findings: DataFrame) -> DataFrame:
    """Why a document can't be exported, or ok: not analysed, an old revision, unreadable pages, unknown findings.

    documents: doc_id, analysed, revision, current; pages: doc_id, readable; selected: doc_id, finding_id.
    """
    dark = pages.groupBy("doc_id").agg(F.bool_and("readable").alias("readable"))
    odd = selected.distinct().join(findings.select("doc_id", "finding_id"), ["doc_id", "finding_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))
    j = documents.join(dark, "doc_id", "left").join(odd, "doc_id", "left")
    return j.select("doc_id", F.when(~F.col("analysed"), "not_analysed").when(F.col("revision") != F.col("current"), "old_revision").when(~F.coalesce("readable", F.lit(True)), "unreadable").when(F.coalesce("unknown", F.lit(0)) > 0, "unknown_findings").otherwise("ok").alias("gate"))


def searched(findings: DataFrame, words: str) -> DataFrame:
    """Findings with the words in their text, type, reason or excerpts, whatever their case."""
    return findings.filter(F.contains(F.lower(F.concat_ws(" ", "original_text", "field_type", "reason", "excerpt_before", "excerpt_after")), F.lit(words.lower())))


def compare_targets(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """Per target (doc_id, page, start, end): spans (o_start, o_end) that overlap it, and whether one has its very extent."""
    keys = ["doc_id", "page", "start", "end"]
    hit = overlap_join(targets.select(*keys).distinct(), spans, "inner", inside=False).groupBy(*keys).agg(F.count("*").alias("hits"), F.max((F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end"))).alias("exact"))
    return targets.join(hit, keys, "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "exact": F.coalesce("exact", F.lit(False))})


def totals(findings: DataFrame) -> DataFrame:
    """Selected, kept and unreviewed findings of each document."""
    return findings.groupBy("doc_id").agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("kept"), F.count_if(F.col("status") == "unreviewed").alias("unreviewed"))


def entity_spans(entities: DataFrame, language: str) -> DataFrame:
    """A named-entity model's rows (doc_id, page, start, end, label, ord) as common spans; other labels are dropped."""
    from ..functions.exprs import mapped

    pick = lambda i: mapped({k: v[i] for k, v in fixed.ENTITY_LABELS.items()}, F.col("label"))
    kept = entities.filter(F.col("label").isin(list(fixed.ENTITY_LABELS)))
    return kept.select("doc_id", "page", "start", "end", pick(0).alias("field_type"), pick(1).alias("level"), F.lit("entity").alias("subcategory"), F.lit(f"ner/{language}").alias("detector"), F.concat(F.lit("Named entity: "), "label").alias("reason"), "ord")


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key (organisation, text hashes, languages, engine) has no stored result: what is left to compute."""
    key = F.sha2(F.to_json(F.struct("org", "hashes", "languages", "engine")), 256)
    return requests.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def newest(rows: DataFrame, n: int, by: list[str], at: str) -> DataFrame:
    """The n newest rows of each key: a first-in, first-out store of bounded size."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc(at))
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def model_comparison(changes: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks that each model passes: expected (finding_id, want) is keep, protect (no change, or one that doesn't keep) or a
    field type; changes: model, finding_id, action, field_type. Every model is held against every expectation."""
    models = changes.agg(F.array_sort(F.collect_set("model")).alias("models")).scalar()  # one value: the models that were tried
    every = expected.select("finding_id", "want", F.explode(models).alias("model"))
    j = every.join(changes, ["model", "finding_id"], "left")
    passed = F.when(F.col("want") == "keep", F.coalesce(F.col("action") == "keep", F.lit(False))).when(F.col("want") == "protect", F.coalesce(F.col("action") != "keep", F.lit(True))).otherwise(F.coalesce(F.col("field_type") == F.col("want"), F.lit(False)))
    return j.groupBy("model").agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"))


def reference_list(findings: DataFrame) -> DataFrame:
    """Legal references of each document with where to look them up, what that proves, and how often each is mentioned.
    findings: doc_id, page, field_type, original_text, subcategory."""
    from ..functions.exprs import reference_portal

    r = findings.filter("field_type = 'case_reference'").groupBy("doc_id", "original_text", "subcategory").agg(F.count("*").alias("mentions"), F.min("page").alias("first_page"))
    url, status = reference_portal(F.col("subcategory"), F.col("original_text"))
    return r.withColumn("url", url).withColumn("status", status)


def bulk(findings: DataFrame, selected: bool) -> DataFrame:
    """All findings chosen to go, or to stay, as a person's decision."""
    return findings.withColumns({"selected": F.lit(selected), "status": F.lit("confirmed_remove" if selected else "confirmed_keep")})


def per_category(rows: DataFrame, category: str, order: list, n: int, most: int | None = None) -> DataFrame:
    """The first n rows of each category by the order, and of those the first `most` categories' by name (None: all)."""
    from pyspark.sql import Window

    got = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
    if most is None:
        return got
    return got.join(rows.select(category).distinct().orderBy(category).limit(most), category, "left_semi")


def counted(rows: DataFrame, label: str, who: str) -> DataFrame:
    """Rows and different `who` of each label."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.count_distinct(who).alias("users"))

"""Sources and sinks: page tables, saved runs, remembered terms, restored findings, text exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs

#: A saved run of a model: one JSON file.
SAVED = "schema_version int, pdf_sha256 string, pdf_path string, captured_at string, model struct<name:string>, pages array<struct<text_sha256:string,spans:array<struct<label:string,start:int,end:int,text:string,placeholder:string>>>>"
#: A file of remembered terms.
MEMORY = "version int, terms array<struct<id:string,text:string,field_type:string,sensitivity_levels:array<string>,review_set:string,origin_document_hash:string,organisation_id:string,approval_state:string,approved_at:string,approved_by:string>>"


def pages_of(df: DataFrame, id_col: str, text_col: str, page_col: str | None = None) -> DataFrame:
    """Any table of texts as pages (doc_id, page, text), page 1 where it has none."""
    return df.select(F.col(id_col).alias("doc_id"), (F.col(page_col).cast("int") if page_col else F.lit(1)).alias("page"), F.col(text_col).alias("text"))


def read_text_files(spark: SparkSession, path: str, cap: int | None = None, pattern: str = "*.txt") -> DataFrame:
    """One page per file; form feeds part pages. A file over `cap` bytes (None: no cap) fails the query; see uploads.uploads(),
    which gives the reason against each file instead."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    content = F.col("content")
    if cap is not None:
        content = F.when(F.col("length") <= cap, content).otherwise(F.raise_error(F.concat(F.lit(f"over {cap} bytes: "), "path")).cast("binary"))
    return f.select(F.col("path").alias("doc_id"), F.posexplode(F.split(F.decode(content, "utf-8"), "\f")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """Saved runs of schema version 1: (run, pdf_sha256, page, text_sha256, spans)."""
    r = spark.read.schema(SAVED).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("run", F.input_file_name())
    return r.filter("schema_version = 1").select("run", "pdf_sha256", F.posexplode("pages").alias("i", "p")).select("run", "pdf_sha256", (F.col("i") + 1).alias("page"), "p.text_sha256", "p.spans")


def replay(saved: DataFrame, pages: DataFrame) -> DataFrame:
    """Saved spans of pages whose text still has the saved hash; a page that changed fails the query."""
    j = saved.join(pages, ["run", "page"], "left")
    same = F.coalesce(F.sha2("text", 256) == F.col("text_sha256"), F.lit(False))
    spans = F.when(same, F.col("spans")).otherwise(F.raise_error(F.lit("a saved page differs from the text")).cast(saved.schema["spans"].dataType))
    return j.select("run", "page", F.posexplode(spans).alias("ord", "s")).select("run", "page", "ord", "s.label", "s.start", "s.end", "s.text")


def catalogue(saved: DataFrame) -> DataFrame:
    """Runs with their pages and spans."""
    return saved.groupBy("run").agg(F.count("*").alias("pages"), F.sum(F.size("spans")).alias("spans"))


def run_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The saved runs under path (files *.baseline.json): run, title, pages, model, in any version."""
    r = spark.read.schema(SAVED).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.baseline.json").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.baseline\.json$", 1)
    return r.select(name.alias("run"), name.alias("title"), F.size("pages").alias("pages"), F.col("model.name").alias("model"))


def save_runs(runs: DataFrame, path: str) -> None:
    """Runs (run and the columns of SAVED) as JSON, a folder each; a run that is there already is never overwritten."""
    runs.repartition("run").write.partitionBy("run").mode("errorifexists").json(path)


def screened(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The spans (doc_id, page, ord, ...) of a screening's results (doc_id, page, text_sha256, spans), if each page of each document came
    back once, with the hash its text has, and every span lies in its page; else the query fails and nothing is applied."""
    back = results.groupBy("doc_id", "page").agg(F.count("*").alias("times"), F.any_value("text_sha256").alias("told"), F.any_value("spans").alias("spans"))
    j = pages.select("doc_id", "page", "text", F.lit(True).alias("there")).join(back, ["doc_id", "page"], "full_outer")
    text = F.coalesce("text", F.lit(""))
    inside = F.forall("spans", lambda s: F.coalesce(exprs.valid_span(text, s["start"], s["end"]), F.lit(False)))
    kind = results.schema["spans"].dataType
    fault = F.when(~F.coalesce(F.col("there") & (F.col("times") == 1), F.lit(False)), "the screening did not return every page once").when(~F.coalesce(F.sha2(text, 256) == F.col("told"), F.lit(False)), "the screening's texts differ from the pages").when(~F.coalesce(inside, F.lit(False)), "a screening span is outside the page")
    ok = F.when(fault.isNull(), F.col("spans")).otherwise(F.raise_error(fault).cast(kind))
    return j.select("doc_id", "page", F.posexplode(ok).alias("ord", "s")).select("doc_id", "page", "ord", "s.*")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Remembered terms of versions 1 and 2; those of version 2 need an organisation and a state of approval."""
    m = spark.read.schema(MEMORY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    t = m.filter(F.col("version").isin(1, 2)).select("version", F.explode("terms").alias("t")).select("version", "t.*")
    ok = (F.col("version") == 1) | (F.col("organisation_id").isNotNull() & F.col("approval_state").isNotNull())
    fine = F.when(ok & F.length("text").between(2, 200), F.col("text")).otherwise(F.raise_error(F.lit("the file of remembered terms is not valid")))
    return t.withColumn("text", fine).withColumns({"organisation_id": F.coalesce("organisation_id", F.lit("local-organisation")), "approval_state": F.coalesce("approval_state", F.lit("approved"))})


def restore(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans of findings, one row per level, with new ids. Findings on unknown pages, with another text than the page has at
    their place, or with an id that occurs twice (where they have one, as source_id) fail the query."""
    j = findings.join(pages, ["doc_id", "page"], "left")
    ok = exprs.valid_span(F.col("text"), F.col("start"), F.col("end")) & (exprs.slice_of(F.col("text"), F.col("start"), F.col("end")) == F.col("original_text"))
    if "source_id" in findings.columns:
        twice = findings.groupBy(F.col("doc_id").alias("t_doc"), F.col("source_id").alias("t_id")).agg(F.count("*").alias("t_n"))
        j = j.join(twice, (F.col("doc_id") == F.col("t_doc")) & (F.col("source_id") == F.col("t_id")), "left")
        ok = ok & (F.coalesce("t_n", F.lit(1)) == 1)
    kind = F.when(F.coalesce(ok, F.lit(False)), F.col("field_type")).otherwise(F.raise_error(F.lit("a restored finding does not match the page, or its id occurs twice")))
    j = j.withColumn("field_type", kind)
    return j.select("doc_id", "page", "start", "end", "field_type", F.explode("levels").alias("level"), exprs.finding_id(F.col("doc_id"), F.col("page"), F.col("start"), F.col("end"), F.col("field_type")).alias("finding_id"))


def restored_review(findings: DataFrame, pages: DataFrame, characters: DataFrame) -> DataFrame:
    """restore()'s findings, one row each, with boxes computed anew from the characters and tokens numbered anew: nothing that was
    saved but places, types, levels and decisions is trusted. findings also hold selected and status."""
    from ..operators import spans

    place = ["doc_id", "page", "start", "end", "field_type"]
    f = restore(findings, pages).groupBy(*place, "finding_id").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    f = f.join(pages, ["doc_id", "page"]).withColumn("original_text", exprs.slice_of(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    f = f.join(findings.select(*place, "selected", "status").distinct(), place)
    at = characters.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1}).drop("pos")
    s = f.select("doc_id", "page", F.col("start").alias("o_start"), F.col("end").alias("o_end"), "finding_id")
    boxes = spans.line_boxes(spans.overlap_join(at, s, "inner", inside=True).filter(F.col("x0").isNotNull()))
    boxes = boxes.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "y0", "x1", "y1"))), lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))).alias("boxes"))
    mentions = f.withColumn("ord", F.col("page").cast("bigint") * (1 << 32) + F.col("start"))
    tokens = spans.number_tokens(mentions.select("doc_id", "field_type", "original_text", "ord", "finding_id")).select("finding_id", "token")
    return f.join(boxes, "finding_id", "left").join(tokens, "finding_id")


def manifest(pages: DataFrame) -> DataFrame:
    """Per document: characters, hash of the joined text, empty pages."""
    from ..operators.spans import joined_pages

    empty = pages.groupBy("doc_id").agg(F.count_if(exprs.blank(F.col("text"))).alias("empty_pages"))
    return joined_pages(pages).join(empty, "doc_id").select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"), "empty_pages")


def write_text(pages: DataFrame, path: str) -> None:
    """One JSON line per document with its text; its manifest beside it. Never overwrites."""
    from ..operators.spans import joined_pages

    joined_pages(pages).write.mode("errorifexists").json(f"{path}/texts")
    manifest(pages).write.mode("errorifexists").json(f"{path}/manifest")


def save_memory(spark: SparkSession, terms: list[dict], path: str) -> None:
    """A new version of the file of remembered terms, as one file in a new folder."""
    spark.createDataFrame([(json.dumps({"version": 2, "terms": terms}, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def remember_in(path: str, new: DataFrame, most: int | None = None) -> dict:
    """Upserts terms (see review.remember()) into the versioned table at path, as one new version that readers see whole or not at all.
    Another writer's version in between makes it fail rather than undo what it hasn't seen."""
    from ..operators.review import remember
    from . import versions

    spark = new.sparkSession
    old = versions.read(spark, path) if versions.exists(spark, path) else new.limit(0)
    return versions.commit(remember(old, new, most), path, append=False)


def token_keys(tokens: DataFrame) -> DataFrame:
    """The private key table, apart from all shared output: document -> map of token to original text."""
    firsts = tokens.groupBy("doc_id", "token").agg(F.min_by("original_text", "ord").alias("original_text"))
    return firsts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "original_text")))).alias("keys"))

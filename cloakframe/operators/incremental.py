"""Incremental analysis: a page that was analysed is not analysed again, whatever document it is in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import versions
from . import spans

_SPAN = "array<struct<start:int,end:int,field_type:string,level:string,subcategory:string,detector:string,reason:string,ord:int>>"


def page_key(org: Column, text: Column, engine: str, languages: list[str] | None = None, payload: Column | None = None) -> Column:
    """What a page's result depends on: organisation, text, engine with its version and, where they matter, the languages and
    the file's bytes (their hash). An engine that reads every language alike has the same key whatever was asked for."""
    asked = F.lit("*" if languages is None else ",".join(sorted(set(languages))))
    return F.sha2(F.to_json(F.struct(F.coalesce(org.cast("string"), F.lit("")).alias("org"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text"), F.lit(engine).alias("engine"), asked.alias("languages"), (F.lit("") if payload is None else F.coalesce(payload, F.lit(""))).alias("payload"))), 256)


def detect_once(pages: DataFrame, path: str, engine: str, names: list[str] | None = None, languages: list[str] | None = None, run: Callable[[DataFrame], DataFrame] | None = None, org: str | None = None, payload: str | None = None) -> DataFrame:
    """spans.detect() of pages (doc_id, page, text), reading what is stored under `path` and computing the rest only.

    engine names the detectors and their version; it, the page's text, org (a column, one for all by default), languages
    and payload (a column with the file's hash) make the key, see page_key(). names: detectors of the registry; run:
    instead, a function from pages with the key as doc_id to common spans (a model). Pages with equal keys are computed
    once. New results are added to the store in one version, pages without any span too; a run over unchanged pages
    calls no detector and writes nothing. Null and empty texts have no spans and aren't stored.
    """
    spark = pages.sparkSession
    org_ = F.col(org) if org else F.lit("")
    keyed = pages.filter(F.length("text") > 0).withColumn("cache_key", page_key(org_, F.col("text"), engine, languages, F.col(payload) if payload else None))
    wanted = keyed.groupBy("cache_key").agg(F.first("text").alias("text"))
    known = versions.read(spark, path) if versions.exists(spark, path) else spark.createDataFrame([], f"cache_key string, engine string, found {_SPAN}")
    missing = wanted.join(known.select("cache_key"), "cache_key", "left_anti")
    texts = missing.select(F.col("cache_key").alias("doc_id"), F.lit(1).alias("page"), "text")
    found = run(texts) if run else spans.detect(texts, names or ["contacts"])
    each = F.struct(*[F.col(c).cast("int" if c in ("start", "end", "ord") else "string").alias(c) for c in ("start", "end", "field_type", "level", "subcategory", "detector", "reason", "ord")])
    got = found.groupBy("doc_id").agg(F.collect_list(each).alias("found"))
    new = missing.select("cache_key").join(got, F.col("cache_key") == F.col("doc_id"), "left").select("cache_key", F.lit(engine).alias("engine"), F.coalesce("found", F.array().cast(_SPAN)).cast(_SPAN).alias("found"))
    if not missing.isEmpty():
        versions.commit(new, path)
        known = versions.read(spark, path)
    j = keyed.select("doc_id", "page", "cache_key").join(known.dropDuplicates(["cache_key"]).select("cache_key", "found"), "cache_key")
    return j.select("doc_id", F.col("page").cast("int").alias("page"), F.explode("found").alias("s")).select("doc_id", "page", "s.*")

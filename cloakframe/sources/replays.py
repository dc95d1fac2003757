"""Replay of saved runs as a whole: all that a run holds is taken, or nothing of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import versions


class ReplayRefused(ValueError):
    """A run that was asked for doesn't hold; nothing was written."""


def judged(asked: DataFrame, saved: DataFrame, files: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """(run, outcome) for each asked run (run): ok, or the first reason against it.

    saved: run, schema_version, pdf_path, pdf_sha256, pages (array of text_sha256 and spans, as readers.SAVED has them); files:
    path, doc_id, sha256 of what is there; pages: doc_id, page, text. Reasons: not_listed (no such saved run), wrong_version,
    outside (the file isn't under root, or its path leads out of it), no_file, file_changed, page_count, page_changed,
    span_outside (a span that isn't its page's slice). A run is looked at page by page, and falls with any of them.
    """
    path = F.concat(F.lit(root.rstrip("/") + "/"), "pdf_path")
    s = saved.select("run", "schema_version", "pdf_sha256", path.alias("path"), (F.col("pdf_path").rlike(r"(^|/)\.\.(/|$)|^/|^[a-z]+:") | F.col("pdf_path").isNull()).alias("out"), F.size("pages").alias("n"))
    f = files.select(F.col("path").alias("f_path"), "doc_id", "sha256")
    j = asked.select("run").distinct().join(s, "run", "left").join(f, F.col("path") == F.col("f_path"), "left")
    there = pages.groupBy(F.col("doc_id").alias("p_doc")).agg(F.count("*").alias("p_n"))
    j = j.join(there, F.col("doc_id") == F.col("p_doc"), "left")
    each = saved.join(asked.select("run").distinct(), "run", "left_semi").select("run", F.posexplode("pages").alias("i", "p"))
    each = each.join(j.select("run", "doc_id"), "run").join(pages.select(F.col("doc_id").alias("t_doc"), F.col("page").alias("t_page"), "text"), (F.col("doc_id") == F.col("t_doc")) & (F.col("i") + 1 == F.col("t_page")), "left")
    same = F.coalesce(F.sha2("text", 256) == F.col("p.text_sha256"), F.lit(False))
    good = F.forall(F.coalesce("p.spans", F.array().cast(_spans(saved))), lambda x: F.coalesce(exprs.valid_span(F.col("text"), x["start"], x["end"]) & (exprs.slice_of(F.col("text"), x["start"], x["end"]) == x["text"]), F.lit(False)))
    odd = each.groupBy("run").agg(F.count_if(~same).alias("changed"), F.count_if(same & ~good).alias("outside"))
    j = j.join(odd, "run", "left")
    outcome = (
        F.when(F.col("schema_version").isNull() & F.col("n").isNull(), "not_listed")
        .when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "wrong_version")
        .when(F.col("out"), "outside")
        .when(F.col("doc_id").isNull(), "no_file")
        .when(~F.coalesce(F.col("sha256") == F.col("pdf_sha256"), F.lit(False)), "file_changed")
        .when(~F.coalesce(F.col("n") == F.col("p_n"), F.lit(False)), "page_count")
        .when(F.col("changed") > 0, "page_changed")
        .when(F.col("outside") > 0, "span_outside")
        .otherwise("ok")
    )
    return j.select("run", "doc_id", outcome.alias("outcome"))


def _spans(saved: DataFrame) -> str:
    return saved.schema["pages"].dataType.elementType["spans"].dataType.simpleString()


def spans_of(judged_runs: DataFrame, saved: DataFrame) -> DataFrame:
    """The spans (run, doc_id, page, ord, label, start, end, text) of the runs that hold."""
    ok = judged_runs.filter("outcome = 'ok'").select("run", "doc_id")
    each = saved.join(ok, "run").select("run", "doc_id", F.posexplode("pages").alias("i", "p"))
    return each.select("run", "doc_id", (F.col("i") + 1).alias("page"), F.posexplode("p.spans").alias("ord", "s")).select("run", "doc_id", "page", "ord", "s.label", "s.start", "s.end", "s.text")


def replay_whole(asked: DataFrame, saved: DataFrame, files: DataFrame, pages: DataFrame, root: str, path: str) -> dict:
    """Commits the spans of all asked runs to the versioned table at path, in one version, or raises ReplayRefused and writes nothing."""
    runs = judged(asked, saved, files, pages, root)
    bad = runs.filter("outcome <> 'ok'").orderBy("run").limit(5).collect()
    if bad:
        raise ReplayRefused("; ".join(f"{r.run}: {r.outcome}" for r in bad))
    return versions.commit(spans_of(runs, saved), path)

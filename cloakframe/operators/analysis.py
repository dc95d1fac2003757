"""Whole flows over pages: analysis, repeats and remembered terms, learning from examples, the quality check's edits.

Each is a plan of the operators beside it; nothing here collects, and every shuffle is by document and page or a finer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..functions.detectors import terms as term_detector
from ..sources.tables import written
from . import layout, review, spans

#: Detectors over whole pages, in the order of their findings; sensitive topics follow, by paragraph.
PAGE_DETECTORS = ["contacts", "parties", "amounts", "dates"]
#: Places in the order of detection that one source of spans may take.
ROOM = 1 << 32
COLUMNS = ["doc_id", "page", "start", "end", "field_type", "level", "subcategory", "detector", "reason", "ord"]


def detect_in_paragraphs(paragraphs: DataFrame, pages: DataFrame, names: list[str]) -> DataFrame:
    """Spans of the named detectors in paragraphs (as layout.paragraphs gives them), as ranges on their pages.

    Pages without any paragraph are looked at whole.
    """
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("begin").cast("string"))
    p = paragraphs.select(key.alias("key"), "doc_id", "page", "text", "offsets")
    found = spans.detect(p.select(F.col("key").alias("doc_id"), "page", "text"), names).withColumnRenamed("doc_id", "key").drop("page")
    on_page = pages.select("doc_id", "page", F.col("text").alias("page_text"))
    j = found.join(p.drop("text"), "key").join(on_page, ["doc_id", "page"]).withColumn("id", F.concat_ws("|", "key", F.col("ord").cast("string")))
    ranges = layout.page_ranges(j.select("id", "start", "end", "offsets", "page_text"))
    mapped = j.drop("start", "end", "offsets", "page_text", "key").join(ranges, "id").select(*COLUMNS)
    bare = pages.join(paragraphs.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return mapped.unionByName(spans.detect(bare, names).select(*COLUMNS))


def _in_turn(*sources: DataFrame) -> DataFrame:
    """The spans of all sources; ord keeps their order within a source and puts the sources one behind the other."""
    out = None
    for i, s in enumerate(sources):
        s = s.select(*[F.col(c) for c in COLUMNS[:-1]], (F.col("ord") + F.lit(i) * ROOM).cast("bigint").alias("ord"))
        out = s if out is None else out.unionByName(s)
    return out


def _and_last(every: DataFrame, extra: DataFrame) -> DataFrame:
    """What _in_turn() gave, and more spans behind all of it."""
    return every.select(*COLUMNS).unionByName(extra.select(*COLUMNS[:-1], (F.col("ord") + F.lit(64) * ROOM).cast("bigint").alias("ord")))


def spans_of(pages: DataFrame, model: DataFrame | None = None, entities: DataFrame | None = None, paragraphs: DataFrame | None = None, terms: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Every source's common spans of pages, in turn, written: what analyse() goes on with. See there for the sources.

    All detectors over whole pages run in one pass over the texts, which are dealt over all cores before: a small file, which
    one task would read, holds many. Only a named-entity model's spans are held against lists of medicines.
    """
    spark = pages.sparkSession
    dealt = pages.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism), "doc_id", "page")
    names = [*PAGE_DETECTORS, *(["terms"] if terms else []), "references", *(["topics"] if paragraphs is None else [])]
    sources = [] if model is None else [spans.label_spans(model, pages)]
    sources.append(spans.detect(dealt, names, {"terms": term_detector(terms or [], fuzzy)} if terms else None))
    if paragraphs is not None:
        sources.append(detect_in_paragraphs(paragraphs, pages, ["topics"]))
    if entities is not None:
        sources.append(layout.drop_medication_places(entities, pages))
    return written(_in_turn(*sources))


def findings_of(every: DataFrame, pages: DataFrame, regions: DataFrame | None = None, boxes: DataFrame | None = None, role: str = "", goal: str = "", retain: list[str] | None = None) -> DataFrame:
    """Findings from a written table of common spans: reconciled, merged, classified, in order; see analyse()."""
    # Part of a date that a model saw takes the whole date's place.
    outside = (F.col("field_type") == "date") & ((F.col("detector") == "model") | F.col("detector").startswith("ner/"))
    whole = every.filter("detector = 'date-rule'").select("doc_id", "page", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("ord").alias("o_ord"))
    partial = every.filter(outside)
    moved = spans.extend_dates(partial.drop("o_ord"), whole).withColumns({"start": F.col("new_start"), "end": F.col("new_end")}).select(*COLUMNS)
    merged = spans.merge_duplicates(every.filter(~outside).select(*COLUMNS).unionByName(moved))
    found = spans.classify(merged, pages, role, goal, retain)
    return annotate(found, regions, boxes).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("start", "end", "field_type")))


def valid_regions(regions: DataFrame) -> DataFrame:
    """Regions of a page within what a layout model may tell, as exprs.valid_region() says; another fails the query."""
    ok = F.coalesce(exprs.valid_region(F.col("page"), F.col("label"), F.col("text")), F.lit(False))
    label = F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("a layout region is not valid")))
    return regions.withColumn("label", label)


def analyse(pages: DataFrame, model: DataFrame | None = None, entities: DataFrame | None = None, paragraphs: DataFrame | None = None, regions: DataFrame | None = None, boxes: DataFrame | None = None, extra: DataFrame | None = None, terms: list[str] | None = None, fuzzy: bool = True, role: str = "", goal: str = "", retain: list[str] | None = None) -> DataFrame:
    """Findings of pages (doc_id, page, text): every detector's spans, reconciled, merged, classified, in order.

    model: a model's spans for spans.label_spans(); entities: a named-entity model's spans as common ones; paragraphs: what
    layout.paragraphs() gives, for sensitive topics (without: whole pages); extra: more common spans, the last in turn;
    terms: the user's own. regions (doc_id, page, label, text, x0 ...) and boxes (finding_id, boxes) add layout evidence;
    a region that isn't valid fails the query. Rows are spans.classify()'s with levels, ord (from 1, by start and end within
    a page), signal and region_label. An empty table, and pages with null or empty texts, give no findings.
    """
    pages = pages.select("doc_id", F.col("page").cast("int").alias("page"), "text")
    every = spans_of(pages, model, entities, paragraphs, terms, fuzzy)
    if extra is not None:
        every = written(_and_last(every, extra))
    return findings_of(every, pages, None if regions is None else valid_regions(regions), boxes, role, goal, retain)


def annotate(findings: DataFrame, regions: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """Adds region_label and signal; section markers that are whole regions are unselected and kept."""
    if regions is not None and boxes is not None:
        f = spans.smallest_region(findings.join(boxes.select("finding_id", "boxes"), "finding_id", "left"), regions).drop("boxes")
        texts = regions.groupBy("doc_id", "page", F.col("label").alias("region_label")).agg(F.collect_set("text").alias("region_texts"))
        f = f.join(texts, ["doc_id", "page", "region_label"], "left")
        strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        mine = F.element_at(F.filter("region_texts", lambda t: strip(t) == strip(F.col("original_text"))), 1)
        mine = F.when(F.size("region_texts") > 0, mine)
    else:
        f, mine = findings.withColumn("region_label", F.lit(None).cast("string")), F.lit(None).cast("string")
    signal, marker = exprs.review_signal(F.col("field_type"), F.col("original_text"), F.col("detector"), F.col("region_label"), mine)
    f = f.withColumn("signal", signal).withColumn("marker", marker)
    f = f.withColumns({"selected": F.col("selected") & ~F.col("marker"), "suggestion": F.when(F.col("marker"), "keep").otherwise(F.col("suggestion"))})
    return f.drop("marker", *(["region_texts"] if "region_texts" in f.columns else []))


def complete(pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """The spans (doc_id, page, start, end, label, text, ord) of predictions (doc_id, page, spans array), if there is one row
    for every page and none for another; else the query fails and nothing of it is applied."""
    rows = predictions.groupBy("doc_id", "page").agg(F.count("*").alias("times"), F.any_value("spans").alias("spans"))
    j = pages.select("doc_id", "page", F.lit(True).alias("there")).join(rows, ["doc_id", "page"], "full_outer")
    ok = F.coalesce(F.col("there") & (F.col("times") == 1), F.lit(False))
    kind = predictions.schema["spans"].dataType
    got = F.when(ok, F.coalesce("spans", F.array().cast(kind))).otherwise(F.raise_error(F.lit("the model did not return every page once")).cast(kind))
    return j.select("doc_id", "page", F.posexplode(got).alias("ord", "s")).select("doc_id", "page", "s.start", "s.end", "s.label", "s.text", "ord")


#: --- fixed values: where a term that is looked for again comes from, and the state of its matches ---
REPEAT, EXAMPLE, REMEMBERED = "document-repeat", "reviewer-example", "screening-memory"


def repeated(pages: DataFrame, sources: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Common spans of every match of sources (doc_id, term, field_type, source, levels), one a level; near ones are
    told apart by the detector's ending."""
    hits = review.match_terms(pages, sources.select("doc_id", "term", "field_type"), fuzzy)
    j = hits.join(sources, ["doc_id", "term", "field_type"]).withColumn("level", F.explode("levels"))
    near = F.col("how") == "fuzzy"
    reason = F.when(near, "Like a known text but for one edit; it may be another.").when(F.col("source") == REPEAT, "The same text was found elsewhere in this document.").otherwise("Matches an example that a person confirmed.")
    detector = F.concat("source", F.when(near, F.lit("-fuzzy")).otherwise(F.lit("")))
    order = Window.partitionBy("doc_id", "page").orderBy("source", "term", "field_type", "start", "level")
    return j.select("doc_id", F.col("page").cast("int").alias("page"), "start", "end", "field_type", "level", F.lit("screening_match").alias("subcategory"), detector.alias("detector"), reason.alias("reason"), F.row_number().over(order).alias("ord"))


def apply_predictions(pages: DataFrame, predictions: DataFrame, examples: DataFrame | None = None, remembered: DataFrame | None = None, prior: DataFrame | None = None, entities: DataFrame | None = None, fuzzy: bool = True, **more) -> DataFrame:
    """analyse() with a model's predictions, its findings looked for again in the whole document, and people's decisions kept.

    predictions: see complete(). examples and remembered: (doc_id, term, field_type, levels), people's own and those of
    review.in_scope(). prior: earlier findings that people decided on, for review.carry_forward(). Adds token.
    """
    pages = pages.select("doc_id", F.col("page").cast("int").alias("page"), "text")
    model = complete(pages, predictions)
    model = written(model)
    kept = {k: more.pop(k) for k in ("paragraphs", "terms") if k in more}
    every = spans_of(pages, model, entities, fuzzy=fuzzy, **kept)
    first = review.folded(findings_of(every, pages, **more), "original_text", "key")
    place = written(first).withColumn("ord", F.col("page").cast("bigint") * ROOM + F.col("ord"))
    listed = review.seeds(place)
    levels = place.groupBy("doc_id", "key", "field_type").agg(F.max_by("levels", "ord").alias("levels"))
    sources = listed.join(levels, ["doc_id", "key", "field_type"]).select("doc_id", "term", "field_type", F.lit(REPEAT).alias("source"), "levels")
    for table, name in ((examples, EXAMPLE), (remembered, REMEMBERED)):
        if table is not None:
            sources = sources.unionByName(table.select("doc_id", "term", "field_type", F.lit(name).alias("source"), "levels"))
    # The detectors' spans stay; only the repeats are new.
    again = findings_of(written(_and_last(every, repeated(pages, written(sources), fuzzy))), pages, **more)
    f = written(again).withColumn("status", F.lit("unreviewed"))
    if prior is not None:
        keys = ["doc_id", "page", "start", "end", "field_type"]
        carried = review.carry_forward(f.select(*keys, "selected", "status"), prior)
        f = f.drop("selected", "status").join(carried, keys, "full_outer")
        f = f.join(pages, ["doc_id", "page"], "left").withColumn("original_text", F.coalesce("original_text", exprs.slice_of(F.col("text"), F.col("start"), F.col("end")))).drop("text")
    place = f.withColumn("o", F.col("page").cast("bigint") * ROOM + F.col("start"))
    place = written(place)
    mentions = place.select("doc_id", "field_type", "original_text", F.col("o").alias("ord"))
    tokens = spans.number_tokens(mentions).groupBy("doc_id", "prefix", "key").agg(F.first("token").alias("token"))
    f = f.withColumn("prefix", exprs.token_prefix(F.col("field_type"))).withColumn("key", exprs.token_key(F.col("original_text")))
    return f.join(tokens, ["doc_id", "prefix", "key"], "left").drop("prefix")


#: Examples of a document at most, and characters of a term.
MOST_EXAMPLES, TERM_LENGTH = 100, (2, 200)


def learn_requests(requests: DataFrame, documents: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """The term that each request to learn asks for (term, term_type, term_levels) and its outcome: the first reason against
    it, or ok.

    requests: request_id, doc_id, revision, finding_id (or null with text, field_type, levels), kept_ids, remember.
    documents: doc_id, analysed, current, examples (how many it has). findings: doc_id, finding_id, original_text,
    field_type, levels. A term must be protected, of 2 to 200 characters, and stand in the open document as it is; only
    people and companies are remembered beyond it.
    """
    f = findings.select(F.col("doc_id").alias("f_doc"), F.col("finding_id").alias("f_id"), "original_text", F.col("field_type").alias("f_type"), F.col("levels").alias("f_levels"))
    r = requests.join(documents, "doc_id", "left").join(f, (F.col("doc_id") == F.col("f_doc")) & (F.col("finding_id") == F.col("f_id")), "left")
    from_finding = F.col("finding_id").isNotNull()
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    r = r.withColumn("term", F.when(from_finding, F.col("original_text")).otherwise(trimmed))
    r = r.withColumn("term_type", F.when(from_finding, F.col("f_type")).otherwise(F.col("field_type"))).withColumn("term_levels", F.when(from_finding, F.col("f_levels")).otherwise(F.col("levels")))
    asked = requests.select("request_id", "doc_id", F.explode("kept_ids").alias("kept"))
    odd = asked.join(f, (F.col("doc_id") == F.col("f_doc")) & (F.col("kept") == F.col("f_id")), "left_anti").select("request_id").distinct().withColumn("odd", F.lit(True))
    wanted = r.filter("term is not null").select("doc_id", "term", F.col("term_type").alias("field_type")).distinct()
    there = review.match_terms(pages, wanted, fuzzy=False).select("doc_id", "term", F.col("field_type").alias("term_type")).distinct().withColumn("there", F.lit(True))
    r = r.join(odd, "request_id", "left").join(there, ["doc_id", "term", "term_type"], "left")
    least, most = TERM_LENGTH
    outcome = (
        F.when(~F.coalesce("analysed", F.lit(False)), "not_analysed")
        .when(F.col("revision") != F.col("current"), "old_revision")
        .when(F.col("odd"), "unknown_kept_finding")
        .when(from_finding & F.col("f_id").isNull(), "unknown_finding")
        .when(~F.coalesce(F.length("term").between(least, most), F.lit(False)) | F.coalesce(F.array_contains("term_levels", fixed.PUBLIC), F.lit(True)), "not_a_protected_term")
        .when(F.col("there").isNull(), "not_in_document")
        .when(F.col("remember") & ~F.col("term_type").isin("person_name", "organisation_name"), "not_remembered_type")
        .when(F.col("examples") >= MOST_EXAMPLES, "too_many_examples")
        .otherwise("ok")
    )
    return r.select("request_id", "doc_id", "term", "term_type", "term_levels", "kept_ids", "remember", outcome.alias("outcome"))


def apply_learning(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings (doc_id, finding_id, original_text, field_type, selected, status) after the accepted rows of
    learn_requests(): mentions equal to a taught term but for case and spacing go, the listed others stay."""
    ok = accepted.filter("outcome = 'ok'")
    taught = review.folded(ok.select("doc_id", "term", F.col("term_type").alias("field_type")), "term", "key").select("doc_id", "key", "field_type")
    f = review.folded(findings.drop("key"), "original_text", "key")
    return review.learned(f, taught, ok.select("doc_id", F.explode("kept_ids").alias("finding_id"))).drop("key")


def decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """People's decisions (doc_id, finding_id, selected) on findings; one on an unknown finding fails the query."""
    d = decisions.select("doc_id", "finding_id", F.col("selected").alias("d_selected"))
    j = findings.withColumn("known", F.lit(True)).join(d, ["doc_id", "finding_id"], "full_outer")
    known = F.when(F.col("known"), F.col("finding_id")).otherwise(F.raise_error(F.lit("a decision names an unknown finding")))
    made = F.col("d_selected").isNotNull()
    status = F.when(made & F.col("d_selected"), "confirmed_remove").when(made, "confirmed_keep").otherwise(F.col("status"))
    return j.withColumns({"finding_id": known, "status": status, "selected": F.coalesce("d_selected", "selected")}).drop("known", "d_selected")


def quality_edits(findings: DataFrame, changes: DataFrame, additions: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings after a quality check, and each document's counts: changed, added, protected, reconciled, kept.

    findings: doc_id, page, start, end, field_type, levels, finding_id, detector, reason, suggestion, selected, status,
    signal; changes: doc_id, finding_id, action (keep, review, remove), and the check's field_type, levels, reason;
    additions: doc_id, page, start, end, field_type, levels, action, reason. What people decided on stays and is counted as
    protected; new findings on a place that people decided on follow them. Fragments inside public texts that the check
    keeps are unselected, unless the check itself asks to protect them.
    """
    if decisions is not None:
        findings = decided(findings, decisions)
    f = findings.withColumn("protected", review.human_protected(F.col("status"), F.col("signal"), F.col("detector")))
    c = changes.select("doc_id", "finding_id", "action", F.col("field_type").alias("c_type"), F.col("levels").alias("c_levels"), F.col("reason").alias("c_reason"))
    j = f.join(c, ["doc_id", "finding_id"], "left")
    told, acts = F.col("action").isNotNull(), F.col("action").isNotNull() & ~F.col("protected")
    sources = F.split("detector", r" \+ ")
    changed = j.withColumns({
        "field_type": F.when(acts, F.col("c_type")).otherwise(F.col("field_type")), "levels": F.when(acts, F.array_distinct("c_levels")).otherwise(F.col("levels")),
        "selected": F.when(acts, F.col("action") != "keep").otherwise(F.col("selected")), "suggestion": F.when(acts, F.col("action")).otherwise(F.col("suggestion")),
        "reason": F.when(acts, F.concat(F.lit("Quality check: "), F.substring("c_reason", 1, 600))).otherwise(F.col("reason")),
        "detector": F.when(acts & ~F.array_contains(sources, "quality"), F.concat("detector", F.lit(" + quality"))).otherwise(F.col("detector")),
        "outcome": F.when(acts, "changed").when(told, "protected").otherwise("unchanged"),
        "asked": F.coalesce(told & (F.col("action") != "keep"), F.lit(False)), "kept": F.coalesce(acts & (F.col("action") == "keep"), F.lit(False)),
    }).drop("c_type", "c_levels", "c_reason", "action")
    # Additions look at places as they were before the changes.
    fresh = review.new_additions(additions, f.select("doc_id", "page", "start", "end", "field_type", "finding_id", "selected", "protected"))
    inherits = F.col("ids").isNotNull()
    place = [F.col(x) for x in ("doc_id", "page", "start", "end", "field_type")]
    new = fresh.select(
        *place, "levels", exprs.finding_id(*place).alias("finding_id"), F.lit("quality").alias("detector"),
        F.when(F.col("conflict"), F.concat(F.lit("People decided differently on this place; removal holds until they agree: "), "ids")).when(inherits, F.concat(F.lit("Follows people's decision on this place: "), "ids")).otherwise(F.substring("reason", 1, 600)).alias("reason"),
        F.when(inherits, F.when(F.col("selected"), "remove").otherwise("keep")).otherwise(F.col("action")).alias("suggestion"), "selected",
        F.when(~inherits, "unreviewed").when(F.col("selected"), "confirmed_remove").otherwise("confirmed_keep").alias("status"), F.lit("candidate").alias("signal"),
        inherits.alias("protected"), F.when(inherits, "added_protected").otherwise("added").alias("outcome"), F.col("selected").alias("asked"), (~F.col("selected")).alias("kept"),
    )
    every = changed.select(*new.columns).unionByName(new)
    every = written(every)  # used three times below
    public = every.filter(F.col("kept") & F.col("field_type").isin("organisation_name", "case_reference") & (F.col("levels") == F.array(F.lit(fixed.PUBLIC))))
    outer = public.select("doc_id", "page", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("finding_id").alias("o_id"))
    # A changed finding that the check asks to protect says so itself; only of additions may several have one id.
    asked = every.filter("asked and outcome like 'added%'").select("finding_id")
    hit = review.fragments(every.filter("not asked"), outer, asked)
    out = review.marked_inside(every, hit)
    counts = out.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == "changed").alias("changed"), F.count_if(F.col("outcome").startswith("added")).alias("added"),
        F.count_if(F.col("outcome").endswith("protected")).alias("protected"), F.count_if(F.col("inside_of").isNotNull()).alias("reconciled"), F.count_if(~F.col("selected")).alias("kept"),
    )
    return out.drop("asked", "kept", "protected"), counts

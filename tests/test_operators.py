import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import analysis, review, sharing, spans
from cloakframe.sources import readers


def test_touching_spans_stay_apart(spark):
    s = spark.createDataFrame([(1, 1, a, b, "date") for a, b in [(0, 5), (3, 8), (8, 9), (20, 30), (22, 25)]], "doc_id int, page int, start int, end int, field_type string")
    assert sorted((r.start, r.end, r.field_type) for r in spans.islands(s).collect()) == [(0, 8, "text"), (8, 9, "date"), (20, 30, "date")]


def test_long_pages_join_once_per_pair(spark):
    left = spark.createDataFrame([(1, 1, 0, 20000), (1, 1, 5000, 5001)], "doc_id int, page int, start int, end int")
    right = spark.createDataFrame([(1, 1, 4000, 13000)], "doc_id int, page int, o_start int, o_end int")
    assert spans.overlap_join(left, right, "inner", inside=False).count() == 2
    assert [r.start for r in spans.overlap_join(left, right, "left_anti", inside=True).collect()] == [0]


def test_tokens_persist(spark):
    m = spark.createDataFrame([("d", "person_name", "Anna  Muster", 1), ("d", "organisation_name", "anna muster", 2), ("d", "person_name", "Beat", 3)], "doc_id string, field_type string, original_text string, ord int")
    first = spans.number_tokens(m)
    assert {r.ord: r.token for r in first.collect()} == {1: "[PARTY_00001]", 2: "[PARTY_00001]", 3: "[PARTY_00002]"}
    known = first.groupBy("doc_id", "prefix", "key", "number").count().drop("count")
    again = spans.number_tokens(m.filter("ord > 1").unionByName(spark.createDataFrame([("d", "date", "1.1.2020", 0), ("d", "person_name", "Adam", 0)], m.schema)), known)
    assert {r.original_text: r.token for r in again.collect()} == {"anna muster": "[PARTY_00001]", "Beat": "[PARTY_00002]", "Adam": "[PARTY_00003]", "1.1.2020": "[DATE_00001]"}


def test_no_fragment_survives_redaction(spark):
    text = "Mail a.b@c.org and CHF 1'000.50 today."
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "")], "doc_id string, page int, text string")
    found = spans.detect(pages, ["contacts", "amounts"], None)
    extra = found.unionByName(found.withColumn("start", F.col("start") + 2).withColumn("field_type", F.lit("other")))
    out = spans.redact(pages, spans.islands(extra).withColumn("label", F.lit("[X]"))).orderBy("page").collect()
    assert [r.text for r in out] == ["Mail [X] and [X] today.", ""]
    assert spans.joined_pages(spark.createDataFrame(out)).first().text == "Mail [X] and [X] today.\n\n"


def test_quotes_reject_parts_of_numbers(spark):
    b = spark.createDataFrame([("b", "in 100%, then 0%.")], "block string, text string")
    s = spark.createDataFrame([("b", "0%", 1), ("b", "0%", 2), ("b", "0%", 3), ("c", "0%", 1)], "block string, quote string, occurrence int")
    assert {(r.block, r.occurrence): r.start for r in review.quotes(b, s).collect()} == {("b", 1): None, ("b", 2): 14, ("b", 3): None, ("c", 1): None}


def test_model_spans_must_match(spark):
    pages = spark.createDataFrame([("d", 1, "Anna lives")], "doc_id string, page int, text string")
    cols = "doc_id string, page int, start int, end int, label string, text string, ord int"
    good = spark.createDataFrame([("d", 1, 0, 4, "private_person", "Anna", 0)], cols)
    assert spans.label_spans(good, pages).first().field_type == "person_name"
    for row in [("d", 1, 0, 4, "nonsense", "Anna", 0), ("d", 1, 1, 5, "private_person", "Anna", 0), ("d", 2, 0, 4, "private_person", "Anna", 0)]:
        with pytest.raises(Exception, match="do not match"):
            spans.label_spans(spark.createDataFrame([row], cols), pages).collect()


def test_repeats_across_pages(spark):
    pages = spark.createDataFrame([("d", 1, "Anna Muster"), ("d", 2, "by anna  muster and Ana Muster"), ("e", 1, "Anna Muster")], "doc_id string, page int, text string")
    terms = spark.createDataFrame([("d", "Anna Muster", "person_name")], "doc_id string, term string, field_type string")
    assert sorted((r.doc_id, r.page, r.start, r.how) for r in review.match_terms(pages, terms).collect()) == [("d", 1, 0, "exact"), ("d", 2, 3, "exact"), ("d", 2, 20, "fuzzy")]


def test_saved_runs_replay_only_unchanged_pages(spark, tmp_path):
    import hashlib

    text = "Anna lives"
    run = {"schema_version": 1, "pdf_sha256": "x", "pages": [{"text_sha256": hashlib.sha256(text.encode()).hexdigest(), "spans": [{"label": "private_person", "start": 0, "end": 4, "text": "Anna"}]}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    saved = readers.saved_runs(spark, f"file://{tmp_path}")
    name = saved.first().run
    ok = spark.createDataFrame([(name, 1, text)], "run string, page int, text string")
    assert readers.replay(saved, ok).first().text == "Anna" and readers.catalogue(saved).first().spans == 1
    with pytest.raises(Exception, match="differs"):
        readers.replay(saved, ok.withColumn("text", F.lit("changed"))).collect()


def test_memory_round_trip_and_pages(spark, tmp_path):
    term = {"id": "1", "text": "Anna", "field_type": "person_name", "sensitivity_levels": ["personal-private"], "review_set": "*", "organisation_id": "o", "approval_state": "approved"}
    readers.save_memory(spark, [term], f"file://{tmp_path}/m")
    assert readers.read_memory(spark, f"file://{tmp_path}/m").first().text == "Anna"
    readers.save_memory(spark, [{k: v for k, v in term.items() if k != "organisation_id"}], f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="not valid"):
        readers.read_memory(spark, f"file://{tmp_path}/bad").collect()
    (tmp_path / "a.txt").write_text("one\ftwo")
    pages = readers.read_text_files(spark, f"file://{tmp_path}/a.txt")
    assert [(r.page, r.text) for r in pages.collect()] == [(1, "one"), (2, "two")]
    readers.write_text(pages, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/manifest").first().chars == 8


def test_downloads_give_the_first_reason(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(k, t) for k in "abcdx"], "token string, at timestamp")
    g = spark.createDataFrame([("a", 1, 1, t + dt.timedelta(1), False), ("b", 1, 1, t, False), ("c", 1, 1, t + dt.timedelta(1), True), ("d", 1, 2, t + dt.timedelta(1), False)], "token string, doc_id int, revision int, expires_at timestamp, revoked boolean")
    out = {x.token: x.outcome for x in sharing.downloads(r, g, spark.createDataFrame([(1, 1)], "doc_id int, current int")).collect()}
    assert out == {"a": "allowed", "b": "expired_or_revoked", "c": "expired_or_revoked", "d": "version_changed", "x": "not_found"}


def test_grant_stream(spark, tmp_path):
    from cloakframe.streaming import state

    schema = "doc_id bigint, recipient string, action string, at timestamp, seq bigint, ttl int"
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, "r", "issue", t, 1, 60), (1, "r", "issue", t + dt.timedelta(seconds=30), 2, 60), (2, "r", "issue", t, 3, 600), (2, "r", "revoke", t + dt.timedelta(seconds=9), 4, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = state.grants(stream).writeStream.format("memory").queryName("grants").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.status) for r in spark.table("grants").collect()) == [(1, "issued"), (1, "issued"), (1, "replaced"), (2, "issued"), (2, "revoked")]


def test_session_and_audit_streams(spark, tmp_path):
    from cloakframe.streaming import state

    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "user_id bigint, ts timestamp, at timestamp, action string"
    for i, m in enumerate([0, 20, 70, 600]):
        spark.createDataFrame([(1, t + dt.timedelta(minutes=m), t + dt.timedelta(minutes=m), "view")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/s")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/s")
    for name, made in (("sess", state.session_ttl(stream)), ("audit", state.audit_counts(stream))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert [r.n for r in spark.table("sess").orderBy("opened").collect()][:2] == [2, 1]
    assert spark.table("audit").agg(F.sum("n")).first()[0] >= 3


def test_analysis_of_a_page(spark):
    """Every detector in turn, a partial date extended, a medicine list's places dropped, equal spans merged, in order."""
    from cloakframe.operators import analysis

    text = "client: Hans Muster\nMail a@b.ch on 12 March 2020, CHF 1'000. The diagnosis\nis open. traitement médicamenteux (Paris, Berne)"
    pages = spark.createDataFrame([("d", 1, text), ("e", 1, ""), ("f", 1, None)], "doc_id string, page int, text string")
    at = text.index
    cols = "doc_id string, page int, start int, end int, label string, text string, ord int"
    model = spark.createDataFrame([("d", 1, at("Hans"), at("Hans") + 11, "private_person", "Hans Muster", 0), ("d", 1, at("March"), at("March") + 10, "private_date", "March 2020", 1)], cols)
    ner = spark.createDataFrame([("d", 1, at("Paris"), at("Paris") + 5, "address", "professional-secrecy", "entity", "ner/fr", "Named entity", 0)], "doc_id string, page int, start int, end int, field_type string, level string, subcategory string, detector string, reason string, ord int")
    got = analysis.analyse(pages, model, ner, terms=["Hans Muster"]).orderBy("doc_id", "page", "ord").collect()
    found = [(r.field_type, r.original_text, r.detector, r.selected) for r in got]
    assert found == [
        ("confidential_term", "Hans Muster", "user-term", True), ("organisation_name", "Hans Muster", "legal-rule", True), ("person_name", "Hans Muster", "model", True),
        ("email", "a@b.ch", "contact-rule", True), ("date", "12 March 2020", "model + date-rule", False), ("amount", "CHF 1'000", "legal-rule", True),
        ("medical_information", "The diagnosis\nis open. traitement médicamenteux (Paris, Berne)", "concept-rule", True),
    ]
    assert got[4].levels == ["personal-private", "professional-secrecy"] and [r.ord for r in got] == list(range(1, 8)) and got[0].signal == "approved"


def test_topics_in_paragraphs_lead_back_to_the_page(spark):
    from cloakframe.operators import analysis, layout

    text = "Head\nA trade se-\ncret of ours. Next"
    chars = spark.createDataFrame([("d", 1, i, 5.0, 5.0 if i < 4 else 50.0) for i in range(len(text))], "doc_id string, page int, pos int, x double, y double")
    regions = spark.createDataFrame([("d", 1, "h", "section_header", 0.0, 0.0, 10.0, 10.0), ("d", 1, "p", "text", 0.0, 40.0, 10.0, 60.0)], "doc_id string, page int, region string, label string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, text), ("e", 1, "The diagnosis.")], "doc_id string, page int, text string")
    paras = layout.paragraphs(pages, layout.owners(chars, regions))
    assert {r.text for r in paras.collect()} == {"Head", "A trade secret of ours. Next"}
    got = analysis.analyse(pages, paragraphs=paras).filter("detector = 'concept-rule'").collect()
    assert sorted((r.doc_id, r.field_type, r.original_text) for r in got) == [("d", "business_secret", "A trade se-\ncret of ours."), ("e", "medical_information", "The diagnosis.")]


@pytest.mark.parametrize(("text", "want"), [("a  b", "a b"), ("Bei­spiel", "Bei spiel"), ("Wort-\nteil", "Wortteil"), ("Wort- teil", "Wort- teil"), (" \n", ""), ("a -\nb", "a - b"), ("x y ", "x y")])
def test_paragraph_text(text, want):
    from cloakframe.operators.layout import paragraph_of

    got, at = paragraph_of(text, list(range(len(text))))
    assert got == want and len(at) == len(got) and at == sorted(at)


def test_predictions_repeats_and_kept_decisions(spark):
    from cloakframe.operators import analysis

    pages = spark.createDataFrame([("d", 1, "Anna Muster came."), ("d", 2, "So did ANNA MUSTER and Ana Muster, by Nord.")], "doc_id string, page int, text string")
    kind = "doc_id string, page int, spans array<struct<label:string,start:int,end:int,text:string>>"
    pred = spark.createDataFrame([("d", 1, [("private_person", 0, 11, "Anna Muster")]), ("d", 2, [])], kind)
    terms = spark.createDataFrame([("d", "Nord", "organisation_name", ["professional-secrecy"])], "doc_id string, term string, field_type string, levels array<string>")
    prior = spark.createDataFrame([("d", 2, 7, 18, "person_name", False, "confirmed_keep")], "doc_id string, page int, start int, end int, field_type string, selected boolean, status string")
    got = {(r.page, r.original_text): r for r in analysis.apply_predictions(pages, pred, remembered=terms, prior=prior).collect()}
    assert set(got) == {(1, "Anna Muster"), (2, "ANNA MUSTER"), (2, "Ana Muster"), (2, "Nord")}
    assert got[1, "Anna Muster"].detector == "model + document-repeat" and got[2, "Ana Muster"].detector == "document-repeat-fuzzy" and got[2, "Ana Muster"].signal == "weak"
    assert got[2, "Nord"].signal == "approved" and (got[2, "ANNA MUSTER"].selected, got[2, "ANNA MUSTER"].status) == (False, "confirmed_keep")
    assert got[1, "Anna Muster"].token == got[2, "ANNA MUSTER"].token == "[PARTY_00001]"
    for bad in (pred.filter("page = 1"), pred.unionByName(pred.filter("page = 2"))):
        with pytest.raises(Exception, match="every page once"):
            analysis.apply_predictions(pages, bad).collect()


def test_learning_gives_the_first_reason(spark):
    from cloakframe.operators import analysis

    docs = spark.createDataFrame([("d", True, 2, 0), ("n", False, 2, 0), ("m", True, 2, 100)], "doc_id string, analysed boolean, current int, examples int")
    pages = spark.createDataFrame([(x, 1, "Anna Muster and Nordbank here.") for x in "dnm"], "doc_id string, page int, text string")
    f = spark.createDataFrame([("d", "f1", "Anna Muster", "person_name", ["personal-private"]), ("d", "f2", "here", "other", ["public"])], "doc_id string, finding_id string, original_text string, field_type string, levels array<string>")
    secret = ["professional-secrecy"]
    rows = [
        ("ok", "d", 2, "f1", None, None, None, ["f2"], True), ("text", "d", 2, None, "  Nordbank ", "organisation_name", secret, [], True), ("not_analysed", "n", 2, None, "x", "date", secret, [], False),
        ("old_revision", "d", 1, "f1", None, None, None, [], False), ("unknown_kept_finding", "d", 2, "f1", None, None, None, ["zz"], False), ("unknown_finding", "d", 2, "f9", None, None, None, [], False),
        ("not_a_protected_term", "d", 2, "f2", None, None, None, [], False), ("short", "d", 2, None, "N", "person_name", secret, [], False), ("not_in_document", "d", 2, None, "Nordban", "organisation_name", secret, [], False),
        ("not_remembered_type", "d", 2, None, "here", "confidential_term", secret, [], True), ("too_many_examples", "m", 2, None, "Nordbank", "organisation_name", secret, [], False),
    ]
    r = spark.createDataFrame(rows, "request_id string, doc_id string, revision int, finding_id string, text string, field_type string, levels array<string>, kept_ids array<string>, remember boolean")
    out = {x.request_id: x for x in analysis.learn_requests(r, docs, f, pages).collect()}
    assert {k: x.outcome for k, x in out.items()} == {k: {"text": "ok", "short": "not_a_protected_term"}.get(k, k) for k in out} and len(out) == len(rows)
    assert out["text"].term == "Nordbank" and out["ok"].term == "Anna Muster"


def test_quality_edits(spark):
    """Changes, additions that follow people, public keeps without their fragments, explicit protection, counts."""
    from cloakframe.operators import analysis

    cols = "doc_id string, page int, start int, end int, field_type string, levels array<string>, finding_id string, detector string, reason string, suggestion string, selected boolean, status string, signal string"
    row = lambda i, a, b, kind, status="unreviewed", detector="model", selected=True: ("d", 1, a, b, kind, ["personal-private"], i, detector, "", "review", selected, status, "candidate")
    f = spark.createDataFrame([row("org", 0, 20, "organisation_name"), row("in", 2, 6, "person_name"), row("asked", 7, 9, "person_name"), row("human", 10, 12, "date", "confirmed_remove"), row("own", 13, 15, "other", detector="user-term"), row("away", 30, 35, "date")], cols)
    c = spark.createDataFrame([("d", "org", "keep", "organisation_name", ["public"], "a known company"), ("d", "asked", "remove", "person_name", ["personal-private"], "a client"), ("d", "human", "keep", "date", ["public"], "x")], "doc_id string, finding_id string, action string, field_type string, levels array<string>, reason string")
    a = spark.createDataFrame([("d", 1, 30, 35, "other", ["personal-private"], "review", "new"), ("d", 1, 10, 12, "other", ["personal-private"], "keep", "on a person's place"), ("d", 1, 30, 35, "date", ["personal-private"], "keep", "there already")], "doc_id string, page int, start int, end int, field_type string, levels array<string>, action string, reason string")
    d = spark.createDataFrame([("d", "away", False)], "doc_id string, finding_id string, selected boolean")
    out, counts = analysis.quality_edits(f, c, a, d)
    got = {(r.start, r.end, r.field_type): r for r in out.collect()}
    assert {k: r.selected for k, r in got.items()} == {(0, 20, "organisation_name"): False, (2, 6, "person_name"): False, (7, 9, "person_name"): True, (10, 12, "date"): True, (13, 15, "other"): True, (30, 35, "date"): False, (30, 35, "other"): False, (10, 12, "other"): True}
    assert got[2, 6, "person_name"].suggestion == "keep" and got[2, 6, "person_name"].detector == "model + quality" and "org" in got[2, 6, "person_name"].reason
    assert got[10, 12, "other"].status == "confirmed_remove" and got[30, 35, "other"].status == "confirmed_keep"
    r = counts.first()
    assert (r.changed, r.added, r.protected, r.reconciled, r.kept) == (2, 2, 3, 1, 4)
    with pytest.raises(Exception, match="unknown finding"):
        analysis.decided(f, d.withColumn("finding_id", F.lit("zz"))).collect()


def test_blocks_of_paragraphs(spark):
    text = "word " * 700
    p = spark.createDataFrame([("d", 2, 0, "second"), ("d", 1, 0, text.strip()), ("d", 1, 4000, "x" * 2501), ("d", 3, 0, "")], "doc_id string, page int, begin int, text string")
    got = review.json_size(review.blocks(p)).orderBy("n").collect()
    assert [(r.id, len(r.block)) for r in got] == [("P1B1", 2499), ("P1B2", 1000), ("P1B3", 2500), ("P1B4", 1), ("P2B5", 6)]
    assert got[1].begin == 2499 and got[1].block.startswith(" word")
    assert all(r["size"] == len(json.dumps({"id": r.id, "page": r.page, "text": r.block}, ensure_ascii=False)) for r in got)
    sent = spark.createDataFrame([("d", "P1B1"), ("d", "P1B2")], "doc_id string, id string")
    assert review.check_acknowledged(sent, sent).count() == 2
    for bad in (sent.limit(1), sent.unionByName(sent.limit(1)), sent.withColumn("id", F.lit("P9B9"))):
        with pytest.raises(Exception, match="acknowledge"):
            review.check_acknowledged(sent, bad).collect()


def test_tokens_fold_sharp_s_and_blanks(spark):
    m = spark.createDataFrame([("d", "person_name", "Anna STRASSE", 1), ("d", "person_name", "anna Straße", 2)], "doc_id string, field_type string, original_text string, ord int")
    assert {r.token for r in spans.number_tokens(m).collect()} == {"[PARTY_00001]"}
    pages = spark.createDataFrame([("d", 1, "\n "), ("d", 2, "x")], "doc_id string, page int, text string")
    assert readers.manifest(pages).first().empty_pages == 1


def test_restored_findings_must_match(spark):
    pages = spark.createDataFrame([("d", 1, "Anna lives")], "doc_id string, page int, text string")
    cols = "doc_id string, page int, start int, end int, field_type string, original_text string, levels array<string>, source_id string"
    good = ("d", 1, 0, 4, "person_name", "Anna", ["personal-private"], "a")
    assert readers.restore(spark.createDataFrame([good], cols), pages).count() == 1
    for bad in (("d", 1, 0, 4, "person_name", "Hans", ["personal-private"], "b"), ("d", 2, 0, 4, "person_name", "Anna", ["personal-private"], "b"), good):
        with pytest.raises(Exception, match="does not match"):
            readers.restore(spark.createDataFrame([good, bad], cols), pages).collect()


def test_texts_of_one_file_are_dealt_over_the_cores(spark):
    """Detection ran in the one task that reads a small file, and once more for lists of medicines (F12)."""
    pages = spark.range(200).selectExpr("id AS doc_id", "cast(1 AS int) AS page", "concat('Sold on 2024-03-04 to c', id, '@shop.ch') AS text").coalesce(1)
    every = analysis.spans_of(pages)
    assert every.select(F.input_file_name()).distinct().count() > 1
    assert every.count() == 400 and every.select("doc_id").distinct().count() == 200
    ents = pages.selectExpr("doc_id", "page", "cast(0 AS int) AS start", "cast(4 AS int) AS `end`", "'address' AS field_type", "'personal-private' AS level", "'entity' AS subcategory", "'ner/de' AS detector", "'r' AS reason", "cast(0 AS int) AS ord")
    got = analysis.spans_of(pages.withColumn("text", F.when(F.col("doc_id") < 5, "traitement médicamenteux (Dafalgan)").otherwise(F.col("text"))), entities=ents.withColumns({"start": F.lit(26), "end": F.lit(34)}))
    assert got.filter("detector = 'ner/de'").count() == 195


def test_spans_of_an_order_stay_together(spark):
    """Lines are moved once, by order, to be numbered and merged; they were moved with their texts, and again to be merged (F9, F11)."""
    from cloakframe.plans import queries

    df = spans.merge_duplicates(queries._spans(spark, "/root/testdata/sf0.001"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_findings_are_not_sorted_for_what_was_learned(spark):
    """Findings stream past the terms and the kept ones of a task; two sorts held them before (F9)."""
    f = spark.range(50).selectExpr("id % 5 AS doc_id", "cast(id AS string) AS finding_id", "'k' AS key", "'date' AS field_type", "false AS selected", "'unreviewed' AS status")
    got = review.learned(f, f.filter("doc_id = 1").select("doc_id", "key", "field_type"), f.filter("doc_id = 2").select("doc_id", "finding_id"))
    assert "Sort [" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.selected, r.status) for r in got.collect()} == {(0, False, "unreviewed"), (1, True, "confirmed_remove"), (2, False, "confirmed_keep"), (3, False, "unreviewed"), (4, False, "unreviewed")}

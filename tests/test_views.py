"""Token-only views, reveals, selections, page reads, capacity and identities; detectors that are added."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import detectors, fixed
from cloakframe.operators import quality, spans, views

T = dt.datetime(2024, 1, 1)


def test_a_view_in_tokens_has_no_value(spark):
    docs = spark.createDataFrame([("d", "o", True), ("intake", "o", False)], "doc_id string, org string, shared boolean")
    assigned = spark.createDataFrame([("d", "u"), ("d", "u"), ("intake", "u")], "doc_id string, user_id string")
    m = spark.createDataFrame([("d", "[PARTY_00001]", ["b", "a"], "Anna"), ("d", "[PARTY_00001]", ["a"], "ANNA"), ("d", "[DATE_00001]", ["c"], "1.1.2020")], "doc_id string, token string, levels array<string>, original_text string")
    texts = spark.createDataFrame([("d", "By [PARTY_00001]")], "doc_id string, text string")
    asked = [("1", "d", "u", "o"), ("2", "d", "x", "o"), ("3", "d", "u", "p"), ("4", "zz", "u", "o"), ("5", "intake", "u", "o"), ("6", "intake", "curator", "o"), ("7", None, "u", "o"), ("8", "d", "u", None)]
    out = views.document_views(spark.createDataFrame(asked, "request_id string, doc_id string, user_id string, user_org string"), docs, assigned, m, texts)
    got = {r.request_id: r for r in out.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"1": "allowed", "2": "not_assigned", "3": "other_organisation", "4": "unknown_document", "5": "not_assigned", "6": "allowed", "7": "unknown_document", "8": "other_organisation"}
    assert [(f.token, f.levels) for f in got["1"].fields] == [("[DATE_00001]", ["c"]), ("[PARTY_00001]", ["a", "b"])] and got["1"].text == "By [PARTY_00001]"
    assert got["6"].fields == [] and got["6"].text is None and all(got[k].fields is None and got[k].text is None for k in "234578")
    assert "Anna" not in str(out.collect()) and "original_text" not in out.columns


def test_all_mentions_of_a_value(spark):
    f = spark.createDataFrame([("d", "1", "Anna-Muster"), ("d", "2", "anna muster!"), ("d", "3", "ANNAMUSTER"), ("d", "4", "Ben"), ("e", "5", "annamuster"), ("e", "6", None)], "doc_id string, finding_id string, original_text string")
    focus = spark.createDataFrame([("d", "1"), ("e", "zz")], "doc_id string, finding_id string")
    assert [(r.doc_id, r.reveal_ids) for r in views.reveal_sets(f, focus).collect()] == [("d", ["1", "3"])]


def test_selections_count_code_points(spark):
    pages = spark.createDataFrame([("d", 1, "é😀 ab  \n")], "doc_id string, page int, text string")
    s = spark.createDataFrame([("d", 1, a, b) for a, b in ((0, 2), (1, 2), (2, 6), (5, 8), (4, 4), (6, 2), (-3, 2))] + [("x", 1, 0, 2)], "doc_id string, page int, a int, b int")
    got = {(r.doc_id, r.a, r.b): (r.text, r.usable) for r in views.selected_texts(s, pages).collect()}
    assert got == {("d", 0, 2): ("é😀", True), ("d", 1, 2): ("😀", False), ("d", 2, 6): ("ab", True), ("d", 5, 8): (None, False), ("d", 4, 4): (None, False), ("d", 6, 2): (None, False), ("d", -3, 2): ("é😀", True), ("x", 0, 2): (None, False)}


def test_reads_of_pages_and_policy(spark):
    pages = spark.createDataFrame([("d", 1, "t"), ("d", 2, None)], "doc_id string, page int, text string")
    paras = spark.createDataFrame([("d", 1, 9, "second"), ("d", 1, 0, "first")], "doc_id string, page int, begin int, text string")
    r = spark.createDataFrame([("1", "d", 1), ("2", "d", 2), ("3", "x", 1)], "request_id string, doc_id string, page int")
    got = {x.request_id: x for x in views.page_reads(r, pages, paras).collect()}
    assert [p.text for p in got["1"].paragraphs] == ["first", "second"] and got["2"].paragraphs is None and got["3"].text is None
    rows = {x.field_type: x for x in views.policy(spark).collect()}
    assert rows["date"].category == "Date" and rows["other"].colour == fixed.CATEGORY_COLOUR["Other"] and rows["email"].token_prefix == "EMAIL"
    runs = spark.createDataFrame([("a", 2)], "run string, pages int")
    assert views.sample(runs, "a").first().pages == 2
    with pytest.raises(Exception, match="no example"):
        views.sample(runs, "b").collect()
    assert [x.page for x in views.closed(pages, spark.createDataFrame([("e",)], "doc_id string")).collect()] == [1, 2] and views.closed(pages, spark.createDataFrame([("d",)], "doc_id string")).count() == 0


def test_stores_hold_so_many_documents_and_identities_end_with_their_run(spark):
    u = spark.createDataFrame([(1, f"d{i}", T + dt.timedelta(seconds=i), i) for i in range(10)] + [(1, "later", T + dt.timedelta(seconds=views.OPEN_SECONDS), 0)], "store int, doc_id string, at timestamp, seq int")
    assert sorted(r.doc_id for r in views.opened(u).filter("not admitted").collect()) == ["d8", "d9"]
    runs = spark.createDataFrame([("r", "o", T + dt.timedelta(seconds=100)), ("old", "o", T)], "run_id string, run_org string, run_expires timestamp")
    asked = spark.createDataFrame([("r", "curator", T), ("r", "outsider", T - dt.timedelta(seconds=5000)), ("r", "nobody", T), ("old", "curator", T), ("x", "curator", T)], "run_id string, user_id string, at timestamp")
    got = {(r.run_id, r.user_id): r for r in views.identities(runs, asked).collect()}
    assert [got[k].outcome for k in (("r", "curator"), ("r", "outsider"), ("r", "nobody"), ("old", "curator"), ("x", "curator"))] == ["issued", "issued", "unknown_user", "no_run", "no_run"]
    assert got["r", "curator"].session_expires == T + dt.timedelta(seconds=100) and got["r", "outsider"].user_org == "o-other" and len(got["r", "curator"].token) == 64 and got["old", "curator"].token is None


def test_an_added_detector_and_bulk_choices(spark):
    detectors.register("shouting", lambda t: [(0, len(t), "other", fixed.PRIVATE, "loud", "loud-rule", "Loud.")] if t.isupper() else [], gate="^[A-Z]+$")
    try:
        pages = spark.createDataFrame([("d", 1, "LOUD"), ("d", 2, "quiet"), ("d", 3, "LOUD TOO")], "doc_id string, page int, text string")
        found = spans.detect(pages, ["shouting"])
        assert [(r.page, r.detector) for r in found.collect()] == [(1, "loud-rule")]  # the gate keeps the third in the JVM
        detectors.register("shouting", detectors.REGISTRY["shouting"])
        assert spans.detect(pages, ["shouting"]).count() == 2 and "shouting" not in detectors.GATES
    finally:
        del detectors.REGISTRY["shouting"]
    f = spark.createDataFrame([(True, "unreviewed"), (False, "confirmed_keep")], "selected boolean, status string")
    assert {(r.selected, r.status) for r in quality.bulk(f, True).collect()} == {(True, "confirmed_remove")} and quality.bulk(f, False).filter(F.col("selected")).count() == 0


def test_a_region_beyond_the_limits_fails_the_analysis(spark):
    from cloakframe.operators import analysis

    kind = "doc_id string, page int, label string, text string, x0 double, y0 double, x1 double, y1 double"
    fine = spark.createDataFrame([("d", 1, "text", "t", 0.0, 0.0, 1.0, 1.0)], kind)
    assert analysis.valid_regions(fine).count() == 1
    for bad in (("d", 41, "text", "t"), ("d", 1, "x" * 81, "t"), ("d", 0, "text", None)):
        with pytest.raises(Exception, match="not valid"):
            analysis.valid_regions(spark.createDataFrame([(*bad, 0.0, 0.0, 1.0, 1.0)], kind)).collect()

"""The context check as a whole: blocks, batches, answers that hold or don't, and what they change."""

from pyspark.sql import functions as F

from cloakframe.operators import context_check as cc
from cloakframe.operators import layout

TEXT = {
    ("a", 1): "Anna Muster was born on 12 March 1981. There is a house by the lake, far from the town and its noise. Therapy since 3 May 2020 and 4 June 2021 helps.",
    ("a", 2): "Costs 100% of 0% here. Anna again.",
    ("b", 1): "Ben lives. Ben works.",
    ("c", 1): "Nothing to see.",
    ("d", 1): "",
}
FINDING = "doc_id string, page int, start int, end int, field_type string, levels array<string>, finding_id string, detector string, reason string, suggestion string, selected boolean, status string, signal string"
ANSWER = f"doc_id string, batch int, {cc.ANSWER}"


def finding(key, quote, kind, **more):
    s = TEXT[key].index(quote)
    row = {"doc_id": key[0], "page": key[1], "start": s, "end": s + len(quote), "field_type": kind, "levels": ["personal-private"], "finding_id": f"{key}-{quote}", "detector": "model", "reason": "r", "suggestion": "review", "selected": True, "status": "unreviewed", "signal": "candidate"}
    return tuple((row | more).values())


def tables(spark, answers):
    pages = spark.createDataFrame([(*k, t) for k, t in TEXT.items()], "doc_id string, page int, text string")
    rows = [finding(("a", 1), "Anna Muster", "person_name"), finding(("a", 1), "3 May 2020", "date"), finding(("a", 2), "Anna", "person_name", status="confirmed_remove"), finding(("b", 1), "Ben", "person_name"), finding(("c", 1), "Nothing", "other")]
    return pages, spark.createDataFrame(rows, FINDING), spark.createDataFrame(answers, ANSWER)


def q(block, quote, n=1, kind="person_name", action="hide"):
    return (block, quote, n, kind, action)


GOOD = [
    ("a", 0, ["P1B1", "P2B2"], [q("P1B1", "Anna Muster"), q("P1B1", "born on 12 March 1981", kind="birth_date"), q("P1B1", "Therapy since 3 May 2020 and 4 June 2021 helps", kind="medical_information"), q("P1B1", "4 June 2021", kind="date"), q("P2B2", "Anna", action="review")]),
    ("b", 0, ["P1B1"], [q("P1B1", "Ben", 2)]),
    ("c", 0, ["P1B1"], []),
]


def test_quotations_change_a_document(spark):
    pages, f, a = tables(spark, GOOD)
    after, counts, told = cc.apply(f, pages, a)
    assert {r.doc_id: (r.outcome, r.batches) for r in told.collect()} == {"a": ("ok", 1), "b": ("ok", 1), "c": ("ok", 1)}
    rows = {(r.doc_id, r.page, TEXT[r.doc_id, r.page][r.start : r.end], r.field_type): r for r in after.collect()}
    got = {k: (r.selected, r.outcome) for k, r in rows.items()}
    assert {k: v for k, v in got.items() if k[0] != "b"} == {
        ("a", 1, "Anna Muster", "person_name"): (True, "changed"), ("a", 1, "3 May 2020", "date"): (False, "changed"),
        ("a", 2, "Anna", "person_name"): (True, "protected"),  # a person's decision stays
        ("a", 1, "born on 12 March 1981", "birth_date"): (True, "added"), ("a", 1, "4 June 2021", "date"): (True, "added"),
        ("a", 1, "Therapy since ", "medical_information"): (True, "added"), ("a", 1, " and 4 June 2021 helps", "medical_information"): (True, "added"),  # but for the ordinary date
        ("c", 1, "Nothing", "other"): (False, "changed"),
    }
    b = {r.start: (r.selected, r.outcome) for r in after.filter("doc_id = 'b'").collect()}
    assert b == {0: (False, "changed"), 11: (True, "added")}
    assert counts.filter("doc_id = 'a'").first().added == 4


def test_a_document_whose_answer_does_not_hold_stays_as_it_is(spark):
    reasons = {
        "not_acknowledged": [("a", 0, ["P1B1", "P1B1"], [])], "unknown_block": [("a", 0, ["P1B1", "P2B2"], [q("P3B9", "Anna")])], "unverified_quotation": [("a", 0, ["P1B1", "P2B2"], [q("P2B2", "Anna", 2), q("P2B2", "again")])],
        "part_of_number": [("a", 0, ["P1B1", "P2B2"], [q("P2B2", "0%", 1)])], "bad_quote": [("a", 0, ["P1B1", "P2B2"], [q("P2B2", "A")])], "no_answer": [],
    }
    for reason, bad in reasons.items():
        pages, f, a = tables(spark, [*bad, GOOD[1], GOOD[2]])
        told, changes, additions = cc.check(pages, f, a)
        assert {r.doc_id: r.outcome for r in told.collect()} == {"a": reason, "b": "ok", "c": "ok"}
        assert changes.filter("doc_id = 'a'").count() == additions.filter("doc_id = 'a'").count() == 0 and changes.count() == 2
    # only the batch that didn't hold is asked again; a number may be quoted as a whole
    fixed_ = [("a", 0, ["P2B2", "P1B1"], [q("P2B2", "0%", 2)]), ("b", 0, ["P1B1"], [q("P1B1", "lives")])]
    pages, f, a = tables(spark, [*reasons["part_of_number"], GOOD[1], GOOD[2]])
    told, changes, additions = cc.check(pages, f, a, spark.createDataFrame(fixed_, ANSWER))
    assert {r.doc_id: (r.outcome, r.repaired) for r in told.collect()} == {"a": ("ok", 1), "b": ("ok", 0), "c": ("ok", 0)}
    assert sorted((r.doc_id, r.start, r.end) for r in additions.collect()) == [("a", 14, 16), ("b", 11, 14)]


def test_blocks_fill_batches_and_keys_follow_what_is_sent(spark):
    pages = spark.createDataFrame([("d", 1, "word " * 900), ("d", 2, "tail"), ("e", 1, None)], "doc_id string, page int, text string")
    sent = cc.to_send(pages, block=1000, batch=2500)
    rows = sent.orderBy("n").collect()
    assert "".join(r.block for r in rows[:-1]) == "word " * 900 and rows[-1].id == f"P2B{len(rows)}" and max(len(r.block) for r in rows) <= 1000
    assert [r.batch for r in rows] == sorted(r.batch for r in rows) and len({r.batch for r in rows}) >= 3 and rows[0].context == ("word " * 900)[: cc.CONTEXT]
    assert len({r.batch_key for r in rows}) == len({r.batch for r in rows})
    other = cc.to_send(pages, model="m", block=1000, batch=2500)
    assert not {r.batch_key for r in other.collect()} & {r.batch_key for r in rows}
    assert cc.to_send(pages.limit(0)).collect() == []


def test_a_quotation_in_a_paragraph_leads_back_over_its_line_break(spark):
    text = "A trade se-\ncret of ours."
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    chars = spark.createDataFrame([("d", 1, i, 5.0, 5.0) for i in range(len(text))], "doc_id string, page int, pos int, x double, y double")
    regions = spark.createDataFrame([("d", 1, "p", "text", 0.0, 0.0, 10.0, 10.0)], "doc_id string, page int, region string, label string, x0 double, y0 double, x1 double, y1 double")
    paras = layout.paragraphs(pages, layout.owners(chars, regions))
    f = spark.createDataFrame([], FINDING)
    answers = spark.createDataFrame([("d", 0, ["P1B1"], [q("P1B1", "secret", kind="business_secret")])], ANSWER)
    told, _, additions = cc.check(pages, f, answers, paragraphs=paras)
    assert told.first().outcome == "ok" and [(text[r.start : r.end], r.levels) for r in additions.collect()] == [("se-\ncret", ["professional-secrecy"])]
    assert additions.filter(F.col("action") != "remove").count() == 0

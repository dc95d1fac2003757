"""Catalogues, saved runs, screenings, restored reviews and remembered terms."""

import datetime as dt
import hashlib
import json

import pytest

from cloakframe.operators import context_check, review
from cloakframe.sources import readers, versions

T = dt.datetime(2024, 1, 1)
TERM = "org string, key string, field_type string, review_set string, levels array<string>, at timestamp"


def test_the_catalogue_of_runs(spark, tmp_path):
    for name, pages in (("one", 2), ("two", 1)):
        (tmp_path / f"{name}.baseline.json").write_text(json.dumps({"schema_version": 1, "model": {"name": "m"}, "pages": [{"text_sha256": "x", "spans": []}] * pages}))
    (tmp_path / "one.screening.json").write_text("{}")
    got = readers.run_catalogue(spark, f"file://{tmp_path}").orderBy("run").collect()
    assert [(r.run, r.title, r.pages, r.model) for r in got] == [("one", "one", 2, "m"), ("two", "two", 1, "m")]
    runs = spark.createDataFrame([("a", 1), ("b", 1)], "run string, schema_version int")
    readers.save_runs(runs, f"file://{tmp_path}/saved")
    assert spark.read.json(f"file://{tmp_path}/saved").count() == 2
    with pytest.raises(Exception, match="exists"):
        readers.save_runs(runs, f"file://{tmp_path}/saved")


def test_a_screening_fits_its_pages_or_fails(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pages = spark.createDataFrame([("d", 1, "Anna"), ("d", 2, None)], "doc_id string, page int, text string")
    kind = "doc_id string, page int, text_sha256 string, spans array<struct<start:int,end:int,label:string>>"
    good = [("d", 1, sha("Anna"), [(0, 4, "PER")]), ("d", 2, sha(""), [])]
    assert [(r.page, r.start, r.label) for r in readers.screened(spark.createDataFrame(good, kind), pages).collect()] == [(1, 0, "PER")]
    bad = {"every page": good[:1], "differ": [("d", 1, sha("Ben"), []), good[1]], "outside": [("d", 1, sha("Anna"), [(0, 5, "PER")]), good[1]], "page once": [*good, good[1]]}
    for why, rows in bad.items():
        with pytest.raises(Exception, match=why):
            readers.screened(spark.createDataFrame(rows, kind), pages).collect()


def test_a_restored_review_is_computed_anew(spark):
    pages = spark.createDataFrame([("d", 1, "Anna\nanna x")], "doc_id string, page int, text string")
    chars = spark.createDataFrame([("d", 1, i, c, int(i > 4), None if c == "\n" else 6.0 * i, 0.0, 6.0 * i + 6, 10.0) for i, c in enumerate("Anna\nanna x")], "doc_id string, page int, pos int, char string, line int, x0 double, y0 double, x1 double, y1 double")
    f = spark.createDataFrame([("d", 1, 0, 4, "person_name", ["b", "a"], "Anna", "old1", True, "unreviewed"), ("d", 1, 0, 9, "person_name", ["a"], "Anna\nanna", "old2", False, "confirmed_keep"), ("d", 1, 5, 9, "person_name", ["a"], "anna", "old3", True, "unreviewed")], "doc_id string, page int, start int, end int, field_type string, levels array<string>, original_text string, source_id string, selected boolean, status string")
    got = {(r.start, r.end): r for r in readers.restored_review(f, pages, chars).collect()}
    assert len(got) == 3 and got[0, 4].levels == ["a", "b"] and got[0, 4].token == got[5, 9].token == "[PARTY_00001]" and got[0, 9].token == "[PARTY_00002]"
    assert [(b.x0, b.x1) for b in got[0, 9].boxes] == [(0.0, 24.0), (30.0, 54.0)] and got[0, 9].status == "confirmed_keep"


def test_remembered_terms_in_versions(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    row = lambda key, levels, s: ("o", key, "person_name", "*", levels, T + dt.timedelta(seconds=s))
    table = lambda *rows: spark.createDataFrame(list(rows), TERM)
    readers.remember_in(path, table(row("anna", ["b"], 1), row("anna", ["a", "b"], 2)))
    readers.remember_in(path, table(row("anna", ["c", "a"], 3), row("ben", [], 4)))
    got = {r.key: (r.levels, r["at"]) for r in versions.read(spark, path).collect()}
    assert got == {"anna": (["b", "a", "c"], T + dt.timedelta(seconds=3)), "ben": ([], T + dt.timedelta(seconds=4))} and versions.current(spark, path)["number"] == 1
    with pytest.raises(Exception, match="too many"):
        readers.remember_in(path, table(row("carl", ["a"], 5)), most=2)
    assert versions.read(spark, path).count() == 2  # a version that failed is none
    many = table(*[row("anna", ["b"], 0)] * 500)
    assert [r.levels for r in review.remember(many, table()).collect()] == [["b"]]


def test_usage_of_a_check(spark):
    outcomes = spark.createDataFrame([("d", 2), ("e", 1)], "doc_id string, batches int")
    used = spark.createDataFrame([("d", 0, 10, 1), ("d", 0, 5, 1), ("d", 1, 7, 2)], "doc_id string, batch int, input_tokens bigint, output_tokens bigint")
    got = {r.doc_id: (r.input_tokens, r.output_tokens, r.asked_twice) for r in context_check.usage(outcomes, used).collect()}
    assert got == {"d": (22, 4, 1), "e": (0, 0, 0)}

"""Uploads with their limits, and saved runs that are replayed as a whole."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import export
from cloakframe.sources import readers, replays, uploads, versions


def line(text, y=0.0):
    return [[c, 6.0 * i, y, 6.0 * i + 6, y + 10] for i, c in enumerate(text)]


def page(*lines, width=595, height=842, **more):
    return {"width": width, "height": height, "lines": [line(t, 12.0 * k) for k, t in enumerate(lines)], **more}


def test_every_file_is_a_row(spark, tmp_path):
    put = lambda name, doc: (tmp_path / name).write_bytes(doc if isinstance(doc, bytes) else json.dumps(doc).encode())
    (tmp_path / "sub").mkdir()
    put("a.json", {"metadata": {"title": "T"}, "attachments": 1, "pages": [page("Hé 😀", "b"), page(images=2)]})
    put("big.json", b"{" + b" " * 5000 + b"}")
    put("none.json", {"pages": []})
    put("many.json", {"pages": [page("x")] * 4})
    put("wide.json", {"pages": [page("x", width=1501)]})
    put("long.json", {"pages": [page("y" * 60)]})
    put("locked.json", {"locked": True, "pages": [page("x")]})
    put("sub/words.txt", b"just words")
    put("empty", b"")
    put("broken.json", b'{"pages": [')
    put("odd.json", {"pages": [{"width": 1, "height": 1, "lines": [[["ab", 0, 0, 1, 1]]]}]})
    put("short.json", {"pages": [{"width": 1, "height": 1, "lines": [[["a", 0, 0]]]}]})
    put("x.pdf", b"%PDF-1.4 nothing")
    limits = uploads.Limits(file_bytes=4000, pages=3, characters=50)
    got = uploads.uploads(spark, f"file://{tmp_path}", limits)
    rows = {r.filename: r for r in got.collect()}
    pdf = {"no_pdf_reader", "damaged"}
    assert {k: r.outcome for k, r in rows.items() if k != "x.pdf"} == {
        "a.json": "kept", "big.json": "too_large", "none.json": "page_count", "many.json": "page_count", "wide.json": "page_size", "long.json": "too_many_characters",
        "locked.json": "locked", "words.txt": "not_a_document", "empty": "not_a_document", "broken.json": "damaged", "odd.json": "damaged", "short.json": "damaged",
    } and rows["x.pdf"].outcome in pdf and len(rows) == 13
    kept = rows["a.json"]
    assert kept.metadata == {"title": "T"} and len(kept.warnings) == 3 and kept.sha256 == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    assert rows["big.json"].pages is None and rows["big.json"].bytes == 5002
    pages = uploads.pages_of_uploads(got).orderBy("page").collect()
    assert [(r.page, r.text, r.readable) for r in pages] == [(1, "Hé 😀\nb\n", True), (2, "", False)]
    chars = uploads.characters_of_uploads(got).orderBy("page", "pos").collect()
    assert "".join(r.char for r in chars) == "Hé 😀\nb\n" and [r.line for r in chars] == [0, 0, 0, 0, 0, 1, 1]
    assert chars[3].x0 == 18.0 and chars[4].x0 is None and [r.pos for r in chars] == list(range(7))
    assert [r.doc_id for r in uploads.uploads(spark, f"file://{tmp_path}", limits, "a.json").collect()] == [kept.doc_id]


def test_an_upload_goes_through_to_its_export(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pages": [page("Mail a@b.ch now")]}))
    files = uploads.uploads(spark, f"file://{tmp_path}")
    pages = uploads.pages_of_uploads(files)
    from cloakframe.operators import spans

    found = spans.detect(pages, ["contacts"]).withColumn("finding_id", F.lit("f"))
    got = export.original_layout(uploads.characters_of_uploads(files), pages.select("doc_id", "page", "width", "height"), found).orderBy("ord").collect()
    assert [(r.kind, r.text) for r in got] == [("page", None), ("fill", None), ("text", "Mail "), ("text", " now"), ("swatch", None), ("legend", "Contact")]


def saved_run(texts, spans_, **more):
    return {"schema_version": 1, "pdf_path": "a.pdf", "pdf_sha256": "h", "pages": [{"text_sha256": hashlib.sha256(t.encode()).hexdigest(), "spans": [{"label": "private_person", "start": a, "end": b, "text": x} for a, b, x in s]} for t, s in zip(texts, spans_)], **more}


def test_a_saved_run_is_replayed_whole_or_not_at_all(spark, tmp_path):
    texts = ["Anna lives", "So does Ben"]
    good = [[(0, 4, "Anna")], [(8, 11, "Ben")]]
    runs = {
        "ok": saved_run(texts, good), "wrong_version": saved_run(texts, good, schema_version=2), "outside": saved_run(texts, good, pdf_path="../a.pdf"), "no_file": saved_run(texts, good, pdf_path="z.pdf"),
        "file_changed": saved_run(texts, good, pdf_sha256="other"), "page_count": saved_run(texts[:1], good[:1]), "page_changed": saved_run([texts[0], "So did Ben"], good), "span_outside": saved_run(texts, [good[0], [(8, 12, "Ben")]]),
    }
    (tmp_path / "runs").mkdir()
    for k, r in runs.items():
        (tmp_path / "runs" / f"{k}.json").write_text(json.dumps(r))
    saved = spark.read.schema(readers.SAVED).option("multiLine", True).json(f"file://{tmp_path}/runs").withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    files = spark.createDataFrame([("/data/a.pdf", "d", "h")], "path string, doc_id string, sha256 string")
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page int, text string")
    asked = spark.createDataFrame([(k,) for k in [*runs, "not_listed"]], "run string")
    got = replays.judged(asked, saved, files, pages, "/data")
    assert {r.run: r.outcome for r in got.collect()} == {k: k for k in [*runs, "not_listed"]}
    path = f"file://{tmp_path}/out"
    replays.replay_whole(asked.filter("run = 'ok'"), saved, files, pages, "/data", path)
    assert sorted((r.page, r.text) for r in versions.read(spark, path).collect()) == [(1, "Anna"), (2, "Ben")]
    for k in runs.keys() - {"ok"}:
        with pytest.raises(replays.ReplayRefused, match=k):
            replays.replay_whole(asked.filter(F.col("run").isin("ok", k)), saved, files, pages, "/data", path)
    assert versions.current(spark, path)["number"] == 0  # one bad page, no rows

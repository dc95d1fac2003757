"""Exports as tables against brute force: no character of what is hidden is left, and all others are."""

import html
import random

from pyspark.sql import functions as F

from cloakframe.functions import fixed
from cloakframe.operators import export, grid


def test_lines_break_between_words(spark):
    width = 5 * 556
    for text in ("", "a", "a  b\n\n c\r\nddddddddddddddd e", "WWWWWWWWWW i i i i i i", "é" * 30 + " x", "日本語日本語", "\n"):
        lines = list(export.wrapped(text, width))
        wide = lambda s: sum(map(export.char_width, s))
        hards = text.splitlines()
        assert sorted({h for h, _ in lines}) == list(range(len(hards)))
        for h, line in enumerate(hards):
            own = [x for k, x in lines if k == h]
            assert "".join(own).replace(" ", "") == "".join(line.split())
            assert all(wide(x) <= width for x in own if len(x) > 1)
            for a, b in zip(own, own[1:]):  # greedy: the next word, or the next character of a long one, had no room
                word = b.split(" ")[0]
                assert wide(a) + 278 + wide(word) > width or wide(a) + wide(word[0]) > width


def test_pages_and_lines_as_rows(spark):
    text = "\n".join(f"line {i} <b>" for i in range(120))
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, None), ("e", 1, "a & 'b'\n\nc")], "doc_id string, page int, text string")
    got = export.reflow(pages).orderBy("doc_id", "page", "sheet", "line").collect()
    first = [r for r in got if (r.doc_id, r.page) == ("d", 1)]
    assert [(r.sheet, r.line) for r in first] == [(i // 57 + 1, i % 57 + 1) for i in range(120)]
    assert [r.html for r in first] == [html.escape(f"line {i} <b>") for i in range(120)]
    assert [(r.sheet, r.line, r.html) for r in got if r.page == 2] == [(1, 1, "")]
    assert [r.html for r in got if r.doc_id == "e"] == ["a &amp; &#x27;b&#x27;", "", "c"]
    assert export.reflow(pages.limit(0)).collect() == []


def page_of(text, columns=10, step=6.0):
    """Characters in rows of `columns`; line ends have no box."""
    out, line, x = [], 0, 0
    for i, c in enumerate(text):
        if c == "\n" or x == columns:
            line, x = line + 1, 0
        if c == "\n":
            out.append((i, c, line - 1, None, None, None, None))
            continue
        out.append((i, c, line, 10 + step * x, 10 + 12.0 * line, 10 + step * (x + 1), 20 + 12.0 * line))
        x += 1
    return out


CHARS = "doc_id string, page int, pos int, char string, line int, x0 double, y0 double, x1 double, y1 double"


def draw(spark, texts, found, labels=None, sizes=(400, 300)):
    chars = spark.createDataFrame([("d", k, *c) for k, t in texts.items() for c in page_of(t)], CHARS)
    size = spark.createDataFrame([("d", k, *sizes) for k in texts], "doc_id string, page int, width int, height int")
    f = spark.createDataFrame([("d", p, a, b, kind, f"{p}-{a}-{b}-{kind}") for p, a, b, kind in found], "doc_id string, page int, start int, end int, field_type string, finding_id string")
    l = None if labels is None else spark.createDataFrame([("d", *x) for x in labels], "doc_id string, page int, start int, end int, label string")
    return export.original_layout(chars, size, f, l).orderBy("page", "ord").collect()


def test_nothing_hidden_is_drawn_and_all_else_is(spark):
    rnd = random.Random(5)
    texts = {k: "".join(rnd.choice("abcdefgh  \n") for _ in range(90)) for k in range(1, 6)}
    found = [(k, s, min(90, s + rnd.randrange(1, 14)), rnd.choice(["date", "person_name", "email", "zz"])) for k in texts for s in (rnd.randrange(90) for _ in range(4))]
    found = [f for f in set(found) if f[0] != 5]
    got = draw(spark, texts, found)
    for k, text in texts.items():
        mine = [r for r in got if r.page == k]
        chars = page_of(text)
        fills = [(r.x0, r.y0, r.x1, r.y1) for r in mine if r.kind == "fill"]
        hidden = {i for p, a, b, _ in found if p == k for i in range(a, b)}
        for i, c, _, x0, y0, x1, y1 in chars:
            if i in hidden and x0 is not None and not c.isspace():
                assert any(a <= x0 and x1 <= d and b <= y0 and y1 <= e for a, b, d, e in fills)  # each hidden character is under a fill
        drawn = "".join(r.text for r in mine if r.kind == "text")
        kept = [c for i, c, _, x0, y0, x1, y1 in chars if x0 is not None and not c.isspace() and i not in hidden and not any(x0 < d and a < x1 and y0 < e and b < y1 for a, b, d, e in fills)]
        assert sorted(drawn.replace(" ", "")) == sorted(kept)
        for r in mine:
            if r.kind == "text":  # a run's rectangle holds no fill
                assert not any(r.x0 < d and a < r.x1 and r.y0 < e and b < r.y1 for a, b, d, e in fills) or " " in r.text
        assert [r.ord for r in mine] == list(range(1, len(mine) + 1)) and mine[0].kind == "page"
    assert "".join(sorted("".join(r.text for r in got if r.page == 5 and r.kind == "text").replace(" ", ""))) == "".join(sorted(texts[5].replace(" ", "").replace("\n", "")))


def test_labels_and_legend(spark):
    got = draw(spark, {1: "abcdefghijklmnop"}, [(1, 8, 12, "person_name"), (1, 8, 12, "date"), (1, 14, 15, "nothing known")], [(1, 8, 12, "[PARTY_00001]"), (1, 14, 15, "")], sizes=(280, 100))
    at = [(r.kind, r.text, r.x0, r.y0) for r in got]
    assert ("label", "[PARTY_00001]", 58.0, 10.0) in at and [r.text for r in got if r.kind == "text"] == ["abcdefgh", "mn", "p"]
    assert [(r.text, r.x0, r.y0) for r in got if r.kind == "legend"] == [("Party", 26.0, 112.0), ("Date", 161.0, 112.0), ("Other", 26.0, 128.0)]
    assert got[0].y1 == 100 + 18 + 16 * 2 and {r.colour for r in got if r.kind == "swatch"} == {fixed.CATEGORY_COLOUR[c] for c in ("Party", "Date", "Other")}
    assert draw(spark, {1: "ab"}, [(1, 0, 0, "date")])[0].y1 == 300  # no legend without a fill


def test_boxes_that_touch(spark):
    rnd = random.Random(8)
    box = lambda w: (lambda x, y: (x, y, x + rnd.uniform(0, w), y + rnd.uniform(0, w)))(rnd.uniform(0, 500), rnd.uniform(0, 500))
    small = [(rnd.choice("ab"), i, *box(rnd.choice([0, 8, 8, 400]))) for i in range(200)] + [("a", 900, 0.0, 0.0, 1e9, 1e9), ("a", 901, None, 0.0, 1.0, 1.0)]
    large = [(rnd.choice("ab"), *box(rnd.choice([0, 5, 60, 500]))) for _ in range(60)]
    s = spark.createDataFrame(small, "k string, i int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(large, "k string, x0 double, y0 double, x1 double, y1 double")
    real = lambda a, b_, c, d: None not in (a, b_, c, d) and c > a and d > b_
    want = sorted(i for k, i, *r in small if real(*r) and any(k == q and real(*t) and r[0] < t[2] and t[0] < r[2] and r[1] < t[3] and t[1] < r[3] for q, *t in large))
    assert sorted(r.i for r in grid.touching(s, b, ["k"]).collect()) == want and 900 in want
    assert grid.touching(s, b.filter(F.lit(False)), ["k"]).collect() == []


def test_layouts_move_lines_not_characters(spark):
    """The query lays out lines of characters, and the operator gathers characters into lines before they meet anything (F8)."""
    from cloakframe.plans import queries

    sf = "/root/testdata/sf0.001"
    lines, sizes, found = queries._layout(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("length(text) > 0")
    assert lines.count() <= turns.selectExpr("sum((length(text) - 1) div 80 + 1)").first()[0]
    chars = lines.select("doc_id", "page", "line", F.explode(F.arrays_zip("pos", "char", "x0", "y0", "x1", "y1")).alias("c")).select("doc_id", "page", "line", "c.*")
    labels = found.select("doc_id", "page", "start", "end", "label")
    one, other = export.original_layout(chars, sizes, found, labels), export.layout_of_lines(lines, sizes, found, labels)
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0 < one.count()


def test_flat_boxes_meet_small_ones_as_pairs(spark):
    rnd = random.Random(8)
    flat = [("k", i, x := rnd.uniform(0, 500), y := rnd.uniform(0, 500), x + rnd.choice([3.0, 480.0, 9000.0]), y + 10.0) for i in range(60)]
    box = [("k", x := rnd.uniform(0, 900), y := rnd.uniform(0, 500), x + rnd.choice([0.0, 7.0, 300.0]), y + 10.0) for _ in range(60)]
    s = spark.createDataFrame(flat, "k string, i int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(box, "k string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.i, r.g_x0, r.g_y0, r.g_x1, r.g_y1) for r in grid.touching(s, b, ["k"], pairs=True).collect()]
    want = [(f[1], *g[1:]) for f in flat for g in box if g[3] > g[1] and f[2] < g[3] and g[1] < f[4] and f[3] < g[4] and g[2] < f[5]]
    assert sorted(got) == sorted(want) and want

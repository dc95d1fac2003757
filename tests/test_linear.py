"""The grid and the folds against brute force, and a page of 100,000 spans in seconds."""

import random
import time

from pyspark.sql import functions as F

from cloakframe.operators import grid, layout, review, spans
from cloakframe.plans.queries import QUERIES

SPAN = "doc_id string, page int, start int, end int, ord int"


def some_spans(rnd, n, most=60):
    return [(rnd.choice("ab"), 1, s, s + rnd.randrange(0, 9), i) for i, s in enumerate(rnd.randrange(most) for _ in range(n))]


def test_points_in_boxes(spark):
    rnd = random.Random(6)
    odd = [None, float("nan"), float("inf"), -5.0, 1e9]
    num = lambda p: rnd.choice(odd) if rnd.random() < 0.04 else round(rnd.uniform(0, p), 1)
    boxes = []
    for i in range(150):
        x, y = num(600), num(800)
        w, h = rnd.choice([(0, 0), (5, 5), (700, 900), (40, 3), (-1, 2), (-9, -9), (1e7, 1e7)])
        boxes.append((rnd.choice("ab"), i, x, y, None if x is None else x + w, None if y is None else y + h))
    points = [(rnd.choice("abc"), i, num(600), num(800)) for i in range(400)]
    p = spark.createDataFrame(points, "k string, i int, x double, y double")
    b = spark.createDataFrame(boxes, "k string, j int, x0 double, y0 double, x1 double, y1 double")
    ok = lambda *v: all(x is not None and x == x and abs(x) < 1e15 for x in v)
    want = sorted((i, j) for k, i, x, y in points for k2, j, a, c, d, e in boxes if k == k2 and ok(x, y, a, c, d, e) and a - 1 <= x <= d + 1 and c - 1 <= y <= e + 1)
    assert sorted((r.i, r.j) for r in grid.in_boxes(p, b, ["k"], 1.0).collect()) == want and want
    assert grid.in_boxes(p, b.limit(0), ["k"]).collect() == []


def test_a_character_meets_few_regions(spark):
    """A page of 10,000 characters and 1,000 lines as regions: a few pairs a character, not a thousand."""
    chars = spark.range(10_000).selectExpr("concat('d', id % 1) AS doc_id", "cast(1 + id % 1 as int) AS page", "cast(id as int) AS pos", "cast(id % 100 * 6 as double) AS x", "cast(floor(id / 100) * 10 as double) AS y")
    regions = spark.range(1000).selectExpr("concat('d', id % 1) AS doc_id", "cast(1 + id % 1 as int) AS page", "concat('r', id) AS region", "'text' AS label", "cast(id % 10 * 60 as double) - 2 AS x0", "cast(floor(id / 10) * 10 as double) - 3 AS y0", "cast(id % 10 * 60 as double) + 56 AS x1", "cast(floor(id / 10) * 10 as double) + 3 AS y1")
    cells = grid.in_boxes(chars, regions, ["doc_id", "page"], 1.0)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "g_cx" in plan
    got = layout.owners(chars, regions).collect()
    assert all(r.owner == f"r{r.pos // 100 * 10 + r.pos % 100 // 10}" and r.run is None for r in got) and len(got) == 10_000


def test_folds_against_brute_force(spark):
    rnd = random.Random(1)
    for n in (1, 40, 90):
        rows = some_spans(rnd, n)
        df = spark.createDataFrame(rows, SPAN)
        kept = {}
        for k, _, s, e, o in sorted(rows, key=lambda r: (r[2] - r[3], r[2], r[4])):
            if all(not (s < y and e > x) for x, y, _ in kept.setdefault(k, [])):
                kept[k].append((s, e, o))
        assert sorted((r.doc_id, r.start, r.end, r.ord) for r in spans.longest_first(df).collect()) == sorted((k, *x) for k, v in kept.items() for x in v)
        holes = spark.createDataFrame([(k, 1, s, e) for k, _, s, e, _ in some_spans(rnd, 12)], "doc_id string, page int, o_start int, o_end int")
        cut = [(r.doc_id, r.o_start, r.o_end) for r in holes.collect()]
        want = []
        for k, _, s, e, o in rows:
            free = [i for i in range(s, e) if not any(k == d and a <= i < b for d, a, b in cut)]
            # An empty hole inside a span parts it, too.
            at = sorted({a for d, a, b in cut if d == k and a == b})
            for i in free:
                if i - 1 not in free or i in at and i > s:
                    want.append([k, i, i + 1, o])
                else:
                    want[-1][2] = i + 1
        assert sorted((r.doc_id, r.start, r.end, r.ord) for r in spans.subtract(df, holes).collect()) == sorted(map(tuple, want))


def test_the_plain_export_s_merge(spark):
    rnd = random.Random(2)
    for _ in range(4):
        rows = [(k, 1, s, e, rnd.choice(["x", "y", None]), rnd.choice(["[A]", "[B]", None])) for k, _, s, e, _ in some_spans(rnd, 40, 90) if s < e]
        df = spark.createDataFrame(rows, "doc_id string, page int, start int, end int, entity_id string, replacement string")
        want = []
        low = lambda x: (x is not None, x or "")
        for k in "ab":
            own = []
            for _, _, s, e, ent, rep in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], -r[3], low(r[4]), r[5] or "[REDACTED]")):
                if own and s < own[-1][1]:
                    if ent is None or own[-1][3] != ent:
                        own[-1][2] = "[REDACTED]"
                    own[-1][1] = max(own[-1][1], e)
                else:
                    own.append([s, e, rep or "[REDACTED]", ent])
            want += [(k, a, b, r) for a, b, r, _ in own]
        assert sorted((r.doc_id, r.start, r.end, r.label) for r in spans.fold_export(df).collect()) == sorted(want)


def test_redaction_by_code_points(spark):
    pages = spark.createDataFrame([("d", 1, "é😀 ab cd"), ("d", 2, None), ("e", 1, "same")], "doc_id string, page int, text string")
    put = spark.createDataFrame([("d", 1, 3, 5, "[X]"), ("d", 1, 0, 2, None), ("d", 1, 8, 8, "!"), ("d", 2, 0, 1, "[Y]")], "doc_id string, page int, start int, end int, label string")
    assert {(r.doc_id, r.page): r.text for r in spans.redact(pages, put).collect()} == {("d", 1): "[REDACTED] [X] cd!", ("d", 2): None, ("e", 1): "same"}


def test_a_page_of_100_000_spans_takes_seconds(spark):
    df = spark.range(100_000).selectExpr("'d' AS doc_id", "1 AS page", "cast(id * 7 % 900001 as int) AS start", "cast(id * 7 % 900001 + 1 + id % 13 as int) AS end", "cast(id as int) AS ord", "cast(id % 5 as string) AS entity_id", "'[A]' AS replacement", "'[A]' AS label", "cast(1 + id % 4000 as bigint) AS size")
    spans.longest_first(df.limit(10)).collect()
    page = spark.createDataFrame([("d", 1, "x" * 1_000_000)], "doc_id string, page int, text string")
    start = time.time()
    assert spans.longest_first(df).count() > 1000 and spans.fold_export(df).count() > 1000
    kept = spans.longest_first(df).withColumn("label", F.lit("[L]"))
    assert spans.redact(page, kept).select(F.length("text")).first()[0] > 500_000
    assert review.pack(df.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "size")).agg(F.max("batch")).first()[0] > 1000
    assert time.time() - start < 60


def test_page_ranges_of_a_long_text_take_one_pass(spark):
    text = "abcdef " * 40_000 + "ab-\xad  cdxef"
    at = [i for i in range(len(text)) if i % 7 != 6 or i > 279_990]
    rows = [("long", 0, len(at), at, text), ("part", 1, 5, [0, 2, 5, 6, 9, 10], "a-b  cd- ex"), ("other", 0, 3, [0, 2, 4], "a.b-c"), ("none", 2, 2, [0, 1, 2], "abc"), ("bare", 0, 2, [0, 5], None)]
    df = spark.createDataFrame(rows, "id string, start int, end int, offsets array<int>, page_text string")
    start = time.time()
    got = sorted((r.id, r.start, r.end) for r in layout.page_ranges(df).collect())
    assert time.time() - start < 20
    assert got == [("bare", 0, 6), ("long", 0, len(text)), ("other", 0, 1), ("other", 2, 5), ("part", 2, 10)]


def test_paragraphs_carry_no_text_with_each_character(spark):
    p = QUERIES["paragraph_texts"](spark, "/root/testdata/sf0.001")
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

"""Exports as tables: text laid out anew on pages, and the original layout with what is hidden cut out of it, as draw commands."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..sources.tables import written
from . import grid, spans

_ASCII = [int(x) for x in fixed.HELVETICA.split()]


@lru_cache(maxsize=1 << 16)
def char_width(c: str) -> int:
    """In thousandths of the font's size: a letter with accents is as wide as without, East Asian wide ones are 1000."""
    if " " <= c <= "~":
        return _ASCII[ord(c) - 32]
    if unicodedata.combining(c):
        return 0
    if unicodedata.east_asian_width(c) in "WF":
        return 1000
    base = unicodedata.normalize("NFKD", c)[:1]
    return _ASCII[ord(base) - 32] if " " <= base <= "~" else 556


def wrapped(text: str, width: int) -> Iterator[tuple[int, str]]:
    """(hard line from 0, line) of a text: words, one blank apart, as many to a line as its width in thousandths takes.

    A hard line without words is an empty line; a word wider than a line is cut where it no longer fits.
    """
    for hard, line in enumerate(text.splitlines()):
        now, used = "", 0
        for word in line.split():
            need = sum(map(char_width, word))
            if now and used + _ASCII[0] + need <= width:
                now, used = f"{now} {word}", used + _ASCII[0] + need
                continue
            if now:
                yield hard, now
            now, used = "", 0
            for c in word if need > width else ():
                if now and used + char_width(c) > width:
                    yield hard, now
                    now, used = "", 0
                now, used = now + c, used + char_width(c)
            if need <= width:
                now, used = word, need
        yield hard, now


def reflow(pages: DataFrame, width: float = fixed.PAGE_WIDTH - 2 * fixed.PAGE_MARGIN, height: float = fixed.PAGE_HEIGHT - 2 * fixed.PAGE_MARGIN, size: float = fixed.FONT_SIZE) -> DataFrame:
    """Lines of (doc_id, page, text) on new pages: doc_id, page, sheet (from 1 within the page), line (from 1 on the sheet), hard, html.

    Nothing of an original file is in it: html is the line's text, escaped. Each page begins a new sheet, also one that is
    empty or null, which has one empty line. Lines break between words at `width` points of the font's `size`.
    """
    most = int(width * 1000 / size)
    rows = max(1, int(height / (size * fixed.LINE_HEIGHT)))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            docs, out = [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                lines = [(n, *x) for n, x in enumerate(wrapped(text or "", most))] or [(0, 0, "")]
                docs += [k] * len(lines)
                out += lines
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.string())))], names=["doc_id", "page", "n", "hard", "text"])

    lines = pages.select("doc_id", "page", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, n int, hard int, text string")
    return lines.select("doc_id", "page", F.expr(f"cast(n div {rows} + 1 as int)").alias("sheet"), (F.col("n") % rows + 1).alias("line"), "hard", exprs.html_escaped(F.col("text")).alias("html"))


def _colour(category: Column) -> Column:
    return exprs.mapped(fixed.CATEGORY_COLOUR, category)


_BOX = ["x0", "y0", "x1", "y1"]


def lines_of(chars: DataFrame) -> DataFrame:
    """Characters (as original_layout() takes them) line by line: doc_id, page, line and arrays pos, char, x0, y0, x1, y1 in order of pos."""
    names = ["pos", "char", *_BOX]
    g = chars.filter(F.col("x0").isNotNull()).groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("c"))
    return g.select("doc_id", "page", "line", *[F.col(f"c.{n}").alias(n) for n in names])


def original_layout(chars: DataFrame, sizes: DataFrame, selected: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Draw commands of pages in their own layout, without what is selected: doc_id, page, ord, kind, text, colour, x0, y0, x1, y1.

    chars: doc_id, page, pos, char, line, x0, y0, x1, y1 (no box: a line's end); sizes: doc_id, page, width, height; selected:
    doc_id, page, start, end, field_type, finding_id; labels: doc_id, page, start, end, label of islands, as spans.islands()
    and number_tokens() give them (an empty label draws nothing).

    kind page: the sheet, taller than the page by the legend; fill: a rectangle of a finding on a line, in its category's
    colour; text: what is left of a line between two hidden places, never a character of a finding or one whose box a
    fill touches; label: an island's label in its first line's rectangle; swatch and legend: the page's categories, in columns.
    Fills come first, then text and labels from top to bottom, then the legend. Pages without findings keep all their text.
    """
    return layout_of_lines(lines_of(chars), sizes, selected, labels)


def layout_of_lines(lines: DataFrame, sizes: DataFrame, selected: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """original_layout() of characters that come line by line, as lines_of() gives them.

    Characters move as whole lines, twice: to the findings on their line, and to these and the rectangles that touch it.
    """
    key = ["doc_id", "page"]
    lines = written(lines)  # used several times below
    every = F.arrays_zip("pos", "char", *_BOX)
    least, most = (lambda of, n: F.array_min(F.transform(of, lambda c: c[n]))), (lambda of, n: F.array_max(F.transform(of, lambda c: c[n])))
    around = lambda of: [f(of, n).alias(n) for f, n in zip((least, least, most, most), _BOX)]

    def beside(left: DataFrame, per_line: DataFrame, how: str) -> DataFrame:
        r = per_line.withColumnsRenamed({c: f"r_{c}" for c in (*key, "line")})
        on = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & F.col("line").eqNullSafe(F.col("r_line"))
        return left.join(r, on, how).drop("r_doc_id", "r_page", "r_line")

    none = F.lit(None).cast("string")
    s = selected.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), exprs.redaction_category(F.col("field_type")).alias("category"), F.col("finding_id").cast("string").alias("finding_id"), none.alias("label"))
    if labels is not None:
        s = s.unionByName(labels.filter(F.length("label") > 0).select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), none.alias("category"), none.alias("finding_id"), "label"))
    extent = lines.select(*key, "line", F.array_min("pos").alias("start"), (F.array_max("pos") + 1).alias("end"))
    on_line = spans.overlap_join(extent, s, "inner", inside=False).groupBy(*key, "line").agg(F.collect_list(F.struct("o_start", "o_end", "category", "finding_id", "label")).alias("found"))
    on_line = written(on_line)
    within = lambda c, f: (c["pos"] >= f["o_start"]) & (c["pos"] < f["o_end"])
    m = beside(lines, on_line, "inner").select(*key, "line", every.alias("every"), F.explode("found").alias("f"))
    m = m.select(*key, "line", "f", F.filter("every", lambda c: within(c, F.col("f")) & ~exprs.blank(c["char"])).alias("own")).filter(F.size("own") > 0).select(*key, "line", "f", *around(F.col("own")))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    of_label = F.col("f.label").isNotNull()
    # A finding's places on a line are one rectangle; an island's are its own.
    m = written(m.groupBy(*key, "line", "f.finding_id", "f.category", "f.label", F.when(of_label, F.col("f.o_start")).alias("o_start"), F.when(of_label, F.col("f.o_end")).alias("o_end")).agg(*box))
    fills = m.filter("label is null").drop("label", "o_start", "o_end")
    # A character goes if it is a finding's own, or if a rectangle around a finding's line touches its box.
    real = lambda c: (F.abs(c["x0"]) < 1e15) & (F.abs(c["y0"]) < 1e15) & (F.abs(c["x1"]) < 1e15) & (F.abs(c["y1"]) < 1e15) & (c["x1"] > c["x0"]) & (c["y1"] > c["y0"])
    outline = lines.select(*key, "line", F.filter(every, real).alias("real")).select(*key, "line", *around(F.col("real")))
    near = grid.touching(outline, fills.select(*key, *_BOX), key, pairs=True)
    near = near.groupBy(*key, "line").agg(F.collect_set(F.struct("g_x0", "g_y0", "g_x1", "g_y1")).alias("near"))
    share = lambda c, g: (c["x0"] < g["g_x1"]) & (g["g_x0"] < c["x1"]) & (c["y0"] < g["g_y1"]) & (g["g_y0"] < c["y1"])
    hidden = lambda c: (F.exists("hides", lambda f: within(c, f)) | (F.exists("touch", lambda g: share(c, g)) & real(c))) & ~exprs.blank(c["char"])
    j = beside(beside(lines, on_line, "left"), near, "left").select(*key, "line", every.alias("every"), F.filter(F.coalesce("found", F.array().cast(on_line.schema["found"].dataType)), lambda f: f["label"].isNull()).alias("hides"), F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("touch"))
    left = j.select(*key, "line", F.filter("every", lambda c: ~F.coalesce(hidden(c), F.lit(False))).alias("left")).filter(F.size("left") > 0)
    # Runs begin where places are left out; each goes up to the next one's beginning.
    left = left.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("left") - 1), lambda i: (i == 0) | (F.get("left", i)["pos"] - F.get("left", i - 1)["pos"] > 1)))
    runs = left.select(*key, "line", F.explode(F.transform("begins", lambda b, i: F.slice("left", b + 1, F.coalesce(F.get("begins", i + 1), F.size("left")) - b))).alias("run"))
    runs = runs.select(*key, "line", F.array_join(F.transform("run", lambda c: c["char"]), "").alias("text"), *around(F.col("run"))).filter(~exprs.blank(F.col("text")))
    place = [F.col(c).cast("double").alias(c) for c in _BOX]
    out = [
        fills.select(*key, F.lit(1).alias("part"), F.lit("fill").alias("kind"), none.alias("text"), _colour(F.col("category")).alias("colour"), *place),
        runs.select(*key, F.lit(2).alias("part"), F.lit("text").alias("kind"), "text", none.alias("colour"), *place),
    ]
    if labels is not None:
        first = m.filter("label is not null").groupBy(*key, "o_start", "o_end", "label").agg(F.min(F.struct("line", *_BOX)).alias("b"))
        out.append(first.select(*key, F.lit(2).alias("part"), F.lit("label").alias("kind"), F.col("label").alias("text"), none.alias("colour"), *[F.col(f"b.{c}").cast("double").alias(c) for c in _BOX]))
    names = F.array(*[F.lit(c) for c in fixed.CATEGORY_COLOUR])
    shown = fills.groupBy(*key).agg(F.collect_set("category").alias("has")).select(*key, F.filter(names, lambda c: F.array_contains("has", c)).alias("shown"))
    p = sizes.join(shown, key, "left").withColumn("columns", F.greatest(F.lit(1), F.floor(F.col("width") / fixed.LEGEND_COLUMN).cast("int")))
    count = F.coalesce(F.size("shown"), F.lit(0))
    footer = F.when(count > 0, 18 + fixed.LEGEND_ROW * F.ceil(count / F.col("columns"))).otherwise(0)
    out.append(p.select(*key, F.lit(0).alias("part"), F.lit("page").alias("kind"), none.alias("text"), none.alias("colour"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), (F.col("height") + footer).cast("double").alias("y1")))
    each = p.select(*key, "height", "columns", F.posexplode("shown").alias("i", "category"))
    x, y = fixed.LEGEND_MARGIN + F.col("i") % F.col("columns") * fixed.LEGEND_COLUMN, F.col("height") + fixed.LEGEND_MARGIN + F.floor(F.col("i") / F.col("columns")) * fixed.LEGEND_ROW
    each = each.withColumns({"x": x.cast("double"), "y": y.cast("double")})
    b = fixed.LEGEND_BOX
    out.append(each.select(*key, F.lit(3).alias("part"), F.lit("swatch").alias("kind"), none.alias("text"), _colour(F.col("category")).alias("colour"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + b).alias("x1"), (F.col("y") + b).alias("y1")))
    out.append(each.select(*key, F.lit(3).alias("part"), F.lit("legend").alias("kind"), F.col("category").alias("text"), none.alias("colour"), (F.col("x") + 14).alias("x0"), F.col("y").alias("y0"), (F.col("x") + fixed.LEGEND_COLUMN).alias("x1"), (F.col("y") + b).alias("y1")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy("part", F.round("y0", 1), "x0", "kind", "text", "x1", "y1"))).drop("part")

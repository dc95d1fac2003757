"""Uploads: files as documents of pages, characters with boxes and lines. A file that can't be taken is a row with the reason."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


@dataclass(frozen=True)
class Limits:
    """What an upload may have at most; a page's side in points."""

    file_bytes: int = fixed.MOST_BYTES
    pages: int = fixed.MOST_PAGES
    side: float = fixed.MOST_SIDE
    characters: int = fixed.MOST_CHARACTERS


class Refused(ValueError):
    """Why a file isn't taken, as one word."""


_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_PAGE = f"struct<page:int,width:double,height:double,readable:boolean,text:string,lines:array<int>,boxes:array<{_BOX}>>"
_TOLD = f"path string, sha256 string, outcome string, warnings array<string>, metadata map<string,string>, pages array<{_PAGE}>"


def _pdf(data: bytes) -> dict:
    """A PDF file as a page document, by pymupdf where that is installed."""
    try:
        import pymupdf
    except ImportError:
        raise Refused("no_pdf_reader") from None
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        pages = []
        for page in doc if not doc.needs_pass else ():
            page.set_rotation(0)
            lines = [[[c, *char["bbox"]] for span in line["spans"] for char in span["chars"] for c in char["c"]] for block in page.get_text("rawdict", sort=True)["blocks"] for line in block.get("lines", [])]
            pages.append({"width": page.rect.width, "height": page.rect.height, "images": len(page.get_images()), "notes": bool(page.first_annot or page.first_widget), "lines": lines})
        return {"locked": bool(doc.needs_pass), "metadata": {k: v for k, v in doc.metadata.items() if v}, "attachments": doc.embfile_count(), "pages": pages}


def taken(data: bytes, limits: Limits) -> tuple[list[str], dict, list[dict]]:
    """(warnings, metadata, pages) of a file's bytes, or Refused.

    A page document is JSON: locked, metadata, attachments, pages of width, height, images and lines, each a list of
    [character, x0, y0, x1, y1]. Each line's characters are followed by a line end without a box, with the line's number.
    """
    if data[:5] == b"%PDF-":
        doc = _pdf(data)
    elif data.lstrip()[:1] == b"{":
        doc = json.loads(data)
    else:
        raise Refused("not_a_document")
    if doc.get("locked"):
        raise Refused("locked")
    if not 1 <= len(doc["pages"]) <= limits.pages:
        raise Refused("page_count")
    pages, warnings, total = [], [], 0
    for number, page in enumerate(doc["pages"], 1):
        if max(page["width"], page["height"]) > limits.side:
            raise Refused("page_size")
        chars, boxes, lines = [], [], []
        for n, line in enumerate(page["lines"]):
            for c, *box in line:
                chars.append(c)
                boxes.append(dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)))
                lines.append(n)
            chars.append("\n")
            boxes.append(None)
            lines.append(n)
        if any(len(c) != 1 for c in chars):
            raise Refused("damaged")
        text = "".join(chars)
        total += len(text)
        readable = bool(text.strip())
        if not readable:
            warnings.append(f"Page {number} has no text that can be read; it can't be exported.")
        if page.get("images"):
            warnings.append(f"Page {number} has images; text in them isn't looked at.")
        pages.append({"page": number, "width": float(page["width"]), "height": float(page["height"]), "readable": readable, "text": text, "lines": lines, "boxes": boxes})
    if total > limits.characters:
        raise Refused("too_many_characters")
    if doc.get("attachments") or any(p.get("notes") for p in doc["pages"]):
        warnings.append("The file has attachments, notes or form fields; they are left out.")
    return warnings, {k: str(v) for k, v in (doc.get("metadata") or {}).items()}, pages


def uploads(spark: SparkSession, path: str, limits: Limits = Limits(), pattern: str = "*") -> DataFrame:
    """One row per file under path: path, doc_id, filename, bytes, sha256, outcome, warnings, metadata, pages.

    outcome is kept, or the reason: too_large, not_a_document, no_pdf_reader, locked, page_count, page_size,
    too_many_characters, damaged. Refused files have no pages. A file over the limit of bytes is never read. doc_id is
    made of path and content, so that reading again gives the same; filename is the path's end, cut to NAME_LENGTH.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for name, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                warnings, metadata, pages, outcome = [], {}, None, "kept"
                try:
                    warnings, metadata, pages = taken(data, limits)
                except Refused as e:
                    outcome = str(e)
                except Exception:  # whatever else is wrong with a file is its own fault
                    outcome = "damaged"
                row = {"path": name.as_py(), "sha256": hashlib.sha256(data).hexdigest(), "outcome": outcome, "warnings": warnings, "metadata": list(metadata.items()), "pages": pages}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_TOLD))
    size = files.select("path", F.col("length").alias("bytes"))
    # Spark's file sources list empty files but never read them: what the list has beyond the rows is empty.
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    size = size.unionByName(listed.join(size, "path", "left_anti").withColumn("bytes", F.lit(0).cast("bigint")))
    small = files.filter(F.col("length") <= limits.file_bytes)
    read = small.select("path", "content").mapInArrow(run, _TOLD).withColumnRenamed("path", "r_path")
    got = size.join(read, F.col("path") == F.col("r_path"), "left").drop("r_path")
    name = F.substring(F.element_at(F.split("path", "/"), -1), 1, fixed.NAME_LENGTH)
    ident = F.substring(F.sha2(F.concat_ws("|", "path", F.coalesce("sha256", F.lit(""))), 256), 1, 24)
    return got.select("path", ident.alias("doc_id"), name.alias("filename"), "bytes", "sha256", F.coalesce("outcome", F.when(F.col("bytes") == 0, "not_a_document").otherwise("too_large")).alias("outcome"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "metadata", "pages")


def pages_of_uploads(files: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, width, height, readable) of the kept files."""
    p = files.filter("outcome = 'kept'").select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", "p.page", "p.text", "p.width", "p.height", "p.readable")


def characters_of_uploads(files: DataFrame) -> DataFrame:
    """Characters (doc_id, page, pos, char, line, x0, y0, x1, y1) of the kept files; line ends have no box."""
    p = files.filter("outcome = 'kept'").select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", F.posexplode(F.arrays_zip(F.split("p.text", "").alias("char"), F.col("p.lines").alias("line"), F.col("p.boxes").alias("box"))).alias("pos", "c"))
    return p.filter(F.col("c.line").isNotNull()).select("doc_id", "page", "pos", "c.char", "c.line", "c.box.x0", "c.box.y0", "c.box.x1", "c.box.y1")

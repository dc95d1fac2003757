"""Fill-in-the-middle: a text's pieces, two of which cut it into prefix, middle and suffix, in the order a model is trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Pieces that a text is cut between.
UNITS = "[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle; a text with any of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that are changed, and of 100 changed ones those with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Code points that one call of the library splits, about: its list of offsets is far larger than the text.
STEP = 1 << 20

_MARKS = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
_NOT_LETTER = re.compile("[^A-Za-z]")


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated")


def _blocks(text: str, step: int) -> Iterator[tuple[int, int]]:
    """Parts of about `step` code points, each but the last ending with a character that is a unit of its own."""
    start = 0
    while len(text) - start > step:
        end = _NOT_LETTER.search(text, start + step - 1)
        if end is None:
            break
        yield start, end.end()
        start = end.end()
    yield start, len(text)


def cut_points(text: str, picks: tuple[int, int], step: int = STEP) -> tuple[int, int, int]:
    """(n, a, b): the units of a text, and the code points before its first k of them, for k either pick modulo n + 1, a <= b.

    The library's split gives each unit's offsets; a longer text is split block by block, first for the count, then, in
    the two blocks that hold the cuts, for the offsets, so that no list is longer than a block.
    """
    split = _splitter(UNITS).pre_tokenize_str
    if len(text) <= step:
        offsets = split(text)
        n = len(offsets)
        a, b = sorted(p % (n + 1) for p in picks)
        return n, (offsets[a][1][0] if a < n else len(text)), (offsets[b][1][0] if b < n else len(text))
    blocks = list(_blocks(text, step))
    counts = [len(split(text[i:j])) for i, j in blocks]
    n, places = sum(counts), []
    for k in sorted(p % (n + 1) for p in picks):
        place = len(text)
        for (i, j), m in zip(blocks, counts):
            if k < m:
                place = i + split(text[i:j])[k][1][0]
                break
            k -= m
        places.append(place)
    return n, places[0], places[1]


def transform(text: str, key: str, step: int = STEP) -> tuple[int, str, int | None, int | None, str]:
    """(n units, form, code points of the prefix, of the middle, output) of a text; the key's SHA-256 decides."""
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n, a, b = cut_points(text, (h1, h2), step)
    if not text or h3 % 100 >= CHANGED or _MARKS.search(text):
        return n, "plain", None, None, text
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restore(output: str, form: str) -> str:
    """The text behind an output. No mark overlaps itself and changed texts hold none, so each mark's first place is its own."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    middle = output.index(MIDDLE, at + len(second))
    one, two = output[len(first) : at], output[at + len(second) : middle]
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + output[middle + len(MIDDLE) :] + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", with_output: bool = True, step: int = STEP) -> DataFrame:
    """One row per row of docs: id_col, n, form, prefix_chars, middle_chars, output (if with_output), output_sha256, restored_sha256.

    The SHA-256 of "seed:id" picks the two cuts among the n + 1 places between units, whether a text is changed at all,
    and which part comes first; so reruns and repeated rows agree. Null and empty texts have no units and stay plain, as
    do texts that hold a mark; a null id counts as no digits. restored_sha256 is of the text rebuilt from output and form
    alone. Texts of any length are taken whole, and split in blocks. Other columns aren't read; no rows give no rows.

    One pass without a shuffle; a task holds one Arrow batch and one block's offsets, and is simply run again when lost.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", *(["output"] if with_output else []), "output_sha256", "restored_sha256"]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(*batch.columns):
                i = i.as_py()
                n, form, prefix, middle, output = transform(text.as_py() or "", f"{seed}:{'' if i is None else i}", step)
                rows.append((n, form, prefix, middle, *([output] if with_output else []), sha(output), sha(restore(output, form))))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] if with_output else []), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    schema = f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint" + (", output string" if with_output else "") + ", output_sha256 string, restored_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents cut, reordered and restored; see fill_in_middle()."""
    return fill_in_middle(table(spark, sf_dir, "documents"), with_output=False)


OP13_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '{UNITS}') as units from documents),
n as (select *, len(units)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {CHANGED} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(units[1:lo], '') as prefix, array_to_string(units[lo + 1:hi], '') as middle, array_to_string(units[hi + 1:n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

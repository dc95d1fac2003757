"""Column expressions: identities, checks, labels. All of it stays in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def mapped(values: dict, key: Column, default: Column | None = None) -> Column:
    """values[key], or the default."""
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return got if default is None else F.coalesce(got, default)


def blank(text: Column) -> Column:
    """White space of any kind alone, or nothing."""
    return text.rlike(r"(?U)\A\s*\z")


def casefolded(text: Column) -> Column:
    """Full case folding: STRASSE and Straße, ﬁ and FI, Σ and ς are equal.

    Upper case writes letters out in full, and lower case of that is the folded form, but for a dotless i, which stays, and
    for a sigma, which has one form wherever it stands: two private characters keep their places. Cherokee, which folds
    to capitals, stays in lower case.
    """
    got = F.translate(F.replace(text, F.lit("ẞ"), F.lit("ß")), "ı", "\ue000")
    return F.translate(F.lower(F.translate(F.upper(got), "Σ", "\ue001")), "\ue000\ue001", "ıσ")


#: The collation by which letters are equal whatever their case and accents.
LETTERS = "UNICODE_CI_AI"


def by_letters(text: Column) -> Column:
    """A text that compares, groups and joins by its letters alone, whatever their case and accents. Blanks and punctuation count."""
    return F.collate(text, LETTERS)


def token_key(text: Column) -> Column:
    """Equal for mentions that differ in case and white space alone."""
    return F.trim(F.regexp_replace(casefolded(text), r"(?U)\s+", " "))


def finding_id(doc: Column, page: Column, start: Column, end: Column, field_type: Column) -> Column:
    return F.substring(F.sha2(F.concat(doc.cast("string"), F.lit("|"), page.cast("string"), F.lit("|("), start.cast("string"), F.lit(", "), end.cast("string"), F.lit(", '"), field_type, F.lit("')")), 256), 1, 20)


def entity_id(doc: Column, field_type: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(doc.cast("string"), F.lit("|"), field_type, F.lit("|"), token_key(text)), 256), 1, 12)


def excerpts(text: Column, start: Column, end: Column, width: int = 110) -> tuple[Column, Column]:
    """What stands before and after a span, with white space collapsed."""
    lo = F.greatest(F.lit(0), start - width)
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    return squeeze(F.substring(text, lo + 1, start - lo)), squeeze(F.substring(text, end + 1, F.lit(width)))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def valid_span(text: Column, start: Column, end: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= F.length(text))


def account_ok(value: Column) -> Column:
    """Length 15 to 34 and remainder 1 by 97; folded digit by digit, so no number overflows."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(v, 5, 100), F.substring(v, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    return F.length(v).between(15, 34) & (rest == 1)


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution, or swap of neighbours."""
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    d = F.levenshtein(a, b, 2)
    return (d == 1) | ((d == 2) & (n == F.length(b)) & (n >= 2) & swap)


def birth_near(text: Column, start: Column, end: Column) -> Column:
    """A word of birth within 90 characters of the span."""
    lo = F.greatest(F.lit(0), start - 90)
    return F.lower(F.substring(text, lo + 1, end + 90 - lo)).rlike(fixed.BIRTH_NEAR)


def selected_by_default(field_type: Column, subcategory: Column, birth: Column) -> Column:
    """Dates only near a word of birth, case references only if internal, all else."""
    return F.when(field_type == "date", birth).when(field_type == "case_reference", F.coalesce(subcategory == "internal_file", F.lit(False))).otherwise(F.lit(True))


def suggestion(field_type: Column, birth: Column, role: Column, goal: Column, retain: Column) -> Column:
    """keep, remove or review. The date rule has the last word on dates, whatever was asked to be kept."""
    asked = F.lower(F.concat_ws(" ", goal, retain))
    kind = ((field_type == "date") & asked.rlike(fixed.KEEP_DATE)) | ((field_type == "amount") & asked.rlike(fixed.KEEP_AMOUNT))
    keep = F.array_contains(retain, field_type) | (F.lower(role).rlike(fixed.TRANSLATOR) & asked.rlike(fixed.KEEP_VERBS) & kind)
    return F.when(field_type == "date", F.when(birth, "remove").otherwise("keep")).when(keep, "keep").otherwise("review")


def levels_kept(levels: Column) -> Column:
    """public gives way to any protected level."""
    return F.when(F.size(levels) > 1, F.array_remove(levels, fixed.PUBLIC)).otherwise(levels)


def token_prefix(field_type: Column) -> Column:
    return mapped(fixed.TOKEN_PREFIX, field_type, F.upper(field_type))


def token_text(prefix: Column, number: Column) -> Column:
    return F.concat(F.lit("["), prefix, F.lit("_"), F.lpad(number.cast("string"), F.greatest(F.lit(5), F.length(number.cast("string"))), F.lit("0")), F.lit("]"))


def redaction_category(field_type: Column) -> Column:
    return mapped(fixed.REDACTION_CATEGORY, field_type, F.lit("Other"))


def review_signal(field_type: Column, original: Column, detector: Column, region_label: Column, region_text: Column) -> tuple[Column, Column]:
    """(signal, whether it is a section marker that is kept): approved, priority, weak or candidate, in this order."""
    sources = F.split(detector, r" \+ ")
    approved = F.arrays_overlap(sources, F.array(*map(F.lit, fixed.APPROVED_SOURCES)))
    structural = F.coalesce(region_label.isin(fixed.STRUCTURAL_LABELS), F.lit(False))
    marker = F.trim(original).rlike(r"^(?:[A-Z]|[IVXLCDM]{1,6}|\d{1,3})[.)]?$") & structural & F.coalesce(F.trim(region_text) == F.trim(original), F.lit(False))
    plain = by_letters(F.regexp_replace(original, r"(?U)^\s+|\s+$", ""))
    generic = reduce(or_, [plain == by_letters(F.lit(w)) for w in fixed.GENERIC_WORDS])
    weak = F.contains(detector, F.lit("-fuzzy")) | generic | structural
    first = field_type.isin(fixed.PRIORITY_TYPES)
    signal = F.when(approved, "approved").when(first, "priority").when(marker | weak, "weak").otherwise("candidate")
    return signal, ~approved & ~first & marker


def reference_portal(kind: Column, text: Column) -> tuple[Column, Column]:
    """Where to look a reference up, and what that proves; never a link for internal or unresolved ones."""
    urls = {k: v[0] for k, v in fixed.PORTALS.items() if v[0]}
    words = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    asked = F.when(kind == "bger_case", F.concat(F.lit("?type=simple_query&lang=de&query_words="), F.url_encode(words))).otherwise(F.lit(""))
    return F.concat(mapped(urls, kind), asked), mapped({k: v[1] for k, v in fixed.PORTALS.items()}, kind, F.lit("Internal or unresolved reference - no external link"))


def review_group(field_type: Column, levels: Column, signal: Column, mode: str = "category") -> Column:
    """The sort key parent:category of a finding's review group in a mode: category, signal, priority or sensitivity."""
    order = F.lit(str(len(fixed.REVIEW_CATEGORIES) - 1))
    for i, (_, types) in reversed(list(enumerate(fixed.REVIEW_CATEGORIES))):
        if types:
            order = F.when(field_type.isin(types), str(i)).otherwise(order)
    parent = {
        "category": F.lit(""),
        "signal": mapped(fixed.SIGNAL_ORDER, F.coalesce(signal, F.lit("candidate")), F.lit("2")),
        "priority": F.when(field_type.isin(fixed.REVIEW_FIRST), "1").when(field_type.isin(fixed.REVIEW_CONTEXT), "3").otherwise("2"),
        "sensitivity": F.when(F.size(levels) > 1, "0").when(F.element_at(levels, 1) == fixed.SECRECY, "1").when(F.element_at(levels, 1) == fixed.PRIVATE, "2").otherwise("3"),
    }[mode]
    return F.concat(parent, F.lit(":"), order)


def download_name(source: Column, extension: str, prefix: str = "") -> Column:
    """A safe file name: the last part of a path without .pdf and forbidden characters, at most 180 long, or document."""
    name = F.element_at(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r'[\x00-\x1f\x7f<>:"/\\|?*]', "_")
    stem = F.coalesce(F.nullif(F.regexp_replace(stem, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("document"))
    return F.concat(F.lit(prefix), F.substring(stem, 1, 180), F.lit("." + extension))


def equivalent_key(text: Column) -> Column:
    """Equal for mentions that differ in case and punctuation; where there are digits, punctuation counts as a blank."""
    low = F.lower(text)
    gone = F.when(low.rlike(r"\d"), F.regexp_replace(low, r"[\p{P}\p{S}]+", " ")).otherwise(F.regexp_replace(low, r"[\p{P}\p{S}]+", ""))
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def html_escaped(text: Column) -> Column:
    """&, <, >, double and single quotes as entities, for texts that go into a page."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Pages, and characters of a label and of a text, that a layout region may have.
MOST_PAGES, LABEL_LENGTH, REGION_LENGTH = 40, 80, 200_000


def valid_region(page: Column, label: Column, text: Column) -> Column:
    """A layout region's page, label and text are within their limits."""
    return F.coalesce(page.between(1, MOST_PAGES) & (F.length(label) <= LABEL_LENGTH) & (F.length(F.coalesce(text, F.lit(""))) <= REGION_LENGTH), F.lit(False))

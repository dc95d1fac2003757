"""Case folding by Spark's own functions against the language's, over all characters; names by their letters."""

import unicodedata

from pyspark.sql import functions as F

from cloakframe.functions import exprs

# Cherokee, which folds to capitals, and private characters.
LEFT_OUT = [(0x13A0, 0x13FD), (0xAB70, 0xABBF), (0xE000, 0xE001)]


def test_case_folding_of_every_character(spark):
    codes = [c for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and not any(a <= c <= b for a, b in LEFT_OUT)]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, s string")
    odd = [hex(r.c) for r in df.select("c", exprs.casefolded(F.col("s")).alias("f")).collect() if r.f != chr(r.c).casefold()]
    assert odd == []
    words = ["STRASSE", "Straße", "STRAẞE", "ΟΔΟΣ οδός", "ﬃ", "İI ıi", "ǰ ŉ և", ""]
    got = spark.createDataFrame([(w,) for w in [*words, None]], "s string").select(exprs.casefolded(F.col("s")).alias("f")).collect()
    assert [r.f for r in got] == [*(w.casefold() for w in words), None]


def test_names_by_letters(spark):
    def bare(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))

    names = ["Méni", "MENI", "méni", "Meni", "ﬁn", "FIN", "Straße", "strasse", "ÉTAT", "etat", "eta t", "Å", "a", "ñ", "n", "Čapek", "capek", "m.", "m", ""]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    j = df.crossJoin(df.toDF("b")).select("a", "b", (exprs.by_letters(F.col("a")) == exprs.by_letters(F.col("b"))).alias("same"))
    assert all(r.same == (bare(r.a) == bare(r.b)) for r in j.collect())
    g = df.groupBy(exprs.by_letters(F.col("a"))).count().collect()
    assert len(g) == len({bare(n) for n in names})


def test_generic_words_are_weak_with_any_accents(spark):
    rows = [("État", "weak"), ("ETAT", "weak"), (" état ", "weak"), ("MME", "weak"), ("Anna", "candidate")]
    df = spark.createDataFrame([(t, w) for t, w in rows], "t string, want string")
    none = F.lit(None).cast("string")
    got = df.select("want", exprs.review_signal(F.lit("person_name"), F.col("t"), F.lit("model"), none, none)[0].alias("signal")).collect()
    assert [r.signal for r in got] == [r.want for r in got]

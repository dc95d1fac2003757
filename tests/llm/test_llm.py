"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import bpe, common, jaccard, licenses, mixing, neardup_vectors, search, store, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, **more):
    """(doc_id, text[, source]) rows, with columns whose names operators use inside."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1) for r in rows], DOCS)
    for name in ("size", "target", "taken", "score", "key", "h", "n", "rep", "id", "th", "start", "finish", "held_out", "_pid", "kind", "a8", *more):
        df = df.withColumn(name, F.lit("clash"))
    return df


def sample(n=120):
    import duckdb

    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()


# --- 1 licences


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def licence_brute(text):
    clean = re.sub(r"[^a-z0-9\n]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), (text or "").replace("\r", "\n")))
    units = [(0, re.sub(r"[ \n]+", " ", clean)), *(((i + 1), u) for i, u in enumerate(clean.split("\n")) if "\n" in clean)]
    hits = {}
    for line, u in units:
        w = u.split()
        g = {f"{x} {y}" for x, y in zip(w, w[1:])}
        for name, t in licenses.TEMPLATES:
            d = round(dice(g, set(licenses._template_bigrams(t))), 12) if g else 0
            if d >= licenses.THRESHOLD:
                hits[line] = min(hits.get(line, (0, "~", 0)), (-d, name, line))
    best = min(hits.values(), default=None)
    return (best[1], -best[0], best[2], len(hits)) if best else (None, 0.0, None, 0)


def test_licences(spark):
    t = licenses.TEMPLATES
    rows = [(1, None), (2, ""), (3, t[0][1]), (4, "Some prose.\n" + t[4][1].upper() + "\nMore."), (5, f"x {t[2][1]} y z"), (6, t[3][1] + " provided"), (7, "a " * 50_000), (8, "licensed licensed licensed"), (None, t[2][1]), (3, t[0][1]), (9, t[9][1] + "\r\n" + t[9][1])]
    rows += [(i + 100, x) for i, x, _ in sample(60)]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    want = collections.Counter((i, *licence_brute(x)) for i, x, *_ in rows)
    assert collections.Counter((r.doc_id, r.license, r.dice, r.line, r.n_hits) for r in got) == want
    assert licenses.scan_licenses(docs(spark, rows).limit(0)).collect() == []


def test_licence_scan_has_no_shuffle_and_no_python(spark):
    plan = licenses.scan_licenses(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


MIT_TEXT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def run_brute(text):
    """(-dice, id, line) of the best run of words and the number of groups of runs that overlap, by trying all runs."""
    words = [(w, i + 1) for i, u in enumerate((text or "").replace("\r", "\n").split("\n")) for w in re.sub(r"[^a-z0-9]+", " ", u.lower()).split()]
    grams = [f"{a[0]} {b[0]}" for a, b in zip(words, words[1:])]
    found = []
    for name, t in licenses.TEMPLATES:
        want, most = set(licenses._template_bigrams(t)), int(len(licenses._template_words(t)) * 1.5)
        for i in range(len(grams)):
            for j in range(i, min(len(grams), i + most)):
                if grams[i] in want and grams[j] in want and (d := round(dice(set(grams[i : j + 1]), want), 12)) >= licenses.THRESHOLD:
                    found.append((i, j, -d, name, words[i][1]))
    n, upto = 0, -1
    for i, j, *_ in sorted(found):
        n, upto = n + (i > upto), max(upto, j)
    return min((f[2:] for f in found), default=None), n


def test_licences_in_runs_of_words(spark):
    """Notices wrapped over lines or beside other prose, which are no unit of their own."""
    t = licenses.TEMPLATES
    prose = "Some words of prose that go on here. " * 5
    rows = [(1, MIT_TEXT), (2, prose + "\n" + MIT_TEXT + "\n" + prose), (3, "Copyright 2020 Someone. Released under the MIT License."), (4, prose + "\nThis work is licensed under\nthe GNU General Public License, version 3. " + prose + t[9][1] + " " + prose), (5, prose), (6, None), (7, "license"), (8, "The license of the software is under the license of the license. " * 20)]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows), windows=True).collect()}
    for i, x in rows:
        best, n = run_brute(x)
        assert licence_brute(x)[3] == 0
        assert (got[i].license, got[i].dice, got[i].line, got[i].n_hits) == ((best[1], -best[0], best[2], n) if best else (None, 0.0, None, 0)), i
    assert [got[i].license for i in (1, 2, 3)] == ["MIT"] * 3 and got[2].line == 4 and got[4].n_hits == 2
    same = [(1, "Some prose.\n" + t[4][1]), (2, t[0][1]), (3, t[9][1] + "\n" + prose + "\n" + t[9][1])]
    assert sorted(licenses.scan_licenses(docs(spark, same), windows=True).collect()) == sorted(licenses.scan_licenses(docs(spark, same)).collect())
    plan = licenses.scan_licenses(docs(spark, [(1, "x")]), windows=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- 2 toxicity


def test_block_max_search_is_exact():
    rng = random.Random(3)
    vectors = []
    for _ in range(500):
        v = {rng.randrange(40): rng.random() for _ in range(rng.randrange(1, 6))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    vectors += vectors[:30]  # ties
    index = toxicity.BlockMaxIndex(vectors, 40)
    for q in vectors[:80]:
        every = sorted(((round(sum(x * v.get(t, 0) for t, x in sorted(q.items())), 12), i) for i, v in enumerate(vectors)), key=lambda x: (-x[0], x[1]))
        assert index.search(q, 7) == [x for x in every if x[0] > 0][:7]


def test_toxicity(spark):
    rng = random.Random(5)
    bad, plain = ["vileword", "nastyword", "foulword"], [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=30) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words).upper() if i % 8 == 0 else " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "vileword foulword"), (600, None), (601, ""), (602, "x " * 60_000 + "nastyword vileword"), (3, rows[3][1])]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, rows)
    got = toxicity.score_toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600} == set(held)
    assert sum(by[i].predicted == int(i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert by[None].predicted == 1 and by[602].predicted == 1 and by[600].predicted == by[601].predicted == 0
    flipped = lab.withColumn("toxic", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.score_toxicity(df, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in toxicity.score_toxicity(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), lab).collect() == []


def test_toxicity_reads_all_words(spark):
    """A long clean text with one word that most of its few examples are toxic for isn't toxic; all other words count."""
    rng = random.Random(11)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, " ".join(rng.choices(plain, k=40) + ["vileword"] * toxic + ["filler"] * (i % 40 == 0 or i in (1, 3)))))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, " ".join(rng.choices(plain, k=400) + ["filler"])), (1001, "vileword")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got[1001].predicted == 1 and got[1000].predicted == 0
    clean = [got[i] for i in range(400) if i % 8]
    assert all(r.neighbours for r in clean) and not any(r.predicted for r in clean)


# --- 3 archives


def test_warc_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(3, "http://a/x y", long), (1, None, long), (2, "http://b/?q#f", None), (4, "http://c", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", long), (9, "z", "only" * 50), (7, "a", "x" * 300_000), (8, "a\nb", "x" * 300_000), (3, "http://a/x y", long)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))
    path = common.shared_dir(spark)
    warc.write_warc(df, path)
    back = warc.read_records(spark, path, payload=True)
    got = warc.resolve_revisits(warc.assemble(back)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and i != first.get(h, i) and sum(x[2] == h for x in rows) > 1
        want[(None if i is None else str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(first[h]) if revisit else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert back.filter("type = 'request'").count() == len(rows)
    path = common.shared_dir(spark)
    warc.write_warc(df.limit(0), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def test_warc_assembly_follows_concurrent_to(spark):
    rows = [("r1", "request", None), ("s1", "response", ["r1"]), ("m1", "metadata", ["s1"]), ("s2", "response", None), ("r2", "request", ["s2"]), ("m3", "metadata", None)]
    rows += [("s4", "response", ["r4", "m4"]), ("r4", "request", []), ("m4", "metadata", None), ("m4", "metadata", None)]  # one record names the others
    df = spark.createDataFrame([(i, t, c, None, None, None, 0, "", None) for i, t, c in rows], warc.RECORD)
    got = {r.capture_id: (r.request and r.request.record_id, r.response and r.response.record_id, [m.record_id for m in r.metadata]) for r in warc.assemble(df).collect()}
    assert got == {"m1": ("r1", "s1", ["m1"]), "r2": ("r2", "s2", []), "m3": (None, None, ["m3"]), "m4": ("r4", "s4", ["m4"])}


def test_warc_repeated_headers_and_urls(spark):
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nwarc-concurrent-to:<c>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    ((headers, block),) = warc.parse_records(data)
    assert headers["warc-concurrent-to"] == ["<b>", "<c>"] and bytes(block) == b"ok"
    urls = ["http://a/x y", "http://a/\r\nWARC-Type: x", " http://b/\t ", None, "http://c/" + "p" * 70_000, ""]
    path = common.shared_dir(spark)
    warc.write_warc(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, html string"), path)
    got = [r.target_uri for r in warc.read_records(spark, path).filter("type = 'response'").collect()]
    assert sorted(got, key=str) == sorted(["http://a/x y", "http://a/%0D%0AWARC-Type: x", "%20http://b/%09%20", None, urls[4], ""], key=str)


def test_warc_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    rows = [(i, "u", chr(97 + i % 26) * (2000 + i if i % 2 else 10)) for i in range(40)]
    path = common.shared_dir(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    sizes = [sum(len(b) for _, b in warc.parse_records(warc._gunzip(bytes(f.content)))) for f in files]
    assert len(files) > 8 and max(sizes) < 12_000
    assert warc.read_records(spark, path).count() == 120


# --- 4 mixing


def test_mixing_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["b", "a", "Z", None, "é", "b", "b"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "\t \n", "tiny"), (902, "one\u00a0word two", "tiny"), (5, rows[5][1], rows[5][2])]
    got = mixing.mix(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        for s in full or open_:
            target[s] = 3 * total[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken * r.n
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sum(r.n for r in got) == len(rows)
    assert sum(taken.values()) <= sum(total.values())
    for s in names:
        assert abs(taken[s] - target[s]) <= 80
    key = lambda out: sorted((r.id or 0, r.th, r.taken) for r in out)
    assert key(got) == key(mixing.mix(docs(spark, rows).repartition(7)).collect())
    assert mixing.mix(docs(spark, rows).limit(0)).collect() == []
    stage = mixing.mix_stage(spark, docs(spark, rows), SF)
    assert stage.columns == docs(spark, rows).columns
    assert collections.Counter(r.source for r in stage.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(1)))).collect()).keys() <= set(names)


# --- 5 byte pairs


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, tiktoken_encoding):
    rng = random.Random(11)
    texts = [None, "", " ", "\n\n  x", "a" * 9_001, "😀é<|endoftext|> don't", "".join(rng.choices("abé日x'! \n", k=4_000)), *(t for _, t, _ in sample(80))]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, [(None, "x"), (1, "x"), (1, "x")]), with_ids=False).count() == 3
    assert bpe.encode(docs(spark, [(1, "x")]).limit(0)).collect() == []


# --- 6 and 8 vectors


def vectors():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((300, 16))
    near = x[:60] + 0.05 * rng.standard_normal((60, 16))
    chain = [x[70] + 0.1 * k * x[71] for k in range(6)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*x, *near, *chain, *[x[5]] * 40, 3 * x[6]])]
    return rows, [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, []), (1006, [1.0, 2.0])]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("rep", F.lit(1))


def test_embedding_near_duplicates(spark):
    good, odd = vectors()
    for block in (4096, 16):  # small blocks split cells
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(table_of(spark, good + odd), block_rows=block).collect()}
        u = np.array([v for _, v in good])
        u /= np.linalg.norm(u, axis=1)[:, None]
        s = u @ u.T >= 0.95
        np.fill_diagonal(s, False)
        comp = np.arange(len(u))
        for _ in range(len(u)):
            comp = np.minimum(comp, np.where(s, comp[None], len(u)).min(axis=1))
        assert len(got) == len(good) + len(odd)
        assert all(got[i] == (s[i].sum(), comp[i], comp[i] == i) for i in range(len(u)))
        assert all(got[i] == (0, i, True) for i, _ in odd)
    assert neardup_vectors.near_duplicates(table_of(spark, good).limit(0)).collect() == []
    assert neardup_vectors.near_duplicates(table_of(spark, [(None, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0])])).filter("n_links = 1").count() == 2


@pytest.mark.parametrize("sure", [None, search.SURE])
def test_nearest(spark, sure):
    good, odd = vectors()
    for rows in (good, good[:9]):
        got = collections.defaultdict(list)
        for r in search.nearest(table_of(spark, rows + odd), k=12, every=20, sure=sure, cell_rows=64, query_rows=5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        hit = total = 0
        for q, v in rows:
            if q % 20 == 0:
                every = sorted(((float((np.array(w) * np.array(v)).sum()), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))[:12]
                assert [r for r, _, _ in got[q]] == list(range(1, len(every) + 1))
                hit += len({i for _, i in every} & {i for _, i, _ in got[q]})
                total += len(every)
                if sure is None:
                    assert [(i, s) for _, i, s in got[q]] == [(i, pytest.approx(s, abs=1e-12)) for s, i in every]
        assert hit >= 0.95 * total
    assert search.nearest(table_of(spark, good).limit(0)).collect() == []


def test_chi_square():
    assert search.chi2_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-4) and search.chi2_ppf(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# --- 7 store


def test_token_store(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(17)
    rows = [(5, "Hello  WORLD don't"), (2, None), (9, ""), (7, "e\u0301 <|endoftext|> x\x1cy\u00a0z 日本"), (1, "w " * 30_000), (3, " ".join(rng.choices(["alpha", "beta", "gamma"], k=5_000))), (None, "null id"), (5, "Hello  WORLD don't")]
    rows += [(100 + i, x) for i, x, _ in sample(60)] + [(300, rows[5][1] + " tail")]
    path = common.shared_dir(spark)
    store.write_store(docs(spark, rows), path)
    got = sorted(store.read_store(spark, path).collect(), key=lambda r: r.start)
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, text) in zip(got, order):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), True)
        start += len(ids)
    back = {r.start: list(r.ids) for r in store.read_ids(spark, path).collect()}
    assert all(back[r.start] == t.encode(x or "", add_special_tokens=False).ids + [2] for r, (_, x) in zip(got, order))
    chunks = spark.read.parquet(f"{path}/chunks")
    stored, whole = chunks.agg(F.sum("n")).first()[0], start
    assert chunks.count() == chunks.select("digest").distinct().count() and stored < whole
    tree = spark.read.parquet(f"{path}/manifest")
    assert tree.filter("level = 0").agg(F.sum("docs"), F.sum("ids")).first()[:] == (len(rows), start)
    assert tree.filter(F.col("level") == tree.agg(F.max("level")).first()[0]).count() == 1
    path = common.shared_dir(spark)
    store.write_store(docs(spark, rows).limit(0), path)
    assert store.read_store(spark, path).collect() == []


def test_store_sees_damage(spark):
    path = common.shared_dir(spark)
    store.write_store(docs(spark, [(1, "one two three"), (2, "four")]), path)
    bad = [(r.digest, r.n, bytes(r.body[:-2]) + b"\1\1") for r in spark.read.parquet(f"{path}/chunks").collect()]
    spark.createDataFrame(bad, "digest binary, n int, body binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert [r.verified for r in store.read_store(spark, path).collect()] == [False, False]


def test_store_sees_lost_and_added_files(spark, monkeypatch):
    """Lost recipe files, recipes of another store, a lost manifest and lost chunk files don't go unnoticed."""
    import glob
    import shutil

    monkeypatch.setattr(store, "SPAN_BITS", 4)
    monkeypatch.setattr(store, "FAN_BITS", 2)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 7 + 1))) for i in range(60)]
    path, other = common.shared_dir(spark), common.shared_dir(spark)
    store.write_store(docs(spark, rows), path)
    store.write_store(docs(spark, [(99, "one more")]), other)
    local = path.removeprefix("file://")
    assert spark.read.parquet(f"{path}/manifest").agg(F.max("level")).first()[0] >= 2
    assert store.read_store(spark, path).filter("verified").count() == 60
    for what in ("lost recipes", "more recipes", "no manifest"):
        shutil.copytree(local, f"{local}-x")
        if what == "lost recipes":
            os.remove(next(f for f in glob.glob(f"{local}-x/recipes/part-*") if spark.read.parquet(f"file://{f}").count()))
        elif what == "more recipes":
            shutil.copy(next(f for f in glob.glob(f"{other.removeprefix('file://')}/recipes/part-*") if spark.read.parquet(f"file://{f}").count()), f"{local}-x/recipes/part-extra.parquet")
        else:
            for f in glob.glob(f"{local}-x/manifest/part-*"):
                os.remove(f)
        with pytest.raises(store.StoreDamaged):
            store.read_store(spark, f"{path}-x")
        shutil.rmtree(f"{local}-x")
    lost = next(f for f in glob.glob(f"{local}/chunks/part-*") if spark.read.parquet(f"file://{f}").count())
    n = spark.read.parquet(f"file://{lost}").count()
    os.remove(lost)
    assert n and store.read_store(spark, path).filter("not verified").count() >= 1


def test_joined_crc():
    parts = [os.urandom(n) for n in (1, 0, 7, 5000, 64)]
    assert store.crc_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


# --- 9 Jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def components_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words)


def test_jaccard_join(spark):
    rng = random.Random(19)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = [None, "", " \t", "One two", "one TWO", "one two three", "a b c d e", "A b c d e", "a b c d e f", "a b c d e f g h", "b c d e f g h", "a b c d e f g"]
    for n in (6, 8, 9, 12, 20, 40, 90, 300, 700):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts += [edited(rng, base, s) for s in (0, 0.01, 0.02, 0.03, 0.04, 0.05)]
            texts += [" ".join(base + [word() for _ in range(n // 4)]), " ".join(base[: n * 3 // 4]), " ".join(base[n // 2 :] + base[: n // 2])]
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randrange(5, 200))] + passage + [word() for _ in range(9)]) for _ in range(90)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(1, 12))]) for _ in range(70)]  # mostly the common passage
    family = [word() for _ in range(150)]
    texts += [edited(rng, family, 0.02) for _ in range(120)] + [" ".join(family)] * 80
    texts.append("long " * 3 + " ".join(word() for _ in range(30_000)))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(docs(spark, rows).repartition(5)).collect()}
    assert got == components_brute(rows)


def test_jaccard_edges(spark):
    assert jaccard.join_similar(docs(spark, [(1, "x")]).limit(0)).collect() == []
    got = jaccard.join_similar(docs(spark, [(None, "a b c d e"), (4, "A b c d e"), (4, "a b c d e"), (3, None), (2, "q")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 1, 4), (2, 1, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4)]


def test_partenum_signatures_share_one():
    """Any two sets that are similar enough share at least one + spare() signatures."""
    rng = np.random.default_rng(23)
    for size in (*range(3, 40), 63, 64, 100, 127, 128, 250, 300, 511, 512, 700, 1500):
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for extra in {0, len(a) // 7, len(a) // 3}:
                most = len(a) - int(np.ceil(3 * (len(a) + extra) / 4)) if extra else len(a) // 7
                gone = max(0, most)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**64, extra or gone, dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if 4 * inter >= 3 * (len(a) + len(b) - inter) and not np.array_equal(a, b):
                    shared = len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))
                    assert shared > jaccard.spare(jaccard.band_of(min(len(a), len(b)))), (len(a), len(b), inter)


# --- 10 URLs


def judge_brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "nourl", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://xexample.com/en/", "http://a.example.com/en/1", "https://b.net/es/?q", "b.net/es/", "x://net/fr/a://b/c", "ftp://É.net/fr/", "http://h.com\n/a", "http://a.b.www.example.com/en/", "http://e.org?x=/en/", "http://" + "a." * 500 + "net/es/" + "p" * 5000]
    rows = [*enumerate(urls), (3, urls[3]), (6, urls[6]), (None, urls[6])]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("key", F.lit("x"))
    got = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((i, *judge_brute(u)) for i, u in rows)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).collect() == []


# --- together


@pytest.mark.parametrize("one_task", [0, common.ONE_TASK])
def test_components_of_a_long_path_and_a_star(spark, one_task):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint"), one_task=one_task).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300)) and len(got) == 499


def test_prefix_sums_of_a_hot_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.lit(2).cast("bigint").alias("v"))
    assert all(r.s == 2 * (r.id if r.k == "hot" else r.id - 900) for r in common.prefix_sums(df, ["id"], "v", "s", within="k").collect())
    assert all(r.s == 2 * r.id for r in common.prefix_sums(df, ["id"], "v", "s").collect())


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    """Repeated ids, null ids and an id that stands for two texts."""
    copied, single = " ".join(f"c{i}" for i in range(60)), " ".join(f"s{i}" for i in range(60))
    rows = [(1, copied), (1, copied), (2, copied), (None, copied), (2, single), (None, "n1 n2 n3 n4 n5 n6 n7"), (None, "n1 n2 n3 n4 n5 n6 n7"), (5, None), (5, "")]
    df = docs(spark, rows)
    got = jaccard.jaccard_stage(spark, df, SF)
    assert got.columns == df.columns
    want = [(1, copied), (2, single), (None, "n1 n2 n3 n4 n5 n6 n7"), (5, None), (5, "")]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)


CLASH = ("_tox_id", "_mix_id", "_mix_source", "_mix_th", "_mix_times", "_mix_copy", "_row", "_gone", "row", "g_row", "h", "component_id", "c", "first", "n", "rep", "k", "f")


def test_stages_keep_columns_of_any_name(spark):
    from cloakframe.llm.bpe import bpe_stage
    from cloakframe.llm.toxicity import toxicity_stage

    texts = [" ".join(f"a{i}b{k}" for k in range(20)) for i in range(12)]
    rows = [*enumerate(texts), (20, texts[3]), (None, texts[4]), (3, texts[3]), (30, None), (31, "")]
    df = docs(spark, rows, **dict.fromkeys(CLASH))
    for stage, ids in ((toxicity_stage, None), (jaccard.jaccard_stage, 14), (mixing.mix_stage, None)):
        got = stage(spark, df, SF)
        out = got.collect()
        assert got.columns == df.columns and all(r[name] == "clash" for r in out for name in CLASH)
        assert ids is None or len(out) == ids
        assert stage(spark, df.limit(0), SF).collect() == []
    assert bpe_stage(spark, df, SF).count() == 17 and bpe_stage(spark, df.limit(0), SF).count() == 0


def test_vectors_of_tiny_and_huge_components(spark):
    """All are finite and not zero, so all take part."""
    rng = np.random.default_rng(31)
    x = rng.standard_normal((60, 8))
    rows = [(i, [float(c) for c in v * (1e-200 if i % 3 == 0 else 1e150 if i % 3 == 1 else 1.0)]) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in search.nearest(table_of(spark, rows), k=5, every=20, sure=None, cell_rows=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (0, 20, 40):
        want = sorted(((-float(np.dot(np.array(v), np.array(rows[q][1]))), i) for i, v in rows if i != q))[:5]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s, rel=1e-12)) for s, i in want], q
    near = rows + [(100 + i, [c * 7 for c in v]) for i, v in rows if i % 3 < 2]
    out = {r.vec_id: r for r in neardup_vectors.near_duplicates(table_of(spark, near)).collect()}
    assert all(out[100 + i].component_id == i for i in range(60) if i % 3 < 2)


def test_recall_of_nearest_as_shipped(spark):
    """All rows of embeddings, with the query's own settings and with small cells, against brute force."""
    df = common.table(spark, SF.replace("0.001", "0.01"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    for more in ({}, {"cell_rows": 64}):
        got = collections.defaultdict(set)
        for r in search.nearest(df, **more).collect():
            got[r.query_id].add(r.vec_id)
        hit = total = 0
        for q in np.flatnonzero(ids % 20 == 0):
            s = x @ x[q]
            best = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != q][:20]
            hit, total = hit + len(got[int(ids[q])] & set(best)), total + len(best)
        assert hit >= 0.95 * total


def test_piece_splitter_agrees_with_the_library():
    """The quick path of the store's encoder against the library on odd strings."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(37)
    alphabet = "abcXYZ019'’ \n\t.,;:!?-_<|>éÉßöÜñ\u0130\u0301\u00a0\u00ad\u2019\u2026日😀\x85\x1c#%"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(1500)] + ["don't I'LL we've 'S 's", "<|endoftext|>", "a" * 3000]
    got = store.encode_packed(texts, path)
    for x, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_words_are_looked_up_once_a_call(monkeypatch):
    """The store's encoder asks its table once for each different word of a call, not once for each word."""
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    asked = []

    class Counting(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    first, *rest = store._tokenizer(path)
    made = (first, *[Counting() if type(x) is dict else type(x)() if isinstance(x, bytearray) else x for x in rest])
    monkeypatch.setattr(store, "_tokenizer", lambda _: made)
    texts = ["The cat don't  sit on the mat. " * 500, "the mat", "", "cat"]
    for _ in range(2):
        asked.clear()
        got = store.encode_packed(texts, path)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [first.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(asked) < 40


def test_checkpoint_folder_is_needed_on_a_cluster():
    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_damaged_archives_lose_only_what_is_damaged(spark, tmp_path):
    import gzip

    end = b"\r\n\r\n"

    def record(rid, block, length=None, kind="application/http", more=b""):
        n = b"" if length == "" else f"Content-Length: {len(block) if length is None else length}\r\n".encode()
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: " + rid + b"\r\n" + n + b"Content-Type: " + kind.encode() + more + end + block + end

    http = b"HTTP/1.1 200 OK" + end
    files = {
        "fine": record(b"a", http + b"one") + record(b"b", http + b"two"),
        "no_length": record(b"c", http + b"x", "") + record(b"d", http + b"after"),
        "wrong": record(b"e", http + b"longer than told", 21) + record(b"f", http + b"after"),
        "words": record(b"g", http + b"x", "many") + record(b"h", http + b"after"),
        "cut": record(b"i", http + b"whole") + record(b"j", http + b"x" * 99, None)[:-60],
        "head": record(b"k", http + b"whole") + b"WARC/1.1\r\nWARC-Type: resp",
        "odd": record(b"l", b"no blank line") + record(b"m", b"page-id: \xff\r\n", kind="application/warc-fields") + record(b"n", b"page-id: 1\r\npage-id: 2\r\n", kind="application/warc-fields"),
        "empty": b"", "noise": b"\x00\x01 nothing here", "too_far": record(b"p", http + b"x", 10**9) + record(b"q", http + b"after"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "fine.gz").write_bytes(gzip.compress(record(b"r", http + b"zip")) + gzip.compress(record(b"s", http + b"zap")))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(record(b"t", http + b"t") + record(b"u", http + random.Random(1).randbytes(3000)))[:-1500])
    (tmp_path / "bad.gz").write_bytes(gzip.compress(record(b"v", http + b"v")) + b"\x1f\x8b broken")
    back = warc.read_records(spark, f"file://{tmp_path}", payload=True).collect()
    faults = {r.record_id: r.fault for r in back}
    assert {k: v for k, v in faults.items() if v} == {"c": "no_length", "e": "wrong_length", "g": "no_length", "j": "truncated", None: "no_header_end", "l": "no_http_end", "m": "not_text", "p": "truncated", "u": "truncated"}
    assert {r.record_id: bytes(r.payload) for r in back if not r.fault and r.record_id != "n"} == {"a": b"one", "b": b"two", "d": b"after", "f": b"after", "h": b"after", "i": b"whole", "k": b"whole", "q": b"after", "r": b"zip", "s": b"zap", "t": b"t", "v": b"v"}
    got = warc.assemble(warc.read_records(spark, f"file://{tmp_path}")).collect()
    assert {r.capture_id for r in got} == {k for k, v in faults.items() if not v}

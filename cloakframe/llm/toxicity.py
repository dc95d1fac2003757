"""Toxicity: votes of the nearest labelled examples by exact cosine of whole texts, TF-IDF weighted by the label's tie to each word."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, written

#: Labelled documents the model learns from at most (those with the smallest hash of the id), a fixed bound.
EXAMPLES = 24_000
#: Neighbours that vote, and terms of the index held as a matrix: those of the most examples.
K, FREQUENT = 15, 512
#: Examples of a block of the index, and queries searched at a time.
BLOCK, GROUP = 64, 64
#: Weight of the base rate beside the votes.
PRIOR = 0.5
#: Nats of evidence for a word's tie to the label that chance alone exceeds once in twenty times (half the 95% point of
#: chi-square with one degree of freedom): only what is beyond adds to a word's weight.
CHANCE = 1.92

_WORD = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    """Lower-case runs of word characters of the whole text, composed (NFC)."""
    text = text or ""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _WORD(text.lower())


class BlockMaxIndex:
    """A block-max inverted index over unit vectors, for exact searches of many queries at once.

    Examples lie in blocks of BLOCK alike ones (clustered by their frequent terms). The lists of the FREQUENT terms of the
    most examples are kept block by block, filled up to matrices, with each block's largest weight of each term; the other
    terms' inverted lists are short and summed whole. A query's products with a block's largest weights, and the largest
    of its other sums there, bound its cosine with all of the block. Blocks with the highest bounds are scored first; then
    only those whose bound reaches the k-th best cosine, which leaves no neighbour out. Bounds and sums are taken in single precision; the k best and all within its error of them are
    summed again in double precision. Ties go to the smaller example number.
    """

    def __init__(self, vectors: Iterable[dict[int, float] | tuple[np.ndarray, np.ndarray]], n_terms: int):
        pairs = [_arrays(v) for v in vectors]
        self.n, self.n_terms = len(pairs), n_terms
        self.cuts = np.concatenate([[0], np.cumsum([len(t) for t, _ in pairs])]).astype(np.int64)
        self.terms = np.concatenate([t for t, _ in pairs] or [np.array([], np.int32)])
        self.weights = np.concatenate([w for _, w in pairs] or [np.array([])])
        del pairs, vectors
        held = np.bincount(self.terms, minlength=n_terms)
        frequent = np.argsort(-held, kind="stable")[:FREQUENT]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.cuts))
        at = self.column[self.terms]
        matrix = np.zeros((self.n, len(frequent)), np.float32)
        matrix[owner[at >= 0], at[at >= 0]] = self.weights[at >= 0]
        self.number = self._alike(matrix)  # the example at each place
        place = np.empty(self.n, np.int32)
        place[self.number] = np.arange(self.n, dtype=np.int32)
        self.blocks = -(-self.n // BLOCK)
        self.matrix = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        np.take(matrix, self.number, axis=0, out=self.matrix[: self.n])
        del matrix
        self.most = self.matrix.reshape(self.blocks, BLOCK, -1).max(axis=1)
        rare = np.nonzero(at < 0)[0]
        rare = rare[np.lexsort((place[owner[rare]], self.terms[rare]))]
        in_lists = np.where(self.column < 0, held, 0)
        self.lists = np.concatenate([[0], np.cumsum(in_lists)]).astype(np.int64)
        self.list_at, self.list_weights = place[owner[rare]], self.weights[rare].astype(np.float32)

    @staticmethod
    def _alike(matrix: np.ndarray) -> np.ndarray:
        """The rows in an order that puts alike ones together: a few rounds of spherical k-means, from evenly spaced rows."""
        n = len(matrix)
        k = min(64, n // (4 * BLOCK))
        if k < 2:
            return np.arange(n)
        centre = matrix[np.linspace(0, n - 1, k).astype(np.int64)].copy()
        for _ in range(4):
            near = (matrix @ centre.T).argmax(axis=1)
            for j in range(k):
                if (near == j).any():
                    mean = matrix[near == j].mean(axis=0)
                    centre[j] = mean / (np.linalg.norm(mean) or 1)
        return np.lexsort((np.arange(n), near))

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.cuts[i] : self.cuts[i + 1]], self.weights[self.cuts[i] : self.cuts[i + 1]]

    def search(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int = K) -> list[tuple[float, int]]:
        """The k nearest examples with a positive cosine, (cosine, number), nearest first."""
        return self.search_all([query], k)[0]

    def search_all(self, queries: list, k: int = K) -> list[list[tuple[float, int]]]:
        queries = [_arrays(q) for q in queries]
        found: list[list[tuple[float, int]]] = [[] for _ in queries]
        if not self.n or not queries:
            return found
        dense = np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        for row, (t, w) in zip(dense, queries):
            at = self.column[t]
            row[at[at >= 0]] = w[at >= 0]
        bound = dense @ self.most.T
        order = np.argsort(bound.argmax(axis=1), kind="stable")  # alike queries go to the same blocks
        for lo in range(0, len(order), GROUP):
            group = order[lo : lo + GROUP]
            self._group(group, [queries[i] for i in group], dense[group], bound[group], k, found)
        return found

    def _group(self, group: np.ndarray, queries: list, dense: np.ndarray, bound: np.ndarray, k: int, found: list) -> None:
        rest = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        for row, (t, w) in zip(rest, queries):
            at, size = _ranges(self.lists, t)
            if len(at):
                row[:] = np.bincount(self.list_at[at], np.repeat(w, size) * self.list_weights[at], minlength=len(row))
        bound = bound + rest.reshape(len(queries), self.blocks, BLOCK).max(axis=2)
        first = np.argsort(-bound.max(axis=0), kind="stable")[: max(4, -(-2 * k // BLOCK))]

        def scored(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            return places, dense @ self.matrix[places].T + rest[:, places]

        places, sums = scored(first)
        kth = np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] >= k else np.zeros(len(sums), np.float32)
        more = (bound >= np.maximum(kth - 2e-5, 1e-30)[:, None]).any(axis=0)
        more[first] = False
        if more.any():
            p, s = scored(np.flatnonzero(more))
            places, sums = np.concatenate([places, p]), np.concatenate([sums, s], axis=1)
            kth = np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] >= k else kth
        full = np.zeros(self.n_terms)
        for i, row, least, (t, w) in zip(group.tolist(), sums, kth, queries):
            near = places[row >= max(least - 1e-5, 1e-30)]
            near = self.number[near[near < self.n]]
            full[t] = w
            best = [(round(float(full[self.terms[a:b]] @ self.weights[a:b]), 12), j) for j, a, b in zip(near.tolist(), self.cuts[near].tolist(), self.cuts[near + 1].tolist())]
            full[t] = 0
            found[i] = sorted((x for x in best if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k]


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's distinct words, and their counts."""
    c = Counter(words(text))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, c), np.uint64, len(c)).view(np.int64), np.fromiter(c.values(), np.int32, len(c))


def _arrays(v: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter(v, np.int32, len(v)), np.fromiter(v.values(), float, len(v))) if isinstance(v, dict) else v


def _ranges(ends: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists of terms t, joined, and how many each has."""
    lo = ends[t]
    size = ends[t + 1] - lo
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size), size


class Scorer:
    """Votes on texts' term counts. Plain data, so that it can be sent to the workers: bounded by EXAMPLES' texts."""

    def __init__(self, weight: np.ndarray, other: float, examples: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int]):
        """weight: of each word; other: of words that no example has; examples: (terms, counts) of those with any word."""
        self.weight, self.other, self.ids, self.labels = weight, other, ids, labels
        self.examples = examples
        self.base = (sum(labels) + 0.5) / (len(labels) + 1)

    def __getstate__(self) -> dict:
        """Counts instead of weights, and no index, which each worker builds once: a broadcast lies on every executor's disk."""
        terms, counts = (np.concatenate([x[k] for x in self.examples] or [np.array([], np.int32)]) for k in (0, 1))
        small = (terms, counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), np.cumsum([len(t) for t, _ in self.examples])[:-1])
        return {k: v for k, v in self.__dict__.items() if k not in ("examples", "index")} | {"small": small}

    def __setstate__(self, state: dict) -> None:
        terms, counts, cuts = state.pop("small")
        self.__dict__.update(state)
        self.examples = list(zip(np.split(terms, cuts), np.split(counts, cuts))) if len(self.ids) else []

    @cached_property
    def index(self) -> BlockMaxIndex:
        made = BlockMaxIndex((self.unit(t, n, 0.0) for t, n in self.examples), len(self.weight))
        self.examples = []  # the index holds them now
        return made

    def unit(self, terms: np.ndarray, counts: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text; rest: the sum of squares of (1 + log count) over its words that no example has."""
        w = (1 + np.log(counts, dtype=float)) * self.weight[terms]
        return terms, w / math.sqrt(w @ w + rest * self.other**2 or 1.0)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The labels of the neighbours, weighted by nearness, beside the base rate."""
        weight = sum(s for s, _ in near)
        return (sum(s * self.labels[i] for s, i in near) + PRIOR * self.base) / (weight + PRIOR)


def calibrate(votes: list[tuple[float, int]], base: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps from (vote, label) to observed rates (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, y in sorted(votes):
        pools.append([v, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v2, y2, n2 = pools.pop()
            pools[-1] = [v2, pools[-1][1] + y2, pools[-1][2] + n2]
    if not pools:
        return np.array([0.0, 1.0]), np.array([base, base])
    return np.array([p[0] for p in pools]), np.array([(p[1] + base) / (p[2] + 1) for p in pools])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[np.ndarray, ...]:
    """(ids, toxic, first, size, terms, counts) of the examples in the order of their ids: hashes of the words in the whole text
    and how often they occur, example by example from first on.

    Examples are labelled documents that aren't held out; where there are more, those with the smallest hash of the id.
    A document with several labels is toxic if any says so.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), "toxic").filter("toxic is not null and l_id is not null").filter(~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(examples)
    # At most `examples` rows, a fixed bound, so the documents needn't move; of documents that repeat an id one is taken.
    got = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), F.col("id") == F.col("l_id"))
    got = got.groupBy("id", F.col("toxic").cast("int").alias("toxic")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "toxic", "x.h", "x.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [hashed(text.as_py()) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([h for h, _ in rows], pa.list_(pa.int64())), pa.array([n for _, n in rows], pa.list_(pa.int32()))], names=["id", "toxic", "h", "terms", "counts"])

    rows = got.mapInArrow(count, "id bigint, toxic int, h bigint, terms array<bigint>, counts array<int>").toArrow()
    joined = lambda name, kind: np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks] or [np.zeros(0, kind)])
    size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in rows["counts"].chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
    terms, counts = joined("terms", np.int64), joined("counts", np.int32)
    counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    ids, toxic, h = (rows[c].to_numpy() for c in ("id", "toxic", "h"))
    del rows  # the driver holds one copy
    pa.default_memory_pool().release_unused()
    order = np.lexsort((h, ids))
    return ids[order], toxic[order], (np.cumsum(size) - size)[order], size[order], terms, counts


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, calibrated), predicted, neighbours (ids of examples).

    Vectors have all words of the whole texts. A word weighs (1 + log count) times idf (document frequencies are of all
    documents) times 1 + gain, the nats of evidence beyond CHANCE that the examples with it differ from the base rate; so no
    word is left out, and words tied to the label count for more. Words that no example has are in no product and only add to a text's
    length, as if one document had them. Each vector asks the index for its K nearest examples, whose labels vote by
    cosine; isotonic steps learned on the examples turn votes into rates. Texts without words (null and empty ones, too)
    score the rate of such examples. Without any usable labelled document every score is 0. An empty table of documents gives no
    rows. Labels, language, source and id are no inputs of a score. Rows with repeated or null ids are scored each;
    other columns aren't read.

    The text pass and the scoring need no shuffle of texts; the model is broadcast and bounded by the examples' texts.
    """
    spark = docs.sparkSession
    ids, toxic, first, size, terms, tf = learn(docs, labels, examples)
    vocabulary = np.unique(terms)
    codes = np.concatenate([np.searchsorted(vocabulary, terms[lo : lo + (1 << 20)]).astype(np.int32) for lo in range(0, len(terms), 1 << 20)] or [np.zeros(0, np.int32)])
    del terms
    vocabulary_b = spark.sparkContext.broadcast(vocabulary)  # sorted hashes: 8 bytes a word of the examples

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_b.value
        for batch in batches:
            ends, terms, counts, other = [0], [], [], []
            for text in batch.column(1):
                h, n = hashed(text.as_py())
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                seen = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
                terms.append(at[seen].astype(np.int32))
                counts.append(n[seen])
                other.append(float(((1 + np.log(n[~seen])) ** 2).sum()))
                ends.append(ends[-1] + int(seen.sum()))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32())) for x in (terms, counts)), pa.array(other, pa.float64())], names=["doc_id", "terms", "counts", "rest"])

    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == "doc_id")
    counted = written(docs.select("doc_id", "text").mapInArrow(vectors, f"doc_id {kind}, terms array<int>, counts array<int>, rest double"))
    total = counted.count()
    seen = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(len(vocabulary))
    df[seen["term"].to_numpy()] = seen["n"].to_numpy()
    model, steps, none = None, None, 0.0
    if len(toxic):
        base = min(max(toxic.mean(), 1e-6), 1 - 1e-6)
        n = np.bincount(codes, minlength=len(df))
        of_toxic = [codes[a : a + m] for a, m, y in zip(first, size, toxic) if y]
        k = np.bincount(np.concatenate([codes[:0], *of_toxic]), minlength=len(df)).astype(float)
        gain = k * np.log(np.maximum(k, 1) / n / base) + (n - k) * np.log(np.maximum(n - k, 1) / n / (1 - base))
        some = np.nonzero(size)[0]
        scorer = Scorer((np.log((1 + total) / (1 + df)) + 1) * (1 + np.maximum(gain - CHANCE, 0)), math.log((1 + total) / 2) + 1, [(codes[first[i] : first[i] + size[i]], tf[first[i] : first[i] + size[i]]) for i in some], ids[some].tolist(), toxic[some].tolist())
        empty = toxic[size == 0]
        none = float((empty.sum() + scorer.base) / (len(empty) + 1))
        model = spark.sparkContext.broadcast(scorer)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each example voted on by the others."""
            m = model.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = m.index.search_all([m.index.vector(i) for i in ids], K + 1)
                yield pa.RecordBatch.from_arrays([pa.array([m.vote([x for x in near if x[1] != i][:K]) for i, near in zip(ids, got)], pa.float64()), pa.array([m.labels[i] for i in ids], pa.int64())], names=["vote", "y"])

        votes = spark.range(len(some)).mapInArrow(vote, "vote double, y bigint").collect()
        steps = calibrate([(r.vote, r.y) for r in votes], scorer.base)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value if model else None
        for batch in batches:
            scores, ids = [0.0] * len(batch), [[]] * len(batch)
            if m:
                terms, counts, rest = (batch.column(c) for c in (1, 2, 3))
                for a in range(0, len(batch), 1024):
                    part = range(a, min(a + 1024, len(batch)))
                    units = [m.unit(terms[i].values.to_numpy(), counts[i].values.to_numpy(), rest[i].as_py()) for i in part]
                    for i, (t, _), near in zip(part, units, m.index.search_all(units)):
                        scores[i] = float(np.interp(m.vote(near), *steps)) if len(t) or rest[i].as_py() else none
                        ids[i] = [m.ids[j] for _, j in near[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "score", "neighbours"])

    scored = counted.mapInArrow(score, f"doc_id {kind}, score double, neighbours array<bigint>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, by what the labels of the rows that aren't held out teach; see score_toxicity()."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs, whatever their names.

    Rows that share an id (or have none) share its worst score: all of them stay or go. Equal rows stay as often as they
    occur; null and empty texts score as texts without words do. No rows give no rows.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    name = unused("_tox_id", docs)
    bad = scored.filter("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    bad = written(bad)  # ids only; its size is known, so that Spark broadcasts it only under its threshold
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")

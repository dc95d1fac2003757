"""Embedding near-duplicates by an inverted multi-index: product cells visited in multi-sequence order, then verified."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, written
from .vectors import matrix, packed

#: Least cosine of a link.
COSINE = 0.95
#: Part of the links that the traversal is to find, as calibrated on links of exactly that cosine.
RECALL = 0.995
#: Vectors that the codebooks are fitted on at most (those with the smallest hash, 256 a codeword), and codewords of a half at most.
SAMPLE, CODEWORDS = 65_536, 1024
#: Rows of a block of cells, about; larger cells are split.
BLOCK_ROWS = 4_096
SEED = 29


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin(distances(x[lo : lo + 4096], c), axis=1) for lo in range(0, len(x), 4096)])
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def multi_sequence(d1: np.ndarray, d2: np.ndarray, margin: float) -> list[tuple[int, int]]:
    """Cells (i, j) in ascending order of d1[i] + d2[j], to the last within `margin` of the nearest."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    limit, out = a[0] + b[0] + margin, []
    heap, row = [(a[0] + b[0], 0, 0)], [0] * len(a)
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            break
        out.append((int(o1[i]), int(o2[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class MultiIndex:
    """Independent codebooks of the two halves of unit vectors, and the margin that finds RECALL of the links.

    A pair is found if either end visits the other's cell. The margin is calibrated on made links: sampled vectors and
    partners at exactly the least cosine in random directions, the hardest case that counts.
    """

    def __init__(self, sample: np.ndarray, k: int, cosine: float = COSINE, recall: float = RECALL):
        self.half = max(1, sample.shape[1] // 2)
        self.c1, self.c2 = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        rng = np.random.default_rng(SEED + 1)
        x = np.repeat(sample[: 2048], max(1, 2048 // len(sample)), axis=0)
        n = rng.standard_normal(x.shape)
        n -= (n * x).sum(1)[:, None] * x
        norm = np.linalg.norm(n, axis=1)[:, None]
        y = cosine * x + math.sqrt(1 - cosine * cosine) * np.divide(n, norm, out=np.zeros_like(n), where=norm > 1e-9)
        (x1, x2), (y1, y2) = self.half_distances(x), self.half_distances(y)
        need = lambda a1, a2, b1, b2: a1[np.arange(len(a1)), b1.argmin(1)] + a2[np.arange(len(a1)), b2.argmin(1)] - a1.min(1) - a2.min(1)
        self.margin = float(np.quantile(np.minimum(need(x1, x2, y1, y2), need(y1, y2, x1, x2)), recall)) + 1e-9

    def half_distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = distances(x[:, self.half :], self.c2) if x.shape[1] > self.half else np.zeros((len(x), 1))
        return distances(x[:, : self.half], self.c1), d2

    @property
    def width(self) -> int:
        return len(self.c2)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1)[:, None]
    x = x / scale
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    n_links counts the other vectors found with a cosine of at least `cosine` (verified in double precision), equal ones
    included; component_id is the smallest id reachable by links. Unusable vectors (null, zero, or with null or
    non-finite components) link with nothing. Vectors of different lengths never link. Rows that repeat an id with equal
    vectors are each other's copies. No rows give no rows; other columns aren't read; rows with null ids are left as they are, with no links.

    Equal vectors are joined first, with partial aggregates, so a vector that a third of the rows share is one vector with
    a count. The distinct ones are residents of their cell and visit the cells near them; cells are dealt into blocks of
    about block_rows residents. A dense cell is split by hash into several blocks, and its visitors into as many groups:
    a task sees one block and one group, about 2 * block_rows vectors however dense the cell (with more where many
    vectors visit a cell that few live in), and its pairs slice by slice. Only link counts and a spanning set of links
    leave it. The driver holds the codebooks and one count per non-empty cell, at most CODEWORDS squared. Each length of
    vectors has its own index and turn.
    """
    spark = df.sparkSession
    rows = written(packed(df, id_col, vec_col).withColumn("h", F.unhex(F.md5("v"))))
    distinct = written(rows.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("h").alias("h")))
    found = None
    for dim, count in sorted(tuple(r) for r in distinct.groupBy("dim").count().collect()):
        got = _links(spark, distinct.filter(F.col("dim") == dim).drop("dim", "h"), count, cosine, recall, block_rows)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "rep bigint, links bigint, other bigint")
    found = written(found)
    counts = found.filter("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("c_rep"), "comp")
    reps = distinct.join(counts.withColumnRenamed("rep", "n_rep"), F.col("rep") == F.col("n_rep"), "left").join(comps, F.col("rep") == F.col("c_rep"), "left")
    reps = reps.select(F.col("h").alias("r_h"), F.col("dim").alias("r_dim"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    linked = rows.join(written(reps), (F.col("h") == F.col("r_h")) & (F.col("dim") == F.col("r_dim"))).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    # An id that repeats with other vectors has links of each; its component is the smaller.
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")).withColumnRenamed("vec_id", "l_id")
    every = df.select(F.col(id_col).cast("long").alias("vec_id"))
    got = every.join(linked, F.col("vec_id") == F.col("l_id"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(spark: SparkSession, vectors: DataFrame, count: int, cosine: float, recall: float, block_rows: int) -> DataFrame:
    """From (v, rep, n) of one length: (rep, links, null) partial counts, and (rep, null, other) of a spanning set of links."""
    k = min(CODEWORDS, 1 << max(1, math.ceil(math.log2(max(2, math.sqrt(count / 16))))))
    sample = vectors.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(min(SAMPLE, max(4096, 256 * k))).collect()
    index = MultiIndex(unit(np.stack([np.frombuffer(r.v, dtype="<f8") for r in sample])), k, cosine, recall)
    width = index.width

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d1, d2 = index.half_distances(unit(matrix(b.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(d1.argmin(1) * width + d2.argmin(1), pa.int64())], names=["cell"])

    load = sorted((r.cell, r["count"]) for r in vectors.select("v").mapInArrow(cells, "cell bigint").groupBy("cell").count().collect())
    first, split, used, block = {}, {}, 0, 0  # a cell's first block, and its number of blocks
    for cell, n in load:
        if used and used + n > block_rows:
            block, used = block + 1, 0
        first[cell], split[cell] = block, -(-n // block_rows)
        used += n
        if split[cell] > 1:
            block, used = block + split[cell], 0
    lay = np.full((len(index.c1) * width, 2), -1, dtype=np.int64)
    for cell in first:
        lay[cell] = first[cell], split[cell]
    shared = spark.sparkContext.broadcast((index, lay))  # CODEWORDS squared rows at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lay = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2 = index.half_distances(unit(matrix(b.column(0))))
            at, blocks, flags = [], [], []
            for r, rep in enumerate(b.column(1).to_pylist()):
                home = int(d1[r].argmin()) * width + int(d2[r].argmin())
                h = rep * 2654435761 % 2**32
                f, s = (int(x) for x in lay[home])
                mine = f + h % s
                # (block, group) -> 1: lives there, 2: visits there; a block that is one of s of a cell has s groups of visitors.
                to = {(mine, g): 1 for g in range(s)}
                to[mine, (h >> 8) % s] = 3
                for i, j in multi_sequence(d1[r], d2[r], index.margin):
                    f, s = (int(x) for x in lay[i * width + j])
                    if f >= 0:
                        for x in range(f, f + s):
                            to[x, (h >> 8) % s] = to.get((x, (h >> 8) % s), 0) | 2
                at += [r] * len(to)
                blocks += [x << 20 | g for x, g in to]
                flags += to.values()
            part = pa.Table.from_batches([b]).take(pa.array(at, pa.int64()))
            part = part.append_column("task", pa.array(blocks, pa.int64())).append_column("flag", pa.array(flags, pa.int32())).combine_chunks()
            yield from part.to_batches()

    def verify(t: pa.Table) -> pa.Table:
        index, _ = shared.value
        x = unit(matrix(t.column("v")))
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        flag = t.column("flag").to_numpy()
        lives, visits = flag & 1 == 1, flag & 2 == 2
        d1, d2 = index.half_distances(x)
        i1, i2 = d1.argmin(1), d2.argmin(1)
        home, limit = i1 * width + i2, d1.min(1) + d2.min(1) + index.margin
        links, label = np.zeros(len(rep), dtype=np.int64), rep.copy()
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        for cell in np.unique(home[lives]):
            here = np.nonzero(lives & (home == cell))[0]
            visit = np.nonzero(visits & (d1[:, cell // width] + d2[:, cell % width] <= limit))[0]
            for lo in range(0, len(visit), 512):
                p = visit[lo : lo + 512]
                a, b = np.nonzero(x[p] @ x[here].T >= cosine)
                a, b = p[a], here[b]
                # A pair met from both ends counts where the smaller id visits.
                twice = (d1[b, i1[a]] + d2[b, i2[a]] <= limit[b]) | (home[a] == home[b])
                keep = (a != b) & (~twice | (rep[a] < rep[b]))
                a, b = a[keep], b[keep]
                links += np.bincount(a, n[b], minlength=len(rep)).astype(np.int64) + np.bincount(b, n[a], minlength=len(rep)).astype(np.int64)
                was, changed = label.copy(), len(a) > 0
                while changed:  # the smallest id that links of this slice, and labels so far, reach
                    before = label.copy()
                    low = np.minimum(label[a], label[b])
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                    changed = not np.array_equal(before, label)
                new = np.nonzero(label != was)[0]
                stars.append((was[new], label[new]))  # what either label stood for is connected
        some = np.nonzero(links)[0]
        star = np.unique(np.concatenate([np.stack(q, axis=1) for q in stars]), axis=0) if stars else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"rep": pa.array(np.concatenate([rep[some], star[:, 0]]), pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * len(star)], pa.int64()), "other": pa.array([*[None] * len(some), *star[:, 1].tolist()], pa.int64())})

    sent = vectors.select("v", "rep", "n").mapInArrow(route, "v binary, rep bigint, n bigint, task bigint, flag int")
    return sent.groupBy("task").applyInArrow(lambda t: verify(t), "rep bigint, links bigint, other bigint")


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all rows of embeddings; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square stopping test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import matrix, usable

#: Dimensions of the projection, points of a leaf in a cell's tree, queries that walk it together.
PROJECTED, LEAF, WALK = 8, 256, 512
#: The search stops once a point nearer than the k-th best would have been met with this probability.
SURE = 0.98
#: Candidates of a cell, about, and queries that meet a cell in one task.
CELL_ROWS, QUERY_ROWS = 8_192, 16_384
#: Rows whose projections choose the cells' planes at most (those with the smallest hash of the id).
SAMPLE = 65_536
SEED = 23


def chi2_cdf(x: np.ndarray | float, m: int) -> np.ndarray:
    """Of the chi-square distribution with an even number m of degrees of freedom."""
    h = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


@lru_cache(maxsize=64)
def chi2_ppf(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


class Projection:
    """Gaussian (2-stable) projections of vectors of one length, for the largest inner products.

    With M the largest norm, a point gets one more component, sqrt(M^2 - |x|^2), and a query is scaled to norm M with 0
    there: |q - x|^2 = 2 M^2 - 2 <q, x>. Projections of a point at distance d lie at a squared distance of d^2 times a
    chi-square variable with m degrees of freedom. All is taken in units of `scale`, the largest component of all, so that
    M is no more than sqrt(dim) and neither tiny nor huge vectors under- or overflow.
    """

    def __init__(self, dim: int, scale: float, m2: float, m: int = PROJECTED, seed: int = SEED):
        self.scale, self.m2, self.m = scale, m2, m
        self.a = np.random.default_rng(seed).standard_normal((dim + 1, m))

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, self.m2 - (x * x).sum(axis=1)))[:, None]]) @ self.a

    def queries(self, q: np.ndarray) -> np.ndarray:
        return math.sqrt(self.m2) * unit(q) @ self.a[:-1]

    def squared(self, cosine: np.ndarray) -> np.ndarray:
        """The squared distance of a point whose inner product with the query's unit vector is `cosine` (in units of scale)."""
        return np.maximum(2 * self.m2 - 2 * cosine * math.sqrt(self.m2), 1e-12 * self.m2)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q in double precision; where a sum over- or underflows on the way, of scaled vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * q).sum(axis=1)
    odd = np.flatnonzero(~np.isfinite(s))
    if len(odd):
        a, b = np.abs(x[odd]).max(axis=1), float(np.abs(q).max())
        with np.errstate(over="ignore"):
            s[odd] = ((x[odd] / a[:, None]) * (q / b)).sum(axis=1) * a * b
    return s


class Cells:
    """The top of the kd-tree over projected points: planes at medians, as deep as `cells` cells need."""

    def __init__(self, p: np.ndarray, cells: int):
        m = p.shape[1]
        self.planes: list[tuple[int, int, float] | None] = []  # by node, children at 2 i + 1 and 2 i + 2 of a heap: axis, value
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.first, self.count = (1 << depth) - 1, 1 << depth
        self.axis, self.at = np.zeros(self.first, np.int64), np.zeros(self.first)
        low, high = np.full((self.first + self.count, m), -np.inf), np.full((self.first + self.count, m), np.inf)
        held = {0: np.arange(len(p))}
        for node in range(self.first):
            mine = held.pop(node)
            if len(mine):
                self.axis[node] = int(np.argmax(np.ptp(p[mine], axis=0)))
                self.at[node] = float(np.median(p[mine, self.axis[node]]))
            axis, at = self.axis[node], self.at[node]
            for child, side in ((2 * node + 1, p[mine, axis] <= at), (2 * node + 2, p[mine, axis] > at)):
                low[child], high[child] = low[node], high[node]
                held[child] = mine[side]
            high[2 * node + 1, axis] = min(high[node, axis], at)
            low[2 * node + 2, axis] = max(low[node, axis], at)
        self.low, self.high = low[self.first :], high[self.first :]

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        while len(p) and node[0] < self.first:  # all are at the same depth
            node = 2 * node + 1 + (p[rows, self.axis[node]] > self.at[node])
        return node - self.first

    def away(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distances to the cells' regions."""
        out = np.zeros((len(p), self.count))
        for j in range(p.shape[1]):
            gap = np.maximum(0, np.maximum(self.low[None, :, j] - p[:, j, None], p[:, j, None] - self.high[None, :, j]))
            out += gap * gap
        return out


class ProjectedTree:
    """A kd-tree over the projections of a cell's points, which many queries walk together.

    Each query meets the leaves in ascending order of projected distance, a few at a time (1, 2, 4, ...), and the leaf's
    points are verified by their inner products. It stops when the next leaf is so far off that, by the chi-square test, a
    point nearer than its k-th best would have been met before with probability `sure`.
    """

    def __init__(self, x: np.ndarray, projection: Projection):
        self.projection = projection
        p = projection.points(x)
        self.order = np.arange(len(x))
        cuts, stack = [], [(0, len(x))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF:
                cuts.append((lo, hi))
                continue
            part = self.order[lo:hi]
            axis = int(np.argmax(np.ptp(p[part], axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = part[np.argpartition(p[part, axis], mid)]
            stack += [(lo + mid, hi), (lo, lo + mid)]
        self.cuts = sorted(cuts)
        self.low = np.array([p[self.order[a:b]].min(axis=0) for a, b in self.cuts])
        self.high = np.array([p[self.order[a:b]].max(axis=0) for a, b in self.cuts])
        self.x = np.ascontiguousarray(x[self.order] / projection.scale)

    def search(self, q: np.ndarray, k: int, sure: float | None, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of the best k of each query at least, with all ties at the k-th place among those met.

        bound: what the k-th best has at least, as products with the queries' unit vectors in units of scale (-inf: unknown).
        """
        pr, u, n = self.projection, unit(q), len(q)
        near = pr.queries(q)
        away = np.zeros((n, len(self.cuts)))
        for j in range(pr.m):
            gap = np.maximum(0, np.maximum(self.low[None, :, j] - near[:, j, None], near[:, j, None] - self.high[None, :, j]))
            away += gap * gap
        order = np.argsort(away, axis=1, kind="stable")
        limit = chi2_ppf(sure, pr.m) if sure is not None else math.inf
        slack = 1e-9 * math.sqrt(pr.m2)
        kth, open_, at, step = bound.copy(), np.arange(n), 0, 1
        got_q, got_p, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while len(open_) and at < len(self.cuts):
            leaves = order[open_, at : at + step]
            far = np.take_along_axis(away[open_], leaves, axis=1)
            with np.errstate(invalid="ignore"):
                most = limit * pr.squared(np.where(kth[open_] > -np.inf, kth[open_], -math.sqrt(pr.m2)))
            go = far <= np.where(kth[open_] > -np.inf, most, np.inf)[:, None]
            rows, column = np.nonzero(go)
            which, asks = leaves[rows, column], open_[rows]
            by = np.argsort(which, kind="stable")
            ends = np.flatnonzero(np.concatenate([which[by][1:] != which[by][:-1], [True]])) + 1 if len(by) else []
            lists, begin = [(got_q, got_p, got_s)], 0
            for end in ends:
                qs = asks[by[begin:end]]
                a, b = self.cuts[which[by[begin]]]
                begin = end
                s = u[qs] @ self.x[a:b].T
                i, j = np.nonzero(s >= (kth[qs] - slack)[:, None])
                lists.append((qs[i], a + j, s[i, j]))
            got_q, got_p, got_s = (np.concatenate(c) for c in zip(*lists))
            by = np.lexsort((-got_s, got_q))
            got_q, got_p, got_s = got_q[by], got_p[by], got_s[by]
            start = np.searchsorted(got_q, np.arange(n))
            size = np.diff(np.append(start, len(got_q)))
            full = np.flatnonzero(size >= k)
            kth[full] = np.maximum(kth[full], got_s[start[full] + k - 1])
            keep = got_s >= kth[got_q] - slack
            got_q, got_p, got_s = got_q[keep], got_p[keep], got_s[keep]
            open_ = open_[go.all(axis=1)]
            at, step = at + step, step * 2
        return got_q, self.order[got_p]


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sure: float | None = SURE, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest by inner product, in double precision, of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Candidates are all rows but the query's own; ties go to the smaller id; with fewer candidates, all of them. sure=None
    looks at every cell and leaf, which is exact. Vectors of another length than the query's aren't candidates of it. Rows
    with unusable vectors (see packed) or null ids take no part; rows that repeat an id are each a candidate of other ids,
    and each a query. Scores beyond the range of doubles are infinite and tie. No rows give no rows; other columns aren't read.

    Planes at medians of projected rows (at most SAMPLE) cut the projected space into cells of about cell_rows candidates.
    A query visits the cell it lies in first; its k-th best there bounds the chi-square test, by which it then visits only
    cells that may hold a better one, with that bound. A task holds a cell and at most about query_rows of its queries; a
    cell that more queries visit is read by several tasks. Of equal vectors the k + 1 smallest ids are candidates, cut
    before any shuffle of them (no query can have more), so a vector that a third of the rows share is no hot cell.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    same = Window.partitionBy("dim", "v").orderBy("id")
    cand = rows.withColumn("rn", F.dense_rank().over(same)).filter(F.col("rn") <= k + 1).select("dim", "id", "v")
    found = None
    for dim, n in sorted(tuple(r) for r in rows.groupBy("dim").count().collect()):  # one turn for each length of vectors
        got = _of_dim(cand.filter(F.col("dim") == dim).select("id", "v"), rows.filter((F.col("dim") == dim) & (F.col("id") % every == 0)).select("id", "v"), dim, n, k, sure, cell_rows, query_rows)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.sql("select cast(null as bigint) query_id, cast(null as int) rank, cast(null as bigint) vec_id, cast(null as double) score where false")
    order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_dim(cand: DataFrame, asks: DataFrame, dim: int, n: int, k: int, sure: float | None, cell_rows: int, query_rows: int) -> DataFrame:
    spark = cand.sparkSession

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                top = np.abs(x).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(np.linalg.norm(x / top[:, None], axis=1))], names=["top", "norm"])

    tops = cand.select("v").mapInArrow(largest, "top double, norm double")
    scale = tops.agg(F.max("top")).first()[0] or 1.0
    m2 = tops.agg(F.max(F.col("top") / F.lit(scale) * F.col("norm"))).first()[0] or 1.0
    pr = Projection(dim, scale, m2 * m2)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in pr.points(matrix(b.column(1)))], pa.binary())], names=["id", "p"])

    sample = np.zeros((0, pr.m))
    if n > cell_rows:  # the same rows whatever their order: those with the smallest hash of the id, a fixed bound
        sample = matrix(cand.mapInArrow(project, "id bigint, p binary").orderBy(F.xxhash64("id"), "id", "p").limit(SAMPLE).select("p").toArrow().column("p"))
    cells = Cells(sample, max(1, math.ceil(n / cell_rows)))
    shared = spark.sparkContext.broadcast((pr, cells))  # 2 (dim + 1) m doubles, and 2 m + 2 a cell
    limit = chi2_ppf(sure, pr.m) if sure is not None else math.inf

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pr, cells = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(pr.points(matrix(b.column(1)))), pa.int64())], names=["id", "v", "cell"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pr, cells = shared.value
        for b in batches:
            if b.num_rows:
                to = cells.of(pr.queries(matrix(b.column(2))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.float64()), pa.array(to, pa.int64())], names=["id", "q_row", "v", "bound", "cell"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pr, cells = shared.value
        step = max(1, (1 << 22) // cells.count)
        for b in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            away = cells.away(pr.queries(matrix(b.column(2))))
            mine = np.array(b.column(4).to_pylist())
            bound = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            most = np.where(np.isnan(bound), np.inf, limit * pr.squared(np.where(np.isnan(bound), 0, bound)))
            go = away <= most[:, None]
            go[np.arange(len(mine)), mine] = False
            at, to = np.nonzero(go)
            for lo in range(0, len(at), 8192):
                part = pa.Table.from_batches([b]).take(pa.array(at[lo : lo + 8192], pa.int64())).combine_chunks()
                yield from part.set_column(4, "cell", pa.array(to[lo : lo + 8192], pa.int64())).to_batches()

    def run(t: pa.Table) -> pa.Table:
        pr, _ = shared.value
        asking = np.array(t.column("asks").to_pylist(), dtype=bool)
        ids, x = t.column("id").to_numpy(), matrix(t.column("v"))
        pool, pool_ids = x[~asking], ids[~asking]
        rows_ = t.column("q_row").to_numpy(zero_copy_only=False)[asking]
        bound = t.column("bound").to_numpy(zero_copy_only=False).astype(float)[asking]
        out: list[tuple] = []
        if len(pool) and asking.any():
            tree = ProjectedTree(pool, pr)
            own = int(np.unique(pool_ids, return_counts=True)[1].max())  # rows of a query's id, which it leaves out
            for lo in range(0, int(asking.sum()), WALK):
                q, qid, qrow, b = x[asking][lo : lo + WALK], ids[asking][lo : lo + WALK], rows_[lo : lo + WALK], bound[lo : lo + WALK]
                qs, at = tree.search(q, k + own, sure, np.where(np.isnan(b), -np.inf, b))
                ends = np.searchsorted(qs, np.arange(len(q) + 1))
                u = unit(q)
                for i in range(len(q)):
                    mine = at[ends[i] : ends[i + 1]]
                    mine = mine[pool_ids[mine] != qid[i]]
                    s, v = products(pool[mine], q[i]), pool_ids[mine]
                    top = np.lexsort((v, -s))[:k]
                    close = np.sort(pool[mine[top]] / pr.scale @ u[i])[::-1]
                    # What the query's k-th best has at least, once it has met k.
                    best = float(close[-1]) if len(top) == k else math.nan
                    out += [(int(qid[i]), int(qrow[i]), int(v[j]), float(s[j]), best) for j in top]
        names = ["query_id", "q_row", "vec_id", "score", "bound"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t_) for c, t_ in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    def visit(asked: DataFrame) -> DataFrame:
        """asked: (id, q_row, v, bound, cell); the rows of run() over all cells that are asked."""
        groups = asked.groupBy("cell").count().select(F.col("cell").alias("g_cell"), F.ceil(F.col("count") / query_rows).cast("int").alias("groups"))
        groups = written(groups)  # a row a cell
        none = F.lit(None)
        asked = asked.join(groups, F.col("cell") == F.col("g_cell")).select("cell", F.pmod(F.col("q_row"), F.col("groups")).cast("int").alias("grp"), F.lit(True).alias("asks"), "id", "v", "q_row", "bound")
        pool = placed.join(groups, F.col("cell") == F.col("g_cell")).select("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(False).alias("asks"), "id", "v", none.cast("bigint").alias("q_row"), none.cast("double").alias("bound"))
        return written(pool.unionByName(asked).groupBy("cell", "grp").applyInArrow(run, "query_id bigint, q_row bigint, vec_id bigint, score double, bound double"))

    placed = written(cand.mapInArrow(place, "id bigint, v binary, cell bigint"))
    asks = written(asks.withColumn("q_row", F.monotonically_increasing_id()).select("id", "q_row", "v").mapInArrow(home, "id bigint, q_row bigint, v binary, bound double, cell bigint"))
    first = visit(asks)
    found = first
    if cells.count > 1:
        bounds = first.groupBy(F.col("q_row").alias("b_row")).agg(F.max("bound").alias("b"))
        known = asks.join(bounds, F.col("q_row") == F.col("b_row"), "left").select("id", "q_row", "v", F.when(~F.isnan("b"), F.col("b")).alias("bound"), "cell")
        second = visit(written(known.mapInArrow(onward, "id bigint, q_row bigint, v binary, bound double, cell bigint")))
        found = first.unionByName(second)
    return found.select("query_id", "q_row", "vec_id", "score")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every row of embeddings whose vec_id is divisible by 20; see nearest()."""
    return nearest(table(spark, sf_dir, "embeddings"))

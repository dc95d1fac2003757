"""Best-fit packing of tokenised documents into sequences under limits of tokens, documents and attention cost."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import table, written
from .store import encode_packed

#: Tokens of a sequence, and the id after each document.
TOKENS, END_ID = 4096, 1
#: Pieces that one task packs together.
SHARE = 1 << 13
#: Rounds in which sequences with room left are packed again, at most.
ROUNDS = 6


def best_fit(sizes: np.ndarray, capacity: np.ndarray, rule: str = "norm", weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, tokens before it in the bin) of each item of a share; sizes: one row an item, one column a capacity, tokens first.

    Items come in order of falling weighted size. Each goes to an open bin with room left in every column: by "norm" the
    one that it leaves the least weighted residual, by "dot" the one whose residual has the largest weighted dot product
    with the item; the earliest where several do equally well; a new bin where none has room. weights default to the share of a
    column's capacity that an average item takes, so that the scarce column counts.
    """
    n, d = sizes.shape
    part = sizes / capacity
    if weights is None:
        mean = part.mean(axis=0) if n else np.ones(d)
        weights = mean / mean.sum()
    order = np.lexsort((np.arange(n), -(part @ weights)))
    left = np.empty((d, n), dtype=np.float64)  # of open bins, in parts of the capacities
    room = np.empty((d, n), dtype=np.int64)
    ident = np.empty(n, dtype=np.int64)
    used = np.zeros(n, dtype=np.int64)
    bins, before, opened, live = np.empty(n, np.int64), np.empty(n, np.int64), 0, 0
    # Least sizes of all items still to come: a bin without room for these is closed.
    ahead = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]
    for k, i in enumerate(order):
        if k % 256 == 0 and live:
            keep = (room[:, :live] >= ahead[k][:, None]).all(axis=0)
            m = int(keep.sum())
            if m < live:
                for a in (left, room):
                    a[:, :m] = a[:, :live][:, keep]
                ident[:m] = ident[:live][keep]
                live = m
        fits = np.flatnonzero((room[:, :live] >= sizes[i][:, None]).all(axis=0))
        if len(fits):
            rest = left[:, fits]
            if rule == "norm":
                at = fits[np.argmin(weights @ (rest - part[i][:, None]) ** 2)]
            else:
                at = fits[np.argmax((weights * part[i]) @ rest)]
        else:
            at = live
            left[:, at], room[:, at], ident[at] = 1.0, capacity, opened
            opened, live = opened + 1, live + 1
        b = ident[at]
        bins[i], before[i] = b, used[b]
        used[b] += sizes[i][0]
        room[:, at] -= sizes[i]
        left[:, at] = room[:, at] / capacity
    return bins, before


def _pack_shares(items: DataFrame, capacity: tuple[int, int, int], rule: str, share: int, first: int) -> DataFrame:
    """(item, sequence_id, before) of rows (item, tokens, documents, attention), share by share; ids from `first` on, a range for each share."""
    shares = max(1, math.ceil(items.count() / share))
    limit = np.array(capacity, dtype=np.int64)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("item")
        sizes = np.stack([t.column(c).to_numpy() for c in ("tokens", "documents", "attention")], axis=1)
        bins, before = best_fit(sizes, limit, rule)
        base = first + (t.column("share")[0].as_py() << 32)
        return pa.table({"item": t.column("item"), "sequence_id": pa.array(base + bins, pa.int64()), "before": pa.array(before, pa.int64())})

    # Shares are dealt by the item, which is a row's own number, so that none is larger than about `share`.
    dealt = items.withColumn("share", F.pmod(F.xxhash64("item", F.lit(first)), F.lit(shares)))
    return written(dealt.groupBy("share").applyInArrow(run, "item bigint, sequence_id bigint, before bigint"))


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, rule: str = "norm", share: int = SHARE) -> DataFrame:
    """(item, sequence_id, offset) for rows (item, length): item a row's own number, length from 1 to `tokens`.

    A sequence holds at most `tokens` tokens, `documents` pieces (None: as many as tokens) and `attention` cost, the sum of
    its pieces' squared lengths (None: that of one full piece); offsets are gapless from 0. Pieces of full length are
    sequences of their own; the others are dealt into shares of about `share`, and each share is packed by best_fit() in a
    task. Then the pieces of all sequences that have room for the smallest sequence are dealt and packed again, until they
    are one share or a round saves less than one in a hundred of these sequences; a round that saves none is dropped. A piece over one limit alone is an error. No rows give no rows.
    """
    capacity = (tokens, documents or tokens, attention or tokens**2)
    most = min(tokens, math.isqrt(capacity[2]))
    low, high = pieces.agg(F.min("length"), F.max("length")).first()
    if low is not None and (low < 1 or high > most):
        raise ValueError(f"a piece has {low if low < 1 else high} tokens; each must have 1 to {most}")
    full = pieces.filter(F.col("length") == tokens).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < tokens).select("item", F.col("length").cast("long").alias("tokens"), F.lit(1).cast("long").alias("documents"), (F.col("length").cast("long") * F.col("length")).alias("attention"))
    placed = _pack_shares(items, capacity, rule, share, 0)
    names = ("tokens", "documents", "attention")
    for n in range(1, ROUNDS + 1):
        each = placed.join(items.withColumnRenamed("item", "i_item"), F.col("item") == F.col("i_item")).drop("i_item")
        bins = written(each.groupBy("sequence_id").agg(*[F.sum(c).alias(c) for c in names]))
        least = bins.agg(*[F.min(c) for c in names]).first()
        room = F.lit(least[0] is not None)
        for c, x, cap in zip(names, least, capacity):
            room = room & (F.col(c) + F.lit(x) <= cap)
        open_ = bins.filter(room).select(F.col("sequence_id").alias("open"))
        was = open_.count()
        if was < 2:
            break
        again = written(each.join(open_, F.col("sequence_id") == F.col("open"), "left_semi").select("item", *names))
        moved = _pack_shares(again, capacity, rule, share, n << 56)
        now = moved.select("sequence_id").distinct().count()
        if now >= was:
            break
        kept = placed.join(open_, F.col("sequence_id") == F.col("open"), "left_anti")
        placed = written(kept.unionByName(moved))
        if now > 0.99 * was or again.count() <= share:
            break
    placed = placed.withColumnRenamed("before", "offset")
    return full.unionByName(placed)


def tokenised(docs: DataFrame, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, ids (if with_ids).

    A document's ids, with the end id last, are cut after every `tokens`; only the last piece may be shorter. Null texts
    are empty and have the end id alone.
    """
    tokenizer = tokenizer or vocabulary("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed = encode_packed([t or "" for t in part.column(1).to_pylist()], tokenizer)
                owner, rows = [], []
                for k, raw in enumerate(packed):
                    raw += end
                    for at in range(0, len(raw), 4 * tokens):
                        piece = raw[at : at + 4 * tokens]
                        owner.append(k)
                        rows.append((at // (4 * tokens), at // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<u4").astype(np.int32)] if with_ids else [])))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, rule: str = "norm", share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of docs: id_col, piece, start, length, ids_crc32, ids (if with_ids), sequence_id, offset.

    See tokenised() and pack(). Where the attention limit is below that of one full piece, documents are cut shorter, so that
    each piece fits. Rows of equal or null ids are documents of their own; repeated rows are packed as often as they
    occur. Texts of any length are taken whole. Other columns aren't read; no rows give no rows.

    Texts are encoded once, into a written table of pieces; only short rows (number, length) are shuffled, dealt evenly
    whatever the ids, so that no task packs more than about `share` pieces.
    """
    length = min(tokens, math.isqrt(attention or tokens**2))
    pieces = written(tokenised(docs, length, id_col, text_col, tokenizer, end_id, with_ids).withColumn("_item", F.monotonically_increasing_id()))
    places = pack(pieces.select(F.col("_item").alias("item"), "length"), tokens, documents, attention, rule, share)
    return pieces.join(places, F.col("_item") == F.col("item")).drop("_item", "item")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of TOKENS tokens, whose other limits a full sequence can't exceed; see pack_documents()."""
    return pack_documents(table(spark, sf_dir, "documents"))

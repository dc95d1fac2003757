"""Byte-level BPE encoding and decoding; each merge takes the leftmost pair of the lowest rank from a segment tree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Pieces whose ids a worker keeps; beyond it, new pieces are encoded each time they occur.
CACHE = 1 << 18
#: Larger pieces are never kept.
CACHE_BYTES = 64


class BytePairs:
    """Encodes pieces of bytes by merge ranks (rank = id), and decodes ids.

    The positions of a piece are the leaves of a segment tree; a leaf holds the rank of the pair that starts there with
    the next live neighbour, an inner node the leftmost minimum of its leaves as one integer (rank * size + position).
    A merge joins two live neighbours in a linked list and updates the two leaves whose pairs changed and the one that
    died, each in as many steps as the tree is high: n log n in all, so a piece of a million bytes is no trouble.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self._kept: dict[str, bytes] = {}
        n = max(self.words) + 1 if self.words else 1
        self.offsets = np.zeros(n + 1, dtype=np.int64)
        for i, b in self.words.items():
            self.offsets[i + 1] = len(b)
        self.lengths = self.offsets[1:].copy()
        self.offsets = np.cumsum(self.offsets)
        self.pool = np.frombuffer(b"".join(self.words.get(i, b"") for i in range(n)), dtype=np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                other, i = tree[i ^ 1], i >> 1
                least = value if value < other else other
                if tree[i] == least:
                    return
                tree[i] = value = least

        while tree[1] < none:
            i = tree[1] % size
            j = after[i]
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                r = ranks.get(parts[i] + parts[after[i]])
            else:
                r = None
            put(j, none)
            put(i, none if r is None else r * size + i)
            if before[i] >= 0:
                p = before[i]
                r = ranks.get(parts[p] + parts[i])
                put(p, none if r is None else r * size + p)
        return [ranks[b] for b in parts if b]

    def packed(self, piece: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if (got := self._kept.get(piece)) is None:
            raw = piece.encode("utf-8", "replace")
            got = np.array(self.encode_piece(raw), dtype="<u4").tobytes()
            if len(self._kept) < CACHE and len(raw) <= CACHE_BYTES:
                self._kept[piece] = got
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        at = np.arange(total, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.pool[at].tobytes()


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of texts: id_col, n_tokens, ids (array, if with_ids), ids_sha256, decoded_sha256.

    Each match of the pattern is encoded on its own, special tokens' strings like any other text; the ids are decoded
    again and both are hashed. path and pattern default to the production vocabulary. Null texts are empty: no ids, the hash of no bytes. Texts of any length are taken
    whole; repeated rows, null ids and other columns do no harm; no rows give no rows.

    One pass without a shuffle; a task holds one Arrow batch and a cache of CACHE pieces at most. A lost executor's tasks
    are simply run again.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    kind = next(f.dataType.simpleString() for f in texts.schema if f.name == id_col)
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, split = load(path), regex.compile(pattern).findall
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], []
            get, packed = pairs._kept.get, pairs.packed
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = b"".join([get(p) or packed(p) for p in split(text)])
                ids = np.frombuffer(raw, dtype="<u4")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            out = [batch.column(0), pa.array(counts, pa.int64())] + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []) + [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {kind}, n_tokens bigint" + (", ids array<int>" if with_ids else "") + ", ids_sha256 string, decoded_sha256 string"
    return texts.select(id_col, text_col).mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded, decoded and hashed; see encode()."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty, repeated rows and null ids give a row each, other columns aren't read; no rows give no rows.
    """
    return encode(docs, with_ids=False)

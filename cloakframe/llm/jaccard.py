"""N-gram Jaccard join by PartEnum signatures over word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, parts, table, unused, written
from .url_filter import MAX_BLOCKS, _block, _mask

#: Words of a shingle.
WORDS = 5
#: Linked: 4 * intersection >= 3 * union. The size bands and thresholds below are those of this similarity.
#: Signatures of more than so many distinct sets are common: their pairs are compared by pivots, not at once.
COMMON = 48
#: Signatures that a task holds before it sends them, and documents hashed at a time.
FLUSH, SLICE = 400_000, 250
#: Buckets of hashes, one of which a task works off at a time, at least (else one a partition): so many sets' names are sent.
BUCKETS = 64
#: Words whose hashes a worker keeps.
CACHE = 1 << 17

_U64 = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_hashes: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_hashes.__getitem__, words), dtype=_U64, count=len(words))
    except KeyError:
        get, xx = _hashes.get, xxhash.xxh3_64_intdigest
        out = np.empty(len(words), dtype=_U64)
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = xx(w)
                if len(_hashes) < CACHE and len(w) < 64:
                    _hashes[w] = h
            out[i] = h
        return out


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set of shingles, as sorted distinct 64-bit hashes.

    Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return, A-Z in
    lower case. A text of fewer than WORDS words has one shingle, the whole sequence; one without words has none.
    """
    worded = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # on bytes, ASCII only
    sizes = np.array([len(w) for w in worded], dtype=np.int64)
    h = _word_hashes([w for ws in worded for w in ws])
    n = len(h)
    total = np.zeros(max(0, n - WORDS + 1), dtype=_U64)
    for i in range(WORDS if n >= WORDS else 0):
        total += h[i : n - WORDS + 1 + i] * _ODD[i]
    total = _mixed(total)
    out, at = [], 0
    for ws, size in zip(worded, sizes.tolist()):
        if size >= WORDS:
            out.append(np.unique(total[at : at + size - WORDS + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=size)], dtype=_U64))
        else:
            out.append(np.zeros(0, dtype=_U64))
        at += size
    return out


def top_of(band: int) -> int:
    """The largest size of a band: 3, 7, 15, 31, ..."""
    return (4 << band) - 1


def band_of(size: int) -> int:
    return max(0, size.bit_length() - 2)


def spare(band: int) -> int:
    """Signatures that a pair shares beyond the first: so many of a document's may be common without harm.

    As many as a band's smallest sets have partitions for, up to sizes where signatures weigh in the shuffle.
    """
    u = top_of(band)
    return u // 16 if u >= 511 else 3 * u // 16 if u >= 31 else 2 if u == 15 else 0


def tags(size: int) -> list[tuple[int, int, int]]:
    """(tag, partitions, signatures) of a set: one tag for pairs within its band, one for pairs across each border it is near.

    Sets of a and b shingles that are similar enough differ in (a + b) / 7 of them at most; with k the most that is
    possible under a tag, of any k + 1 non-empty partitions one at least is the same in both.
    """
    out = []
    j = band_of(size)
    if j:
        out.append((2 * j, _partitions(top_of(j)), needed(j, False)))
    for low in (j, j - 1):
        if low >= 0:
            u = top_of(low)
            if 4 * size >= 3 * (u + 1) if low == j else 3 * size <= 4 * u:
                out.append((2 * low + 1, _partitions(u), needed(low, True)))
    return out


def _partitions(u: int) -> int:
    return u * 5 // 4 if u >= 511 else 16 * u if u >= 31 else 64 * u


def signatures(f: np.ndarray) -> np.ndarray:
    """The set's PartEnum signatures.

    The domain of hashes is cut into equal ranges, the partitions; a signature names a tag, a partition and the set's
    features in it. With the first level's partitions so small that equal ones are common among similar sets, the second
    level's subsets are single partitions. Only non-empty ones are enumerated, in order, until there are enough: of two
    similar sets, the one whose enumeration ends first shares at least one + spare() of them with the other. A set with
    too few non-empty partitions also has the signatures "too few", which such sets share.
    """
    out = []
    for tag, n, need in tags(len(f)):
        # The hashes are sorted, so partitions are runs of them; a partition has less than two on average.
        p = ((f >> _U64(32)) * _U64(n)) >> _U64(32)
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.append(starts[1:], len(f))[need - 1] if len(starts) >= need else len(f)
        few = len(starts) < need
        starts = starts[:need]
        sums = np.add.reduceat(_mixed(f[:ends] ^ _U64(tag * 2 + 1)), starts)
        out.append(_mixed(sums + p[starts] * _ODD[0] + _U64(tag * int(_ODD[1]) % 2**64)))
        if few:
            out.append(_mixed(np.arange(need, dtype=_U64) * _ODD[2] + _U64(tag * int(_ODD[3]) % 2**64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=_U64)


def key_of(f: np.ndarray) -> bytes:
    return hashlib.blake2b(f.tobytes(), digest_size=16).digest()


_SKETCH = "kind int, bucket int, doc_id bigint, n bigint, key binary, key8 bigint, blob binary, other bigint, m bigint"
_NAMES = [x.strip().split(" ")[0] for x in _SKETCH.split(",")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _packed(buckets: int, values: list[np.ndarray], keys: list[int], sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    """Sets' 64-bit values by range of the value, one blob a bucket: 6 bytes a value (the range is the rest), 16 a set."""
    value, doc = np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values])
    key, size = np.array(keys, dtype=np.int64), np.array(sizes, dtype="<u4")
    bucket = (((value >> _U64(32)) * _U64(buckets)) >> _U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    value, doc, bucket = value[order], doc[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        lo, hi = cut[b], cut[b + 1]
        used, many = np.unique(doc[lo:hi], return_counts=True)  # the sort is stable: values lie set by set
        six = np.ascontiguousarray(value[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :6]
        yield b, b"".join([len(used).to_bytes(4, "little"), key[used].tobytes(), size[used].tobytes(), many.astype("<u4").tobytes(), six.tobytes()])


def _sketch(buckets: int):
    """documents -> kind 0: (doc_id, n, key, key8); kind 1: signatures of new sets, packed by bucket of the signature."""

    def pack(sigs: list[np.ndarray], keys: list[int], sizes: list[int]) -> pa.RecordBatch:
        which, blobs = zip(*_packed(buckets, sigs, keys, sizes))
        return _batch(kind=[1] * len(which), bucket=which, blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # keys of the sets that this task has sent: 8 bytes a document of its own split
        sigs, keys, sizes, held = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                sets = features(part.column(1).to_pylist())
                names = [key_of(f) for f in sets]
                short = [int.from_bytes(k[:8], "little", signed=True) for k in names]
                yield _batch(kind=[0] * len(sets), bucket=[(lo + i) % buckets for i in range(len(sets))], doc_id=part.column(0), n=[len(f) for f in sets], key=names, key8=short)
                for f, k in zip(sets, short):
                    if len(f) >= 3 and k not in seen:
                        seen.add(k)
                        s = signatures(f)
                        sigs.append(s)
                        keys.append(k)
                        sizes.append(len(f))
                        held += len(s)
                if held >= FLUSH:
                    yield pack(sigs, keys, sizes)
                    sigs, keys, sizes, held = [], [], [], 0
        if sigs:
            yield pack(sigs, keys, sizes)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    keys = np.frombuffer(blob, dtype="<i8", count=n, offset=4)
    sizes = np.frombuffer(blob, dtype="<u4", count=n, offset=4 + 8 * n)
    many = np.frombuffer(blob, dtype="<u4", count=n, offset=4 + 12 * n)
    count = int(many.sum())
    sig = np.zeros((count, 8), dtype=np.uint8)
    sig[:, :6] = np.frombuffer(blob, dtype=np.uint8, count=6 * count, offset=4 + 16 * n).reshape(-1, 6)
    return sig.view("<i8").ravel(), np.repeat(keys, many), np.repeat(sizes, many).astype(np.int64)


def _similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes kind 0 on; kind 2: (key8, other, n: signatures that they need, m: that they share) of rare ones; kind 3: (key8, n, other: signature) of common ones.

    A partition holds its share of all signatures, which the number of partitions bounds; it is worked off by bucket.
    """
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        kind = batch.column(0).to_numpy()
        yield batch.filter(pa.array(kind == 0))
        sent = batch.filter(pa.array(kind == 1))
        for b, blob in zip(sent.column(1).to_pylist(), sent.column(6).to_pylist()):
            blobs.setdefault(b, []).append(blob)
    for bucket in list(blobs):
        sig, key, size = (np.concatenate(c) for c in zip(*map(_unpack, blobs.pop(bucket))))
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        sig, key, size = sig[order], key[order], size[order]
        order = np.lexsort((key, sig))
        sig, key, size = sig[order], key[order], size[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]) if len(sig) else np.zeros(0, dtype=bool)
        sig, key, size = sig[new], key[new], size[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.append(starts, len(sig)))
        a_all, b_all, n_all = [], [], []
        for n in np.unique(lengths):
            if 2 <= n <= COMMON:
                rows = starts[lengths == n][:, None] + np.arange(n)
                x, y = np.triu_indices(n, 1)
                step = max(1, 1_000_000 // len(x))
                for lo in range(0, len(rows), step):
                    a, b = rows[lo : lo + step][:, x].ravel(), rows[lo : lo + step][:, y].ravel()
                    near = _similar_sizes(size[a], size[b])
                    a, b = a[near], b[near]
                    a_all.append(key[a])
                    b_all.append(key[b])
                    n_all.append(_required(size[a], size[b]))
        if a_all:
            a, b, n = map(np.concatenate, (a_all, b_all, n_all))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
            count = np.diff(np.append(first, len(a)))
            for lo in range(0, len(first), 100_000):
                f = first[lo : lo + 100_000]
                yield _batch(kind=np.full(len(f), 2), key8=a[f], other=b[f], n=n[f], m=count[lo : lo + 100_000])
        hot = np.repeat(lengths > COMMON, lengths)
        if hot.any():
            name = (sig[hot].view(_U64) ^ _mixed(np.array([bucket], dtype=_U64))).view(np.int64)
            for lo in range(0, len(name), 100_000):
                cut = slice(lo, lo + 100_000)
                yield _batch(kind=np.full(len(name[cut]), 3), key8=key[hot][cut], n=size[hot][cut], other=name[cut])


def needed(low: int, cross: bool) -> int:
    """Signatures of a set under a tag: k + 1 + spare(), for pairs within a band or across its upper border."""
    u = top_of(low)
    return ((u + 4 * u // 3) // 7 if cross else 2 * u // 7) + 1 + spare(low)


def _required(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of signatures that similar sets of these sizes share: they differ in (a + b) / 7 shingles at most."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    bands = np.array([[needed(j, False), needed(j, True)] for j in range(band_of(int(high.max(initial=1))) + 1)])
    i, j = (np.maximum(0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 1) for x in (low, high))
    return bands[i, (i != j).astype(np.int64)] - (low + high) // 7


def _top(n: Column) -> Column:
    """top_of(band_of(n)) as an expression."""
    return F.call_function("shiftleft", F.lit(4).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(n)) - 2).cast("int")) - 1


def _needed(top: Column, cross: Column) -> Column:
    spare_ = F.when(top >= 511, F.floor(top / 16)).when(top >= 31, F.floor(top * 3 / 16)).when(top == 15, 2).otherwise(0)
    return F.when(cross, F.floor((top + F.floor(top * 4 / 3)) / 7)).otherwise(F.floor(top * 2 / 7)) + 1 + spare_


def _required_of(a: Column, b: Column) -> Column:
    """_required() as an expression."""
    low, high = F.least(a, b), F.greatest(a, b)
    return _needed(_top(low), _top(low) != _top(high)) - F.floor((a + b) / 7)


def _harmless(n: Column) -> Column:
    """So many common signatures leave a set of n shingles a rare one in common with every similar set.

    The least over its tags, for the largest partner that a tag allows.
    """
    top = _top(n)
    below, most = (top + 1) / 2 - 1, F.floor(n * 4 / 3)
    own = _needed(top, F.lit(False)) - F.floor((n + F.least(top, most)) / 7)
    up = F.when(4 * n >= 3 * (top + 1), _needed(top, F.lit(True)) - F.floor((n + most) / 7))
    down = F.when((top > 3) & (3 * n <= 4 * below), _needed(below, F.lit(True)) - F.floor((n + below) / 7))
    return F.least(F.when(top > 3, own), up, down, F.lit(1 << 30)) - 1


def _read_again(docs: DataFrame, names: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, text) of the representatives of the sets whose keys are in names (k).

    A blocked Bloom filter of at most MAX_BLOCKS words, so of bounded size, keeps the other texts out, so that no text is
    shuffled; a few others may pass, which do no harm: sets that nobody asks for.
    """
    wanted = written(reps.join(names.distinct(), F.col("r8") == F.col("k")).select("rep"))
    blocks = min(MAX_BLOCKS, max(16, wanted.count() // 2))
    bits = wanted.groupBy(_block(F.col("rep"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("rep"))).alias("bits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("at", _block(F.col("id"), blocks)).withColumn("mask", _mask(F.col("id")))
    return rows.join(F.broadcast(bits), (F.col("at") == F.col("block")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))).select("text")


def _short(f: np.ndarray) -> int:
    return int.from_bytes(key_of(f)[:8], "little", signed=True)


def _six(f: np.ndarray) -> bytes:
    """A sorted set by the upper 48 bits of its hashes."""
    return np.ascontiguousarray(f >> _U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _whole(raw) -> np.ndarray:
    six = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view(_U64).ravel()


def _sets(docs: DataFrame, names: DataFrame, reps: DataFrame) -> DataFrame:
    """(k, f) of the sets whose keys are in names (k), read again from their representatives' texts; a set may come once from each task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # 8 bytes a set of the task's own split
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                new = {k: f for f in features(batch.column(0).slice(lo, SLICE).to_pylist()) if (k := _short(f)) not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([_six(f) for f in new.values()], pa.binary())], names=["k", "f"])

    return written(_read_again(docs, names, reps).mapInArrow(sets, "k bigint, f binary"))


def _lone(docs: DataFrame, names: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(k, n, lone) of the sets named (k): their shingles, and those of them that no other of these sets has.

    Shingles meet by range of the hash, packed as the signatures are; counts go back packed by key.
    """
    buckets = max(BUCKETS, n)
    rows = _read_again(docs, names, reps)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        fs: list[np.ndarray] = []
        keys: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            which, blobs = zip(*_packed(buckets, fs, keys, [len(f) for f in fs]))
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for f in features(batch.column(0).slice(lo, SLICE).to_pylist()):
                    if len(f) >= 3 and (k := _short(f)) not in seen:
                        seen.add(k)
                        fs.append(f)
                        keys.append(k)
                        held += len(f)
                if held >= FLUSH:
                    yield flush()
                    fs, keys, held = [], [], 0
        if fs:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blobs.setdefault(b, []).append(blob)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in list(blobs):
            value, key, size = (np.concatenate(c) for c in zip(*map(_unpack, blobs.pop(b))))
            order = np.lexsort((key, value))
            value, key, size = value[order], key[order], size[order]
            same = value[1:] == value[:-1]
            again = same & (key[1:] == key[:-1])  # equal sets from several tasks are one
            other = same & ~again
            # A run of one value holds one set's key alone if no step within it changes the key.
            run = np.cumsum(np.concatenate([[0], ~same])) if len(value) else np.zeros(0, dtype=np.int64)
            several = np.bincount(run[1:][other], minlength=run[-1] + 1 if len(run) else 0) > 0
            first = np.concatenate([[True], ~again]) if len(value) else np.zeros(0, dtype=bool)
            found.append(_sums(key[first], size[first], ~several[run[first]]))
        if found:
            ks, sizes, lone = _sums(*(np.concatenate(c) for c in zip(*found)))
            to = (ks.view(_U64) >> _U64(32)) * _U64(n) >> _U64(32)
            order = np.argsort(to, kind="stable")
            ks, sizes, lone, to = ks[order].astype("<i8"), sizes[order].astype("<u4"), lone[order].astype("<u4"), to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])).tolist()
            parts_ = [slice(i, j) for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[p.start]) for p in parts_], pa.int32()), pa.array([int(p.stop - p.start).to_bytes(4, "little") + ks[p].tobytes() + sizes[p].tobytes() + lone[p].tobytes() for p in parts_], pa.binary())], names=["bucket", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got.setdefault(b, []).append(blob)
        for b in list(got):
            rows_ = []
            for blob in got.pop(b):
                c = int.from_bytes(blob[:4], "little")
                rows_.append((np.frombuffer(blob, "<i8", c, 4), np.frombuffer(blob, "<u4", c, 4 + 8 * c), np.frombuffer(blob, "<u4", c, 4 + 12 * c)))
            ks, sizes, lone = _sums(*(np.concatenate(x) for x in zip(*rows_)))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(lone.astype(np.int64))], names=["k", "n", "lone"])

    met = rows.mapInArrow(spread, "bucket int, blob binary").repartitionById(n, F.col("bucket") % n).mapInArrow(meet, "bucket int, blob binary")
    return met.repartitionById(n, "bucket").mapInArrow(add, "k bigint, n bigint, lone bigint")


def _sums(key: np.ndarray, size: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their size, and the sum of lone."""
    ks, at = np.unique(key, return_inverse=True)
    sizes = np.zeros(len(ks), dtype=np.int64)
    sizes[at] = size
    return ks, sizes, np.bincount(at, lone, minlength=len(ks))


def _verified(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a8, b8) of sets, the links (a, b) between their keys, compared exactly."""
    # Only the sets of these pairs move, and no more of them than there are pairs.
    mine = pairs.select(F.col("a8").alias("p")).unionByName(pairs.select(F.col("b8").alias("p"))).distinct()
    made = made.join(written(mine), F.col("k") == F.col("p"), "left_semi")
    left = made.select(F.col("k").alias("ka"), F.col("f").alias("fa"))
    right = made.select(F.col("k").alias("b"), F.col("f").alias("fb"))
    both = pairs.join(left, F.col("a8") == F.col("ka")).select(F.col("a8").alias("a"), "b8", "fa").join(right, F.col("b8") == F.col("b")).select("a", "b", "fa", "fb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _whole(x.as_buffer()), _whole(y.as_buffer())
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                good.append(4 * common >= 3 * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return written(both.mapInArrow(compare, "a bigint, b bigint"))


#: Sets of a block, when all sets under common signatures are compared.
BLOCK = 1024


def _block_links(t: pa.Table) -> pa.Table:
    """A spanning set of the links (a, b) within one block, or between two."""
    rep, which = t.column("key8").to_numpy(), np.array(t.column("own").to_pylist(), dtype=bool)
    sets = [_whole(x) for x in t.column("f").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    same = h[1:] == h[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    h, doc = h[shared], doc[shared]
    column = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else h.astype(np.int64)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(column.max(initial=-1)) + 1, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[doc[a:b], column[a:b] - lo] = 1
        common += m @ m.T
    near = 4 * common >= 3 * (sizes[:, None] + sizes[None] - common)
    if which.any() and not which.all():
        near &= which[:, None] != which[None]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    label = rep.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if np.array_equal(before, label):
            break
    star = np.nonzero(label != rep)[0]
    return pa.table({"a": pa.array(rep[star], pa.int64()), "b": pa.array(label[star], pa.int64())})


def _blockwise(made: DataFrame, held: DataFrame) -> DataFrame:
    """Links among the sets of held (key8, label, sigs) that share a signature, labels apart.

    Labels that share a signature make clusters; a cluster's sets are dealt into blocks of about BLOCK, those of a label with
    many sets into blocks of its own, and every two blocks meet in a task, but for two of one label. Pairs are counted
    there as matrix products and never leave it. A task holds two blocks, however large a cluster is.
    """
    marked = written(held.repartition(parts(held.sparkSession)).select("label", F.explode("sigs").alias("sig")).distinct())
    ends = marked.groupBy("sig").agg(F.min("label").alias("b"), F.count("*").alias("c")).filter("c > 1").select(F.col("sig").alias("e_sig"), "b")
    edges = marked.join(ends, F.col("sig") == F.col("e_sig")).select(F.col("label").alias("a"), "b").distinct()
    cluster = components(edges)
    cluster = written(cluster.unionByName(cluster.select(F.col("comp").alias("node"), "comp")).distinct())
    nodes = written(held.join(cluster, F.col("label") == F.col("node")).select("key8", "label", F.col("comp").alias("cluster")))
    by_label = nodes.groupBy(F.col("cluster").alias("c"), F.col("label").alias("l")).agg(F.count("*").alias("n"))
    by_cluster = by_label.groupBy("c").agg(F.sum(F.when(F.col("n") < BLOCK // 2, F.col("n"))).alias("rest"))
    big = by_label.filter(F.col("n") >= BLOCK // 2)
    n = nodes.join(big, (F.col("cluster") == F.col("c")) & (F.col("label") == F.col("l")), "left").drop("c", "l").join(by_cluster, F.col("cluster") == F.col("c"))
    own = F.when(F.col("n").isNotNull(), F.col("label")).otherwise(-1)
    share = F.pmod(F.xxhash64("key8"), F.ceil(F.coalesce("n", F.col("rest")) / BLOCK))
    n = written(n.select("key8", "cluster", F.struct(own.alias("own"), share.alias("part")).alias("blk")))
    listed = n.groupBy(F.col("cluster").alias("c")).agg(F.array_sort(F.collect_set("blk")).alias("all"))
    meets = F.filter("all", lambda o: (o["own"] != F.col("blk.own")) | (o["own"] == -1))
    sent = n.join(listed, F.col("cluster") == F.col("c")).select("key8", "cluster", "blk", F.explode(meets).alias("o"))
    sent = sent.select("key8", "cluster", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), (F.col("blk") <= F.col("o")).alias("own"))
    got = sent.join(made, F.col("key8") == F.col("k")).select("cluster", "x", "y", "own", "key8", "f")
    return written(got.groupBy("cluster", "x", "y").applyInArrow(_block_links, "a bigint, b bigint"))


def join_similar(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Documents link when 4 * |A and B| >= 3 * |A or B| for their sets of five-word shingles (see features). Null texts and
    texts without words have no shingles and link with nothing. Rows that repeat a doc_id are documents of their own that
    lie in one component if their sets are equal; null doc_ids follow their set's component, or stay null. No rows give no
    rows. Only doc_id and text are read.

    1. One pass over the texts sends each distinct set's signatures (8 bytes each, packed by hash bucket) to where equal
       ones meet. Equal sets are sent once per task and are one set where they meet.
    2. Rare signatures give pairs with the number of signatures that they share; similar pairs share one + spare() at
       least, less those of them that are common. Of common signatures, only sets with more than spare() of them remain.
    3. The candidates' shingles meet by hash. A set with a partner has three quarters of its shingles in common with it at
       least, so candidates with more lone shingles go, and pairs whose remaining shingles can't be enough. What shares
       but a passage, and copies too far from all others, end here, at a cost in proportion to their length.
    4. Each set is compared with the partner it shares most with, and with a central one under its common signatures;
       then the other pairs whose ends aren't yet connected: rare signatures' pairs one by one, sets under common ones
       block by block. Comparisons are exact and on whole texts, and every pair that could link is either compared or
       within one component already.
    """
    spark = docs.sparkSession
    n = parts(spark)
    pairs_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(max(BUCKETS, n)), _SKETCH)
    met = written(pairs_of.repartitionById(n, F.col("bucket") % n).mapInArrow(_collide, _SKETCH))
    rows = met.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "key", "key8")
    classes = written(rows.filter("n_shingles > 0").groupBy("key", "key8").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")))
    reps = classes.select(F.col("key8").alias("r8"), "rep").filter("rep is not null")
    shared = met.filter("kind = 2").groupBy(F.col("key8").alias("a8"), F.col("other").alias("b8")).agg(F.sum("m").alias("m"), F.min("n").alias("n"))
    # A set's own common signatures, as many as it has signatures at most, are one row.
    hot = met.filter("kind = 3").groupBy("key8").agg(F.count("*").alias("hot"), F.max("n").alias("n"), F.collect_list("other").alias("sigs"))
    hot = hot.withColumn("held", F.col("hot") > _harmless(F.col("n")))
    hot = written(hot.select("key8", "hot", "held", F.when(F.col("held"), F.col("sigs")).alias("sigs")))
    count = lambda k: hot.select(F.col("key8").alias(f"h_{k}"), F.col("hot").alias(f"hot_{k}"), F.col("held").alias(f"held_{k}"))
    rare = shared.join(count("a8"), F.col("a8") == F.col("h_a8"), "left").join(count("b8"), F.col("b8") == F.col("h_b8"), "left")
    # Two held sets meet under their common signatures, if they share any; without, they need rare ones alone.
    both = F.coalesce(F.col("held_a8") & F.col("held_b8"), F.lit(False))
    allowed = F.when(both, 0).otherwise(F.least(F.coalesce("hot_a8", F.lit(0)), F.coalesce("hot_b8", F.lit(0))))
    rare = written(rare.filter(F.col("m") >= F.col("n") - allowed).select("a8", "b8", "m"))

    named = rare.select(F.col("a8").alias("k")).unionByName(rare.select(F.col("b8").alias("k"))).unionByName(hot.filter("held").select(F.col("key8").alias("k")))
    alive = _lone(docs, named, reps, n).filter("4 * (n - lone) >= 3 * n")
    alive = written(alive.select("k", "n", (F.col("n") - F.col("lone")).alias("met")))
    size = lambda k: alive.select(F.col("k").alias(f"s_{k}"), F.col("n").alias(f"n_{k}"), F.col("met").alias(f"met_{k}"))
    rare = rare.join(size("a8"), F.col("a8") == F.col("s_a8")).join(size("b8"), F.col("b8") == F.col("s_b8"))
    rare = written(rare.filter(7 * F.least("met_a8", "met_b8") >= 3 * (F.col("n_a8") + F.col("n_b8"))).select("a8", "b8", "m"))
    held = written(hot.filter("held").join(alive, F.col("key8") == F.col("k")).select("key8", "hot", "sigs"))
    made = _sets(docs, rare.select(F.col("a8").alias("k")).unionByName(rare.select(F.col("b8").alias("k"))).unionByName(held.select(F.col("key8").alias("k"))), reps)

    # A text and its many edited copies share more common signatures than two copies do: each set looks to the one with
    # the most of them, under a few of its own, picked alike by all (least hashes). Only a choice of what to compare first.
    leaders = held.repartition(n).select("key8", "hot", F.explode("sigs").alias("l_sig")).groupBy("l_sig").agg(F.max(F.struct("hot", "key8"))["key8"].alias("leader"))
    few = F.array_distinct(F.array(*[F.array_min(F.transform("sigs", lambda s, i=i: F.struct(F.xxhash64(F.lit(i), s), s.alias("s"))))["s"] for i in range(4)]))
    stars = held.select("key8", F.explode(few).alias("sig")).join(leaders, F.col("sig") == F.col("l_sig")).filter("leader <> key8").groupBy(F.col("leader").alias("a8"), F.col("key8").alias("b8")).agg(F.count("*").alias("m"))
    each = rare.unionByName(rare.select(F.col("b8").alias("a8"), F.col("a8").alias("b8"), "m"))
    top = lambda p: p.groupBy("b8").agg(F.min(F.struct((-F.col("m")).alias("o"), "a8")).alias("x")).select(F.least("x.a8", "b8").alias("a8"), F.greatest("x.a8", "b8").alias("b8"))
    best = written(top(each).unionByName(top(stars)).distinct())
    links = _verified(made, best)

    comps = components(links)
    label = written(alive.select(F.col("k").alias("r8")).join(comps, F.col("r8") == F.col("node"), "left").select("r8", F.coalesce("comp", "r8").alias("label")))
    on = lambda k: label.select(F.col("r8").alias(f"l_{k}"), F.col("label").alias(f"label_{k}"))
    rest = rare.select("a8", "b8").join(on("a8"), F.col("a8") == F.col("l_a8")).join(on("b8"), F.col("b8") == F.col("l_b8")).filter("label_a8 <> label_b8").select("a8", "b8")
    rest = written(rest.join(best.select(F.col("a8").alias("d_a"), F.col("b8").alias("d_b")), (F.col("a8") == F.col("d_a")) & (F.col("b8") == F.col("d_b")), "left_anti"))
    held = written(held.join(label, F.col("key8") == F.col("r8")).select("key8", "label", "sigs"))
    more = [_verified(made, rest)] if not rest.isEmpty() else []
    more += [_blockwise(made, held)] if not held.isEmpty() else []
    for found in more:
        links = links.unionByName(found)
    if more:
        comps = components(links)
    named = classes.join(comps, F.col("key8") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "key8").alias("comp"))
    named = written(named)
    # Only components of several sets have to meet; their smallest key's own class has no row in comps.
    roots = written(comps.select(F.col("comp").alias("root")).distinct())
    several = named.join(roots, F.col("comp") == F.col("root"), "left_semi")
    least = several.groupBy(F.col("comp").alias("l_comp")).agg(F.min("rep").alias("least"))
    final = written(named.join(least, F.col("comp") == F.col("l_comp"), "left").select(F.col("key").alias("c_key"), F.coalesce("least", "rep").alias("comp")))
    got = rows.select("doc_id", "n_shingles", "key").join(final, (F.col("key") == F.col("c_key")) & (F.col("n_shingles") > 0), "left")
    return got.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and components of all documents; see join_similar()."""
    return join_similar(table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that with the smallest doc_id (nulls last; ties: by the text's hash), with the columns of docs.

    Rows are numbered, so repeated and null ids, and equal rows, are told apart. Null texts and texts without words are in
    no group and stay. Columns may have any names. No rows give no rows.
    """
    row, gone_row = unused("_row", docs), unused("_gone", docs)
    laid = written(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = laid.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    groups = written(join_similar(laid.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("g_row"), "component_id"))
    named = groups.join(slim, F.col("g_row") == F.col("row"))
    first = named.groupBy(F.col("component_id").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row"))["row"].alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = groups.join(first, F.col("component_id") == F.col("c")).filter("g_row <> first").select(F.col("g_row").alias(gone_row))
    return laid.join(written(gone), F.col(row) == F.col(gone_row), "left_anti").drop(row)

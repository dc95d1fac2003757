"""Token ids in a content-addressed store: chunks cut by rolling hashes, document recipes, Merkle roots."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import parts, prefix_sums, shared_dir, table, written
from .url_filter import MAX_BLOCKS, _block, _mask

#: The id after each document.
END_ID = 2
#: Ids that the rolling hash sees; a cut falls where its low bits are 0 (one place in 2**CUT_BITS), after LEAST ids at least
#: and MOST at most.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
#: Ids that a leaf of the manifest's tree covers, and children that an inner node has at most, as powers of two.
SPAN_BITS, FAN_BITS = 20, 12
#: Words and pieces whose ids a worker keeps, about.
CACHE = 1 << 20
#: Low bits of a place among the kept ids, which are their number; the others are where they begin.
_BITS = 30
_SIZE = (1 << _BITS) - 1

#: Any but the characters that the quick path may see: those up to U+00FF that Python and the library class alike, and common punctuation.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff‐-‧‰-⁞]").search
#: The file's own splitter for such texts in lower case (fixed value).
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, quick = Tokenizer.from_file(path), Tokenizer.from_file(path)
    # For pieces in lower case, one blank apart: nothing is left to lower and to split but at blanks.
    quick.normalizer = None
    quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
    return tokenizer, quick, {}, bytearray(), ends


def _library(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _learn(tokenizer, quick, ends: np.ndarray, pieces: list[str]) -> tuple[bytes, list[int]]:
    """The ids of the pieces, one behind the other, and where each piece's end: all in one call, a piece's last token ends it."""
    ids = np.array(quick.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
    cut = np.flatnonzero(ends[ids]) + 1
    if len(cut) == len(pieces):
        return ids.tobytes(), cut.tolist()
    each = [_library(tokenizer, p) for p in pieces]
    return b"".join(each), list(accumulate(len(x) >> 2 for x in each))


def encode_packed(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, by the tokenizers library.

    The tokenizer lower-cases, drops white space and encodes each piece of its splitter on its own. Texts of characters
    that Python surely splits alike are cut here, and each piece goes to the library once (until CACHE are known); any
    other text, and any with what may be a special token, goes to the library whole. Arrow parts the texts into words and
    numbers the different ones, so that Python looks each of them up once in a call.
    """
    tokenizer, quick, places, pool, ends = _tokenizer(path)
    whole = ["<|" in t or _OTHER(t) is not None for t in texts]
    lists = pc.utf8_split_whitespace(pa.array(["" if x else t for t, x in zip(texts, whole)], pa.large_string()))
    coded = pc.dictionary_encode(lists.flatten())
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    # A place: where in the pool the ids begin, and how many they are (in the low bits).
    place = np.fromiter(map(places.get, different, repeat(-1)), np.int64, len(different))
    missing, known, late = np.flatnonzero(place < 0), len(pool) >> 2, []
    if len(missing):
        new = [different[k] for k in missing.tolist()]
        # Most words are of letters a to z alone, so one piece.
        parted = [w.lower() if w.isascii() and w.isalpha() else _PIECES(w.lower()) for w in new]
        pieces = {p for p in parted if type(p) is str}.union(*[p for p in parted if type(p) is list])
        fresh = [p for p in pieces if p not in places]
        raw, cut = _learn(tokenizer, quick, ends, fresh)
        pool += raw
        places.update(zip(fresh, [known + i << _BITS | j - i for i, j in zip([0, *cut], cut)]))
        at = len(pool) >> 2
        for k, ps in enumerate(parted):
            if type(ps) is list:  # several pieces: their ids, joined
                if len(ps) != 1:
                    joined = b"".join([pool[4 * (x >> _BITS) : 4 * ((x >> _BITS) + (x & _SIZE))] for x in map(places.__getitem__, ps)])
                    pool += joined
                    parted[k] = at << _BITS | len(joined) >> 2
                    at += len(joined) >> 2
                else:
                    parted[k] = places[ps[0]]
            else:
                parted[k] = places[ps]
        places.update(zip(new, parted))
        place[missing] = parted
        late = [*fresh, *new]
    # Each word's ids from those of the different ones, all at once.
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = (place & _SIZE)[which]
    last = np.cumsum(n)
    ids = np.frombuffer(pool, dtype="<u4")[np.arange(n.sum()) + np.repeat((place >> _BITS)[which] - last + n, n)]
    at = np.concatenate([[0], last])[lists.offsets.to_numpy()].tolist()
    if len(places) > CACHE:  # what came too late is forgotten
        for w in late:
            places.pop(w, None)
        del pool[4 * known :]
    return [_library(tokenizer, t) if x else ids[i:j].tobytes() for t, x, i, j in zip(texts, whole, at, at[1:])]


_MIX = np.random.default_rng(20240101).integers(1, 2**32, size=1 << 16, dtype=np.uint64).astype(np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: by the last WINDOW ids alone, so that equal passages are cut alike."""
    n = len(ids)
    h = _MIX[ids & 0xFFFF] ^ (ids >> np.uint32(16)).astype(np.uint32)
    width = 1
    while width < WINDOW:  # the sum over twice the window, from two windows beside each other
        if n > width:
            h[width:] += np.left_shift(h[: n - width].copy(), np.uint32(2 * width))
        width *= 2
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1


def cuts(n: int, at: list[int]) -> list[int]:
    """Where the chunks of a document of n ids end, of the places `at`: LEAST to MOST ids each, the last one may be shorter.

    No place before LEAST counts, so marks may be taken over joined documents: WINDOW is less.
    """
    ends, last = [], 0
    for c in [*at, n]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST or c == n and c > last:
            ends.append(c)
            last = c
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """The root over chunk digests, leaves and nodes told apart by a first byte."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


class StoreDamaged(ValueError):
    """Recipes were lost, added or changed since the manifest was written."""


_NODE = "level int, at bigint, docs bigint, ids bigint, root binary"


def manifest(recipes: DataFrame) -> DataFrame:
    """The Merkle tree over the documents of recipes: _NODE rows, the last level of which is the one root.

    A document's hash is over its id, place, length and the root over its chunks. Level 0 has a node for every 2**SPAN_BITS
    places of the id stream with a document that starts there (as many at most, each id being one), and each next level
    a node for 2**FAN_BITS of the last, until there is one: as many steps as the tree is high. A task holds a node's children.
    """

    def hashed(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots = []
                for kids in batch.column(3).to_pylist():
                    if level:
                        roots.append(merkle([k["root"] for k in kids]))
                    else:
                        roots.append(merkle([hashlib.sha256(f"{k['id']!r} {k['start']} {k['n']} ".encode() + k["root"]).digest() for k in kids]))
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(roots), pa.int32()), *batch.columns[:3], pa.array(roots, pa.binary())], names=["level", "at", "docs", "ids", "root"])

        return run

    kid = F.struct("start", F.col("doc_id").cast("string").alias("id"), F.col("n_tokens").alias("n"), "root")
    last = recipes.groupBy(F.shiftright("start", SPAN_BITS).alias("at")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"), F.array_sort(F.collect_list(kid)).alias("kids"))
    last = written(last.select("at", "docs", "ids", "kids").mapInArrow(hashed(0), _NODE))
    every, level = last, 0
    while (n := last.count()) > 1:
        level += 1
        up = last.groupBy(F.shiftright("at", FAN_BITS).alias("at")).agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "root"))).alias("kids"))
        last = written(up.select("at", "docs", "ids", "kids").mapInArrow(hashed(level), _NODE))
        every = every.unionByName(last)
    if n == 0:  # an empty store has a root, too
        every = recipes.sparkSession.sql(f"select 0 as level, 0L as at, 0L as docs, 0L as ids, unhex('{merkle([]).hex()}') as root")
    return every


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes path/chunks (digest, n, body), path/recipes (doc_id, start, n_tokens, chunks, root) and path/manifest.

    Bodies are ids as unsigned 16-bit (32-bit where one doesn't fit) integers, stored once whatever number of documents
    has them. Recipes lie in ascending order of doc_id; start counts the ids of all documents before. The manifest is the
    Merkle tree over the recipes, see manifest().
    Null texts have the end id only. Rows with equal ids (or null ids, which come first) follow each other, in the order
    of their Merkle roots. Other columns aren't read; no rows make an empty store.

    Texts are encoded once, into a staging table; only chunks that occur twice are shuffled, with partial aggregates
    before, so that a chunk which a third of the documents share arrives once per task.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests whose bodies this task has emitted: 16 bytes a chunk of its own split
        row = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed = encode_packed([t or "" for t in part.column(1).to_pylist()], tokenizer)
                end = end_id.to_bytes(4, "little")
                every = np.frombuffer(b"".join([x + end for x in packed]), dtype="<u4")
                at, begin = marks(every), 0
                short = every.astype("<u2") if int(every.max()) < 1 << 16 else None
                rows: list[tuple] = []
                for ident, raw in zip(part.column(0).to_pylist(), packed):
                    n = len(raw) // 4 + 1
                    inner = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, begin + n)] - begin
                    digests, sizes, bodies, last = [], [], [], 0
                    for stop in cuts(n, inner.tolist()):
                        lo_, hi_ = begin + last, begin + stop
                        body = short[lo_:hi_].tobytes() if short is not None else b"\0" + every[lo_:hi_].tobytes()
                        d = hashlib.sha256(body).digest()[:16]
                        digests.append(d)
                        sizes.append(stop - last)
                        bodies.append(None if d in seen else body)
                        seen.add(d)
                        last = stop
                    begin += n
                    rows.append((ident, row, n, digests, sizes, bodies, merkle(digests)))
                    row += 1
                types = [part.schema.types[0], pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc_id", "row", "n_tokens", "digests", "sizes", "bodies", "root"])

    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == id_col)
    schema = f"doc_id {kind}, row bigint, n_tokens bigint, digests array<binary>, sizes array<int>, bodies array<binary>, root binary"
    stage = f"{path}/_staging"
    docs.select(id_col, text_col).mapInArrow(run, schema).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)
    # Only chunks that occur twice must meet. A blocked Bloom filter of their digests, of bounded size, picks them (and a
    # few others) out; all the rest are unique for sure and are written where they are.
    twice = written(staged.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest"))
    blocks = min(MAX_BLOCKS, max(16, twice.count() // 2))
    key = F.col("digest")
    bits = twice.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("bits"))
    flat = staged.select(F.explode(F.arrays_zip("digests", "sizes", "bodies")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.bodies").alias("body")).filter("body is not null")
    flat = flat.withColumn("at", _block(key, blocks)).withColumn("mask", _mask(key))
    listed = (F.col("at") == F.col("block")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    once = flat.join(F.broadcast(bits), listed, "left_anti").select("digest", "n", "body")
    chunks = flat.join(F.broadcast(bits), listed, "left_semi").groupBy("digest").agg(F.min("n").alias("n"), F.first("body").alias("body"))
    chunks.unionByName(once).write.option("compression", "zstd").parquet(f"{path}/chunks")
    # Same text, same root: rows with equal ids and roots are alike, so that either order gives the same files.
    recipes = prefix_sums(staged.select("doc_id", "n_tokens", F.col("digests").alias("chunks"), "root", F.monotonically_increasing_id().alias("u")), ["doc_id", "root", "u"], "n_tokens", "start")
    recipes = recipes.repartitionByRange(parts(spark), "doc_id", "root", "u").sortWithinPartitions("doc_id", "root", "u").drop("u")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")

    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(stage)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """Products of polynomials with one modulo the CRC-32 polynomial, all with reflected bits."""
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), np.uint32(b), np.uint32(0))
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


@lru_cache(maxsize=64)
def _square(k: int) -> int:
    """x ** (8 * 2**k), reflected."""
    if not k:
        return 1 << 23
    half = _square(k - 1)
    return int(_times(np.array([half], dtype=np.uint32), half)[0])


def shifted(crcs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 registers moved on by n zero bytes each: times x ** (8 n), by the bits of n."""
    out, n = crcs.astype(np.uint32), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        some = np.flatnonzero(n >> k & 1)
        out[some] = _times(out[some], _square(k))
    return out


def crc_joined(items: list[tuple[int, int]]) -> int:
    """CRC-32 of joined parts from their (crc, bytes): each moved on by the bytes after it."""
    sizes = np.array([n for _, n in items], dtype=np.int64)
    after = sizes.sum() - np.cumsum(sizes)
    return int(np.bitwise_xor.reduce(shifted(np.array([c for c, _ in items], dtype=np.uint32), after), initial=np.uint32(0)))


def _ids(body: bytes) -> np.ndarray:
    """A body of even length has 16-bit ids; else a first zero byte and 32-bit ids."""
    return np.frombuffer(body, dtype="<u2").astype("<u4") if len(body) % 2 == 0 else np.frombuffer(body[1:], dtype="<u4")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Builds the Merkle tree over the recipes again and holds it against the manifest, node by node.

    Lost, added and changed recipes (whole files, too) change a leaf and the root; any difference raises StoreDamaged.
    """
    node = ["level", "at", "docs", "ids", "root"]
    told = spark.read.schema(_NODE).parquet(f"{path}/manifest").select(*[F.col(c).alias(f"t_{c}") for c in node])
    got = manifest(spark.read.parquet(f"{path}/recipes")).select(*node)
    same = F.lit(True)
    for c in node[2:]:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    both = got.join(told, (F.col("level") == F.col("t_level")) & (F.col("at") == F.col("t_at")), "full")
    odd = both.agg(F.count(F.when(~same, 1)), F.count(F.when(F.col("level") == 0, F.col("docs"))), F.min(F.when(~same & (F.coalesce("level", "t_level") == 0), F.coalesce("at", "t_at"))), F.count("*")).first()
    if odd[0] or not odd[3]:
        raise StoreDamaged(f"{path}: {odd[0]} nodes of the manifest's tree don't match the recipes, the first of them at ids from {(odd[2] or 0) << SPAN_BITS}")


def read_store(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, verified.

    First the recipes are held against the manifest: where any was lost, added or changed, StoreDamaged is raised (with
    strict; else what is there is read). Every chunk is read and hashed again; verified says that each chunk has the digest
    it is stored under, that the recipe's Merkle root and length hold, and that no chunk is missing. Chunks carry the CRC
    of their ids, from which the document's is combined, so that bodies don't move and a chunk that many documents share
    is hashed once.
    """
    if strict:
        check_manifest(spark, path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            ids = [_ids(b) for b in bodies]
            good = [hashlib.sha256(b).digest()[:16] == d for b, d in zip(bodies, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(good)], names=["digest", "n", "crc", "good"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "body").mapInArrow(check, "digest binary, n bigint, crc bigint, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("start", F.posexplode("chunks").alias("pos", "r_digest"))
    joined = refs.join(chunks, F.col("r_digest") == F.col("digest"), "left").groupBy("start").agg(F.collect_list(F.struct("pos", "r_digest", "n", "crc", "good")).alias("items"))
    # start tells documents apart: each has one id at least.
    whole = recipes.select("doc_id", "start", "n_tokens", "root").join(joined.withColumnRenamed("start", "j_start"), F.col("start") == F.col("j_start"), "left").select("doc_id", "start", "n_tokens", "root", "items")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, crc, after, begins, known = [], [], [], [], []
            for n, root, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                items = sorted(items or [], key=lambda x: x["pos"])
                sizes = [x["n"] or 0 for x in items]
                good.append(all(x["good"] for x in items) and sum(sizes) == n and merkle([x["r_digest"] for x in items]) == root)
                known.append(all(sizes) and bool(sizes))
                begins.append(len(crc))
                left = sum(sizes)
                for x, size in zip(items, sizes):
                    left -= size
                    crc.append(x["crc"] or 0)
                    after.append(4 * left)
            # All parts of the batch move on at once; a document's CRC is what its parts add up to.
            moved = shifted(np.array(crc, dtype=np.uint32), np.array(after, dtype=np.int64))
            ends = [*begins[1:], len(crc)]
            crcs = [int(np.bitwise_xor.reduce(moved[i:j])) if k else None for i, j, k in zip(begins, ends, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    kind = next(f.dataType.simpleString() for f in recipes.schema if f.name == "doc_id")
    return whole.mapInArrow(combine, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents' ids put together again from their chunks."""
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("pos", "r_digest"))
    got = refs.join(spark.read.parquet(f"{path}/chunks"), F.col("r_digest") == F.col("digest")).groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(x["body"]) for x in items]).astype(np.int32) for items in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    kind = next(f.dataType.simpleString() for f in refs.schema if f.name == "doc_id")
    return got.mapInArrow(join, f"doc_id {kind}, start bigint, ids array<int>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store in the shared folder, and what reading it back gives; see write_store(), read_store()."""
    path = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)

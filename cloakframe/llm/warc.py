"""WARC: writes captures as archives, reads archives, and assembles records into one nested row per capture."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
#: Captures in one archive file at most, and about so many bytes of payloads, so that a reading task holds a bounded file:
#: payloads of more than LARGE bytes lie in files of their own, which hold as many as fit.
CAPTURES_PER_FILE, LARGE, FILE_BYTES = 1000, 1 << 17, 1 << 27
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, digest string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: str | Column, rid: Column, uri: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), block)


def _one_line(url: Column) -> Column:
    """Control characters, and blanks at either end, percent-encoded one by one, so that a header holds the url as it is."""
    odd = "\x7f" + "".join(map(chr, range(32)))
    coded = reduce(lambda u, c: F.replace(u, F.lit(c), F.lit(f"%{ord(c):02X}")), odd, url)
    return F.when(url.rlike(r"[\x00-\x1F\x7F]|^ | $"), F.regexp_replace(coded, r"^ | $", "%20")).otherwise(url)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, per_file: int = CAPTURES_PER_FILE) -> None:
    """Writes a request, a response (or revisit) and a metadata record for each row of pages to gzipped WARC 1.1 files.

    Of rows with equal payloads of at least least_bytes bytes, that with the smallest id is a response and the others
    revisit it, without the payload. Rows that share both id and payload are all responses or all revisits; rows with
    null ids are responses, unless one with an id has the payload. Null payloads are empty. Null urls have no target.

    Control characters of urls are percent-encoded. Files hold at most per_file captures and, but for one larger payload,
    about FILE_BYTES bytes; a file is one gzip member.

    Spark's text writer ends each value with the blank lines that end a WARC record, so the files go to whatever store
    Spark can reach, and task commits make reruns of lost tasks safe. Only digests and ids are grouped (with partial
    minima, so a payload that a third of the pages share is no hot key); pages meet the digests that occur twice, which
    Spark broadcasts only under its own size threshold.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    twice = p.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    twice = written(twice.select(F.col("digest").alias("d_digest"), F.col("first")))
    p = p.join(twice, F.col("digest") == F.col("d_digest"), "left").withColumn("revisit", F.coalesce(~F.col("id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull())
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    p = p.withColumn("row", F.monotonically_increasing_id().cast("string"))
    request, response = _uuid(F.lit("request"), "row", "digest"), _uuid(F.lit("response"), key(F.col("id")), "digest")
    uri = _one_line(F.col("url"))
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    req = _record("request", request, uri, [], "application/http; msgtype=request", F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    rev = F.when(F.col("revisit"), F.concat_ws(CRLF, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: "), _uuid(F.lit("response"), key(F.col("first")), "digest"))))
    rid = F.when(F.col("revisit"), _uuid(F.lit("revisit"), "row", "digest")).otherwise(response)
    res = _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), rid, uri, [F.concat(F.lit("WARC-Concurrent-To: "), request), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), rev], "application/http; msgtype=response", F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body"))))
    meta = _record("metadata", _uuid(F.lit("metadata"), "row", "digest"), uri, [F.concat(F.lit("WARC-Concurrent-To: "), request)], "application/warc-fields", F.concat_ws("", F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF))))
    gap = F.lit(CRLF * 2)
    largest = p.agg(F.max("bytes")).first()[0] or 0
    turns = [(F.lit(True), per_file)] if largest <= LARGE else [(F.col("bytes") <= LARGE, per_file), (F.col("bytes") > LARGE, max(1, min(per_file, FILE_BYTES // largest)))]
    for which, most in turns:
        p.filter(which).select(F.concat(req, gap, res, gap, meta).alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


#: Where parse_records() says what is wrong with a record; no header has this name.
FAULT = ":fault"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """The headers (names in lower case, with all their values) and block of each record of an uncompressed archive.

    A damaged record has what is left of it and, under FAULT, why: no_header_end, no_length, truncated (the file ends
    within it) or wrong_length (no record's end stands where its length says). Reading goes on at the next record.
    """
    at, view = 0, memoryview(data)
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF.encode() * 2, at)
        if end < 0:
            yield {FAULT: ["no_header_end"]}, view[len(data) :]
            return
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers: dict[str, list[str]] = {}
        for k, _, v in (line.partition(":") for line in lines):
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        length = headers.get("content-length", [""])[0]
        begin = end + 4
        stop = begin + int(length) if length.isascii() and length.isdigit() else -1
        fault = "no_length" if stop < 0 else "truncated" if stop > len(data) else None
        if fault is None and data[stop : stop + 4] not in (b"", CRLF.encode(), CRLF.encode() * 2):
            fault = "wrong_length"
        if fault:
            after = data.find(CRLF.encode() * 2 + b"WARC/", begin)
            stop = after if after >= 0 else len(data)
            headers[FAULT] = [fault]
        yield headers, view[begin:stop]
        at = stop


def _gunzip(data: bytes) -> bytes:
    """A file's members, one behind the other; what can be read of a damaged one."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not d.eof:
                out.append(d.decompress(data[at : at + (1 << 20)]))
                at += 1 << 20
        except zlib.error:
            break
        if not d.eof:
            break
        data = d.unused_data + data[at:]
    return b"".join(out) if out else data


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives under path, gzipped or not: RECORD's columns, fault, and the payload if asked for.

    payload_bytes and payload_digest are of the bytes read (of HTTP records: after the HTTP headers); digest is what the
    header claims; fields are those of application/warc-fields blocks. fault is null, or what is wrong with the record: see
    parse_records(), and no_http_end (no blank line ends the HTTP headers; no payload) and not_text (fields that aren't
    UTF-8). A damaged record or file never fails the others; an empty folder is an error, as there is nothing to read,
    and an empty file has no records. A file is held whole by the task that reads it; write_warc() bounds its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in RECORD.split(", ")] + ["fault"] + ["payload"] * payload
        types = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()] + [pa.binary()] * payload
        for batch in batches:
            for file in batch.column(0):
                rows: list[tuple] = []
                for every, block in parse_records(_gunzip(file.as_py())):
                    h = {k: v[0] for k, v in every.items()}
                    kind, fields, fault = h.get("content-type", ""), None, h.get(FAULT)
                    if kind.startswith("application/http"):
                        head = bytes(block).find(b"\r\n\r\n")
                        fault = fault or ("no_http_end" if head < 0 else None)
                        block = block[head + 4 if head >= 0 else len(block) :]
                    elif kind.startswith("application/warc-fields"):
                        told = bytes(block).decode("utf-8", "replace")
                        fault = fault or ("not_text" if "\ufffd" in told else None)
                        fields = list({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in told.split(CRLF) if x)}.items())
                    digest = h.get("warc-payload-digest", "").partition(":")[2] or None
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), every.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, len(block), hashlib.sha256(block).hexdigest(), fields, fault, *([bytes(block)] if payload else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD + ", fault string" + (", payload binary" if payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit) and metadata (array).

    Records belong together that name each other in WARC-Concurrent-To (any number of times), straight or through one other
    record, whichever of them names which; a record that names none and is named by none is a capture of its own.
    capture_id is the smallest record id. Of several requests or responses of a capture, that with the smallest record id is
    taken; repeated records count once, missing ones are null; records without an id or with a fault, and an empty table, give
    no rows.

    Only ids meet to find the captures: two rounds of the least id among neighbours, with partial minima.
    """
    if "fault" in records.columns:
        records = records.filter("fault is null").drop("fault")
    cols = [c for c in records.columns if c != "payload"] + (["payload"] if "payload" in records.columns else [])
    named = written(records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).filter("a is not null and b is not null").distinct())
    both = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
    far = both.join(once.select(F.col("a").alias("o"), "low"), F.col("b") == F.col("o")).groupBy("a").agg(F.min("low").alias("low"))
    far = far.select(F.col("a").alias("l_id"), "low")
    r = records.filter("record_id is not null").join(far, F.col("record_id") == F.col("l_id"), "left")
    one = F.struct(*cols)
    least = lambda cond: F.min_by(F.when(cond, one), F.when(cond, F.col("record_id")))
    about = F.collect_set(F.when(F.col("type") == "metadata", F.struct("record_id", F.map_entries("fields").alias("fields"))))
    got = r.groupBy(F.coalesce("low", "record_id").alias("capture_id")).agg(least(F.col("type") == "request").alias("request"), least(F.col("type").isin("response", "revisit")).alias("response"), F.array_sort(about).alias("metadata"))
    return got.withColumn("metadata", F.transform("metadata", lambda m: F.struct(m["record_id"].alias("record_id"), F.map_from_entries(m["fields"]).alias("fields"))))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds page_id (text), payload_bytes, payload_digest, record_type and refers_to (page_id text of the original).

    A revisit's size and digest are those of the payload that it refers to, as read from that record (null if that isn't
    there). Only records that are referred to meet the revisits, as a written table: Spark splits a join in which a third of
    all revisits name one record.
    """
    c = captures.select("capture_id", "response", F.col("metadata")[0]["fields"]["page-id"].alias("page_id"))
    seen = c.filter(F.col("response.type") == "response").groupBy(F.col("response.record_id").alias("o_id")).agg(F.min("page_id").alias("o_page"), F.min("response.payload_bytes").alias("o_bytes"), F.min("response.payload_digest").alias("o_digest"))
    wanted = c.select(F.col("response.refers_to").alias("w_id")).filter("w_id is not null").distinct()
    seen = written(seen.join(wanted, F.col("o_id") == F.col("w_id"), "left_semi"))
    c = c.join(seen, F.col("response.refers_to") == F.col("o_id"), "left")
    back = F.col("response.type") == "revisit"
    return c.select("capture_id", "page_id", F.when(back, F.col("o_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"), F.when(back, F.col("o_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"), F.col("response.type").alias("record_type"), F.when(back, F.col("o_page")).alias("refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder, read back, assembled and resolved."""
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    got = resolve_revisits(written(assemble(read_records(spark, path)).select("capture_id", "response", "metadata")))
    return got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) b, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first_id, count(*) n from p where b >= 100 group by 1)
select p.page_id, p.b as payload_bytes, p.d as payload_digest,
  case when f.n > 1 and p.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
  case when f.n > 1 and p.page_id <> f.first_id then f.first_id end as refers_to from p left join f on p.d = f.d
"""

"""WARC archives: an index is written first; selected records are then read by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Winners that are told to every task, and rows of one payload that a key has where there are more.
WINNERS, DEALT = 200_000, 2000
#: Bytes of archives that a task reads, about.
READ = 64 << 20
#: Ranges nearer than this are read as one, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def marked(pages: DataFrame, winners: int = WINNERS, dealt: int = DEALT) -> DataFrame:
    """page_id, url, html, winner: the largest page_id of those with an equal payload, if there are several.

    Up to ``winners`` of them are broadcast. More are joined by a shuffle, in which the rows of a payload have a key for
    each ``dealt`` of them.
    """
    rows = common.columns(pages, page_id="long", url="string", html="string")
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1("html"))
    # hashed in the JVM; what is shuffled for it is a row for each payload and task
    most = rows.groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1")
    most = common.materialize(most, "payloads")
    if most.count() <= winners:
        return rows.join(F.broadcast(most), "sha", "left").select("page_id", "url", "winner", "html")
    hot = common.materialize(most.filter(F.col("n") > dealt).select("sha", F.ceil(F.col("n") / dealt).alias("keys")), "large-payloads")
    keys = F.coalesce("keys", F.lit(1).cast("long"))
    most = most.join(common.few(hot), "sha", "left").select("sha", "winner", F.explode(F.sequence(F.lit(0).cast("long"), keys - 1)).alias("key"))
    rows = rows.join(common.few(hot), "sha", "left").withColumn("key", F.pmod(F.xxhash64("page_id", "url"), keys))
    return rows.join(most, ["sha", "key"], "left").select("page_id", "url", "winner", "html")


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def clean(url: str | None) -> str | None:
    """A URL without what would end a header line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, refers_to) -> tuple[bytes, str]:
    """A record's bytes, and the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"), ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    return header(fields) + block + b"\r\n\r\n", digest


def write(pages: DataFrame, out_dir: str, per_file: int = 256 << 20, winners: int = WINNERS, dealt: int = DEALT) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html; null html is an empty payload) and returns the index.

    Of equal payloads that with the largest page_id is the response (each of its rows, if it is there twice), the others
    are revisits of it; null page_ids are less than all others, and if all are null all are responses. Each record is a
    gzip member of its own. A partition writes files of about ``per_file`` bytes, under an attempt's own name first.
    Other columns are ignored; an empty table writes no file.
    """

    def save(batches):
        part, k, f, at, rows = TaskContext.get().partitionId(), 0, None, 0, []
        held = None
        for batch in batches:
            for page_id, url, winner, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None:
                    path = f"{out_dir}/part-{part:06d}-{k:04d}.warc.gz"
                    held = common.replaced(path)
                    f, at, k = held.__enter__(), 0, k + 1
                refers_to = None if winner is None or page_id == winner else winner
                raw, digest = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = pack.compress(raw) + pack.flush()
                f.write(data)
                rows.append((path, at, len(data), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
                if at >= per_file:
                    held.__exit__(None)
                    held = None
                    yield from out(rows)
                    rows = []
        if held is not None:
            held.__exit__(None)
            yield from out(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def out(rows):
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=names)

    return common.materialize(marked(pages, winners, dealt).mapInArrow(save, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN):
    """Sorted (offset, length) as groups (offset, length, members) that one read each covers."""
    own: list[tuple[int, int]] = []
    for offset, length in rows:
        if own and (offset - (own[-1][0] + own[-1][1]) > gap or offset + length - own[0][0] > span):
            yield own[0][0], own[-1][0] + own[-1][1] - own[0][0], own
            own = []
        own.append((offset, length))
    if own:
        yield own[0][0], own[-1][0] + own[-1][1] - own[0][0], own


def parse(data: bytes) -> dict:
    """One gzip member to its header fields, with ``payload`` for a response."""
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "response":
        fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def number(urn: str | None) -> int | None:
    at = (urn or "").strip("<>").removeprefix("urn:page:")
    return None if at in ("", "None") else int(at)


def read(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of these rows of an index, from the archives: RECORD, and the payload of responses if asked for.

    The rows are dealt out by file and stretch of SPAN bytes, sorted, and near ones are read together. A payload that
    doesn't have its digest is an error.
    """
    where = index.select("path", "offset", "length").withColumn("stretch", F.expr(f"offset div {SPAN}"))
    told = index.agg(F.sum("length").alias("bytes"), F.count_distinct("path").alias("files")).first()
    n = max(1, -(-(told["bytes"] or 0) // READ), min(64, told["files"] * 4))
    where = where.repartition(n, "path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    schema = RECORD + (", payload binary" if payload else "")

    def load(batches):
        for batch in batches:
            rows, paths = list(zip(batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True)), batch["path"].to_pylist()
            lo = 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and paths[hi] == paths[lo]:
                    hi += 1
                with common.open_in(paths[lo]) as f:
                    for offset, length, own in ranges(rows[lo:hi]):
                        data, got = f.read_at(length, offset), []
                        for at, size in own:
                            r = parse(data[at - offset : at - offset + size])
                            digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                            body = r.get("payload")
                            if body is not None and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(r["X-Payload-Length"])):
                                raise ValueError(f"{paths[lo]} at {at}: the payload differs from its digest")
                            got.append((number(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), int(r["X-Payload-Length"]), digest, r["WARC-Type"], number(r.get("WARC-Refers-To")), *([body] if payload else [])))
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        names = [c.split()[0] for c in schema.split(", ")]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=False)], names=names)
                lo = hi

    return where.mapInArrow(load, schema)


def oracle() -> str:
    """In DuckDB's SQL, but for the digest's base 32, which it lacks: bits by tables."""
    return """
with p as (select page_id, sha1(coalesce(html, '')) as s, octet_length(encode(coalesce(html, ''))) as n from pages),
w as (select *, max(page_id) over (partition by s) as winner from p),
k as (select unnest(range(0, 32)) as k),
d as (select s, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + (5 * k // 4), 1) || substr(s || '0', 2 + (5 * k // 4), 1))::bigint >> (3 - 5 * k % 4)) & 31), 1), '' order by k) as b from (select distinct s from p), k group by s)
select page_id, n::bigint as payload_bytes, b as payload_digest, case when page_id = winner then 'response' else 'revisit' end as record_type, case when page_id <> winner then winner end as refers_to from w join d using (s)
"""

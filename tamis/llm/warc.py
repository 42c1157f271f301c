"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: a payload of at least MIN_REVISIT bytes that an earlier page (smaller id) has too becomes
a revisit record without a body.  Which rows are revisits is found from digests alone; pages are
not shuffled by content, so a payload that a third of all pages share is no one's burden.  Each
task writes archives of bounded size into the shared folder under names of its own.

Reading: a task scans a span of a file for the record magic and emits, for each place whose
header parses, the offset at which its successor must begin.  Magic inside payloads is among these
candidates; pointer jumping from the start of the file retains only what is reachable, which is
exactly the records that were written: their number must be the manifest's, or reading fails.

Defined cases: a null payload or url is empty; payloads below the bound are responses even if they
repeat.  A row is judged by its id and its payload together: rows of one id and different payloads
are records of their own, rows of one id and one payload are alike, either all responses or all
revisits of a smaller id.  A null id stands after all others: it revisits a page that has the
payload, and is a response if only null ids have it.  Headers and urls may have any length.  An
empty table gives no archive and no record; other columns of the input do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared
from tamis.tables import read

MAGIC = b"WARC/1.1\r\n"
MIN_REVISIT = 100
#: An archive is closed beyond this size; a scan covers so much of a file.
FILE_BYTES = 64 << 20
SPAN_BYTES = 4 << 20
#: A scan reads so much beyond its span, and more where a header goes on.
HEADER_BYTES = 1 << 16
LENGTH = re.compile(rb"\r\nContent-Length: (\d+)(?=\r\n)")
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """Names a payload of a page."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response holds an HTTP message, a revisit the digest and length of its payload in the header."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = b""
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    else:
        lines.append("Content-Type: application/http; msgtype=response")
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(spark: SparkSession, pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages as WARC archives below ``folder``; returns their manifest (file, bytes, records)."""
    html_ = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), html_.alias("html"), F.sha2(html_, 256).alias("digest"))
    marks = rows.select("id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit)
    firsts = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    # Only revisits need an answer; it is kept beside the archives, by id and payload.
    repeats = marks.join(firsts, "digest").where("id > first or id is null").select(F.col("id").alias("twin"), F.col("digest").alias("twin_digest"), "first")
    twins = shared.table(spark, repeats.distinct(), f"{folder}/twins")
    same = F.col("id").eqNullSafe(F.col("twin")) & (F.col("digest") == F.col("twin_digest"))
    joined = rows.join(shared.broadcast_if_small(twins), same, "left").select("id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{uuid.uuid4().hex}.warc"
            shared.put_bytes(name, b"".join(held))
            out = pa.record_batch([[name], pa.array([size], pa.int64()), pa.array([len(held)], pa.int64())], names=["file", "bytes", "records"])
            held.clear()
            return out

        for batch in batches:
            for i, u, h, d, f in zip(*(batch.column(k).to_pylist() for k in ("id", "url", "html", "digest", "first")), strict=True):
                held.append(record(i, u, h.encode(), d, f))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
                    size = 0
        if held:
            yield close()

    return shared.table(spark, joined.mapInArrow(run, "file string, bytes long, records long"), f"{folder}/manifest")


def task_count(manifest: DataFrame, span: int = SPAN_BYTES) -> int:
    """Tasks for work on all archives: one a span.  The rows of such work are few and small, what they read is not."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return int(min(max(-(-total // span), 1), 1 << 16))


def _headers(data: bytes, until: int) -> tuple[list[int], list[int], list[int]]:
    """Places before ``until`` where a record header parses, the end of each header, and its content length."""
    ends = [m.start() for m in re.finditer(b"\r\n\r\n", data)]
    lengths = [(m.start(), int(m[1])) for m in LENGTH.finditer(data)]
    at, own, stops, sizes = data.find(MAGIC), [], [], []
    while 0 <= at < until:
        e = bisect.bisect(ends, at)
        n = bisect.bisect(lengths, (at,))
        if e < len(ends) and n < len(lengths) and lengths[n][0] < ends[e]:
            own.append(at)
            stops.append(ends[e] + 4)
            sizes.append(lengths[n][1])
        at = data.find(MAGIC, at + 1)
    return own, stops, sizes


def candidates(manifest: DataFrame, span: int = SPAN_BYTES) -> DataFrame:
    """(file, offset, successor) of every place in a file where a record header parses, real or not."""
    spans = manifest.select("file", "bytes", "records", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(span))).alias("start")).where("bytes > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, count, start in zip(*(batch.column(k).to_pylist() for k in ("file", "bytes", "records", "start")), strict=True):
                end = min(start + span, size)
                with shared.open_read(name) as f:
                    f.seek(start)
                    data = f.read(end - start + HEADER_BYTES)
                    last = data.rfind(MAGIC, 0, end - start + len(MAGIC) - 1)
                    # The last header may go on beyond what was read.
                    while last >= 0 and data.find(b"\r\n\r\n", last) < 0 and (more := f.read(HEADER_BYTES + len(data))):
                        data += more
                own, stops, sizes = _headers(data, end - start)
                if start == 0 and own[:1] != [0]:
                    raise ValueError(f"{name} does not begin with a record")
                n = len(own)
                after = [min(start + e + k + 4, 2**62) for e, k in zip(stops, sizes, strict=True)]
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array([start + x for x in own], pa.int64()), pa.array(after, pa.int64()), pa.array([count] * n, pa.int64())], names=["file", "offset", "successor", "records"])

    # A span is a task's work; spans are dealt out evenly.
    return spans.repartition(task_count(manifest, span), "file", "start").mapInArrow(run, "file string, offset long, successor long, records long")


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which offsets the chain from 0 meets, by pointer jumping: hops double, the reached set follows each."""
    order = np.argsort(offsets, kind="stable")
    o, n = offsets[order], len(offsets)
    at = np.minimum(np.searchsorted(o, successors[order]), max(n - 1, 0))
    hop = np.where(o[at] == successors[order], at, n) if n else at
    hop = np.append(hop, n)  # n: past the end, or a broken link
    seen = np.zeros(n + 1, dtype=bool)
    seen[:n] = o == 0
    while True:
        more = seen.copy()
        more[hop[seen]] = True
        if (hop == n).all() or n == 0:
            seen = more
            break
        seen, hop = more, hop[hop]
    out = np.zeros(n, dtype=bool)
    out[order] = seen[:n]
    return out


def chain(found: DataFrame) -> DataFrame:
    """(file, offset) of the real records.  A group is one archive, whose size its writer bounds."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        real = reachable(group.column("offset").to_numpy(), group.column("successor").to_numpy())
        if (want := group.column("records")[0].as_py()) is not None and int(real.sum()) != want:
            raise ValueError(f"{group.column('file')[0]}: {int(real.sum())} records are reachable, {want} were written")
        return group.select(["file", "offset", "successor"]).filter(pa.array(real))

    return found.groupBy("file").applyInArrow(run, "file string, offset long, successor long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def records(found: DataFrame, tasks: int, span: int = SPAN_BYTES, payloads: bool = True) -> DataFrame:
    """Read records at their offsets; of a revisit, what its header says of the payload."""
    work = found.groupBy("file", F.floor(F.col("offset") / span).alias("span")).agg(F.collect_list(F.struct("offset", "successor")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, places in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                rows = []
                with shared.open_read(name) as f:
                    for x in sorted(places, key=lambda p: p["offset"]):
                        f.seek(x["offset"])
                        raw = f.read(x["successor"] - x["offset"])
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        # A response's body is an HTTP message, whose own head ends at the first blank line.
                        body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
                        key = fields["WARC-Record-ID"].split(":")[2]
                        refers = fields.get("WARC-Refers-To", "::").split(":")[2] or None
                        digest = hashlib.sha256(body).hexdigest() if refers is None else fields["WARC-Payload-Digest"][7:]
                        size = len(body) if refers is None else int(fields["X-Payload-Length"])
                        rows.append((None if key == "null" else int(key), fields["WARC-Target-URI"], fields["WARC-Type"], refers and int(refers), size, digest, body if payloads else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return work.repartition(tasks, "file", "span").mapInArrow(run, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    manifest = write(spark, read(spark, sf_dir, "pages"), folder)
    found = records(chain(candidates(manifest)), task_count(manifest), payloads=False)
    out = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return out


QUERIES = {"op5_warc": op5_warc}

ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)"""
}

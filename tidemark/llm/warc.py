"""WARC archives with a merged capture index.

Pages are written as WARC 1.1 records, one archive a task. Beside its archive a task writes a run: its captures (URL key,
time, page, place in the archive) in order. An external merge turns the runs into a global order by
URL key and time: captures are dealt out by ranges of the key, and in each range the runs' slices,
sorted already, meet in a k-way loser tree. A task holds its slices packed as Arrow batches of a few megabytes in all, and
reads a few rows of each at a time. Ranges split on time and page too, so one busy host spans many tasks.

Of records with equal payloads of at least MIN_PAYLOAD bytes the one of smallest page is the
response and the others are revisits, which carry the HTTP header, the digest and the reference but
no payload. Readers follow the merged index into the archives, in the order of places for each
archive, and take everything they return from the records.

Files are written under a name of the attempt and renamed, and carry the partition's number, so a
repeated task leaves one complete archive.

Defined results: a null or empty payload has 0 bytes and is a response; a null URL has an empty
key; rows that repeat a page number are records each (with equal payloads the one that is smallest by page
and URL is the response, and exact ties are all responses); a null page number comes last and reads back as null; an
empty table gives no archives and no rows; columns other than those named are left out.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import parts, scratch, stored, table
from tidemark.llm.token_files import place

MIN_PAYLOAD = 100
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN_SCHEMA = "run int, urlkey string, ts string, page_id long, record_type string, path string, at long, size long"


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed, scheme, www and fragment dropped, lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)(:\d+)?([^#]*)", (url or "").strip(), re.I)
    host = m[1].lower().removeprefix("www.") if m else ""
    return ",".join(reversed(host.split("."))) + ")" + (m[3] or "/") if host else ""


def record(page: int | None, url: str | None, stamp: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, gzipped as a member of its own."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda p: f"<urn:page:{'null' if p is None else p}:{digest[:16]}>"  # noqa: E731 so that a page of two payloads has two
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {stamp}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """Headers of a record (lower-case names) with http, its HTTP headers, and payload."""
    data = gzip.decompress(raw)
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    fields["http"] = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


def roles(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """p, url, html, digest and refers_to of each page: the smallest page of equal payloads."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("p"), F.col(url).alias("url"), body.alias("html"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), (F.octet_length(body) >= MIN_PAYLOAD).alias("long"))
    # digests alone are grouped; the payloads join only what has copies
    same = rows.where("long").select("p", "url", "digest").groupBy("digest").agg(F.min(F.struct(F.col("p").isNull().alias("n"), "p", "url")).alias("f"), F.count("*").alias("k")).where("k > 1").select("digest", "f")
    joined = rows.join(same, "digest", "left")
    first = F.col("p").eqNullSafe(F.col("f.p")) & F.col("url").eqNullSafe(F.col("f.url"))
    return joined.select("p", "url", "html", "digest", F.when(F.col("long") & F.col("f").isNotNull() & ~first, F.col("f.p")).alias("refers_to"))


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives below out; returns the runs: their captures, sorted within each run."""
    rows = roles(pages, key, url, html)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = place(out)
        # two attempts of a task needn't see its rows in one order: each has an archive of its own, and the index names the one that counts
        name, own = f"{task.partitionId():07d}-{task.taskAttemptId()}.warc.gz", f".{task.partitionId():07d}-{task.taskAttemptId()}"
        stream, at, run = None, 0, []
        for batch in batches:
            if stream is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{own}", compression=None)
            for p, u, body, digest, ref in zip(*(batch.column(i).to_pylist() for i in range(5))):
                when = FIRST_CAPTURE + timedelta(seconds=(p or 0) % 1_000_000_000)
                stamp = when.strftime("%Y-%m-%dT%H:%M:%SZ")
                data = record(p, u, stamp, body.encode(), digest, ref)
                stream.write(data)
                run.append((url_key(u), when.strftime("%Y%m%d%H%M%S"), p, "response" if ref is None else "revisit", at, len(data)))
                at += len(data)
        if stream is None:
            return
        stream.close()
        store.move(f"{base}/{own}", f"{base}/{name}")
        run.sort(key=_order)
        for i in range(0, len(run), 10_000):
            k, t, p, kind, a, n = zip(*run[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()] * len(k), pa.int32()), pa.array(k), pa.array(t), pa.array(p, pa.int64()), pa.array(kind), pa.array([f"{out}/{name}"] * len(k)), pa.array(a), pa.array(n)], RUN_FIELDS)

    # a text column is far wider than a capture: the archive's tasks are those of the join
    return stored(rows.mapInArrow(put, RUN_SCHEMA), "warc-runs")


RUN_FIELDS = [f.split()[0] for f in RUN_SCHEMA.split(", ")]


def _order(r: tuple) -> tuple:
    return r[0], r[1], r[2] is None, r[2] or 0


class LoserTree:
    """Merges k sorted iterators. Inner nodes hold the loser of each match; the winner is at 0, and
    taking it replays one path. On ties the smaller run wins."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        for x in self.runs[i]:
            return (0, self.key(x), i), x
        return (1, (), i), None  # behind all others

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self.head[other][0] < self.head[i][0]:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.head[self.tree[0]][1] is not None:
            i = self.tree[0]
            yield self.head[i][1]
            self.head[i] = self._next(i)
            self._play(i)


def merged(runs: DataFrame) -> DataFrame:
    """The captures in global order by URL key, time and page: partitions are ranges in order, and
    each is merged from the runs' slices."""
    order = ["urlkey", "ts", F.col("page_id").asc_nulls_last()]
    dealt = runs.repartitionByRange(parts(runs, 8), *order)  # 8 MB of captures to a task

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[pa.RecordBatch]] = []
        last = None
        for batch in batches:
            # rows of a run arrive in its order, but a run that was read in several pieces is several runs
            keys = [(r, _order(x)) for r, *x in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            begin = 0
            for i, key in enumerate(keys):
                if last is None or key[0] != last[0] or key[1] < last[1]:
                    if i > begin:
                        pieces[-1].append(batch.slice(begin, i - begin))
                    pieces.append([])
                    begin = i
                last = key
            if batch.num_rows > begin:
                pieces[-1].append(batch.slice(begin))
        held = []
        for r in LoserTree([_rows(p) for p in pieces], lambda r: _order(r[1:])):
            held.append(r)
            if len(held) == 10_000:
                yield _captures(held)
                held = []
        if held:
            yield _captures(held)

    return dealt.mapInArrow(merge, RUN_SCHEMA)


def _rows(piece: list[pa.RecordBatch], some: int = 64) -> Iterator[tuple]:
    """The rows of a slice of a run, unpacked a few at a time."""
    for batch in piece:
        for at in range(0, batch.num_rows, some):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, some).columns))


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], RUN_FIELDS)


def histories(index: DataFrame) -> DataFrame:
    """The merged index by URL key: n_captures, first and last time, n_revisits."""
    return index.groupBy("urlkey").agg(F.count("*").alias("n_captures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("record_type") == "revisit").alias("n_revisits"))


def read(index: DataFrame) -> DataFrame:
    """page_id, urlkey, ts, payload_bytes, payload_digest, record_type, refers_to of the captures
    of an index, each from its record."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = batch.to_pylist()
            out = [None] * len(rows)
            store, path, f = None, None, None
            for i in sorted(range(len(rows)), key=lambda i: (rows[i]["path"], rows[i]["at"])):
                r = rows[i]
                if r["path"] != path:
                    if f:
                        f.close()
                    store, where = place(r["path"])
                    path, f = r["path"], store.open_input_file(where)
                got = parse(f.read_at(r["size"], r["at"]))
                kind, n = got["warc-type"], int(got["http"]["content-length"])
                digest = got["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (len(got["payload"]) != n or hashlib.sha256(got["payload"]).hexdigest() != digest):
                    raise ValueError(f"damaged record at {r['at']} of {path}")
                page, ref = (got[h].split(":")[2] if h in got else None for h in ("warc-record-id", "warc-refers-to"))
                out[i] = (None if page == "null" else int(page), r["urlkey"], r["ts"], n, digest, kind, int(ref) if ref else None)
            if f:
                f.close()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "urlkey", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return index.mapInArrow(get, "page_id long, urlkey string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(merged(runs)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, min(CASE WHEN n >= 100 THEN page_id END) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""

"""WARC archives and the external merge of their indexes.

`write` turns pages into WARC/1.1 records, each a gzip member of its own, in archives of about `ARCHIVE` bytes. Of pages with
equal payloads of at least `LEAST` bytes the one with the smallest page_id is a response, the others are revisits without
payload that name it. An archive is one binary value written by Spark's own committed writer (`name`, `content`, as
`binaryFile` reads it), so any store works and a lost task leaves nothing half written.

`runs` reads archives back: it parses every record, checks digests, and writes each archive's captures as one run, sorted by URL
key (host labels reversed), timestamp and page_id. `merge` cuts that order into ranges of about `RANGE` captures, as many as the
captures ask for (Spark's range shuffle; the key ends in archive and offset, so a URL with very many captures spans ranges), and
brings the slices of runs that fall into a range together, each still in its run's order. A loser tree merges them: a task holds
one range, as Arrow columns, whatever the size of the runs. The result is globally ordered: range, then place, with the number
of the capture within its URL's history and the previous capture's time: both are first taken within ranges, then each
range's leading URL is given what the ranges before it hold of it (a row per range, summed up on the driver).

Which payloads repeat is found from digests alone; the few rows about repeated payloads are joined back, broadcast if at most
`BROADCAST_ROWS`, else by a shuffled join of the pages.

Nulls and edge cases: null html is an empty payload; null urls have an empty key and target; equal payloads under `LEAST` bytes
are all responses; rows that repeat a page_id are records of their own (the first of equal payloads stays a response
together with its repeats); a null page_id is written as -1 and read back as null; very long pages are records like
others; an empty table gives no archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, tidy

ARCHIVE, LEAST, BROADCAST_ROWS, RANGE = 4 << 20, 100, 500_000, 50_000
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
CRLF = b"\r\n"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record; the date is `page_id` seconds after 2020 (pages carry no time of their own)."""
    digest = hashlib.sha256(payload)
    known = -1 if page_id is None else page_id
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{known}>"),
        ("WARC-Date", (EPOCH + timedelta(seconds=known % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()),
        ("WARC-Payload-Digest", "sha256:" + base64.b32encode(digest.digest()).decode()),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + payload + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; a damaged record raises ValueError."""
    top, sep, rest = data.partition(CRLF + CRLF)
    lines = top.split(CRLF)
    if not sep or lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    head = {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in lines[1:])}
    n = int(head["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a record is cut off")
    return head, rest[:n]


def members(content: bytes):
    """(offset, length, bytes) of each gzip member of an archive."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        # fed in pieces, so that what follows a member is not copied for each of them
        start, out = at, []
        while not z.eof:
            piece = content[at : at + 65536]
            if not piece:
                raise ValueError("an archive is cut off")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield start, at - start, b"".join(out)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, as capture indexes sort them: `com,example,www)/path`."""
    _, sep, rest = url.partition("://")
    if not sep:
        return url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def write(pages: DataFrame) -> DataFrame:
    """`pages(page_id, url, html)` -> stored archives `(name, content)`."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).where(f"n >= {LEAST}")
    repeated = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first").checkpoint()
    few = repeated.count() <= BROADCAST_ROWS  # at most 40 MB
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.when(F.octet_length(body) >= LEAST, F.sha2(body, 256)).alias("digest"))
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        content, size, names = [], 0, hashlib.sha256()

        def archive():
            data = b"".join(content)
            return pa.RecordBatch.from_arrays([pa.array([f"capture-{names.hexdigest()[:20]}.warc.gz"]), pa.array([data], pa.binary())], names=["name", "content"])

        for b in batches:
            ids, urls, refers = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            for i, (page_id, url, refers_to) in enumerate(zip(ids, urls, refers)):
                payload = b.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                made = z.compress(record(page_id, url, payload, refers_to)) + z.flush()
                content.append(made)
                names.update(made)
                size += len(made)
                if size >= ARCHIVE:
                    yield archive()
                    content, size = [], 0
        if content:
            yield archive()

    return stored(rows.mapInArrow(tidy(run), "name string, content binary"), "archives")


CAPTURE = [("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
COLUMNS = "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _page(urn: str) -> int | None:
    n = int(urn.removeprefix("<urn:page:").removesuffix(">"))
    return None if n == -1 else n


def captures(name: str, content: bytes) -> list[dict]:
    """An archive's captures, sorted: what an index file of it would hold, from its records alone."""
    out = []
    for offset, length, data in members(content):
        head, body = parse(data)
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"{name}: a payload does not have its digest")
        url = base64.b64decode(head["WARC-Target-URI"]).decode("utf-8", "surrogatepass")
        out.append({"url_key": url_key(url), "time": head["WARC-Date"], "page_id": _page(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(body), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": _page(head["WARC-Refers-To"]) if revisit else None, "archive": name, "offset": offset, "length": length})
    out.sort(key=sort_key)
    return out


def sort_key(c: dict) -> tuple:
    return c["url_key"].encode("utf-8", "surrogatepass"), c["time"], -1 if c["page_id"] is None else c["page_id"], c["archive"], c["offset"]


def runs(archives: DataFrame) -> DataFrame:
    """The captures of each archive as a sorted run, with their step in it."""
    schema = pa.schema([*CAPTURE, ("step", pa.int64())])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = captures(name, content.as_py())
                for lo in range(0, len(found), 8192):
                    yield pa.RecordBatch.from_pylist([c | {"step": lo + i} for i, c in enumerate(found[lo : lo + 8192])], schema=schema)

    return stored(archives.select("name", "content").mapInArrow(tidy(run), f"{COLUMNS}, step long"), "runs")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, iterators, key):
        self.sources, self.key = [iter(x) for x in iterators], key
        k = self.k = max(1, len(self.sources))
        self.heads = [self._next(i) for i in range(len(self.sources))] or [None]
        self.tree = [-1] * k
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        item = next(self.sources[i], None)
        return None if item is None else (self.key(item), i, item)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else x[:2] < y[:2]

    def _play(self, i: int) -> None:
        """From leaf i up: the loser stays, the winner goes on; while the tree fills, a winner waits at an empty node."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head[2]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            winner = w
            while node > 0:
                if self._less(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merge(sorted_runs: DataFrame, ranges: int) -> DataFrame:
    """Sorted runs -> capture histories in global order of (range, place)."""
    spark = sorted_runs.sparkSession
    out_schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), *CAPTURE, ("number", pa.int64()), ("previous_time", pa.string())])

    def join(batches):
        """The slices of runs in one range, one after the other -> the range in order."""
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        run, step = t["archive"].to_pylist(), t["step"].to_pylist()
        url, time, page = (t[c].to_pylist() for c in ("url_key", "time", "page_id"))
        offset = t["offset"].to_pylist()
        key = lambda i: (url[i].encode("utf-8", "surrogatepass"), time[i], -1 if page[i] is None else page[i], run[i], offset[i])
        edges = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        if any(step[i] < step[i - 1] for lo, hi in zip(edges, edges[1:]) for i in range(lo + 1, hi)):
            raise ValueError("a run is not in order")
        order, last, number, place, numbers, before = [], None, 0, 0, [], []

        def batch() -> pa.RecordBatch:
            rows = t.take(pa.array(order)).select([c for c, _ in CAPTURE]).combine_chunks()
            n = len(order)
            own = [pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(place - n, place), pa.int64()), *(c.combine_chunks() for c in rows.columns), pa.array(numbers, pa.int64()), pa.array(before, pa.string())]
            return pa.RecordBatch.from_arrays(own, schema=out_schema)

        for i in LoserTree([range(lo, hi) for lo, hi in zip(edges, edges[1:])], key):
            same = last is not None and url[last] == url[i]
            number = number + 1 if same else 1
            order.append(i)
            numbers.append(number)
            before.append(time[last] if same else None)
            last, place = i, place + 1
            if len(order) == 8192:
                yield batch()
                order, numbers, before = [], [], []
        if order:
            yield batch()

    def ends(batches):
        """The first and last capture of each range in a task: a range that was written in pieces has several rows."""
        here = None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if here and here[0] == row[0]:
                    here = here[:1] + min(here[1:3], row[1:3]) + max(here[3:], row[1:])
                    continue
                if here:
                    yield pa.RecordBatch.from_pylist([dict(zip(end_schema.names, here))], schema=end_schema)
                here = row[:3] + row[1:]
        if here:
            yield pa.RecordBatch.from_pylist([dict(zip(end_schema.names, here))], schema=end_schema)

    end_schema = pa.schema([("range", pa.int32()), ("first_place", pa.int64()), ("first_key", pa.string()), ("place", pa.int64()), ("url_key", pa.string()), ("number", pa.int64()), ("time", pa.string())])
    dealt = sorted_runs.repartitionByRange(ranges, "url_key", "time", F.coalesce("page_id", F.lit(-1)), "archive", "offset").sortWithinPartitions("archive", "step")
    merged = dealt.mapInArrow(tidy(join), f"range int, place long, {COLUMNS}, number long, previous_time string")
    merged = stored(merged, "merged")
    found = merged.select("range", "place", "url_key", "number", "time").mapInArrow(ends, "range int, first_place long, first_key string, place long, url_key string, number long, time string")
    before = spark.createDataFrame(carried([tuple(r) for r in found.collect()]), "range int, carried_key string, carried long, carried_time string")
    same = F.col("url_key").eqNullSafe(F.col("carried_key"))
    numbers = [F.when(same, F.col("number") + F.col("carried")).otherwise(F.col("number")).alias("number"), F.when(same & (F.col("number") == 1), F.col("carried_time")).otherwise(F.col("previous_time")).alias("previous_time")]
    return merged.join(F.broadcast(before), "range", "left").select("range", "place", *(c for c, _ in CAPTURE), *numbers)


def carried(ends: list[tuple]) -> list[tuple]:
    """Ends of ranges (range, first place, first key, last place, last key, its number, its time), some in pieces -> (range, key, captures of it before the range, time of the last)."""
    whole: dict[int, tuple] = {}
    for r, first, first_key, *last in ends:
        a, b = whole.get(r, ((first, first_key), last))
        whole[r] = min(a, (first, first_key)), max(b, last)
    out, key, number, time = [], None, 0, None
    for r in sorted(whole):
        (_, first_key), (_, last_key, last_number, last_time) = whole[r]
        if key == first_key:
            out.append((r, key, number, time))
        number = last_number + (number if key == first_key == last_key else 0)
        key, time = last_key, last_time
    return out


def capture_histories(pages: DataFrame) -> DataFrame:
    """Archives written, read back, and their indexes merged: one row per page."""
    sorted_runs = runs(write(pages))
    return merge(sorted_runs, max(1, -(-sorted_runs.count() // RANGE)))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

"""WARC archives through Spark's writers, and their capture index by an external merge of sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, new_path, stored

FILE_BYTES, MOST_BYTES = 8 << 20, 512 << 20
#: Captures that one task merges, about.
RANGE_ROWS = 50_000
RECORD, PROFILE = "urn:strandwork:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: RFC 4648 alphabet and the digits that conv() writes in base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits (5 hex digits) make 4 base32 digits."""
    digest = F.sha1(body)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", epoch: str = "2024-01-01 00:00:00") -> None:
    """Write a WARC record for each row into gzip files of about FILE_BYTES of records under path.

    Of records with equal payloads (length and SHA-1) of at least least_bytes, that with the smallest key holds the
    payload as a response; others revisit it and hold headers only. The table has no capture times, so a record's
    date is `epoch` plus key seconds. A null payload is empty, a null URL is urn:none; repeated rows of the smallest
    key are responses each; a null key is revisited by none; other columns are ignored.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("urn:none")).alias("url"), body.alias("body"))
    rows = rows.select("*", F.length("body").alias("n"), sha1_base32(F.col("body")).alias("digest"))
    spark = pages.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes"), F.max("n").alias("most")).first()
    mean, most = (size["bytes"] or 0) // max(size["rows"], 1) + 600, (size["most"] or 0) + 600
    per_file = max(1, min(FILE_BYTES // mean, MOST_BYTES // most))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    typed = rows.join(first, ["digest", "n"], "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.lit(False)))
    crlf = "\r\n"
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(epoch)) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: <{RECORD}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">{crlf}WARC-Target-URI: "),
        uri,
        F.lit(f"{crlf}WARC-Date: "),
        date,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(f"{crlf}X-Payload-Length: "),
        F.col("n"),
    )
    http = F.concat(F.lit(HTTP), F.col("n"), F.lit(crlf * 2))
    seen = F.concat(head, F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: <{RECORD}"), F.col("first"), F.lit(f">{crlf}Content-Length: 0{crlf * 2}"))
    held = F.concat(head, F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.length(http) + F.col("n"), F.lit(crlf * 2), http, F.decode("body", "UTF-8"))
    typed.select(F.when(F.col("revisit"), seen).otherwise(held).alias("value")).write.option("lineSep", crlf * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        host = None
    if not host:
        return url.lower()
    port = f":{parts.port}" if parts.netloc.rpartition(":")[2].isdigit() and parts.netloc.count(":") == 1 else ""
    return (",".join(reversed(host.split("."))) + f"{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")).lower()


def records(body: bytes):
    """(offset, length, headers, block) of each record of an archive; damage raises ValueError."""
    at = 0
    while at < len(body):
        end = body.find(b"\r\n\r\n", at)
        if not body.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = body[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        start, n = end + 4, int(headers["content-length"])
        if body[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends early")
        yield at, start + n + 4 - at, headers, body[start : start + n]
        at = start + n + 4


CAPTURE = "url_key string, ts string, page_id long, archive string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _key(row):
    return row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4]


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], names=_NAMES)


def _runs(batches):
    """Each archive's captures, payloads checked against their digests, as one sorted run; offsets are those in the unzipped archive."""
    number = lambda v: int(v.removeprefix(f"<{RECORD}").rstrip(">")) if v and "none" not in v else None
    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, name = [], path.rsplit("/", 1)[-1]
            for offset, length, h, block in records(gzip.decompress(body.as_py())):
                digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    n = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"digest of the record at byte {offset} of {name}")
                rows.append((url_key(h["warc-target-uri"]), h["warc-date"], number(h["warc-record-id"]), name, offset, length, h["warc-type"], digest, n, number(h.get("warc-refers-to"))))
            yield _table(sorted(rows, key=_key))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under path: files are read whole (they are bounded when written), a sorted run each."""
    arrow_batches(spark, 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_runs, CAPTURE)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next winner costs log2(k) comparisons."""

    def __init__(self, runs: list[list], key):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.keys = [(0, key(r[0])) if r else (1,) for r in runs]
        self.key = key
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if (self.keys[other], other) < (self.keys[i], i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if self.keys[i] == (1,):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            run = self.runs[i]
            self.keys[i] = (0, self.key(run[self.at[i]])) if self.at[i] < len(run) else (1,)
            self._play(i)


def _merge(batches):
    """A range of keys: its rows are stretches of the archives' sorted runs, which a loser tree merges.

    A stretch that comes in pieces out of order is as many runs; a range holds about RANGE_ROWS rows, however many there are.
    """
    runs: list[list] = []
    of: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            run = of.get(row[3])
            if run is None or _key(row) < _key(run[-1]):
                run = of[row[3]] = []
                runs.append(run)
            run.append(row)
    part, out, n = TaskContext.get().partitionId(), [], 0
    for row in LoserTree(runs, _key):
        out.append((row, n))
        n += 1
        if len(out) == 20000:
            yield _numbered(out, part)
            out = []
    if out:
        yield _numbered(out, part)


def _numbered(rows, part):
    base = _table([r for r, _ in rows])
    return pa.RecordBatch.from_arrays([*base.columns, pa.array([part] * len(rows), pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=[*_NAMES, "range_no", "place"])


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered capture histories: by url_key, ts and page_id within range_no and place, ranges in order.

    runs is a written table of locally sorted runs. Keys are cut by a sample into ranges of about range_rows captures, so
    what a task holds does not grow with the table; time, page and place in the archive are part of the key, so one URL
    with a third of all captures is spread over ranges. Each range merges the stretches of the runs that fall into it.
    """
    spark = runs.sparkSession
    n = -(-runs.count() // range_rows) or 1
    arrow_batches(spark, 5000)
    dealt = runs.repartitionByRange(n, "url_key", "ts", "page_id", "archive", "offset")
    return dealt.mapInArrow(_merge, CAPTURE + ", range_no int, place long")


def archive_and_index(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC, read the archives back, and return their merged capture index. No rows give no rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    runs = stored(read_captures(spark, path), "captures")
    return merge_index(runs)

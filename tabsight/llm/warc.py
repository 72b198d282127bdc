"""WARC archives with a two-level capture index (operator 7).

Archives.  Every page becomes one record, compressed as gzip members of its
own (the .warc.gz convention), so a record can be read by offset.  Of records
with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest
page id is the response and the others are revisits that refer to it; equal
payloads are found on narrow rows (digest and length, largest id by
aggregation), so a payload that a third of all pages share moves no html.
Records are dealt by a hash of the page and cut into archives of about
``ARCHIVE_BYTES``.

Files are written by Spark's text sink, which works on any store Spark writes
to: a gzip member ends with its length in four little-endian bytes, so below
16 MB the last byte is zero, and that byte is what the sink appends as line
separator.  A larger record is closed by an empty member.

Index.  Lines (capture key, place of the record) are sorted by the
reversed-host form of the URL and page id, and packed into compressed blocks
of ``BLOCK_LINES``, at most ``FILE_BLOCKS`` of them a file; the sparse
directory has one row per block (file, offset, length, first and last key).
``lookup`` finds the index file of a key among the files' first keys (one row
for each 100,000 captures), binary-searches that file's part of the directory,
and reads the ranges of the blocks it needs; ``read_records`` reads the ranges
of the records out of the archives.  Only places and keys are shuffled; tasks
open the files themselves by ``pyarrow.fs`` (local and mounted paths, and the
stores that library knows: any other scheme is an error there).

Defined cases: null html is an empty payload; null urls and ids have keys of
their own; equal rows give one response and revisits to it; line breaks in a
URL are escaped in the header; an empty table gives empty archives.
"""
from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.llm.common import written

MIN_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
BLOCK_LINES = 500
FILE_BLOCKS = 200
READ_BYTES = 4 << 20
_EMPTY = gzip.compress(b"", mtime=0)


# ------------------------------------------------------------------- records

def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed-host key of a capture; sorts by host, path, then page."""
    tail = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    if url is None:
        return f"-\t{tail}"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", clean(url))
    host, slash, path = rest.partition("/")
    host = re.sub(r":\d+$", "", host.rpartition("@")[2]).lower()
    return f"{','.join(reversed(host.split('.')))}){slash}{path}\t{tail}"


def clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url)


def member(data: bytes) -> bytes:
    """One record as gzip members; the last byte is zero."""
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1] == 0 else out + _EMPTY


def _num(v) -> int | None:
    return None if v is None or v != v else int(v)


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url, copy: int, revisit: bool) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'-' if page_id is None else page_id}:{copy}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head.append(("Refers-To-Page-ID", str(refers_to)))
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", clean(refers_url)))
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                 .encode() + payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each record of an archive, found by walking
    its gzip members (an empty member belongs to the record before it)."""
    at, size, pending = 0, len(content), None
    view = memoryview(content)
    while at < size:
        d = zlib.decompressobj(31)
        data, pos = [d.decompress(view[at:at + (1 << 16)])], at + (1 << 16)
        while not d.eof and pos < size:
            data.append(d.decompress(view[pos:pos + (1 << 18)]))
            pos += 1 << 18
        end = min(pos, size) - len(d.unused_data)
        body = b"".join(data)
        if body:
            if pending:
                yield pending
            pending = (at, end - at, body)
        elif pending:
            pending = (pending[0], end - pending[0], pending[2])
        at = end
    if pending:
        yield pending


# ------------------------------------------------------------------- writing

def _key(*cols):
    return F.md5(F.concat_ws("\x01", *[F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")),
                                                F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]))


def plan_records(pages: DataFrame) -> DataFrame:
    """One row per distinct page row: key, whether its payload repeats and the
    response it would refer to.  Narrow rows only."""
    narrow = written(pages.select("page_id", "url", "digest", "bytes"), "warc_narrow")
    groups = (narrow.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
              .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("r")).filter("n > 1")
              .select("digest", "bytes", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url")))
    distinct = narrow.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.join(groups, ["digest", "bytes"], "left").select(
        _key("page_id", "url", "digest").alias("key"), "refers_to", "refers_url",
        F.col("refers_to").isNotNull().alias("repeats"))


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext
    part, number, size = TaskContext.get().partitionId(), 0, 0
    for pdf in frames:
        names, blobs = [], []
        for r in pdf.itertuples(index=False):
            page_id, refers = _num(r.page_id), _num(r.refers_to)
            url = r.url if isinstance(r.url, str) else None
            refers_url = r.refers_url if isinstance(r.refers_url, str) else None
            html = r.html if isinstance(r.html, str) else ""
            revisit = bool(r.repeats) and not (page_id == refers and url == refers_url and r.copy == 1)
            blob = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), r.digest, refers, refers_url,
                                 int(r.copy), revisit))
            if size and size + len(blob) > ARCHIVE_BYTES:
                number, size = number + 1, 0
            size += len(blob)
            names.append(f"{part:06d}-{number:04d}")
            blobs.append(blob[:-1])         # the sink appends the closing zero byte
        yield pd.DataFrame({"archive": names, "value": blobs})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Archives of ``pages`` under ``path``/archive=<name>."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))
    keyed = rows.select("page_id", "url", "html", "digest", _key("page_id", "url", "digest").alias("key"))
    # equal rows are numbered within their own key; keys spread whatever the payloads
    copy = Window.partitionBy("key").orderBy("key")
    ready = (keyed.join(plan_records(rows), "key").withColumn("copy", F.row_number().over(copy))
             .drop("key"))
    blobs = ready.mapInPandas(_records, "archive string, value binary")
    (blobs.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive")
     .option("lineSep", "\x00").option("compression", "none").text(path))


# --------------------------------------------------------------------- index

_LINES = "ckey string, path string, offset long, length long"
_DIRECTORY = "path string, offset long, length long, first_key string, last_key string, n long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
            .load(path).select("path", "content"))


def _index_lines(frames):
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            for offset, length, data in members(content):
                h, _ = parse(data)
                page = h.get("Page-ID")
                out.append((capture_key(h.get("WARC-Target-URI"), None if page is None else int(page)), path, offset, length))
            yield pd.DataFrame(out, columns=["ckey", "path", "offset", "length"])


def _blocks(frames):
    held: list[str] = []
    for pdf in frames:
        held += ["\x1f".join(map(str, r)) for r in pdf.itertuples(index=False)]
        full = len(held) // BLOCK_LINES * BLOCK_LINES
        yield pd.DataFrame({"value": [member("\n".join(held[i:i + BLOCK_LINES]).encode("utf-8", "surrogatepass"))[:-1]
                                      for i in range(0, full, BLOCK_LINES)]})
        held = held[full:]
    if held:
        yield pd.DataFrame({"value": [member("\n".join(held).encode("utf-8", "surrogatepass"))[:-1]]})


def _directory(frames):
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            for offset, length, data in members(content):
                lines = data.decode("utf-8", "surrogatepass").split("\n")
                out.append((path, offset, length, lines[0].split("\x1f")[0], lines[-1].split("\x1f")[0], len(lines)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DIRECTORY.split(", ")])


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """Sorted, compressed blocks under ``path``/blocks and the sparse
    directory under ``path``/directory, from the archives alone."""
    lines = written(_files(spark, archives).mapInPandas(_index_lines, _LINES), "warc_lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "ckey").sortWithinPartitions("ckey", "path", "offset")
    (ordered.mapInPandas(_blocks, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS)
     .text(f"{path}/blocks"))
    _files(spark, f"{path}/blocks").mapInPandas(_directory, _DIRECTORY).write.parquet(f"{path}/directory")


def read_ranges(path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (offset, length) of a file, by offset; ranges that
    touch are read at once, up to ``READ_BYTES``."""
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        i = 0
        while i < len(ranges):
            start, j = ranges[i][0], i + 1
            end = start + ranges[i][1]
            while j < len(ranges) and ranges[j][0] <= end and sum(ranges[j]) - start <= READ_BYTES:
                end, j = max(end, sum(ranges[j])), j + 1
            data = f.read_at(end - start, start)
            yield from (data[at - start:at - start + length] for at, length in ranges[i:j])
            i = j


def _find(keys: list[str], directory: pd.DataFrame, path: str) -> list[tuple]:
    """Binary search of keys in the directory of one index file; each block
    that may hold one is read from the file and decompressed once."""
    d = directory.sort_values("offset")
    first, last = d["first_key"].tolist(), d["last_key"].tolist()
    need: dict[int, set[str]] = {}
    for k in keys:
        i = bisect.bisect_left(last, k)
        while i < len(first) and first[i] <= k:
            need.setdefault(i, set()).add(k)
            i += 1
    blocks = sorted(need)
    ranges = [(int(d["offset"].iloc[i]), int(d["length"].iloc[i])) for i in blocks]
    out = []
    for i, block in zip(blocks, read_ranges(path, ranges)):
        text = b"".join(x for _, _, x in members(block)).decode("utf-8", "surrogatepass")
        for line in text.split("\n"):
            k, archive, offset, size = line.split("\x1f")
            if k in need[i]:
                out.append((k, archive, int(offset), int(size)))
    return out


def lookup(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """Places (ckey, path, offset, length) of the captures ``keys(ckey)``."""
    directory = spark.read.schema(_DIRECTORY).parquet(f"{index}/directory")
    fences = [(r["path"], r["lo"], r["hi"]) for r in directory.groupBy("path").agg(
        F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect()]     # one row per index file
    fences.sort(key=lambda f: f[1:])
    lows, highs = [f[1] for f in fences], [f[2] for f in fences]

    def route(frames):
        for pdf in frames:
            ks, paths = [], []
            for k in pdf["ckey"]:
                i = bisect.bisect_left(highs, k)
                while i < len(lows) and lows[i] <= k:
                    ks.append(k)
                    paths.append(fences[i][0])
                    i += 1
            yield pd.DataFrame({"path": paths, "ckey": ks}, dtype=object)

    def search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = _find(asked["ckey"].tolist(), known, asked["path"].iloc[0]) if len(asked) and len(known) else []
        return pd.DataFrame(found, columns=["ckey", "path", "offset", "length"])

    # keys and directory rows of one index file (both bounded) meet in one group
    routed = keys.distinct().mapInPandas(route, "path string, ckey string")
    return routed.groupBy("path").cogroup(directory.groupBy("path")).applyInPandas(search, _LINES)


_READ = ("page_id long, payload_bytes long, payload_digest string, stored_digest string, record_type string, "
         "refers_to long")


def _read(frames):
    for pdf in frames:
        for path, places in pdf.groupby("path", sort=False):
            out = []
            ranges = sorted(zip(places["offset"].astype(int), places["length"].astype(int)))
            for blob in read_ranges(path, ranges):
                h, payload = parse(b"".join(x for _, _, x in members(blob)))
                own = h["WARC-Type"] == "response"
                out.append((_num(h.get("Page-ID")), len(payload) if own else None,
                            hashlib.sha1(payload).hexdigest() if own else None, h["WARC-Payload-Digest"][5:],
                            h["WARC-Type"], _num(h.get("Refers-To-Page-ID"))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")], dtype=object)


def read_records(spark: SparkSession, archives: str, places: DataFrame) -> DataFrame:
    """Records at ``places``: the places of an archive come to one task in
    order of offset, which reads and parses just those ranges."""
    return (places.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
            .mapInPandas(_read, _READ))


def read_back(spark: SparkSession, archives: str, index: str, pages: DataFrame, id_col: str = "page_id",
              url_col: str = "url") -> DataFrame:
    """Every page's capture, through the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  A revisit's payload is that of
    the response it refers to."""
    @F.pandas_udf("string")
    def key(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if i is None else int(i)) for u, i in zip(urls, ids)], dtype=object)

    keys = pages.select(key(F.col(url_col).cast("string"), F.col(id_col).cast("string")).alias("ckey"))
    got = written(read_records(spark, archives, lookup(spark, index, keys)), "warc_read")
    full = (got.filter("record_type = 'response'").groupBy(F.col("stored_digest").alias("stored_digest"))
            .agg(F.max("payload_bytes").alias("full_bytes"), F.max("payload_digest").alias("full_digest")))
    revisits = got.filter("record_type = 'revisit'").join(full, "stored_digest", "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
        "record_type", "refers_to")
    responses = got.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)

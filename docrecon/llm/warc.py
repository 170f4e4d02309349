"""WARC archives with a two-level capture index.

Records go, in the order of their reversed-host URL keys, into archives of one gzip member a record. Beside each archive
stands its index: lines of (key, record id, offset, length), sorted by key, in zlib blocks of ``BLOCK`` lines, and a
sparse directory with each block's first key, offset and length. A look-up searches the table of archives by key range,
then the directory and the block by bisection, and reads the record's bytes only.

Edge cases: a null html is an empty payload. A null URL has the empty key and no WARC-Target-URI. A null page id is kept
as a record without an id; it never is the largest. Rows that share a page id are records of their own; if several share
the largest page id of their payload, all of these are responses. An empty table gives no archive. Other columns are
ignored. Payloads are written and read one at a time. Files of attempts that failed stay behind under names that no
manifest lists.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.ranges import bucket_of, shuffle_parts, spread_of
from docrecon.llm.storage import bounded, create, fresh_path, materialize, open_random

BLOCK = 1024
#: Gzip level of records; text of web pages gains little beyond it.
LEVEL = 1
MANIFEST = "archive int, warc string, index string, directory string, n_records long, first_key string, last_key string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?"


def url_key_column(url: Column) -> Column:
    """The reversed-host key of a URL: ``org,example,www)/path?query`` in lower-case host, scheme and fragment left out."""
    plain = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(plain, _HOST, 1))
    port = F.regexp_extract(plain, _HOST, 2)
    rest = F.regexp_replace(F.regexp_replace(plain, _HOST, ""), "#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(host == "", plain).otherwise(key)


def url_key(url: str | None) -> str:
    """The same key on the driver, for look-ups."""
    url = url or ""
    found = re.match(_HOST, url)
    if not found or not found[1]:
        return url
    rest = re.sub("#.*$", "", url[found.end() :], flags=re.S)
    return ",".join(reversed(urlsplit("//" + found[1].lower()).netloc.split("."))) + (found[2] or "") + ")" + (rest or "/")


def classify(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest, record_type and refers_to.

    Of payloads that several rows share only the digest is counted, summed up before it is shuffled; the table of those
    digests then meets the rows in a join that splits hot digests. Rows keep their html where they are until then.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    shared = large.groupBy("payload_digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared.select(F.col("payload_digest").alias("d"), "last_id"), "warc-shared")
    joined = rows.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last_id")).alias("refers_to"))


def _record(row: dict) -> bytes:
    """One WARC record, compressed as a gzip member."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else (row["html"] or "").encode()
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row["page_id"]}:{row["url"]}')}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a compressed record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def _write_index(index: str, directory: str, lines: list[tuple]) -> None:
    """Blocks of sorted lines, and the directory of blocks."""
    sparse, at = [], 0
    with create(index) as file:
        for start in range(0, len(lines), BLOCK):
            block = zlib.compress("\n".join(json.dumps(x) for x in lines[start : start + BLOCK]).encode(), 6)
            file.write(block)
            sparse.append([lines[start][0], at, len(block)])
            at += len(block)
    with create(directory) as file:
        file.write(json.dumps(sparse).encode())


def write_archives(pages: DataFrame, out_dir: str | None = None, parts: int | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write a record of every row and return the manifest, a row an archive; archives hold ascending ranges of keys.

    A key that fills several archives (a hot host with equal URLs) is spread over them.
    """
    out_dir = out_dir or fresh_path(pages.sparkSession, "warc")
    rows = classify(bounded(pages), least_bytes).withColumn("key", url_key_column(F.col("url")))
    cuts = string_cuts(pages.select(url_key_column(F.col("url")).alias("key")), parts or shuffle_parts(pages))
    placed = rows.withColumn("archive", bucket_of(F.col("key"), spread_of(F.col("page_id")), cuts, "string"))
    ordered = placed.repartitionById(len(cuts) + 1, F.col("archive")).sortWithinPartitions("archive", "key", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, stem, file, at, lines = None, "", None, 0, []

        def done():
            file.close()
            _write_index(stem + ".cdx", stem + ".dir", lines)
            row = {"archive": archive, "warc": stem + ".warc.gz", "index": stem + ".cdx", "directory": stem + ".dir", "n_records": len(lines), "first_key": lines[0][0], "last_key": lines[-1][0]}
            return pa.RecordBatch.from_pylist([row], pa.schema([("archive", pa.int32()), ("warc", pa.string()), ("index", pa.string()), ("directory", pa.string()), ("n_records", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if row["archive"] != archive:
                        if file:
                            yield done()
                        archive, at, lines = row["archive"], 0, []
                        stem = f"{out_dir}/pages-{archive:06d}-{uuid.uuid4().hex}"
                        file = create(stem + ".warc.gz")
                    member = _record(row)
                    file.write(member)
                    lines.append((row["key"], row["page_id"], at, len(member)))
                    at += len(member)
        if file:
            yield done()

    return materialize(ordered.mapInArrow(write, MANIFEST), "warc-manifest")


def string_cuts(df: DataFrame, parts: int, sample: int = 100_000) -> list[str]:
    """Ascending keys that cut ``df`` (key) into ``parts`` ranges, from a sample of about ``sample`` keys.

    Only the balance of the archives rests on the sample; every row is placed.
    """
    if parts < 2:
        return []
    rows = df.count()
    taken = df.select("key").filter(F.rand(11) < min(sample, 200 * parts) / max(rows, 1))  # so many rows on average
    keys = sorted(r["key"] for r in taken.collect())
    return [str(keys[len(keys) * i // parts]) for i in range(1, parts)] if len(keys) else []


def entries(row: dict, key: str | None = None) -> Iterator[list]:
    """Index lines of an archive in the order of their keys: all, or those of one key, found by bisection."""
    with open_random(row["directory"]) as file:
        sparse = json.loads(file.read())
    blocks = range(len(sparse))
    if key is not None:  # a key can begin in the block before the first that starts with it
        firsts = [s[0] for s in sparse]
        blocks = range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key))
    with open_random(row["index"]) as file:
        for b in blocks:
            file.seek(sparse[b][1])
            lines = [json.loads(x) for x in zlib.decompress(file.read(sparse[b][2])).decode().split("\n")]
            if key is None:
                yield from lines
            else:
                keys = [x[0] for x in lines]
                yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]


def lookup(manifest: DataFrame, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All captures of ``url``: headers and block. Reads the directories and blocks that can hold it, then byte ranges."""
    key, found = url_key(url), []
    for row in manifest.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).toLocalIterator():
        with open_random(row["warc"]) as file:
            for _, _, at, length in entries(row.asDict(), key):
                file.seek(at)
                found.append(parse_record(file.read(length)))
    return found


def read_archives(manifest: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key of every record, by way of the index.

    The digest and length of a response are taken of the payload read back and must agree with its headers.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with open_random(row["warc"]) as file:
                    for key, page_id, at, length in entries(row):
                        file.seek(at)
                        headers, body = parse_record(file.read(length))
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        n, kind = int(headers["X-Payload-Length"]), headers["WARC-Type"]
                        if kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{row['warc']} at {at}: the payload doesn't agree with its headers")
                        refers = headers.get("X-Refers-To-Page-ID")
                        out.append({"page_id": page_id, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers is not None else None, "url_key": key})
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    parts = parts or shuffle_parts(manifest)
    dealt = manifest.repartitionById(parts, F.pmod(F.col("archive"), F.lit(parts)))
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string")


def archive_pages(pages: DataFrame, out_dir: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives and return what the archives say of each page."""
    return read_archives(write_archives(pages, out_dir, least_bytes=least_bytes))

"""WARC archives: writing crawls, and a normaliser of monolithic gzip.

A monolithic archive is one gzip stream over a whole file, so no record can be read without inflating
all before it. The normaliser inflates such a stream once, in blocks, rewrites every record as its own
gzip member, and writes a sidecar index (a line of offset, length, type and id for each record).

Edge cases: a null payload is empty; a null url or page id leaves its header out; repeated pages each
get a record; where several rows have the largest page id of a group of equal payloads, all are
responses; where a group's page ids are all null, all are. An empty table gives no file. Other columns are not read.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from . import files
from .session import materialize, new_dir, small_batches, table

#: Payloads of at least this many bytes are revisits of an equal one.
REVISIT_BYTES = 1000
#: Bytes of records after which a file is closed and the next one begun.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 18
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "path string, n_records long"


def record_id(page_id, digest):
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}')}>"


def record(page_id, url, payload, digest, refers_to=None, date="1970-01-01T00:00:00Z"):
    """The bytes of a response record, or of a revisit record of the page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw):
    """(first line, {lower-case name: value}) of a header block."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(f, size=READ_BYTES):
    """The bytes of a gzip file of any number of members, in blocks."""
    z = zlib.decompressobj(31)
    while raw := f.read(size):
        while raw:
            if out := z.decompress(raw, 4 * READ_BYTES):
                yield out
            if z.eof:
                raw = z.unused_data
                z = zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail
    if out := z.flush():
        yield out


def records(blocks):
    """(header block, whole record) of each record of an inflated stream."""
    held = bytearray()
    blocks = iter(blocks)

    def until(enough):
        while not enough():
            more = next(blocks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        seen = 0

        def has_head():
            nonlocal seen
            found = held.find(b"\r\n\r\n", max(0, seen - 3)) >= 0
            seen = len(held)
            return found

        if not until(has_head):
            if held.strip():
                raise ValueError("the archive ends inside a record's header")
            return
        head = bytes(held[: held.find(b"\r\n\r\n")])
        total = len(head) + 4 + int(headers(head)[1]["content-length"]) + 4
        if not until(lambda: len(held) >= total):  # noqa: B023
            raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:total])
        del held[:total]


def parse(head, whole):
    """What a record says of its page: page_id, payload_bytes, payload_digest (hex), record_type, refers_to."""
    _, h = headers(head)
    block = whole[len(head) + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(h[k]) if k in h else None
    if h["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size, digest = int(headers(http)[1]["content-length"]), base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
    return number("warc-page-id"), size, digest, h["warc-type"], number("warc-refers-to-page-id")


def normalise(source, target, index, level=6):
    """Rewrites a gzip archive so that each record is a member of its own; returns how many there are."""
    n = 0
    with files.opened(source) as f, files.Output(target) as out, files.Output(index) as side:
        for head, whole in records(inflated(f)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(whole) + z.flush()
            _, h = headers(head)
            at = out.tell()
            out.write(member)
            side.write(f"{at} {len(member)} {h['warc-type']} {h['warc-record-id']}\n".encode())
            n += 1
    return n


def read_member(f, at, size):
    """One record of a normalised archive, by its place: (header block, whole record)."""
    f.seek(at)
    whole = zlib.decompress(f.read(size), 31)
    return whole[: whole.find(b"\r\n\r\n")], whole


def with_revisits(pages, page_id="page_id", url="url", html="html"):
    """page_id, url, payload, digest and refers_to (null for responses) of every page."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(spark, groups, "revisits")  # read anew, so that a group with a great many pages can be split in the join
    refers = F.when(~F.equal_null("page_id", "kept"), F.col("kept"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(rows, place):
    """Writes the frame of with_revisits() as monolithic archives under `place`; returns the manifest (path, n_records)."""
    small_batches(rows.sparkSession)

    def run(batches):
        z = out = None
        n = size = 0

        def close():
            nonlocal z, out, n, size
            out.write(z.flush())
            out.__exit__(None)
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})
            z, out, n, size = None, None, 0, 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{place}/crawl-{uuid.uuid4().hex}.warc.gz"
                    z, out = zlib.compressobj(1, zlib.DEFLATED, 31), files.Output(path)
                raw = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return materialize(rows.sparkSession, rows.mapInArrow(run, _MANIFEST), "manifest")


def normalise_all(manifest, place):
    """Normalises the archives of a manifest, one task for each; returns a manifest with the column index too."""
    spark = manifest.sparkSession

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{place}/members-{uuid.uuid4().hex}.warc.gz"
                n = normalise(path, target, f"{target}.idx")
                yield pa.RecordBatch.from_pydict({"path": [target], "n_records": [n], "index": [f"{target}.idx"]})

    return materialize(spark, manifest.repartition(max(1, manifest.count())).mapInArrow(run, f"{_MANIFEST}, index string"), "manifest")


def read(manifest):
    """One row for each record of normalised archives, each read by its place in the index."""

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                places = [tuple(map(int, x.split()[:2])) for x in files.read(index).decode().splitlines()]
                with files.opened(path) as f:
                    for k in range(0, len(places), 5000):
                        rows = [parse(*read_member(f, *p)) for p in places[k : k + 5000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_gzip_normaliser(spark, sf_dir):
    crawl = write(with_revisits(table(spark, sf_dir, "pages")), new_dir(spark, "crawl"))
    return read(normalise_all(crawl, new_dir(spark, "warc")))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
, d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p)
, k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> kept THEN kept END AS refers_to
FROM k"""

"""WARC archives: captures written as transactions of records, and assembled again through their concurrent-to identifiers.

Written are, for each page, a request, a response (or a revisit, where a page
with a larger id has the same payload of `least` bytes or more) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. Records
are packed into archives of some megabytes, one Spark row each, which Spark's
text writer commits as one file a row with CRLF CRLF at the end, as a record
has it. So a lost executor leaves no part of an archive behind.

Pages with equal payloads meet by SHA-256 without their texts: the largest id
of each payload that comes twice goes to the pages, as a broadcast up to
BROADCAST_PAYLOADS payloads, otherwise as a join. Partial counts come first, so
a payload that a third of all pages has is a row for each page id at most.

`read` takes WARC files (plain, gzipped as a whole or by record) by the
Content-Length of each record, and `assemble` anchors every record to a
response: records are linked, in either direction, by WARC-Concurrent-To, and
links are followed until no record is reached newly. A capture is one nested
row: its response or revisit, its requests, its metadata, and the response that
a revisit refers to: the one it names, or one with the same payload digest
where it names none that is there.

Defined results: a null html is an empty payload; a null url has no target; a
null page id is no id, smaller than any; pages that repeat an id with the same
payload, if no larger id has it, are responses each; payloads are bytes, whatever their length; extra columns are not
written. A record that no response is linked to is a capture of its own, with
a null response; a revisit whose response isn't in the archives has a null
`refers_to`. No archives, or an empty table: an empty result. A file that is
cut off or no WARC raises an error.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.batches import pieces
from tidegraph.llm.common import checkpoint_folder, checkpointed, parallel

#: Payloads that come twice, up to which they are broadcast (some 60 bytes each).
BROADCAST_PAYLOADS = 20_000
#: All records have this date: pages carry none.
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, name: str, block: bytes, *fields: tuple[str, str | None]) -> bytes:
    """A record without the line ends that close it; fields that are None are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


def digest_field(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def transaction(name: str, page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: str | None) -> bytes:
    """The request, response (or revisit) and metadata records of one capture."""
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    try:
        parts = urlsplit(target or "")
    except ValueError:
        parts = urlsplit("")
    asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main, digest = f"urn:uuid:{name}", digest_field(sha1(payload).digest())
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        response = record("revisit", main, answer, *fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to and f"<urn:uuid:{refers_to}>"))
    else:
        response = record("response", main, answer + payload, *fields)
    beside = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{main}>")]
    said = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return END.join([
        record("request", f"{main}:request", asked, *beside, ("Content-Type", "application/http; msgtype=request")),
        response,
        record("metadata", f"{main}:metadata", said, *beside, ("Content-Type", "application/warc-fields")),
    ])


def _named(*of: Column) -> Column:
    """An identifier in a UUID's form."""
    h = F.md5(F.concat_ws(":", *of))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def captures(pages: DataFrame, least: int = 1000) -> DataFrame:
    """name, page_id, url, html, revisit and refers_to (name of the response, if one row alone has the largest id) of each page (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= least, F.unhex(F.sha2(payload, 256))).alias("key"))
    each = rows.where("key IS NOT NULL").groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"))
    same = each.groupBy("key").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("n")).where("n > 1")
    same = checkpointed(same.select("key", F.col("last.page_id").alias("last"), (F.col("last.n") == 1).alias("one")))
    if same.count() <= BROADCAST_PAYLOADS:
        same = F.broadcast(same)
    found = rows.join(same, "key", "left")
    revisit = F.col("one").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    response = _named(F.lit("response"), F.hex("key"), F.col("last").cast("string"))
    own = _named(F.lit("capture"), F.monotonically_increasing_id().cast("string"))
    return found.select(F.when(F.col("one") & ~revisit, response).otherwise(own).alias("name"), "page_id", "url", "html", revisit.alias("revisit"), F.when(F.col("one") & revisit, response).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 1000, archive_bytes: int = 16 << 20) -> None:
    """The pages as gzipped WARC files in the folder path; a file holds about archive_bytes of records, or one longer capture."""
    rows = parallel(captures(pages, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            first = record("warcinfo", f"{held_name}:info", b"format: WARC File Format 1.1\r\n", ("Content-Type", "application/warc-fields"))
            out = pa.RecordBatch.from_arrays([pa.array([END.join([first, *held])], pa.binary())], ["archive"])
            held.clear()
            return out

        held_name = ""
        for part, texts in pieces(batches, "html"):
            others = (part.column(c).to_pylist() for c in ("name", "page_id", "url", "revisit", "refers_to"))
            for name, page_id, url, revisit, refers_to, payload in zip(*others, texts, strict=True):
                made = transaction(name, page_id, url, payload, revisit, refers_to)
                if held and size + len(made) > archive_bytes:
                    yield archive()
                if not held:
                    held_name, size = f"urn:uuid:{name}", 0
                held.append(made)
                size += len(made)
        if held:
            yield archive()

    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _headers(stream: io.BufferedReader) -> dict[str, list[str]]:
    """Lower-case names and values up to the empty line; lines that begin with white space go on with the one before."""
    out: dict[str, list[str]] = {}
    values: list[str] = []
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC record is cut off in its header")
        if line[:1] in b" \t" and values:
            values[-1] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            values = out.setdefault(name.strip().lower(), [])
            values.append(value.strip())
    return out


def records(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers and block of each record of a WARC file."""
    plain = io.BytesIO(raw)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=plain) if raw[:2] == b"\x1f\x8b" else plain, 1 << 16)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            head = _headers(stream)
            size = int(head.get("content-length", ["0"])[0])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError("a WARC record is cut off in its block")
            yield head, block
    except (EOFError, zlib.error) as e:
        raise ValueError("a gzipped WARC file is cut off or damaged") from e


_RECORD = "record_id string, type string, uri string, date string, concurrent array<string>, refers_id string, http array<string>, payload_bytes long, payload_digest string, intact boolean, fields array<struct<name:string,value:string>>, payload binary"
_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent", pa.list_(pa.string())), ("refers_id", pa.string()), ("http", pa.list_(pa.string())),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary()),
])


def _row(head: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    first = lambda name: head.get(name, [None])[0]
    bare = lambda x: x and x.strip("<>")
    kind, media = first("warc-type"), first("content-type") or ""
    http, payload, fields = [], block, []
    length = None
    if media.startswith("application/http"):
        top, gap, payload = block.partition(END)
        http = top.decode("utf-8", "replace").split("\r\n")
        length = next((int(v) for k, _, v in (x.partition(":") for x in http[1:]) if k.strip().lower() == "content-length" and v.strip().isdigit()), None)
    elif media.startswith("application/warc-fields"):
        fields = [{"name": k.strip(), "value": v.strip()} for k, c, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if c]
    said = first("warc-payload-digest")
    digest, intact = None if kind == "revisit" else sha1(payload).hexdigest(), None
    if said and said.lower().startswith("sha1:"):
        told = base64.b32decode(said[5:].upper()).hex() if len(said) == 37 else said[5:].lower()
        digest, intact = (told, None) if kind == "revisit" else (digest, told == digest)
    n = length if kind == "revisit" else len(payload)
    return (bare(first("warc-record-id")), kind, first("warc-target-uri"), first("warc-date"), [bare(x) for x in head.get("warc-concurrent-to", [])], bare(first("warc-refers-to")), http, n, digest, intact, fields, payload if payloads and kind != "revisit" else None)


def read(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the WARC files in path.

    payload_bytes and payload_digest are of the payload itself; of a revisit, as
    its header says. intact: whether a payload has the digest that its record gives.
    A file is read by one task; the archives that `write` makes are small.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for head, block in records(raw.as_py()):
                    rows.append(_row(head, block, payloads))
                    size += 500 + payloads * len(block)
                    if size > batch_bytes:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def anchored(links: DataFrame, anchors: DataFrame, most_rounds: int = 60) -> DataFrame:
    """record_id, root: the smallest response among those that each record (and each response) is linked to, over any number of links.

    links: record_id, other, in both directions; anchors: record_id of responses.
    """
    known = frontier = anchors.select("record_id", F.col("record_id").alias("root"))
    for _ in range(most_rounds):
        met = links.join(frontier.select(F.col("record_id").alias("other"), "root"), "other")
        frontier = checkpointed(met.groupBy("record_id").agg(F.min("root").alias("root")))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        links = checkpointed(links.join(frontier.select("record_id"), "record_id", "left_anti"))
        if links.isEmpty():
            return known
    raise RuntimeError(f"records did not settle in {most_rounds} rounds")


def assemble(rows: DataFrame) -> DataFrame:
    """A nested row for each capture of the records that `read` gives: capture_id, response, requests, metadata, refers_to.

    response and the elements of requests and metadata have the records' columns;
    refers_to has capture_id and metadata of the response that a revisit refers to.
    """
    kept = rows.where("type IN ('response', 'revisit', 'resource', 'request', 'metadata', 'conversion')")
    is_main = F.col("type").isin("response", "revisit", "resource")
    named = checkpointed(kept.select("record_id", is_main.alias("main"), "concurrent"))
    given = named.select("record_id", F.explode("concurrent").alias("other"))
    both = given.union(given.select("other", "record_id")).where("record_id <> other").distinct()
    anchors = named.where("main").select("record_id")
    roots = anchored(checkpointed(both.join(anchors, "record_id", "left_anti")), anchors)
    whole = F.struct(*rows.columns)
    found = kept.join(roots, "record_id", "left").groupBy(F.coalesce("root", "record_id").alias("capture_id")).agg(
        F.max(F.when(is_main, whole)).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", whole))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type").isin("metadata", "conversion"), whole))).alias("metadata"),
    )
    held = checkpointed(found)
    again = F.coalesce(F.col("response.type") == "revisit", F.lit(False))
    responses = held.where("response.type = 'response'")
    to = F.struct("capture_id", "metadata")
    visits = held.where(again).join(responses.select(F.col("capture_id").alias("target"), to.alias("refers_to")), F.col("response.refers_id") == F.col("target"), "left").drop("target")
    named, open_visits = visits.where("refers_to IS NOT NULL"), visits.where("refers_to IS NULL").drop("refers_to")
    alike = responses.groupBy(F.col("response.payload_digest").alias("digest")).agg(F.max(to).alias("refers_to"))
    open_visits = open_visits.join(alike, F.col("response.payload_digest") == F.col("digest"), "left").drop("digest")
    others = held.where(~again).withColumn("refers_to", F.lit(None).cast(alike.schema["refers_to"].dataType))
    return others.unionByName(named).unionByName(open_visits)


def field(records: Column, name: str) -> Column:
    """The first value of a field in the metadata records of a capture; null if they have none."""
    return F.get(F.flatten(F.transform(records, lambda r: F.filter(r["fields"], lambda f: f["name"] == name))), F.lit(0))["value"]


def rewritten(pages: DataFrame, folder: str | None = None, least: int = 1000, archive_bytes: int = 16 << 20, payloads: bool = False) -> DataFrame:
    """The captures of pages, written to archives in a folder (one in the checkpoint folder) and read back."""
    path = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, archive_bytes)
    return assemble(read(pages.sparkSession, path, payloads))

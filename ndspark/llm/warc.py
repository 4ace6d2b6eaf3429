"""WARC archives: writing with segments, chunks and revisits, and reading them back."""

from __future__ import annotations

import gzip
import hashlib
import io
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, lookup, materialize, shared_folder, whole

CRLF = "\r\n"
#: The writer ends each record with this, as the format wants it.
END = CRLF * 2
URN = "urn:ndspark:page:"


def urn_of(ident, digest: str) -> str:
    """A record's identifier: the page's, escaped so that any text comes back, and the payload's digest."""
    return f"<{URN}{'null' if ident is None else '=' + quote(str(ident), safe='')}:{digest}>"


def page_of(urn: str | None) -> str | None:
    """The page's identifier in one of our record identifiers, null for a page without one; of other archives the part before a colon."""
    if not urn:
        return None
    page = urn.strip("<>").removeprefix(URN).split(":")[0]
    return unquote(page[1:]) if page.startswith("=") else None if page == "null" else page


def chunked(text: str, chars: int) -> str:
    """HTTP chunked framing of the text, in chunks of at most `chars` characters."""
    parts = [text[i : i + chars] for i in range(0, len(text), chars)]
    return "".join([x for p in parts for x in (f"{len(p.encode()):X}", CRLF, p, CRLF)] + [f"0{END}"])


def record(kind: str, headers: list[tuple[str, object]], block: str) -> str:
    """One record without its end, as text; headers that are null are left out."""
    lines = [f"WARC/1.1{CRLF}WARC-Type: {kind}", *[f"{name}: {value}" for name, value in headers if value is not None]]
    return f"{CRLF.join(lines)}{CRLF}Content-Length: {len(block.encode())}{END}{block}"


def page_records(ident, url: str, text: str, first, revisit: bool, chunk: int, segment: int):
    """The records of one page, one at a time; what is written is cut once, so a long page takes time in proportion."""
    payload = text.encode()
    digest = hashlib.sha1(payload).hexdigest()
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    block = f"{head}Content-Length: {len(payload)}{END}" if revisit else f"{head}Transfer-Encoding: chunked{END}{chunked(text, chunk)}"
    own, total, of = urn_of(ident, digest), len(block.encode()), -(-len(block) // segment)
    for k in range(of):
        start, last = k == 0, k == of - 1
        yield record(
            "continuation" if not start else "revisit" if revisit else "response",
            [
                ("WARC-Record-ID", own if start else f"{own[:-1]}:{k}>"),
                ("WARC-Date", "2024-01-01T00:00:00Z"),
                ("WARC-Target-URI", url or None),
                ("WARC-Payload-Digest", f"sha1:{digest}" if start else None),
                ("WARC-Refers-To", urn_of(first, digest) if start and revisit else None),
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if start and revisit else None),
                ("WARC-Segment-Number", k + 1 if of > 1 else None),
                ("WARC-Segment-Origin-ID", None if start else own),
                ("WARC-Segment-Total-Length", total if of > 1 and last else None),
                ("Content-Type", "application/http; msgtype=response" if start else None),
            ],
            block[k * segment : (k + 1) * segment],
        )


def written(batches, chunk: int, segment: int):
    """(id, url, text, first, revisit) -> value: a row each record, a few megabytes at a time."""
    for batch in batches:
        out, held = [], 0
        for ident, url, text, first, revisit in zip(*[c for c in batch.columns]):
            for value in page_records(ident.as_py(), url.as_py(), text.as_py(), first.as_py(), revisit.as_py(), chunk, segment):
                out.append(value)
                held += len(value)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", text_col: str = "html", least: int = 1000, chunk: int = 16_384, segment: int = 65_536, per_file: int = 2048, few: int = 50_000) -> None:
    """Write a record for each row of df to gzipped WARC files of at most `per_file` records under `folder`.

    Of rows with equal payloads of at least `least` bytes (by SHA-256), the one with the largest
    identifier is a response and the others revisit it; rows that repeat that identifier are
    responses too. A response's HTTP body is chunked; blocks over `segment` characters become continuation
    records. Null text is an empty payload. Rows with a null identifier are responses, and others
    never revisit them. Identifiers may be any text. An empty table gives archives without records.
    Up to `few` repeated payloads are broadcast, 32 bytes and an identifier each; with more, pages
    move by digest, frequent ones dealt out.
    """
    text = whole(text_col)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.regexp_replace(url, r"[\x00-\x20]", "").alias("url"), text.alias("text"), F.octet_length(text).alias("n"), F.unhex(F.sha2(text, 256)).alias("digest"))
    many = rows.where((F.col("n") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("w")).where("w > 1")
    many = materialize(many)
    if (repeated := many.count()) <= few:
        rows = rows.join(F.broadcast(many.drop("w")), "digest", "left") if repeated else rows.withColumn("first", F.lit(None).cast(df.schema[id_col].dataType))
    else:
        rows = lookup(rows, many, ["digest"], "w", df.count(), F.xxhash64("id"))
    revisit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("first") != F.col("id"))
    name = lambda c: F.col(c).cast("string").alias(c)
    out = rows.select(name("id"), "url", "text", name("first"), revisit.alias("revisit")).mapInArrow(lambda it: written(it, chunk, segment), "value string")
    out.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def records(stream):
    """(headers, block) of each record; header names in lower case."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a WARC record ends before its Content-Length")
        yield headers, block


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk has another length than it says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


FIELDS = "origin string, segment int, total bigint, kind string, id string, digest string, refers string, bytes bigint, problem string, block binary"


def payload_row(row: dict) -> dict:
    """A record whose block is whole, decoded: bytes and digest are the payload's; block goes."""
    try:
        head, _, body = row["block"].partition(END.encode())
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}
        if row["kind"] == "revisit":
            row["bytes"] = int(fields["content-length"])
        else:
            payload = unchunk(body) if fields.get("transfer-encoding") == "chunked" else body
            row["bytes"] = len(payload)
            if (digest := hashlib.sha1(payload).hexdigest()) != row["digest"]:
                row["problem"] = "the payload has another digest than its record says"
            row["digest"] = digest
    except (ValueError, KeyError) as e:
        row["problem"] = f"no HTTP message: {e}"
    row["block"] = None
    return row


def parse(batches, schema):
    """Rows (path, content) of archives -> rows of FIELDS. Records in one segment are decoded at once."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = io.BytesIO(content.as_buffer())
            out, held = [], 0
            for headers, block in records(gzip.GzipFile(fileobj=data) if path.as_py().endswith(".gz") else data):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = headers.get("warc-segment-number")
                row = {
                    "origin": headers.get("warc-segment-origin-id") or headers["warc-record-id"],
                    "segment": int(number) if number else None,
                    "total": int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
                    "kind": kind,
                    "id": page_of(headers["warc-record-id"]),
                    "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                    "refers": page_of(headers.get("warc-refers-to")),
                    "bytes": None,
                    "problem": None,
                    "block": block,
                }
                out.append(row if number else payload_row(row))
                held += len(block) if number else 200
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)


def decode(batches, schema):
    """(origin, s, total, ...) -> rows of FIELDS: the segments joined in order, and decoded if they are whole."""
    for batch in batches:
        for i in range(len(batch)):  # one page at a time: its segments are all that is held
            row = batch.slice(i, 1).to_pylist()[0]
            blocks = [x["block"] for x in row.pop("s")]
            whole_ = row["segments"] == len(blocks) and row["total"] == sum(map(len, blocks))
            row |= {"block": b"".join(blocks) if whole_ else None, "problem": None if whole_ else "the segments don't add up to the total length"}
            del row["segments"]
            yield pa.RecordBatch.from_pylist([payload_row(row) if whole_ else row], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The responses and revisits of the archives under `folder`: id, kind, bytes, digest, refers, problem.

    Continuation records are grouped by origin, ordered by segment number and joined; the sum must be
    the total length that the last one states, else `problem` says so. Repeated records share
    segments. bytes and digest of a response are computed from its payload. A folder without records
    gives no row.
    """
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in FIELDS.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    parsed = materialize(files.mapInArrow(lambda it: parse(it, schema), FIELDS))
    whole_ = parsed.where("segment IS NULL")
    parts = parsed.where("segment IS NOT NULL").dropDuplicates(["origin", "segment"])
    joined = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"))
    joined = joined.select("origin", "s", "total", F.element_at("s", -1)["segment"].alias("segments"))
    heads = parsed.where("segment = 1").select(*[x.split()[0] for x in FIELDS.split(", ") if x.split()[0] not in ("block", "problem", "total")])
    again = heads.join(joined, "origin").mapInArrow(lambda it: decode(it, schema), FIELDS)
    return whole_.unionByName(again).select("id", "kind", "bytes", "digest", "refers", "problem")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_folder(spark, "warc")
    write(pages, folder)
    found = read(spark, folder)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.col(c).cast(kind)
    out = found.select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.when(F.col("problem").isNull(), F.col("kind")).otherwise(F.raise_error("problem")).alias("record_type"), number("refers").alias("refers_to"))
    out = materialize(out)
    drop_folder(spark, folder)
    return out


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT page_id, t, strlen(t) AS n, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM g
"""

"""WARC archives: a writer in DataFrame expressions and a reader that salvages damaged files.

Writing: each row becomes one record (response, or revisit of an equal payload); Spark's
text sink ends every record with the blank lines that WARC asks for, so the archives land
in any store that Spark can write to. Reading: whole archive files come in by the
binaryFile source; ``salvage`` walks them, and where a check fails it searches for the
next gzip member or version line, goes on there and reports the bytes it left behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import shared_dir, stage

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: 8 groups of 20 bits, 4 digits each."""
    digest = F.sha1(payload)
    digits = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to to every row.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest id
    have refers_to null, the others name that id. A null payload counts as empty; a row
    with a null id refers to the smallest id that is known, if any. Repeats of the row with
    the smallest id are all responses. The smallest ids are aggregated before the shuffle and staged, and only
    payloads that repeat are kept, so a payload that a third of the rows share costs one
    row there and a join that AQE splits.
    """
    rows = df.withColumn(payload_col, F.coalesce(payload_col, F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length(payload_col).cast("long"), "sha": F.unhex(F.sha1(F.encode(payload_col, "UTF-8")))})
    firsts = stage(
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("sha")
        .agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select("sha", "first_id"),
        "firsts",
    )
    other = ~F.col("first_id").eqNullSafe(F.col(id_col)) & F.col("first_id").isNotNull()
    return (
        rows.join(firsts, "sha", "left")
        .withColumn("refers_to", F.when(other, F.col("first_id")))
        .withColumn("payload_digest", base32_sha1(F.encode(payload_col, "UTF-8")))
        .drop("sha", "first_id")
    )


def to_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``record``: the WARC record of each row of ``mark_revisits``, without its end."""
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(payload_col)))
    url = F.regexp_replace(F.trim(F.col(url_col)), r"[\r\n]+", " ")
    return df.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "),
            F.when(revisit, "revisit").otherwise("response"),
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: "),
            urn(F.col(id_col)),
            F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise(""),
            F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(""),
            F.lit("WARC-Payload-Digest: sha1:"),
            F.col("payload_digest"),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length("block").cast("string"),
            F.lit("\r\n\r\n"),
            F.col("block"),
        ).alias("record")
    )


def write_warc(df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, records_per_file: int = 4096, compression: str = "gzip") -> None:
    """Write every row as one WARC record; a file holds at most ``records_per_file``.

    With gzip each record is a member of its own. Members go through the text sink as strings of their bytes;
    the sink's separator gives each its last byte, which is 0, as the length of a record below 16 MB ends with it
    and a longer record is followed by an empty member.
    """
    rows = mark_revisits(df.select(id_col, url_col, payload_col), id_col, payload_col, min_bytes)
    records = to_records(rows, id_col, url_col, payload_col)
    sep = "\r\n\r\n"
    if compression == "gzip":
        records, sep, compression = records.mapInArrow(_members, "member binary").select(F.col("member").cast("string")), "\0", "none"
    records.write.option("lineSep", sep).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _members(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # a few at a time, as records may be long
            out = [gzip.compress(r.encode() + END, mtime=0) for r in batch.column(0).slice(k, 256).to_pylist()]
            out = [m if m[-1] == 0 else m + gzip.compress(b"", mtime=0) for m in out]
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in out], pa.binary())], names=["member"])


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: its headers, block and end; ValueError says which check failed."""
    if not (m := VERSION.match(data, at)):
        raise ValueError("no version line")
    if (stop := data.find(END, m.end() - 2)) < 0:
        raise ValueError("headers without end")
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = stop + len(END)
    end = start + int(headers["content-length"])
    if data[end : end + len(END)] != END:
        raise ValueError("no record end after the content length")
    block = data[start:end]
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if said[5:] != base64.b32encode(hashlib.sha1(payload_of(block)).digest()).decode():
            raise ValueError("payload digest differs")
    return headers, block, end + len(END)


def payload_of(block: bytes) -> bytes:
    return block.partition(END)[2]


def _next_version(data: bytes, at: int) -> int:
    """The next version line at a line's start."""
    later = VERSION.search(data, at)
    while later and later.start() and data[later.start() - 1 : later.start()] != b"\n":
        later = VERSION.search(data, later.start() + 1)
    return later.start() if later else len(data)


def _walk(data: bytes) -> Iterator[tuple]:
    """Records and gaps of what a member gave, at their places in it."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = _parse(data, at)
        except ValueError as why:
            end = _next_version(data, at + 1)
            yield "gap", at, end, str(why), None, None
        else:
            yield "record", at, end, None, headers, block
        at = end


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` gives, its end, and why it broke; up to the very byte where it broke."""
    inflate, parts, k = zlib.decompressobj(31), [], at
    while not inflate.eof and k < len(data):
        before, some = inflate.copy(), data[k : k + 65536]
        try:
            parts.append(inflate.decompress(some))
        except zlib.error as e:
            try:
                for x in some:
                    parts.append(before.decompress(bytes([x])))
            except zlib.error:
                pass
            return b"".join(parts), len(data), str(e)
        k += len(some)
    return b"".join(parts), k - len(inflate.unused_data), "" if inflate.eof else "member without end"


def salvage(data: bytes) -> Iterator[tuple]:
    """(kind, start, end, reason, headers, block) of all records and gaps of one archive.

    kind: record or gap. Plain records and gzip members may follow each other in any order. After
    a failed check the nearer of the next member that begins well and the next version line at a line's start is
    searched. Records that a member gave whole before it broke are still recovered. start and end are places
    in the file, for what a member holds those of the member; the reason of a gap inside a member names its
    bytes in what the member gave.
    """
    at, nexts = 0, [-1, -1]

    def resync(start: int) -> int:
        for k, search in enumerate((_next_member, _next_version)):
            if nexts[k] < start:  # each search goes on from where it found something
                nexts[k] = search(data, start)
        return min(nexts)

    while at < len(data):
        if not data.startswith(MEMBER, at):
            try:
                headers, block, end = _parse(data, at)
            except ValueError as e:
                end = resync(at + 1)
                yield "gap", at, end, str(e), None, None
            else:
                yield "record", at, end, None, headers, block
            at = end
            continue
        inner, end, why = _inflate(data, at)
        end = resync(at + 1) if why else end
        lost = len(inner)
        for kind, a, b, reason, headers, block in _walk(inner):
            if kind == "record" or not why or b < len(inner):
                yield kind, at, end, reason and f"{reason}: bytes {a} to {b} of the member", headers, block
            else:
                lost = a
        if why:
            yield "gap", at, end, f"{why}: from byte {lost} of the member", None, None
        at = end


def _next_member(data: bytes, at: int) -> int:
    while (at := data.find(MEMBER, at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 65536], 64).startswith(b"WARC/"):
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


READ_SCHEMA = "path string, kind string, start long, end long, reason string, row_id string, warc_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("row_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records and quarantined gaps of the archives under ``path``.

    kind is record or gap; gaps carry (path, start, end, reason). A revisit's
    payload_bytes and digest are those of the payload that it refers to. An archive is
    one row of the binaryFile source, so a file must fit into a task.
    """

    def urn(headers: dict, name: str) -> str | None:
        return headers.get(name, "").removeprefix("<urn:row:").removesuffix(">") or None

    def rows(batches):
        for batch in batches:
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for kind, start, end, reason, headers, block in salvage(data.as_py()):
                    row = dict.fromkeys(_ARROW.names) | {"path": where, "kind": kind, "start": start, "end": end, "reason": reason}
                    if headers is not None:
                        payload, kind = payload_of(block), headers.get("warc-type")
                        known = re.search(rb"(?im)^content-length: *(\d+)", block.partition(END)[0])
                        size = int(known[1]) if kind == "revisit" and known else len(payload)
                        row |= {"row_id": urn(headers, "warc-record-id"), "warc_type": kind, "target_uri": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": urn(headers, "warc-refers-to"), "payload": payload if with_payload else None}
                    out.append(row)
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path)
    return files.select("path", "content").mapInArrow(rows, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder, read them back, one row per page."""
    path = f"{shared_dir(spark)}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, "page_id", "url", "html")
    back = read_warc(spark, path).where("kind = 'record'")
    return back.select(
        F.expr("try_cast(row_id AS bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )

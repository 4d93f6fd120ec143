"""Legacy archives: ARC files are written, parsed by version and declared length, and converted to WARC.

An ARC file opens with a version block whose second line gives the version and whose third names the fields of every
record line. Version 1 lines carry URL, IP address, date, content type and length; version 2 lines add result code,
checksum, location, offset and file name. The converter reads what a file's own version block declares, takes each
record by its declared length and synthesises the WARC equivalents: record id (a name-based UUID of where the record
stood, so a task run twice agrees with itself), date, type and digests. Of records with equal payloads the one with the
largest page id stays a response; the others become revisits of it.

Files are written by Spark's text writer (gzip over the whole file, no partial files after a lost task) and read with
``binaryFile``. A new archive begins after a number of records that keeps it at about ``archive_bytes``, and at eight
times that however the long pages fall, so what a task holds of a file and of the decisions on its records is bounded.
WARC files are bounded like ARC files, by their number of records. Digests are shuffled, payloads are not, unless
the decisions are too many to broadcast: then each file is shuffled once, whole, to the decisions about its own records.

Edge cases: null html is an empty payload; empty payloads count as equal to each other; null urls become
``urn:page:<id>``; white space in a url is percent-encoded; a null ``page_id`` stays null, below every other; of rows
with one ``page_id`` and payload one is the response; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.llm.common import saved, shared_dir, small_batches

#: The field line of each ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_line(version: int, url: str, ip: str, date: str, mime: str, block: bytes, name: str) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": digest(block), "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version].split()).encode()


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of a file: its line, then the version and the fields of all lines."""
    body = f"{version} 0 civicmill\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, name) + b"\n" + body


def _arc_rows(versions: tuple[int, ...], date: str, per_file: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Records; a version block opens each run of ``per_file``, where the writer begins a new file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        version, name = versions[part % len(versions)], ""
        for batch in batches:
            out: list[bytes] = []
            for page, url, html in zip(batch["page"], batch["url"], batch["html"], strict=True):
                if n % per_file == 0:
                    name = f"pages-{part:05d}-{n // per_file:05d}.arc"
                    out.append(version_block(version, name, date))
                    n += 1
                body = (html or "").encode()
                known = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(body)}\r\n\r\n".encode() + body
                target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"
                out.append(arc_line(version, target, "0.0.0.0", date, "text/html", block, name) + b"\n" + block)
                n += 1
            yield pd.DataFrame({"record": out})

    return run


def write_archive(records: DataFrame, path: str, separator: str, per_file: int = 0) -> None:
    """The bytes of each row of ``records`` (record binary), each followed by ``separator``; ``per_file``: rows in a file, 0 for a partition's all."""
    options = {"lineSep": separator, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": per_file}
    records.select(F.col("record").cast("string").alias("value")).write.options(**options).text(path)


def records_per_file(pages: DataFrame, archive_bytes: int) -> int:
    """How many records keep a file at ``archive_bytes`` on average, and at eight times that if all are the longest."""
    n_bytes = F.octet_length("html") + 512
    mean, most = pages.agg(F.avg(n_bytes), F.max(n_bytes)).first()
    return max(2, min(int(archive_bytes / (mean or 512)), 8 * archive_bytes // (most or 512)))


def write_arc(pages: DataFrame, path: str, per_file: int, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000") -> None:
    """Pages (page_id, url, html) as ARC files of ``per_file`` records; the tasks' files take the ``versions`` in turn."""
    rows = pages.select(F.col("page_id").cast("string").alias("page"), "url", "html")
    write_archive(rows.mapInPandas(_arc_rows(versions, date, per_file), "record binary"), path, "\n", per_file)


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, fields of the record line, block) of each record after the version block."""
    fields, at = ARC_FIELDS[1].split(), 0
    while at < len(content):
        end = content.index(b"\n", at)
        values = content[at:end].decode("utf-8", "replace").split(" ")
        length = int(values[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"the record at byte {at} is cut short")
        if values[0].startswith("filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            if int(lines[0].split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"ARC version {lines[0]!r}")
            fields = lines[1].split()
        elif len(values) != len(fields):
            raise ValueError(f"the line at byte {at} has {len(values)} fields, not {len(fields)}")
        else:
            yield at, dict(zip(fields, values, strict=True)), block
        at = end + 1 + length + 1


def _page_id(http: bytes) -> int | None:
    found = re.search(rb"^X-Page-Id: (-?\d+)\r?$", http, re.M)
    return int(found[1]) if found else None


def unzipped(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            for at, _, block in arc_records(unzipped(content)):
                http, _, body = block.partition(b"\r\n\r\n")
                rows.append((path, at, _page_id(http), digest(body), len(body)))
            yield pd.DataFrame(rows, columns=["path", "position", "page_id", "digest", "size"]).astype({"page_id": "Int64"})


def survey(spark: SparkSession, arc_path: str) -> DataFrame:
    """(path, position, page_id, digest, size) of each ARC record's payload."""
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    return files.mapInPandas(_surveyed, "path string, position long, page_id long, digest string, size long")


def record_id(path: str, position: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]}#{position}#{payload_digest}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the closing two line ends, which the archive writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _converted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content, decisions in zip(batch["path"], batch["content"], batch["decisions"], strict=True):
            others = {d["position"]: d for d in decisions}
            info = b"software: civicmill\r\nconverted-from: application/x-arc\r\n"
            out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, -1, digest(info))), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)]
            for at, line, block in arc_records(unzipped(content)):
                http, _, body = block.partition(b"\r\n\r\n")
                d, own = line["Archive-date"], digest(body)
                fields = [("WARC-Record-ID", record_id(path, at, own)), ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"), ("WARC-Target-URI", line["URL"]), ("WARC-IP-Address", line["IP-address"]), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http;msgtype=response")]
                if (first := others.get(at)) is not None:
                    block = http + b"\r\n\r\n"
                    named = [] if first["first_page"] is None else [("X-Refers-To-Page-Id", str(first["first_page"]))]
                    fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(first["first_path"], first["first_position"], own)), *named]
                else:
                    fields = [("WARC-Type", "response"), *fields]
                out.append(warc_record([*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block))
            yield pd.DataFrame({"record": out})


def convert(spark: SparkSession, arc_path: str, warc_path: str, per_file: int, min_bytes: int = 0) -> None:
    """ARC files to WARC files of ``per_file`` records; payloads of at least ``min_bytes`` that occur again become revisits."""
    found = saved(survey(spark, arc_path), "survey")
    keyed = found.where(F.col("size") >= min_bytes)
    place = F.struct("page_id", "path", "position")
    firsts = keyed.groupBy("digest").agg(F.max(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keyed.join(firsts, "digest").where(~(place.getField("path").eqNullSafe(F.col("first.path")) & (F.col("position") == F.col("first.position"))))
    decision = F.struct("position", F.col("first.page_id").alias("first_page"), F.col("first.path").alias("first_path"), F.col("first.position").alias("first_position"))
    decided = again.groupBy("path").agg(F.collect_list(decision).alias("decisions"))
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    none = F.array().cast("array<struct<position:long,first_page:long,first_path:string,first_position:long>>")
    joined = files.join(decided, "path", "left").select("path", "content", F.coalesce("decisions", none).alias("decisions"))
    write_archive(joined.mapInPandas(_converted, "record binary"), warc_path, "\r\n\r\n", per_file)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        yield fields, content[begin:at]
        at += 4


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for fields, block in warc_records(unzipped(content)):
                if fields["WARC-Type"] not in ("response", "revisit"):
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and digest(body) != said:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
                size = int(re.search(rb"^Content-Length: (\d+)\r?$", http, re.M)[1])
                rows.append((_page_id(http), size, said, fields["WARC-Type"], int(fields["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in fields else None, fields["WARC-Target-URI"], fields["WARC-Date"]))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date) of each response and revisit; digests of responses are verified."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def archived(pages: DataFrame, min_bytes: int = 0, path: str | None = None, archive_bytes: int = 32 << 20) -> DataFrame:
    """Pages to ARC to WARC, and the WARC files read back."""
    spark = pages.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "archives")
    per_file = records_per_file(pages, archive_bytes)
    write_arc(pages, f"{path}/arc", per_file)
    convert(spark, f"{path}/arc", f"{path}/warc", per_file, min_bytes)
    return read_warc(spark, f"{path}/warc")

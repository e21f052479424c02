"""Operator 4: WARC records, and the assembly of a capture's request, response and metadata."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

_EOL = "\r\n"
_HEADERS = "array<struct<name: string, value: string>>"


def pages_as_records(pages: DataFrame) -> DataFrame:
    """(raw): the three WARC records of each page's capture, as bytes; the page's id goes into the metadata.

    A page is named by its id, url and html, so only rows that repeat all of them are one capture.
    """
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uid = lambda kind: F.concat(F.lit("<urn:md5:"), F.md5(F.concat(F.lit(kind), pid, F.lit(":"), F.coalesce("url", F.lit("")), F.lit(":"), F.xxhash64("html").cast("string"))), F.lit(">"))
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)

    def record(kind: str, ctype: str, body: Column, linked: bool) -> Column:
        head = [F.lit(f"WARC/1.0{_EOL}WARC-Type: {kind}{_EOL}WARC-Record-ID: "), uid(kind), F.lit(f"{_EOL}WARC-Target-URI: "), url]
        if linked:
            head += [F.lit(f"{_EOL}WARC-Concurrent-To: "), uid("response")]
        head += [F.lit(f"{_EOL}WARC-Date: 2024-01-01T00:00:00Z{_EOL}Content-Type: {ctype}{_EOL}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_EOL * 2)]
        return F.concat(*head, body, F.lit(_EOL * 2)).cast("binary")

    html = F.coalesce("html", F.lit(""))
    response = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.octet_length(html).cast("string"), F.lit(_EOL * 2), html)
    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{_EOL}Host: "), F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(_EOL * 2))
    metadata = F.concat(F.lit("page_id: "), pid, F.lit(f"{_EOL}hopsFromSeed: 0{_EOL}"))
    rows = F.array(
        record("request", "application/http; msgtype=request", request, True),
        record("response", "application/http; msgtype=response", response, False),
        record("metadata", "application/warc-fields", metadata, True),
    )
    return pages.select(F.explode(rows).alias("raw"))


def records_of(f) -> Iterator[bytes]:
    """The WARC records of an open file, one at a time; blank lines between them are skipped."""
    while line := f.readline():
        if not line.strip():
            continue
        head, size = [line], 0
        while (line := f.readline()).strip():
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        yield b"".join(head) + b"\r\n" + f.read(size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(raw): one row for each record of the .warc and .warc.gz files under path.

    A task opens its files one after another and streams them: it holds a few MB of records, or one record.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(name) if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", name) else (fs.LocalFileSystem(), name)
                with system.open_input_stream(inner, compression=None) as raw:
                    f = io.BufferedReader(raw, 1 << 20)
                    if f.peek(2)[:2] == b"\x1f\x8b":
                        f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
                    held, size = [], 0
                    for record in records_of(f):
                        held.append(record)
                        size += len(record)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pydict({"raw": pa.array(held, pa.binary())})
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pydict({"raw": pa.array(held, pa.binary())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(split, "raw binary")


def _lines(block: Column) -> Column:
    """name: value lines as an array of pairs."""
    pairs = F.transform(F.split(block, "\r?\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.filter(pairs, lambda x: (x["name"] != "") & F.col("__true")).cast(_HEADERS)


def parsed(raw: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, date, content_type, concurrent_to, payload) of raw WARC records.

    Header names are matched in any case; concurrent_to holds every WARC-Concurrent-To; payload is the
    Content-Length bytes after the header, or all that is there if it is missing. Rows that are null or don't
    begin with WARC/ are left out, fields that are missing are null.
    """
    # a cast takes the bytes as they are: the header's end is found in bytes and the payload is never decoded
    d = raw.where(F.col("raw").isNotNull()).select("raw", F.substring_index(F.col("raw").cast("string"), _EOL * 2, 1).alias("__h"))
    d = d.where(F.col("__h").startswith("WARC/")).withColumn("__end", F.octet_length("__h"))
    get = lambda name: F.nullif(F.trim(F.regexp_extract("__h", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    size = F.coalesce(F.expr("try_cast(regexp_extract(__h, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1) as int)"), F.octet_length("raw"))
    return d.select(
        get("WARC-Record-ID").alias("record_id"), F.lower(get("WARC-Type")).alias("type"), get("WARC-Target-URI").alias("target_uri"), get("WARC-Date").alias("date"),
        get("Content-Type").alias("content_type"), F.regexp_extract_all("__h", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n ]+)"), 1).alias("concurrent_to"),
        F.when(F.col("__end") < F.octet_length("raw"), F.substring(F.col("raw"), F.col("__end") + 5, size)).alias("payload"),
    )


def _http(payload: Column) -> tuple[Column, Column, Column]:
    """Start line, header lines and body of an HTTP message."""
    head = F.substring_index(payload.cast("string"), _EOL * 2, 1)
    end, size = F.octet_length(head), F.octet_length(payload)
    return F.regexp_extract(head, r"^([^\r\n]*)", 1), F.regexp_replace(head, r"^[^\r\n]*(\r\n)?", ""), F.when(end < size, F.substring(payload, end + 5, size))


def assembled(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, target_uri, date, response, request, metadata, n_records.

    records is what parsed() gives. A response is a capture, named by its record id. A request or metadata
    record belongs to the response that it names in concurrent_to, or that names it, or else to that of a record
    that it names or that names it (two hops); of several the least id counts. What reaches no response forms a
    capture without response, under the least id among itself and the records it names. Of several requests
    the one of the least id is the request; metadata records are an array in the order of their ids; n_records
    counts all records of the capture, repeats once.

    response: record_id, status, headers, body (bytes, whole); request: record_id, method, target, headers;
    metadata: array of record_id and fields. Headers and fields are arrays of name and value in order.

    Records without id or of other types are left out. Of records that repeat an id, the first in order of date,
    type and payload counts. Missing parts are null, metadata an empty array. An empty table gives no rows and
    other columns are ignored. Links are resolved on ids alone: what isn't a response is small and is written to
    the shared folder with all ids, so records are read twice and a response's payload is shuffled once.
    """
    r = records.where("record_id is not null and type in ('request', 'response', 'metadata')")
    first = Window.partitionBy("record_id").orderBy("date", "type", "payload")
    one = lambda df: df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    light = cut(r.select("record_id", "type", "target_uri", "date", "concurrent_to", F.when(F.col("type") != "response", F.col("payload")).alias("payload")))
    rest = one(light.where("type <> 'response'"))
    links = light.where("type = 'response'").select("record_id", F.explode("concurrent_to").alias("other")).distinct()
    heads = light.where("type = 'response'").select(F.col("record_id").alias("response")).distinct()
    named = rest.select("record_id", F.explode("concurrent_to").alias("other"))
    both = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    direct = named.join(heads, F.col("other") == F.col("response"), "left_semi").unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    direct = direct.groupBy("record_id").agg(F.min("other").alias("one"))
    hop = both.join(direct.select(F.col("record_id").alias("other"), F.col("one").alias("far")), "other").groupBy("record_id").agg(F.min("far").alias("two"))
    own = named.groupBy("record_id").agg(F.min("other").alias("least"))
    rest = rest.join(direct, "record_id", "left").join(hop, "record_id", "left").join(own, "record_id", "left")
    rest = rest.withColumn("capture_id", F.coalesce("one", "two", F.least("record_id", "least"))).withColumn("__true", F.lit(True))
    start, lines, _ = _http(F.col("payload"))
    is_request = F.col("type") == "request"
    request = F.struct("record_id", F.regexp_extract(start, r"^(\S+)", 1).alias("method"), F.regexp_extract(start, r"^\S+ (\S+)", 1).alias("target"), _lines(lines).alias("headers"))
    meta = F.struct("record_id", _lines(F.decode("payload", "UTF-8")).alias("fields"))
    rest = rest.groupBy("capture_id").agg(
        F.min_by(F.when(is_request, request), F.when(is_request, F.col("record_id"))).alias("request"),
        F.array_sort(F.collect_list(F.when(~is_request, meta))).alias("metadata"),
        F.count("*").alias("__rest"), F.min(F.struct("record_id", "target_uri", "date")).alias("__least"),
    )
    resp = one(r.where("type = 'response'").select("record_id", "type", "target_uri", "date", "payload")).withColumn("__true", F.lit(True))
    start, lines, body = _http(F.col("payload"))
    resp = resp.select(
        F.col("record_id").alias("capture_id"), F.col("target_uri").alias("__uri"), F.col("date").alias("__date"),
        F.struct("record_id", F.nullif(F.regexp_extract(start, r"^\S+ ([0-9]{3})", 1), F.lit("")).cast("int").alias("status"), _lines(lines).alias("headers"), body.alias("body")).alias("response"),
    )
    out = resp.join(rest, "capture_id", "full")
    return out.select(
        "capture_id", F.coalesce("__uri", "__least.target_uri").alias("target_uri"), F.coalesce("__date", "__least.date").alias("date"), "response", "request",
        F.coalesce("metadata", F.array().cast("array<struct<record_id: string, fields: array<struct<name: string, value: string>>>>")).alias("metadata"),
        (F.coalesce("__rest", F.lit(0)) + F.col("response").isNotNull().cast("long")).alias("n_records"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """page_id and the assembled capture of every page, by way of its WARC records.

    Rows that repeat page_id, url and html are one capture; those that differ in any are captures of their own. A
    null url or html counts as empty, a null page_id is kept; other columns are ignored.
    """
    c = assembled(parsed(pages_as_records(pages)))
    field = F.filter("metadata", lambda m: F.exists(m["fields"], lambda f: f["name"] == "page_id"))[0]["fields"]
    page = F.filter(field, lambda f: f["name"] == "page_id")[0]["value"]
    return c.withColumn("page_id", F.when(page != "null", page).cast("long"))

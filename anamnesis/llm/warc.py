"""Operator 2: WARC archives as a chunked record table.

Writing: each payload becomes rows (record, chunk number, bytes) before it reaches Python, and the writer streams them
into archives of gzip members, one per record. Reading: archives are parsed as streams; a payload becomes rows
(record, chunk number, bytes, SHA-256 so far), so that neither side holds a whole record besides its input row.

Defined results: a null payload is empty; payloads under `least` bytes are always responses; of equal payloads the
smallest id is the response, and rows that repeat that id are responses too; a record with a null id is a revisit if
another row has its payload and an id, else a response. An empty table gives no archive. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import filesystem, materialize, scratch

CHUNK = 1 << 18
#: Shared payloads up to which their digests are broadcast, at about 100 bytes each.
SHARED = 500_000


def decisions(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """(id, url, payload, size, digest, refers): what each record is; refers is null for responses.

    Only digests and ids are dealt out to find the payloads that several rows share; these are broadcast up to SHARED of them, so that
    payloads stay where they were read, and beyond that meet the rows in a join whose large partitions Spark splits."""
    rows = pages.select(F.col(key).cast("long").alias("id"), (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload"), 256)})
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(shared, "shared")
    if shared.count() <= SHARED:
        shared = F.broadcast(shared)
    return rows.join(shared, "digest", "left").withColumn("refers", F.when(F.col("first") < F.col("id"), F.col("first")).when(F.col("id").isNull(), F.col("first"))).drop("first")


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, url, size, digest, refers, no, bytes): a row per chunk of each payload, in order within its record; a revisit or an empty payload has one empty chunk.

    Numbers come first and each row cuts its own bytes out of the payload, so the chunks of a record are never there together."""
    raw = F.when(F.col("refers").isNull(), F.col("payload")).otherwise("").cast("binary")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("raw") / chunk).cast("int") - 1))
    rows = records.select("id", "url", "size", "digest", "refers", raw.alias("raw"))
    rows = rows.select("*", F.explode(numbers).alias("no"))
    return rows.select("id", "url", "size", "digest", "refers", "no", F.substring("raw", F.col("no") * chunk + 1, F.lit(chunk)).alias("bytes"))


def head(key: int | None, n: int, url: str | None, size: int, digest: str, refers: int | None, block: int) -> bytes:
    name = f"urn:x-page:{key}" if key is not None else f"urn:x-page:null:{n}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", f"Content-Length: {block}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, at: str, level: int = 1) -> DataFrame:
    """Streams the records into one archive per task below `at`; rows (path, records). A repeated task writes a file of its own name."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{at}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = filesystem(uri)
        out, z, n = None, None, 0
        for batch in batches:
            for key, url, size, digest, refers, no, data in zip(*(c if i == 6 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                if no == 0:
                    if out is None:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    else:
                        out.write(z.compress(b"\r\n\r\n") + z.flush())
                    z = zlib.compressobj(level, wbits=31)
                    n += 1
                    out.write(z.compress(head(key, n, url, size, digest, refers, size if refers is None else 0)))
                out.write(z.compress(data.as_buffer()))
        if out:
            out.write(z.compress(b"\r\n\r\n") + z.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": uri, "records": n}])

    return chunk_rows(records).mapInArrow(write, "path string, records long")


class Members:
    """The bytes of a file of gzip members, as a stream."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step, self.z, self.buffer, self.raw = file, step, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.z.unconsumed_tail or self.raw or self.file.read(self.step)
            self.raw = b""
            if not data:
                return False
            got = self.z.decompress(data, 1 << 18)
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 2 :]
        return out

    def take(self, most: int) -> bytes:
        if not self.buffer:
            self.more()
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def parse(file, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """(headers, chunk number, bytes, SHA-256 of the payload so far, last) of each chunk of each record."""
    stream = Members(file)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while line := stream.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        left, no, sha = int(headers["content-length"]), 0, hashlib.sha256()
        while True:
            part, need = [], min(left, chunk)
            while need:
                got = stream.take(need)
                if not got:
                    raise ValueError("the archive ends within a record")
                sha.update(got)
                part.append(got)
                need -= len(got)
                left -= len(got)
            yield headers, no, b"".join(part), sha.hexdigest(), left == 0
            no += 1
            if not left:
                break


def read_archives(spark: SparkSession, paths: list[str], payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives: record_id, page_id, url, record_type, refers_to, chunk_no, n_bytes, bytes (if `payload`), digest_so_far, last, full_bytes, full_digest.

    The last two are what the headers state of the full payload, for revisits the referred one."""
    number = lambda x: int(x[12:-1]) if x and x.startswith("<urn:x-page:") and not x.startswith("<urn:x-page:null") else None

    def read(frames):
        import pyarrow as pa

        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("n_bytes", pa.int64()), ("bytes", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("full_bytes", pa.int64()), ("full_digest", pa.string())])
        for frame in frames:
            for path in frame.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as file:
                    for h, no, data, digest, last in parse(file, chunk):
                        rows.append((h["warc-record-id"], number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), no, len(data), data if payload else None, digest, last, int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")))
                        held += len(data) if payload else 0
                        if len(rows) >= 2000 or held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(read, "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, n_bytes long, bytes binary, digest_so_far string, last boolean, full_bytes long, full_digest string")


def round_trip(pages: DataFrame, at: str | None = None) -> DataFrame:
    """Writes pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response whose bytes do not have the digest of its header fails the job."""
    spark = pages.sparkSession
    paths = sorted(r.path for r in write_archives(decisions(pages), at or scratch(spark, "warc")).collect())  # a row per archive
    last = read_archives(spark, paths, payload=False).where("last")
    wrong = (F.col("record_type") == "response") & (F.col("digest_so_far") != F.col("full_digest"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("record_id"))).cast("string")).when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("full_digest"))
    return last.select("page_id", F.col("full_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")

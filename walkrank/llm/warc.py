"""WARC archives in URL order, with a two-level capture index: compressed blocks of sorted keys, and a sparse directory of them."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.llm.scratch import Scratch, small

#: Captures in a block of the index; bytes of archive that are read at a time; payloads below SMALL never revisit.
BLOCK, READ_BYTES, SMALL = 1000, 8 << 20, 100
#: Pages of one payload from which they aren't dealt out by it.
HOT = 10_000
_DATE = "1970-01-01T00:00:00Z"
_DIRECTORY = "shard int, first_key string, first_id bigint, index_file string, at bigint, size bigint, captures bigint"


def url_key(url: Column) -> Column:
    """The host's labels reversed, comma-separated, then ) and the rest of the URL: com,example,www)/path?query. Null is empty."""
    rest = F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit(""))
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"(?s)^[^/?#]*", ""))


def roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, page_id, digest, refers_to) of the rows that revisit: those whose payload, of SMALL bytes at least, a smaller page_id has too.

    Only keys, ids and digests move. The least ids are partial sums; rows of
    a payload that more than HOT pages share aren't dealt out by it, unless
    there are very many such payloads.
    """
    large = pages.where(F.col("n") >= SMALL).select("key", "page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("c")).where("refers_to < last").drop("last")
    first, seen = scratch.measured(first, "first", hot=F.count_if(F.col("c") > HOT))
    hot, rest = small(first.where(F.col("c") > HOT), seen["hot"]), first.where(F.col("c") <= HOT)
    others = large.join(hot.select("digest"), "digest", "left_anti")
    return large.join(hot, "digest").unionByName(others.join(rest, "digest")).where("page_id > refers_to").select("key", "page_id", "digest", "refers_to").distinct()


def _record(row: dict, date: str) -> bytes:
    payload, digest = row["payload"] or b"", row["digest"]
    record_id = uuid.UUID(hashlib.sha256(f"{row['page_id']}|{row['url']}|{digest}".encode()).hexdigest()[:32])
    head = ["WARC/1.1", f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {(row['url'] or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if row["refers_to"] is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the payload of a record; it must be whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, date: str):
    def run(batches):
        from pyspark import TaskContext

        filesystem, base = _open(folder)
        shard = TaskContext.get().partitionId()
        # an attempt that is lost leaves files that no directory names
        name = f"{shard:05d}-{uuid.uuid4().hex[:12]}"
        archive = index = None
        at = 0
        held: list[str] = []
        first = ("", None)
        mark, refers_to = None, None
        done: list[tuple] = []

        def close_block() -> None:
            packed = zlib.compress("\n".join(held).encode(), 6)
            done.append((shard, first[0], first[1], f"{name}.idx", index.tell(), len(packed), len(held)))
            index.write(packed)
            held.clear()

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    own = (row["key"], row["page_id"], row["digest"])
                    if row["mark"]:  # says what the rows after it with its key, id and digest refer to
                        mark, refers_to = own, row["refers_to"]
                        continue
                    row["refers_to"] = refers_to if own == mark else None
                    if archive is None:
                        archive, index = (filesystem.open_output_stream(f"{base}/{name}.{kind}", compression=None) for kind in ("warc.gz", "idx"))
                    packed = gzip.compress(_record(row, date), 6, mtime=0)
                    archive.write(packed)
                    if not held:
                        first = (row["key"], row["page_id"])
                    held.append(json.dumps([row["key"], row["page_id"], f"{name}.warc.gz", at, len(packed)]))
                    at += len(packed)
                    if len(held) >= BLOCK:
                        close_block()
            if held:
                close_block()
        finally:
            for stream in (archive, index):
                if stream is not None:
                    stream.close()
        names = ["shard", "first_key", "first_id", "index_file", "at", "size", "captures"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


class Archive:
    """A folder of archives and index blocks; ``directory`` has a row for each block, in key order, and is itself a table."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame):
        self.spark, self.folder, self.directory = spark, folder, directory

    def read(self) -> DataFrame:
        """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

        Each block of the index is read from its range, and the archive from
        the ranges that it names. Captures of a block stand one after the
        other in the archive, so ranges that touch are read together.
        """
        folder = self.folder
        schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def run(batches):
            filesystem, base = _open(folder)
            for batch in batches:
                for row in batch.to_pylist():
                    with filesystem.open_input_file(f"{base}/{row['index_file']}") as f:
                        captures = _captures(f.read_at(row["size"], row["at"]))
                    out, held = [], 0
                    for data in _ranges(filesystem, base, captures):
                        out.append(_row(data))
                        held += len(data)
                        if held > READ_BYTES:
                            yield _rows(out)
                            out, held = [], 0
                    if out:
                        yield _rows(out)

        return self.directory.repartition(n, "shard", "at").mapInArrow(run, schema)

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All records of a URL: a binary search among the shards' first keys, in the directory of a shard and in a block, then range reads.

        The driver gets one row a shard, and the directory rows (one for every
        BLOCK captures) of the shards that can hold the URL.
        """
        key = self.spark.range(1).select(url_key(F.lit(url))).first()[0].encode()
        shards = sorted((r.k.encode(), r.shard) for r in self.directory.groupBy("shard").agg(F.min("first_key").alias("k")).collect())
        some = [shard for _, shard in _around(shards, key)]
        rows = self.directory.where(F.col("shard").isin(some)).select("shard", "at", "first_key", "index_file", "size").collect() if some else []
        filesystem, base = _open(self.folder)
        out = []
        for _, row in _around([(r.first_key.encode(), r) for r in sorted(rows, key=lambda r: (r.shard, r.at))], key):
            with filesystem.open_input_file(f"{base}/{row.index_file}") as f:
                captures = _captures(f.read_at(row.size, row.at))
            own = [c[0].encode() for c in captures]
            found = captures[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]
            out += [parse_record(data) for data in _ranges(filesystem, base, found)]
        return out


def _around(ordered: list[tuple], key: bytes) -> list[tuple]:
    """Of pairs in the order of their first keys: those that begin with the key, and the one before them."""
    firsts = [x[0] for x in ordered]
    return ordered[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]


def _captures(packed: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(packed).decode().split("\n")]


def _ranges(filesystem, base: str, captures: list[list]) -> Iterator[bytes]:
    """The records of captures, by reads of ranges that touch, of about READ_BYTES."""
    i = 0
    while i < len(captures):
        _, _, name, start, size = captures[i]
        j = i + 1
        while j < len(captures) and captures[j][2] == name and captures[j][3] == start + size and size < READ_BYTES:
            size += captures[j][4]
            j += 1
        with filesystem.open_input_file(f"{base}/{name}") as f:
            data = f.read_at(size, start)
        for _, _, _, at, length in captures[i:j]:
            yield gzip.decompress(data[at - start : at - start + length])
        i = j


def _row(data: bytes) -> tuple:
    headers, payload = parse_record(data)
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(headers["x-payload-length"])):
        raise ValueError("a payload doesn't match its digest")
    number = lambda v: int(v) if v else None
    return number(headers.get("x-page-id")), headers.get("warc-target-uri"), int(headers["x-payload-length"]), digest, kind, number(headers.get("x-refers-to-page-id")), payload if kind == "response" else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_archive(frame: DataFrame, scratch: Scratch | None = None, url: str = "url", payload: str = "html", page_id: str = "page_id", date: str = _DATE) -> Archive:
    """Writes a record for every row, by ranges of URL keys: an archive and its index blocks for each task.

    Equal keys are dealt out by page_id, so one URL that many rows have is no
    hot spot. Payloads are shuffled once: the rows that say which records are
    revisits, without payloads, go through the same ranges and come to stand
    before those they speak of. A null payload counts as empty, a null URL has the key ``)``; a
    null page_id is kept, and never referred to. Rows that are equal each have
    a record, of one type. Files go to the shared folder, and the directory
    names those of attempts that ended well.
    """
    spark = frame.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    pages = frame.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    pages = pages.withColumn("key", url_key(F.col("url")))
    revisits = scratch.save(roles(pages.select("key", "page_id", "digest", "n"), scratch), "roles")
    nothing = {"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}
    rows = pages.drop("n").withColumns({"refers_to": F.lit(None).cast("bigint"), "mark": F.lit(False)}).unionByName(revisits.withColumns({**nothing, "mark": F.lit(True)}))
    order = ["key", "page_id", "digest"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.desc("mark"))
    folder = f"{scratch.path}/archive"
    filesystem, base = _open(folder)
    filesystem.create_dir(base, recursive=True)
    directory = scratch.save(dealt.mapInArrow(_writer(folder, date), _DIRECTORY), "directory")
    return Archive(spark, folder, directory)

"""Token ids as Parquet list columns: encoded by a library tokenizer, written in document order, read selectively."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkrank.llm.scratch import Scratch
from walkrank.llm.words import Words, pieces, ragged, run_hashes, split

#: For vocabularies with word ends: chunks of a text between these are encoded apart, whatever stands around them.
_GAPS = np.ones(256, bool)
_GAPS[[0x20, 0x09, 0x0A, 0x0D]] = False
#: What a byte is: in runs of letters, digits and other characters, a gap, or in a chunk that isn't taken apart.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _ODD
_KIND[~_GAPS] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Pieces of which each worker process keeps the ids: the last ones, this many or twice as many, of at most so many characters each.
CACHE, LONGEST = 50_000, 48

#: ids in rows: dictionary pages where few differ, else delta encodings of format v2; small row groups and pages with
#: their indexes, so that a filter on doc_id reads few pages.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}

# Latin-1 letters and printable ASCII: text that normalisation only puts into lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


#: The normalizer and the pre-tokenizer that _PLAIN, _PIECE and ``finer`` do the work of. Fixed value.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Kept:
    """The last outcomes by text, in two generations: what is asked for again outlives what isn't."""

    def __init__(self, size: int = CACHE):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) <= LONGEST:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ChunkIds:
    """Ids of chunks of text; each distinct chunk is encoded once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words, self.kept = Kept(), Kept(2 * CACHE)
        self.alphabet = byte_alphabet()
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.short = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and spec["model"].get("end_of_word_suffix") == "</w>"

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            mapped = word if word.isascii() else "".join(self.alphabet[b] for b in word.encode())
            ids = array("i", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            self.words.put(word, ids)
        return ids

    def of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct runs of ``finer``, as 32-bit integers."""
        kept, tokenize = self.kept, self.tokenizer.model.tokenize
        out: list[bytes] = []
        rest: list[int] = []
        for i, c in enumerate(chunks):
            ids = kept.get(c)
            if ids is None:
                if c.isalnum():  # ASCII letters in lower case, or a digit
                    ids = array("i", [t.id for t in tokenize(c.decode())]).tobytes()
                else:
                    text = c.decode()
                    if _PLAIN.match(text) and not any(a in text for a in self.added):
                        ids = b"".join([self._word(w) for w in _PIECE.findall(text.lower())])
                if ids is None:
                    rest.append(i)
                else:
                    kept.put(c, ids)
            out.append(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i].decode() for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = array("i", e.ids).tobytes()
            kept.put(chunks[i], out[i])
        return out

    def finer(self, words: Words) -> Words:
        """Runs that are encoded apart: letters in lower case, single digits, and other characters of a chunk.

        A chunk with an apostrophe, a letter beyond Latin-1 or the first byte
        of an added token stays whole, and as it is written.
        """
        data, n = words.data, len(words.starts)
        if not n:
            return words
        kind, low = _KIND[data], _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # of two bytes: U+00C0 to U+00FF
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        capital = letter & (second < 0x9F)
        low[lead[capital] + 1] += 0x20
        odd = kind == _ODD
        for token in self.added:
            odd |= data == token.encode()[0]
        whole = np.unique(np.searchsorted(words.starts, np.flatnonzero(odd), "right") - 1)
        whole = whole[whole >= 0]
        begins = np.zeros(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        size = words.ends[whole] - words.starts[whole]
        at = ragged(words.starts[whole], size)
        begins[at] = False
        low[at] = data[at]
        begins[words.starts] = True
        begins &= kind != _SPACE
        starts = np.flatnonzero(begins)
        of = np.searchsorted(starts, words.starts)
        ends = np.append(starts[1:], len(data))
        last = np.append(of[1:], len(starts)) - 1
        ends[last] = words.ends
        return Words(low, starts, ends, np.append(of, len(starts))[words.first])


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte runs, in order of their first places, and the index in them of each run. Runs are in order and don't overlap.

    Runs of equal hash are compared byte by byte with the first of them.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    of = pa.array(run_hashes(data, starts, ends)).dictionary_encode().indices.to_numpy()
    first = np.empty(int(of.max()) + 1, np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    size, like = ends - starts, first[of]
    equal = bool((size == size[like]).all())
    long = np.flatnonzero((size > 8) & (like != np.arange(len(of))))  # shorter ones of equal size and hash are equal
    if equal and len(long):
        equal = bool((data[ragged(starts[long], size[long])] == data[ragged(starts[like[long]], size[long])]).all())
    if not equal:  # different runs of one hash: by the bytes alone
        at = np.empty(2 * len(starts), np.int32)  # runs, and what is between them
        at[::2], at[1::2] = starts, ends
        slices = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(run, len(known)) for run in slices.to_pylist()[::2]], np.int64)
        return list(known), of
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], of


def joined(ids: list[bytes], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of runs whose distinct runs have these ids, and how many each run has."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), np.int32)
    at = np.cumsum(sizes) - sizes
    return flat[ragged(at[of], sizes[of])], sizes[of]


_open: dict[str, ChunkIds] = {}


def encode(frame: DataFrame, tokenizer: str, text: str = "text", end_id: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): each whole text as the tokenizer encodes it without special tokens of its own, then ``end_id``. Null text counts as empty."""

    def run(batches):
        for batch, at, flat in _encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(at, flat)], names=["doc_id", "ids"])

    return frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def _lists(at: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))


def _encoded(batches, tokenizer: str, end_id: int | None):
    """Batches with a text column, the offsets of each row's ids, and all ids."""
    coder = _open.get(tokenizer) or _open.setdefault(tokenizer, ChunkIds(tokenizer))
    for batch in pieces(batches, "text"):
        if coder.short:
            words = coder.finer(split(batch.column("text"), _GAPS))
            chunks, of = distinct_runs(words.data, words.starts, words.ends)
            flat, sizes = joined(coder.of(chunks), of)
            at = np.concatenate([[0], np.cumsum(sizes)])[words.first]
        else:
            whole = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
            at = np.cumsum([0, *map(len, whole)])
            flat = np.fromiter((i for ids in whole for i in ids), np.int32, int(at[-1]))
        if end_id is not None:
            flat = np.insert(flat, at[1:], end_id)
            at = at + np.arange(len(at))
        yield batch, at, flat


def write_tokens(frame: DataFrame, path: str, tokenizer: str, text: str = "text", end_id: int | None = 2, doc_id: str = "doc_id", partitions: int | None = None) -> None:
    """Writes (part, doc_id, local_start, n_tokens, ids) in ascending doc_id order, a range of documents a file.

    ``part`` numbers the files in order; ``local_start`` counts the file's ids
    before the document. Equal doc_ids stand next to each other, ordered by
    text; a null doc_id comes first. The rows are dealt out by range before
    they are encoded, so encoding runs once and no task holds more than a file.
    """
    rows = frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), 0
        for batch, at, flat in _encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("doc_id"), pa.array(base + at[:-1]), pa.array(np.diff(at)), _lists(at, flat)], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            base += int(at[-1])

    schema = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
    dealt.mapInArrow(run, schema).write.mode("overwrite").options(**LAYOUT).parquet(path)


def offsets_of(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]) of the files; ``start`` counts the ids of all documents before.

    A filter on doc_id reaches the page indexes; without ``ids`` only the
    metadata columns are read. The starts of the files come from one row a
    file, so only their number meets in one place.
    """
    schema = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
    files = spark.read.schema(schema).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select(F.col("part").alias("of_part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    rows = (files if where is None else files.where(where)).join(F.broadcast(base), F.col("part") == F.col("of_part"))
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def id_digests(frame: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at, flat = offsets_of(lists), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return frame.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_digests(frame: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of a table, reads them back, and returns start, size and crc32 of each document's ids.

    Null texts count as empty (the end id alone); equal doc_ids keep their
    rows; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(frame.sparkSession, "tokens")
    write_tokens(frame, f"{scratch.path}/ids", tokenizer, end_id=end_id)
    return id_digests(read_tokens(frame.sparkSession, f"{scratch.path}/ids"))

"""Benchmark decontamination: a prefix-filtered join of item windows with the words of documents."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.llm.scratch import Scratch, small
from walkrank.llm.words import ALNUM, hashes, pieces, ragged, split

#: Most bytes of item texts that are indexed, and sent to tasks, at a time (some 200 MB of arrays where each word begins a window); more items are searched in several blocks.
INDEX_BYTES = 2 << 20
#: Candidates that are verified at a time.
STEP = 200_000
#: Words (8 bytes each) that are sent to tasks to be counted at a time, and bytes of hits that may be.
VOCABULARY, SENT_BYTES = 1 << 20, 32 << 20
_FOUND = "n_words bigint, spans array<struct<lo:int,hi:int>>, items array<bigint>"


class Index:
    """Windows of items, found by the rarest words in them; arrays only."""

    def __init__(self, items: list[tuple[int, str]], window: int, share: float):
        words = split(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        h = hashes(words)
        n = np.diff(words.first)
        size = np.minimum(n, window)
        per = np.where(n > 0, n - size + 1, 0)
        start, of = ragged(words.first[:-1], per), np.repeat(np.arange(len(n)), per)
        rows = np.zeros((len(start), window + 1), np.uint64)
        rows[:, window] = size[of]
        for j in range(window):
            within = j < size[of]
            rows[within, j] = h[start[within] + j]
        rows, back = np.unique(rows, axis=0, return_inverse=True)
        self.words, self.size = np.ascontiguousarray(rows[:, :window]), rows[:, window].astype(np.int64)
        self.need = np.maximum(1, np.ceil(self.size * share - 1e-9)).astype(np.int64)
        pairs = np.unique(np.stack([back.reshape(-1), np.array([i for i, _ in items], np.int64)[of]], axis=1), axis=0)
        self.owner, self.owner_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.vocabulary = np.unique(h)

    def prefixes(self, frequency: np.ndarray) -> None:
        """Keeps of each window the rarest words, by their frequency in order of the vocabulary: one more than may be missing, as one of these must then be there."""
        order = np.lexsort((np.arange(len(frequency)), frequency))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        inside = np.arange(self.words.shape[1]) < self.size[:, None]
        place = np.full(self.words.shape, len(order), np.int64)
        place[inside] = rank[np.searchsorted(self.vocabulary, self.words[inside])]
        rarest = np.argsort(place, axis=1, kind="stable")
        window, nth = np.nonzero(np.arange(self.words.shape[1]) < (self.size - self.need + 1)[:, None])
        offset = rarest[window, nth]
        word = self.words[window, offset]
        by = np.argsort(word, kind="stable")
        self.of_window, self.offset = window[by], offset[by]
        self.key, self.at, self.count = np.unique(word[by], return_index=True, return_counts=True)


def lookup(h: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where h is among the keys, and which of them."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 20, bool)
    table[(sorted_keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    key = np.minimum(np.searchsorted(sorted_keys, h[maybe]), len(sorted_keys) - 1)
    hit = sorted_keys[key] == h[maybe]
    return maybe[hit], key[hit]


def _counts(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(word, n): in how many texts each hash of a sorted vocabulary of bounded size is, over all rows; without those that no text has."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in pieces(batches, "text"):
            words = split(batch.column("text"), ALNUM, lower=True)
            at, key = lookup(hashes(words), sent.value)
            row = np.searchsorted(words.first, at, "right") - 1
            total += np.bincount(np.unique(row * len(sent.value) + key) % len(sent.value), minlength=len(sent.value))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(total[some], pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _aligned(counts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Counts, of no more words than the vocabulary has, in its order."""
    out = np.zeros(len(vocabulary), np.int64)
    table = counts.toArrow()
    out[np.searchsorted(vocabulary, table["word"].to_numpy().view(np.uint64))] = table["n"].to_numpy()
    return out


def _vocabulary(batches):
    for batch in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(split(batch.column("text"), ALNUM, lower=True))).view(np.int64))], names=["word"])


def word_frequency(texts: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n): in how many texts each word of items is, as a table. One pass over the texts for each VOCABULARY words that items have."""
    words, seen = scratch.measured(items.select("text").mapInArrow(_vocabulary, "word bigint").distinct(), "vocabulary", n=F.count("*"))
    parts = max(1, -(-seen["n"] // VOCABULARY))
    tables = []
    for p in range(parts):
        some = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == p).toArrow()["word"].to_numpy()
        tables.append(scratch.save(_counts(texts, np.sort(some.view(np.uint64))), f"frequency-{p}"))
    return scratch.spark.read.schema("word bigint, n bigint").parquet(*(f"{scratch.path}/frequency-{p}" for p in range(parts)))


def _hits(index: Index, words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence."""
    found_at, found_window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, key = lookup(h, index.key)
    each = index.count[key]
    cuts = np.searchsorted(np.cumsum(each), np.arange(STEP, int(each.sum()) + STEP, STEP)) + 1 if len(each) else []
    lo = 0
    for hi in cuts:
        a, k, n = at[lo:hi], key[lo:hi], each[lo:hi]
        lo = hi
        entry = ragged(index.at[k], n)
        window = index.of_window[entry]
        start = np.repeat(a, n) - index.offset[entry]
        row = np.searchsorted(words.first, np.repeat(a, n), "right") - 1
        # the window must lie in the document
        inside = (start >= words.first[row]) & (start + index.size[window] <= words.first[row + 1])
        start, window = start[inside], window[inside]
        alike = np.zeros(len(start), np.int64)
        for j in range(index.words.shape[1]):
            within = j < index.size[window]
            alike += within & (h[np.minimum(start + j, len(h) - 1)] == index.words[window, j])
            # no more than the words to come can still be alike
            possible = alike + np.maximum(index.size[window] - j - 1, 0) >= index.need[window]
            if not possible.all():
                start, window, alike = start[possible], window[possible], alike[possible]
        found_at.append(start)
        found_window.append(window)
    at, window = np.concatenate(found_at), np.concatenate(found_window)
    both = np.unique(at * max(1, len(index.size)) + window)
    return both // max(1, len(index.size)), both % max(1, len(index.size))


def _scan(frame: DataFrame, index: Index, schema: T.StructType, text: str, hits_only: bool = False) -> DataFrame:
    """The frame's rows with n_words, spans and items; or those with hits."""
    sent = frame.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = sent.value
        for batch in pieces(batches, text):
            words = split(batch.column(text), ALNUM, lower=True)
            rows = len(words.first) - 1
            at, window = _hits(index, words, hashes(words))
            edges = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + index.size[window], -1)
            items: dict[int, set[int]] = defaultdict(set)
            for r, w in set(zip((np.searchsorted(words.first, at, "right") - 1).tolist(), window.tolist(), strict=True)):
                items[r].update(index.owner[index.owner_at[w] : index.owner_at[w + 1]].tolist())
            covered = np.cumsum(edges[:-1]) > 0
            row = words.row()
            begin = covered & np.concatenate([[True], ~covered[:-1] | (row[1:] != row[:-1])])[: len(covered)]
            end = covered & np.concatenate([~covered[1:] | (row[1:] != row[:-1]), [True]])[: len(covered)]
            lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
            sizes = np.bincount(row[lo], minlength=rows)
            base = words.first[:-1][row[lo]]
            structs = pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi + 1 - base).astype(np.int32))], names=["lo", "hi"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), structs)
            owned = pa.array([sorted(items.get(r, ())) for r in range(rows)], pa.list_(pa.int64()))
            n = pa.array(np.diff(words.first), pa.int64())
            columns = {**dict(zip(batch.schema.names, batch.columns, strict=True)), "n_words": n, "spans": spans, "items": owned}
            names = [f.name for f in schema.fields]
            out = pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
            yield out.take(pa.array(np.flatnonzero(sizes))) if hits_only else out

    return frame.mapInArrow(run, schema)


def _index(items: DataFrame, window: int, share: float) -> Index:
    return Index([(r.item_id, r.text) for r in items.distinct().toLocalIterator()], window, share)


def _union(batches):
    """Spans of several blocks, as their union: in order, apart from each other."""
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        lo, hi = (flat.field(k).to_numpy().astype(np.int64) + (row << 32) for k in ("lo", "hi"))
        order = np.argsort(lo, kind="stable")
        lo, reach, row = lo[order], np.maximum.accumulate(hi[order]), row[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(lo)), bool), lo[1:] > reach[:-1]]))
        end = np.concatenate([begin[1:], [len(lo)] if len(lo) else []]).astype(np.int64) - 1
        structs = pa.StructArray.from_arrays([pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (lo[begin], reach[end])], names=["lo", "hi"])
        at = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=len(lists)))]).astype(np.int32)
        columns = {**dict(zip(batch.schema.names, batch.columns, strict=True)), "spans": pa.ListArray.from_arrays(pa.array(at), structs)}
        yield pa.RecordBatch.from_arrays([columns[c] for c in ("text_key", "spans", "items")], names=["text_key", "spans", "items"])


def _counted(text: str, keep: list[str], key: str):
    """Rows without their texts, unless kept, with their number of words. Rows without words have no hits, and get keys that don't gather them."""

    def run(batches):
        at = 0
        for batch in pieces(batches, text):
            n = np.diff(split(batch.column(text), ALNUM, lower=True).first)
            own = pa.array([f"-{i}" for i in range(at, at + len(n))], pa.string())
            at += len(n)
            keys = pc.if_else(pa.array(n > 0), batch.column(key), own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), keys], names=[*keep, "n_words", key])

    return run


def _hits_of_blocks(texts: DataFrame, known: DataFrame, blocks: int, window: int, share: float, scratch: Scratch) -> DataFrame:
    """(text_key, spans, items) of each different text with hits, from a pass over the texts for each block of items that writes hits alone."""
    frequency = word_frequency(texts, known, scratch)
    spark = scratch.spark
    found = T.DataType.fromDDL(f"text string, {_FOUND}")
    for b in range(blocks):
        index = _index(known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), window, share)
        own = spark.createDataFrame(pa.table({"word": index.vocabulary.view(np.int64)}), "word bigint")
        index.prefixes(_aligned(frequency.join(F.broadcast(own), "word", "left_semi"), index.vocabulary))
        hits = _scan(texts, index, found, "text", hits_only=True).select(F.sha2("text", 256).alias("text_key"), "spans", "items")
        # equal texts have equal hits
        scratch.save(hits.groupBy("text_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), f"hits-{b}")
    each = spark.read.schema("text_key string, spans array<struct<lo:int,hi:int>>, items array<bigint>").parquet(*(f"{scratch.path}/hits-{b}" for b in range(blocks)))
    whole = each.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    size = F.sum(8 * (F.size("spans") + F.size("items")) + 64)
    table, seen = scratch.measured(whole.mapInArrow(_union, each.schema), "hits", n=F.count("*"), bytes=size)
    return small(table, seen["n"]) if (seen["bytes"] or 0) <= SENT_BYTES else table


def find_contamination(frame: DataFrame, items: DataFrame, window: int = 13, share: float = 1.0, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows with n_words, spans (words [lo, hi) in occurrences of item windows) and items (ids of items with occurring windows).

    Windows are ``window`` consecutive words of an item, or all of a shorter
    one; one occurs where at least ``share`` of its words stand in their
    places. A window's words are ordered by their frequency over all
    documents; a document is compared only where one of the rarest of them
    (as many as may be missing, and one) stands, within the bounds that its
    place in the window and the window's length set.

    Items are sent to tasks in blocks of at most ``index_bytes`` of text (or
    one item). One block is a narrow pass over the documents, after one that
    counts words. With more, words are counted once for all blocks, each block
    is a pass that writes nothing but hits, and a last one joins these to the
    rows by the SHA-256 of their texts; texts never move for it, unless they
    are kept and there are too many hits to be sent to tasks. Null texts, and texts without
    words, have no words and no hits; items with a null id or without words
    are left out; equal item ids are one item. Columns named n_words, spans or
    items are replaced; ``keep`` names those to return besides (all).
    """
    frame = frame.drop("n_words", "spans", "items")
    keep = frame.columns if keep is None else keep
    known = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // index_bytes))
    scratch = Scratch(frame.sparkSession, "decontaminate")
    texts = frame.select(F.col(f"`{text}`").alias("text"))
    kept = [frame.schema[c] for c in keep]
    if blocks == 1:
        index = _index(known, window, share)
        index.prefixes(_aligned(_counts(texts, index.vocabulary), index.vocabulary) if len(index.vocabulary) else np.zeros(0, np.int64))
        return _scan(frame, index, T.StructType([*kept, *T.DataType.fromDDL(_FOUND).fields]), text)
    key = "text_key"
    while key in frame.columns:
        key += "_"
    read = frame.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text])), F.sha2(F.col(f"`{text}`"), 256).alias(key))
    rows = read.mapInArrow(_counted(text, keep, key), T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField(key, T.StringType())]))
    hits = _hits_of_blocks(texts, known, blocks, window, share, scratch).withColumnRenamed("text_key", key)
    none = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("spans", "array<struct<lo:int,hi:int>>"), ("items", "array<bigint>"))}
    return rows.join(hits, key, "left").withColumns(none).select(*(f"`{c}`" for c in keep), "n_words", "spans", "items")


def digests(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (some words hit, and at least one in 20)."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn("items_sha256", F.sha2(ids.cast("binary"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

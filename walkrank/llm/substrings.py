"""Removal of passages that occur more than once: suffix trees over suffixes that are partitioned by prefixes of variable length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.llm.scratch import Scratch, small
from walkrank.llm.words import NOT_SPACE, Words, hashes, pieces, ragged, split, windows

#: Words of the prefixes by which suffixes are partitioned: the next longer one where a group is too large, at last the whole window.
PREFIXES = (8, 20)
#: Most anchors of a prefix that form one group, and most bytes of their suffixes.
GROUP, GROUP_BYTES = 5_000, 4 << 20
#: Most hashes of prefixes or windows that are sent to every task; beyond that, rows get their own by a join.
SENT = 100_000


class Anchors(NamedTuple):
    """Runs of windows with one anchor: the row, first window and number of windows, the anchor's word and prefix hash."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    word: np.ndarray
    prefix: np.ndarray


def anchors(words: Words, h: np.ndarray, window: int, length: int, only: np.ndarray | None = None) -> Anchors:
    """Of all windows (or those at ``only``), the anchor: the word in them at which the prefix of ``length`` words and least hash begins (the leftmost, if several).

    It depends on the window's words alone, so equal windows have equal
    anchors at equal places, and the tree of the suffixes in the windows of
    one prefix sees every repeat of them.
    """
    span = window - length + 1
    prefix = windows(h, length)
    size = np.diff(words.first)
    per_row = np.maximum(size - window + 1, 0)
    if not per_row.sum():
        return Anchors(*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    low = (prefix & ~np.uint64(0xFFFFFFFF)) | np.arange(len(prefix), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = ragged(words.first[:-1], per_row)
    row = np.repeat(np.arange(len(size)), per_row)
    if only is not None:
        keep = only[at]
        at, row = at[keep], row[keep]
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], new])) if len(at) else np.zeros(0, np.int64)
    return Anchors(row[first], at[first], np.diff(np.concatenate([first, [len(at)]])), anchor[first], prefix[anchor[first]])


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _listed(batch: pa.RecordBatch, words: Words, name: str) -> np.ndarray:
    """Whether each word is in the row's list."""
    lists = batch.column(name)
    lists = lists.fill_null([]) if lists.null_count else lists
    at = lists.offsets.to_numpy()
    out = np.zeros(len(words.starts), bool)
    out[lists.values.to_numpy()[at[0] : at[-1]] + np.repeat(words.first[:-1], np.diff(at))] = True
    return out


def _known(h: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """Which hashes are among some sorted ones."""
    if not len(sent) or not len(h):
        return np.zeros(len(h), bool)
    return sent[np.minimum(np.searchsorted(sent, h), len(sent) - 1)] == h


def _inside_hot(batch: pa.RecordBatch, words: Words, h: np.ndarray, window: int, before: int, hot: np.ndarray | None) -> np.ndarray:
    """The windows whose anchors of the length ``before`` have a hot prefix: one of those sent, or else one in the row's list."""
    found = anchors(words, h, window, before)
    only = np.zeros(len(words.starts), bool)
    if len(found.word):
        take = _listed(batch, words, "hot")[found.word] if hot is None else _known(found.prefix, hot)
        only[ragged(found.start[take], found.count[take])] = True
    return only


def _find_anchors(window: int, length: int, before: int | None, hot: np.ndarray | None):
    """Anchors of a prefix length; where ``before`` names a shorter one, of the windows with hot prefixes of that length."""

    def run(batches):
        for batch in pieces(batches, "text"):
            words = split(batch.column("text"), NOT_SPACE)
            h = hashes(words)
            found = anchors(words, h, window, length, _inside_hot(batch, words, h, window, before, hot) if before else None)
            d, x = (batch.column(c).to_numpy()[found.row] for c in ("d", "x"))
            more = windows(h, length, 7)[found.word] if length == window and len(found.word) else np.zeros(len(found.word), np.uint64)
            size = words.ends[found.start + found.count + window - 2] - words.starts[found.start]
            yield _batch(g=found.prefix.view(np.int64), g2=more.view(np.int64), d=d, x=x, a=(found.word - words.first[found.row]).astype(np.int32), size=size)

    return run


def _find_leaves(window: int, before: int | None, hot: np.ndarray | None, nodes: dict[int, int]):
    """The spans of words of runs of windows that are among the nodes, by two hashes each."""

    first = np.array(sorted(nodes), np.int64).view(np.uint64)
    order = np.argsort(first)
    first, second = first[order], np.array([nodes[k] for k in sorted(nodes)], np.int64).view(np.uint64)[order]

    def run(batches):
        for batch in pieces(batches, "text"):
            words = split(batch.column("text"), NOT_SPACE)
            h = hashes(words)
            per = np.maximum(np.diff(words.first) - window + 1, 0)
            at, row = ragged(words.first[:-1], per), np.repeat(np.arange(len(per)), per)
            if len(at):
                g, g2 = windows(h, window)[at], windows(h, window, 7)[at]
                leaf = _known(g, first)
                leaf[leaf] = second[np.searchsorted(first, g[leaf])] == g2[leaf]
                if before:
                    leaf &= _inside_hot(batch, words, h, window, before, hot)[at]
                at, row = at[leaf], row[leaf]
            start = at - words.first[row]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(row)) - 1 if len(row) else new
            d, x = (batch.column(c).to_numpy()[row[new]] for c in ("d", "x"))
            yield _batch(d=d, x=x, lo=start[new].astype(np.int32), hi=(start[last] + window).astype(np.int32))

    return run


def _cut_suffixes(window: int, length: int):
    """The text of the windows around each anchor in the list ``cold``."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            words = split(batch.column("text"), NOT_SPACE)
            found = anchors(words, hashes(words), window, length)
            if not len(found.word):
                continue
            take = _listed(batch, words, "cold")[found.word]
            row, start, count, prefix = found.row[take], found.start[take], found.count[take], found.prefix[take]
            d, x = (batch.column(c).to_numpy() for c in ("d", "x"))
            ends = start + count + window - 2  # the last word of the last window
            raw = words.data.tobytes()
            texts = [b" ".join(raw[s:e].split()) for s, e in zip(words.starts[start].tolist(), words.ends[ends].tolist(), strict=True)]
            yield _batch(g=prefix.view(np.int64), d=d[row], x=x[row], s=(start - words.first[row]).astype(np.int32), text=pa.array(texts, pa.binary()).cast(pa.string()))

    return run


class SuffixArray(NamedTuple):
    """Suffixes in the order of their words, and how many words each shares with the one before it."""

    piece: np.ndarray
    offset: np.ndarray
    common: np.ndarray


def _in_order(words: Words, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``at`` by their words' bytes up to the end of their piece; equal ones stay as they come.

    Ranks of single words by their bytes become ranks of two, three or four
    times as many words, as often as ranks fit in an integer, until no piece
    is longer; the last ones are formed for the wanted suffixes alone.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    rank = np.empty(len(one), np.int64)
    rank[sorted(range(len(one)), key=[words.text(i) for i in one.tolist()].__getitem__)] = np.arange(1, len(one) + 1)
    rank = rank[which]
    size = np.diff(words.first)
    end = np.repeat(words.first[1:], size)
    width, longest, every = 1, int(size.max()), np.arange(len(h))
    while True:
        bits = int(rank.max()).bit_length()
        several = 63 // bits
        last = width * several >= longest
        where = at if last else every
        key = rank[where]
        for j in range(1, several):
            after = where + j * width
            key = (key << bits) | np.where(after < end[where], rank[np.minimum(after, len(h) - 1)], 0)
        if last:
            return np.argsort(key, kind="stable")
        rank = np.unique(key, return_inverse=True)[1] + 1
        width *= several


def suffix_array(words: Words, h: np.ndarray, window: int) -> SuffixArray:
    """The suffixes of all pieces that have a window's words at least, in order, and their common prefixes, which end where a piece ends.

    Common prefixes are found by halving steps over hashes of 1, 2, 4 ...
    words.
    """
    per = np.maximum(np.diff(words.first) - window + 1, 0)
    at, piece = ragged(words.first[:-1], per), np.repeat(np.arange(len(per)), per)
    left = words.first[1:][piece] - at
    order = _in_order(words, h, at)
    at, piece, left = at[order], piece[order], left[order]
    a, b, most = at[:-1], at[1:], np.minimum(left[:-1], left[1:])
    shared = np.zeros(len(most), np.int64)
    for k in range(max(1, int(most.max(initial=1))).bit_length() - 1, -1, -1):
        block = windows(h, 1 << k)
        fits = np.flatnonzero(shared + (1 << k) <= most)
        alike = fits[block[a[fits] + shared[fits]] == block[b[fits] + shared[fits]]]
        shared[alike] += 1 << k
    return SuffixArray(piece, at - words.first[piece], np.concatenate([[0], shared])[: len(at)])


def maximal_repeats(suffixes: SuffixArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, lo, hi): the words of each leaf under an internal node of a window's depth or more, down to its deepest such node; overlapping ones of a piece are one."""
    depth = np.maximum(suffixes.common, np.append(suffixes.common[1:], 0))
    leaf = np.flatnonzero(depth >= window)
    piece, lo = suffixes.piece[leaf], suffixes.offset[leaf]
    order = np.lexsort((lo, piece))
    piece, lo, hi = piece[order], lo[order], (lo + depth[leaf])[order]
    if not len(piece):
        return piece, lo, hi
    new = np.concatenate([[True], piece[1:] != piece[:-1]])
    wide = int(hi.max()) + 1
    upto = np.maximum.accumulate(hi + piece * wide) - piece * wide  # pieces ascend, so none reaches into the next
    new[1:] |= lo[1:] > upto[:-1]
    first = np.flatnonzero(new)
    return piece[first], lo[first], upto[np.append(first[1:], len(piece)) - 1]


def _grow_trees(window: int):
    """Of pieces sorted by prefix: the spans of words of maximal repeats, whole groups at a time."""

    def groups(batches) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in pieces(batches, "text", 1 << 20):
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            edge = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if held and (edge or held[-1].column("g")[-1].as_py() != g[0]):
                cut = edge or 0
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in groups(batches):
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            words = split(table.column("text"), NOT_SPACE)
            piece, lo, hi = maximal_repeats(suffix_array(words, hashes(words), window), window)
            start = table.column("s").to_numpy()[piece]
            d, x = (table.column(c).to_numpy()[piece] for c in ("d", "x"))
            yield _batch(d=d, x=x, lo=(start + lo).astype(np.int32), hi=(start + hi).astype(np.int32))

    return run


def _row_keys(frame: DataFrame, doc_id: str, text: str) -> DataFrame:
    """With d and x, by which a row's spans are found again: never null, and equal only for rows of equal id and text."""
    return frame.withColumn("d", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0))).withColumn("x", F.xxhash64(F.col(doc_id), F.col(text)))


def repeated_spans(frame: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, x, copied, spans): for rows with repeats, the spans [lo, hi) of words in windows that also start elsewhere.

    ``copied`` marks texts that several rows have: their windows all repeat,
    and one row stands for them below. Each window's suffixes are dealt out by
    a prefix of 8 words at its anchor; prefixes that only one anchor has are
    dropped. Where more than GROUP anchors, or suffixes of more than
    GROUP_BYTES, have a prefix, their windows get
    anchors of 20 words, then of all words, so that groups fit a task; each
    group's suffix array gives its internal nodes. At the length of a window a group is
    one internal node, of any number of leaves: two are enough.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "substrings")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _row_keys(frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id", "text").select("d", "x", "text")
    ids = scratch.save(rows.select("d", "x", F.md5(F.col("text").cast("binary")).alias("t")), "ids")
    several, seen = scratch.measured(ids.groupBy("t").agg(F.count("*").alias("c"), F.min(F.struct("d", "x")).alias("one")).where("c > 1"), "several", n=F.count("*"))
    copies = scratch.save(ids.join(small(several, seen["n"]), "t").select("d", "x", (F.struct("d", "x") == F.col("one")).alias("stands")).distinct(), "copies")

    trees, lists, before, hot = [], None, None, None
    for length in [n for n in PREFIXES if n < window] + [window]:
        # hot prefixes are few, as each has many anchors: tasks know them, and texts needn't move
        at_hand = rows if lists is None or hot is not None else rows.join(lists.where("size(hot) > 0").select("d", "x", "hot"), ["d", "x"])
        found = at_hand.mapInArrow(_find_anchors(window, length, before, hot), "g bigint, g2 bigint, d bigint, x bigint, a int, size bigint")
        # copies' anchors go before they are dealt out; the texts themselves needn't move for it
        found = scratch.save(found.join(copies.where("NOT stands"), ["d", "x"], "left_anti"), f"anchors-{length}")
        counts = found.groupBy("g", "g2").agg(F.count("*").alias("c"), F.sum("size").alias("size")).where("c > 1")
        counts = counts.select("g", "g2", ((F.col("c") > GROUP) | (F.col("size") > GROUP_BYTES)).alias("large"))
        counts, seen = scratch.measured(counts, f"prefixes-{length}", n=F.count("*"), hot=F.count_if("large"))
        if length == window:
            if seen["n"] <= SENT and hot is not None:
                nodes = {r.g: r.g2 for r in counts.toLocalIterator()}
                trees.append(rows.mapInArrow(_find_leaves(window, before, hot, nodes), "d bigint, x bigint, lo int, hi int"))
            else:
                leaves = found.join(counts.select("g", "g2"), ["g", "g2"])
                trees.append(leaves.select("d", "x", F.col("a").alias("lo"), (F.col("a") + window).alias("hi")))
            break
        found, several = found.select("g", "d", "x", "a"), small(counts.where("large").select("g"), seen["hot"])
        fit = found.join(several, "g", "left_anti").join(counts.where("NOT large").select("g"), "g").withColumn("is_hot", F.lit(False))
        hot = np.sort(np.array([r.g for r in counts.where("large").toLocalIterator()], np.int64).view(np.uint64)) if seen["hot"] <= SENT else None
        if hot is None:
            fit = fit.unionByName(found.join(several, "g").withColumn("is_hot", F.lit(True)))
        lists = fit.groupBy("d", "x").agg(F.collect_list(F.when(~F.col("is_hot"), F.col("a"))).alias("cold"), F.collect_list(F.when(F.col("is_hot"), F.col("a"))).alias("hot"))
        lists = scratch.save(lists, f"lists-{length}")
        cut = rows.join(lists.where("size(cold) > 0").select("d", "x", "cold"), ["d", "x"]).mapInArrow(_cut_suffixes(window, length), "g bigint, d bigint, x bigint, s int, text string")
        cut = scratch.save(cut, f"suffixes-{length}")
        scratch.drop(f"anchors-{length}", f"prefixes-{length}")
        trees.append(cut.repartition(n_parts, "g").sortWithinPartitions("g").mapInArrow(_grow_trees(window), "d bigint, x bigint, lo int, hi int"))
        if not seen["hot"]:
            break
        before = length
    spans = reduce(DataFrame.unionByName, trees).groupBy("d", "x").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")).withColumn("copied", F.lit(False))
    spans = spans.join(copies.select("d", "x"), ["d", "x"], "left_anti")
    all_of = copies.select("d", "x", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"), F.lit(True).alias("copied"))
    out = scratch.save(spans.select("d", "x", "spans", "copied").unionByName(all_of), "spans")
    scratch.drop("ids", "several", "copies", *(f"{kind}-{n}" for kind in ("anchors", "prefixes", "lists", "suffixes") for n in (*PREFIXES, window)))
    return out


def remove_repeats(frame: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The rows with n_words, n_removed and kept: the text without words in windows of ``window`` words that also start elsewhere in the table.

    Windows are judged on the input, so every copy goes. Null texts have no
    words; texts shorter than a window stay whole; words of ``kept`` are
    joined by one space. Rows that are equal are copies of each other. Columns
    named n_words, n_removed or kept are replaced; ``keep`` names the columns
    to return besides (all). An empty table gives an empty result.
    """
    frame = frame.drop("n_words", "n_removed", "kept")
    keep = frame.columns if keep is None else keep
    spans = repeated_spans(frame, window, text, doc_id)
    clash = {"d", "x", "spans", "copied"} & set(frame.columns)
    renamed = frame.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    body, key = (f"__own_{c}" if c in clash else c for c in (text, doc_id))
    source = renamed.withColumn("__text", F.coalesce(F.col(f"`{body}`"), F.lit(""))).withColumn("__id", F.col(f"`{key}`").cast("bigint"))
    rows = _row_keys(source, "__id", "__text").drop("__id").join(spans, ["d", "x"], "left")
    rows = rows.select(*(F.col(f"`__own_{c}`" if c in clash else f"`{c}`").alias(c if c not in clash else f"__own_{c}") for c in keep), F.col("__text"), F.col("spans").alias("__spans"), F.coalesce("copied", F.lit(False)).alias("__copied"))
    own = rows.schema.fields[: len(keep)]
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches):
        for batch in pieces(batches, "__text"):
            words = split(batch.column("__text"), NOT_SPACE)
            n = np.diff(words.first)
            gone = np.zeros(len(words.starts) + 1, np.int64)
            lists = batch.column("__spans")
            copied = batch.column("__copied").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(copied & (n >= window)).tolist():
                gone[words.first[i]] += 1
                gone[words.first[i + 1]] -= 1
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            base = np.repeat(words.first[:-1], sizes)
            if len(flat):
                np.add.at(gone, flat.field("lo").to_numpy() + base, 1)
                np.add.at(gone, flat.field("hi").to_numpy() + base, -1)
            stays = np.cumsum(gone[:-1]) == 0
            removed = n - np.add.reduceat(np.concatenate([stays, [False]]).astype(np.int64), words.first[:-1]) * (n > 0) if len(n) else n
            # the bytes of kept words, each with a blank after it
            index = np.flatnonzero(stays)
            width = words.ends[index] - words.starts[index]
            to = np.cumsum(width + 1) - width - 1
            data = np.full(int((width + 1).sum()), 0x20, np.uint8)
            data[ragged(to, width)] = words.data[ragged(words.starts[index], width)]
            per = n - removed
            ends = np.concatenate([[0], np.cumsum(width + 1)])[np.concatenate([[0], np.cumsum(per)])]
            raw = data.tobytes()
            kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"__own_{c}": c for c in clash})

"""How sources of a language differ in their words: groups stay in their partitions while compressed vectors of their peers go round."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkrank.llm.scratch import Scratch, bounded, small
from walkrank.llm.words import give_back, pieces, split

#: a-z and all bytes of other than ASCII characters; for text in lower case.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Shares are counted in parts of this many.
PARTS = 1_000_000_000
#: Bytes of text whose terms a task counts together; rows of counts in a block of terms, that is, what a task of the audit holds; seats of a language at most.
TALLY_BYTES, BLOCK_ROWS, SEATS = 6 << 20, 400_000, 15
#: Groups for which a language gets another seat.
GROUPS = 4

_CODEC = "zstd"


def tally(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents; a row without a term for each group that occurs."""
    table = pa.Table.from_batches(batches).combine_chunks()
    words = split(table["text"], LETTERS, lower=True)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int32)
    spelled = pa.StringArray.from_buffers(len(words.starts), pa.py_buffer(ends), pa.py_buffer(words.data[LETTERS[words.data]]))
    coded = spelled.dictionary_encode()
    lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group, of_row = np.unique(lang.indices.to_numpy(False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(False), return_inverse=True)
    k = max(1, len(coded.dictionary))
    seen, times = np.unique(words.row() * k + coded.indices.to_numpy(False), return_counts=True)  # of each document and term
    cells, at = np.unique(of_row[seen // k] * k + seen % k, return_inverse=True)
    of_cell = np.concatenate([cells // k, np.arange(len(group))])
    n = np.concatenate([np.bincount(at, times, len(cells)), np.zeros(len(group))]).astype(np.int64)
    docs = np.concatenate([np.bincount(at, minlength=len(cells)), np.zeros(len(group), np.int64)]).astype(np.int64)
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(cells % k)), pa.array([""] * len(group), pa.string())])
    pairs = [frame.dictionary.take(pa.array(codes[of_cell])) for frame, codes in ((lang, group // max(1, len(source.dictionary))), (source, group % max(1, len(source.dictionary))))]
    return pa.RecordBatch.from_arrays([*pairs, terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def count_terms(frame: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of lang, source, text: occurrences, and rows that hold the term; the empty term stands for the group itself. Tasks count first, so a group of any share of the rows sends a row a term and task."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for piece in pieces(batches, "text"):
            held.append(piece)
            size += piece.nbytes
            if size >= TALLY_BYTES:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)
        give_back()

    rows = frame.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and their counts, compressed: steps of four bytes, counts of eight."""
    return pa.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), _CODEC, asbytes=True)


def unpack(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(packed, 12 * size, _CODEC, asbytes=True)
    return np.cumsum(np.frombuffer(data, "<u4", size), dtype=np.int64), np.frombuffer(data, "<i8", size, 4 * size)


_VECTORS = "lang string, block bigint, kind string, source string, n bigint, size bigint, vector binary"


def _vectors(least: int):
    """Of a block of a language's terms: those in ``least`` documents, in order; a vector of counts a source, and that of the language."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, block = key[0].as_py(), key[1].as_py()
        sources = table["source"].combine_chunks().dictionary_encode()
        terms = table["term"].combine_chunks().dictionary_encode()
        n, docs = (table[c].to_numpy().astype(np.int64) for c in ("n", "docs"))
        code, source = terms.indices.to_numpy(False), sources.indices.to_numpy(False)
        spelled = terms.dictionary
        in_docs = np.zeros(len(spelled), np.int64)
        np.add.at(in_docs, code, docs)
        kept = np.flatnonzero((in_docs >= least) & pc.not_equal(spelled, "").to_numpy(False))
        kept = kept[pc.sort_indices(spelled.take(pa.array(kept))).to_numpy()]  # in order of their bytes
        place = np.full(len(spelled), -1, np.int64)
        place[kept] = np.arange(len(kept))
        inside = np.flatnonzero((place[code] >= 0) & (n > 0))
        at, n, source = place[code[inside]], n[inside], source[inside]
        order = np.lexsort((at, source))
        at, n = at[order], n[order]
        bounds = np.searchsorted(source[order], np.arange(len(sources.dictionary) + 1))
        rows = [("source", name, int(n[a:b].sum()), b - a, pack(at[a:b], n[a:b])) for name, a, b in zip(sources.dictionary.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        total = np.zeros(len(kept), np.int64)
        np.add.at(total, at, n)
        rows.append(("lang", None, int(total.sum()), len(kept), pack(np.arange(len(kept)), total)))
        names = "\n".join(spelled.take(pa.array(kept)).to_pylist()).encode()
        rows.append(("terms", None, len(names), len(kept), pa.compress(names, _CODEC, asbytes=True)))
        columns = zip(*((lang, block, *r) for r in rows), strict=True)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "block", "kind", "source", "n", "size", "vector"])

    return run


def shares(count: np.ndarray | int, total: int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 2) / (total + 2 * terms)), exactly: long division by thousands, so that nothing exceeds 64 bits for totals below 9e15."""
    whole = max(1, total + 2 * terms)
    rest = np.asarray(count, np.int64) + 2
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Group:
    """A source's vector in a block: places, shares there, and the share of a term it lacks."""

    __slots__ = ("at", "name", "none", "p")

    def __init__(self, row: dict):
        self.name = row["source"]
        self.at, n = unpack(row["vector"], row["size"])
        self.p, self.none = shares(n, row["total"], row["v"]), shares(0, row["total"], row["v"])


def meet(hosts: list[Group], guests: list[Group], terms: int, home: bool) -> list[tuple[str, str, int]]:
    """(source, item, value) in both directions for each host and guest: sums over all terms of the block. At home each two of one seat meet once."""
    out = []
    dense, inside = np.zeros(terms, np.int64), np.zeros(terms, bool)
    for i, x in enumerate(hosts):
        dense[:], inside[:] = x.none, False
        dense[x.at], inside[x.at] = x.p, True
        for y in guests[i + 1 :] if home else guests:
            both = y.at[inside[y.at]]
            value = differ(dense[y.at], y.p).sum() + differ(x.p, y.none).sum() - differ(dense[both], y.none).sum()
            value = int(value) + (terms - len(x.at) - len(y.at) + len(both)) * int(differ(x.none, y.none))
            out += [(x.name, y.name, value), (y.name, x.name, value)]
    return out


def _result(lang: str, part: list[str], rows: list[tuple[str, str, int]]) -> pa.Table:
    source, item, value = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


_RESULT = "lang string, source string, part string, item string, value bigint"


def _at_home(top: int):
    """The pairs of one seat, and a heap of terms for each of its groups against the language's vector."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        groups, common = [Group(r) for r in left.to_pylist()], {r["kind"]: r for r in right.to_pylist()}
        whole, packed = Group(common["lang"]), common["terms"]
        n = packed["size"]
        pairs, best = meet(groups, groups, n, True), []
        raw = pa.decompress(packed["vector"], packed["n"], _CODEC, asbytes=True) if n else b""
        spelled = raw.decode().split("\n")
        for g in groups:
            q = whole.p[g.at]
            more = np.flatnonzero(g.p > q)
            value = differ(g.p[more], q[more])
            best += [(g.name, spelled[place], -v) for v, place in heapq.nsmallest(top, zip((-value).tolist(), g.at[more].tolist(), strict=True))]
        return _result(key[0].as_py(), ["pair"] * len(pairs) + ["term"] * len(best), pairs + best)

    return run


def _abroad(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    hosts, guests = ([Group(r) for r in t.to_pylist()] for t in (left, right))
    rows = meet(hosts, guests, int(left["terms"][0].as_py()), False) if hosts and guests else []
    return _result(key[0].as_py(), ["pair"] * len(rows), rows)


def audit(frame: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10, top: int = 10, seats: int = SEATS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its most typical terms.

    Terms of a language are those in ``least`` of its rows. A group's share of
    a term is smoothed, p = 1 + floor(PARTS * (n + 2) / (N + 2 * V)), and two
    shares differ by floor((p - q)^2 / (p + q)). Part "pair": of each group and
    other source of its language the sum over all terms, all ranks; part
    "term": terms of which the group has more than the language, ``top`` ranks.

    Terms are dealt to blocks of bounded size, a language's groups to at most
    ``seats`` seats of each block, which stay where they are in memory. In
    each round the vectors of all seats, compressed, move on by one seat; each
    two seats meet once, in half a turn. What a task holds is a block's share
    whatever the number of documents; a lost task takes its seat from the
    shared folder again.

    Null lang, source and text count as empty; a group without terms takes
    part; without terms in a language all its pairs have 0; a single group has
    no pairs; repeated rows each count; an empty table gives an empty result.
    Other columns, whatever their names, don't matter.
    """
    spark = frame.sparkSession
    bounded(spark)
    scratch = Scratch(spark, "divergence")
    named = frame.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = scratch.save(count_terms(named), "counts")
    # a row a language
    langs = counts.groupBy("lang").agg(F.count("*").alias("c"), F.count_if(F.col("term") == "").alias("groups"))
    langs, seen = scratch.measured(langs.select("lang", F.ceil(F.col("c") / BLOCK_ROWS).alias("blocks"), F.least(F.lit(seats), F.ceil(F.col("groups") / GROUPS)).cast("int").alias("seats")), "langs", n=F.count("*"), most=F.max("seats"))
    langs = small(langs, seen["n"])
    dealt = counts.join(langs, "lang")
    # a group stands in every block, with terms there or without
    own = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("term") == "", own).otherwise(F.array(F.pmod(F.xxhash64("term"), F.col("blocks"))))))
    vectors = scratch.save(dealt.select("lang", "block", "source", "term", "n", "docs").groupBy("lang", "block").applyInArrow(_vectors(least), _VECTORS), "vectors")
    totals, groups = scratch.measured(vectors.where("kind = 'source'").groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals", n=F.count("*"))
    sizes = vectors.where("kind = 'lang'").groupBy("lang").agg(F.sum("size").alias("v"), F.sum("n").alias("lang_total"))
    sizes = small(scratch.save(sizes.join(langs, "lang"), "sizes"), seen["n"])
    terms = vectors.where("kind = 'lang'").select("lang", "block", F.col("size").alias("terms"))
    residents = vectors.where("kind = 'source'").join(small(totals, groups["n"]), ["lang", "source"]).join(sizes, "lang").join(terms, ["lang", "block"])
    place = ["lang", "block", "seat"]
    columns = [*place, "source", "size", "vector", "total", "v", "terms", "seats"]
    residents = scratch.save(residents.withColumn("seat", F.pmod(F.xxhash64("source"), F.col("seats")).cast("int")).select(*columns), "residents")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stay = residents.repartition(parts, *place).persist()
    stay.count()  # once they stand, no round deals them out again
    common = vectors.where("kind <> 'source'").join(sizes, "lang").withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    common = common.select(*place, "kind", "source", "n", "size", "vector", F.col("lang_total").alias("total"), "v")
    found = scratch.save(stay.groupBy(*place).cogroup(common.groupBy(*place)).applyInArrow(_at_home(top), _RESULT), "round-0")
    for r in range(1, (seen["most"] or 0) // 2 + 1):
        # half a turn: seats at an even distance of half the ring meet from one side alone
        going = (2 * r < F.col("seats")) | ((2 * r == F.col("seats")) & (F.col("seat") >= r))
        guests = residents.where(going).withColumn("seat", F.pmod(F.col("seat") - r, F.col("seats")))
        met = stay.groupBy(*place).cogroup(guests.groupBy(*place)).applyInArrow(_abroad, _RESULT)
        found = found.unionByName(scratch.save(met, f"round-{r}"))
    stay.unpersist()
    return ranked(found, top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """Values summed over blocks, ranks by value, then by the item's bytes."""
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    rows = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rows = rows.withColumn("rank", order.cast("int"))
    return rows.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")

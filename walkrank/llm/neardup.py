"""Similarity join on word shingles by parity sketches, and the classes of linked documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkrank.llm.scratch import Scratch, small
from walkrank.llm.words import NOT_SPACE, hashes, mix, pieces, split, windows

#: Size bands grow by this factor; a part more than the bound for each so many differences keeps parts non-empty.
BAND_RATIO, SLACK_SHARE = 1.4, 0.10
#: Bits of the smallest sketch for the Hamming bound; larger sets have the next power of two.
SKETCH_BITS = 1024
#: A key's low bits name its band.
BAND_BITS = 6
#: Most rows of a key that are joined by it in one task; larger ones are dealt out as they come.
HOT = 1_000
#: Keys of which a task remembers who stands for them (16 bytes each), and how long one lasts that doesn't come again.
SLOTS, LASTS = 1 << 18, 8
#: 64-bit words of the rows of a bucket that meet in one cell, on either side, and what a row takes besides its arrays.
QUERY_WORDS, TARGET_WORDS, ROW_WORDS = 1 << 17, 1 << 18, 64


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: with fewer words the whole sequence is one, without words none."""
    found = split(column, NOT_SPACE, lower=True)
    h = hashes(found)
    rolled = windows(h, words)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            out.append(windows(h[a:b], b - a, salt=1) if b > a else h[:0])
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(shingles).sum(dtype=np.uint64).astype(np.int64)), int(mix(shingles ^ np.uint64(0xA5A5_5A5A_C3C3_3C3C)).sum(dtype=np.uint64).astype(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit: the Hamming distance of two sketches is at most the sets' symmetric difference.

    A sketch of half the bits is the XOR of the two halves.
    """
    bits = max(SKETCH_BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


class Bands:
    """Bands of set sizes. A linked pair meets in the band of its smaller set, with at most ``differ`` differences there."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edge = [1]

    def of(self, n: int) -> int:
        while self.edge[-1] <= n:
            self.edge.append(max(self.edge[-1] + 1, int(self.edge[-1] * BAND_RATIO)))
        return int(np.searchsorted(self.edge, n, "right")) - 1

    def differ(self, band: int) -> int:
        a = self.edge[band + 1] - 1
        b = a * 100 // self.percent
        # J >= t means that the symmetric difference is at most (1 - t) / (1 + t) of both sizes
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, band: int) -> int:
        d = self.differ(band)
        return d + 1 + int(d * SLACK_SHARE) + 2

    def joined(self, n: int) -> list[int]:
        """The band of a set, and those below where a smaller partner can be."""
        band, least = self.of(n), self.of(max(1, -(-n * self.percent // 100)))
        return [b for b in range(band, least - 1, -1) if b >= 0 and self.differ(b) > 0]


def dealt(shingles: np.ndarray, bands: Bands, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each shingle, ascending, and the first shingle of each part that isn't empty."""
    part = ((shingles >> np.uint64(32)) * np.uint64(bands.parts(band))) >> np.uint64(32)
    return part, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))


def band_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys: the XOR of the shingles of each part of the sketch, by band and part.

    The shingles are dealt to p parts; with at most d differences, at least
    p - d parts of two sets are alike. Empty parts give no key, as p - d is
    more than a set has of them; the few sets with more also meet at these.
    """
    out = [shingles[:0]]
    for band in bands.joined(len(shingles)):
        p, name = bands.parts(band), np.uint64(band)
        part, first = dealt(shingles, bands, band)
        keys = [mix(np.bitwise_xor.reduceat(shingles, first) ^ mix(part[first] + np.uint64(band << 40)))]
        if len(first) <= bands.differ(band):
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), part[first])
            keys.append(mix(mix(empty + np.uint64(band << 40)) ^ np.uint64(0x5EED)))
        out.append((np.concatenate(keys) >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | name)
    return np.concatenate(out)


def needs(shingles: np.ndarray, bands: Bands) -> list[int]:
    """For each band of a set, as band << 32 | need: how many of its keys a linked set of that band has at least."""
    out = []
    for band in bands.joined(len(shingles)):
        filled = len(dealt(shingles, bands, band)[1])
        out.append(band << 32 | max(1, filled - bands.differ(band)))
    return out


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(r.view(np.int64) for r in rows)])))


def _fingerprints(words: int, percent: int):
    def run(batches):
        bands = Bands(percent)
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield _batch(doc_id=batch.column("doc_id"), n_shingles=np.array([len(s) for s in sets], np.int64), f1=prints[:, 0], f2=prints[:, 1], sketch=_lists([sketch(s) for s in sets]), needs=_lists([np.array(needs(s, bands), np.int64) for s in sets]))

    return run


class Heads:
    """Who stands for a key, across the batches of a task: for as many keys as there are slots, preferring those that come again.

    It decides how many rows a frequent key sends to its task, one for each
    task instead of one for each batch, and never which documents share it.
    Slots differ between tasks, so that no two keys always meet in one.
    """

    def __init__(self, salt: int):
        self.salt = np.uint64(salt)
        self.key, self.doc, self.left = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.full(SLOTS, -1, np.int8)

    def of(self, k: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of different keys, each with a document: the one that stands for the key, or its own, which may from now on."""
        at = (mix(k + (self.salt << np.uint64(32))) % np.uint64(SLOTS)).astype(np.int64)
        known = (self.left[at] >= 0) & (self.key[at] == k)
        out = np.where(known, self.doc[at], doc)
        self.left[at[known]] = np.minimum(self.left[at[known]] + 2, LASTS)
        at, k, doc = at[~known], k[~known], doc[~known]
        self.left[at] = np.maximum(self.left[at] - 1, -1)  # once, however many keys ask for the slot
        free = self.left[at] < 0
        at, k, doc = at[free], k[free], doc[free]
        self.key[at], self.doc[at] = k, doc  # of several, the last
        self.left[at] = 0
        return out


def _keys(words: int, percent: int):
    def run(batches):
        bands = Bands(percent)
        task = TaskContext.get()
        heads = Heads(task.partitionId() if task else 0)
        for batch in pieces(batches, "text"):
            keys = [band_keys(s, bands) for s in shingle_sets(batch.column("text"), words)]
            docs = np.repeat(batch.column("doc_id").to_numpy(), [len(k) for k in keys])
            k = np.concatenate(keys)
            if len(k):
                # documents with a key in common, in this batch or in those before: one of them stands for it elsewhere
                order = np.lexsort((docs, k))
                k, docs = k[order], docs[order]
                first = np.concatenate([[True], k[1:] != k[:-1]])
                pivot = heads.of(k[first], docs[first])[np.cumsum(first) - 1]
                new = first | (docs != np.concatenate([[0], docs[:-1]]))
                yield _batch(k=k[new].view(np.int64), doc=docs[new], pivot=pivot[new])

    return run


def _runs(batches):
    """Of rows sorted by key: those that are known to share it, and for each run of several pivots a link of each to the first."""
    last, head = None, None
    for batch in batches:
        k, doc, pivot = (batch.column(c).to_numpy() for c in ("k", "doc", "pivot"))
        own = doc == pivot
        yield _batch(k=k[~own], doc=doc[~own], pivot=pivot[~own])
        k, doc = k[own], doc[own]
        if not len(k):
            continue
        first = np.concatenate([[k[0] != last], k[1:] != k[:-1]])
        heads = np.where(first, doc, 0)
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        heads = np.where(at < 0, head if head is not None else 0, doc[np.maximum(at, 0)])
        keep = ~first & (heads != doc)
        yield _batch(k=k[keep], doc=doc[keep], pivot=heads[keep])
        last, head = k[-1], heads[-1]


def _sets(words: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            yield _batch(doc=batch.column("doc_id"), n=np.array([len(s) for s in sets], np.int64), shingles=_lists(sets))

    return run


def _both(pairs: DataFrame, traits: DataFrame, of: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(traits.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col(of).alias(f"{of}_{side}")), side)
    return pairs


def plausible(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the Hamming distance of the sketches leave."""

    def folded(x: str, y: str):
        half = F.size(y)
        twice = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        more = F.aggregate(F.sequence(F.lit(0), (F.size(x) / half).cast("int") - 1), F.array_repeat(F.lit(0).cast("bigint"), half), lambda s, i: F.zip_with(s, F.slice(x, i * half + 1, half), lambda a, b: a.bitwiseXOR(b)))
        return F.when(F.size(x) == 2 * half, twice).when(F.size(x) > half, more).otherwise(F.col(x))

    rows = _both(pairs, traits, "sketch").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    rows = rows.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), folded("sketch_a", "sketch_b").alias("x"), folded("sketch_b", "sketch_a").alias("y"))
    hamming = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return rows.where(hamming * (100 + percent) <= F.col("n") * (100 - percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, exactly."""
    rows = _both(pairs, sets, "shingles").withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return rows.where(F.col("common") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc, root): the smallest member of each component, for all other members.

    Alternates two steps until nothing changes: every node's larger
    neighbours go to its smallest neighbour; every node and its smaller
    neighbours go to the smallest. Minima are partial aggregates and the joins
    can be split, so a node with many links is no hot spot.
    """
    state = {"n": F.count("*"), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e, before = scratch.measured(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0", **state)
    step = 0
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nearer = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        e, now = scratch.measured(nearer, f"{name}-{step}", **state)
        scratch.drop(f"{name}-{step - 1}")
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("doc"), F.col("v").alias("root"))


def _views(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; lists are views of its buffers, so that sets take 8 bytes a shingle."""
    columns = []
    for column in batch.columns:
        if pa.types.is_list(column.type):
            at, values = column.offsets.to_pylist(), column.values.to_numpy()
            columns.append([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        else:
            columns.append(column.to_pylist())
    for row in zip(*columns, strict=True):
        yield dict(zip(batch.schema.names, row, strict=True))


def _meet(percent: int, exact: bool):
    """Queries against targets of a bucket. By sketches: the rows that may have a partner of another class; else exact links."""

    def rows(batches) -> Iterator[list[dict]]:
        run, key = [], None
        for batch in batches:
            for row in _views(batch):
                cell = (row["k"], row["qb"], row["tb"])
                if cell != key and run:
                    yield run
                    run = []
                key = cell
                run.append(row)
        if run:
            yield run

    def run(batches):
        for cell in rows(batches):
            q, t = [r for r in cell if r["query"]], [r for r in cell if not r["query"]]
            if not q or not t:
                continue
            nq, nt = (np.array([r["n"] for r in x], np.int64) for x in (q, t))
            by_size = defaultdict(list)
            for i, r in enumerate(t):
                by_size[len(r["sketch"])].append(i)
            blocks = [(np.array(at), np.array([t[i]["sketch"] for i in at], np.int64)) for at in by_size.values()]
            ids = np.array([r["doc"] for r in t])
            cq, ct = (np.array([r["root"] for r in x]) for x in (q, t))
            root = {}

            def find(x, root=root):
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            hit, a, b = np.zeros(len(t), bool), [], []
            for i, r in enumerate(q):
                n = nt + nq[i]
                own = r["sketch"]
                far = np.full(len(t), 1 << 60)
                for at, sketches in blocks:  # the longer ones are folded to the shorter
                    bits = min(sketches.shape[1], len(own))
                    if sketches.shape[1] > bits:
                        sketches = np.bitwise_xor.reduce(sketches.reshape(len(at), -1, bits), axis=1)
                    far[at] = np.bitwise_count(sketches ^ np.bitwise_xor.reduce(own.reshape(-1, bits), axis=0)).sum(axis=1, dtype=np.int64)
                near = (ct != cq[i]) & (far * (100 + percent) <= n * (100 - percent)) & (np.minimum(nt, nq[i]) * 100 >= np.maximum(nt, nq[i]) * percent)
                if not exact:
                    hit |= near
                    if near.any():
                        a.append(r["doc"])
                    continue
                for j in np.flatnonzero(near).tolist():
                    x, y = find(int(cq[i])), find(int(ct[j]))
                    if x != y:
                        # of a doc_id with several texts, rows may pair the sketch of one with the set of another
                        one, other = r["shingles"], t[j]["shingles"]
                        common = len(np.intersect1d(one, other, assume_unique=True))
                        if common * (100 + percent) >= (len(one) + len(other)) * percent:
                            root[x] = y
                            a.append(r["doc"])
                            b.append(int(ids[j]))
            if exact:
                yield _batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))
            else:
                docs = np.concatenate([np.array(a, np.int64), ids[hit].astype(np.int64)])
                yield _batch(k=np.full(len(docs), cell[0]["k"], np.int64), doc=docs)

    return run


def of_keys(rows: DataFrame, keys: DataFrame, n_large: int) -> DataFrame:
    """The rows whose k is among keys(k, c), with c, the number of rows there. Rows of keys of more than HOT rows, of which there are n_large, aren't dealt out by them."""
    large = small(keys.where(F.col("c") > HOT), n_large)
    rest = rows.join(large.select("k"), "k", "left_anti").join(keys.where(F.col("c") <= HOT), "k")
    return rest.unionByName(rows.join(large, "k"))


def likely(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Of rows (k, doc, root, c) of all buckets that span classes: those at which linked documents must meet.

    Linked documents of different classes share as many of these keys as both
    need. Documents with fewer in a band go; of the others' keys, those of the
    smallest buckets stay, as many as leave out one key less than they need:
    two such choices have a key in common. So a key that very many documents
    share, as of a common passage, by itself brings nobody together.
    """
    need = traits.select("doc", F.explode("needs").alias("v")).groupBy("doc", F.shiftright("v", 32).alias("band")).agg(F.min(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("need"))
    mine = Window.partitionBy("doc", "band")
    rows = rows.withColumn("band", F.col("k").bitwiseAND(F.lit((1 << BAND_BITS) - 1)))
    rows = rows.withColumn("i", F.row_number().over(mine.orderBy("c", "k"))).withColumn("own", F.count("*").over(mine)).join(need, ["doc", "band"])
    return rows.where("own >= need AND i <= own - need + 1").select("k", "doc", "root")


def _cells(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (k, doc, root, words, ...) of buckets, dealt to cells of bounded size: blocks of those outside the bucket's largest class meet blocks of all."""
    classes = rows.groupBy("k", "root").agg(F.sum("words").alias("w"))
    sums = classes.groupBy("k").agg(F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("root", F.struct("w", "root")).alias("main")).where("all > most")
    sums, seen = scratch.measured(sums, name, n=F.count("*"))
    rows = rows.join(small(sums, seen["n"]), "k")
    q_blocks, t_blocks = F.ceil((F.col("all") - F.col("most")) / QUERY_WORDS), F.ceil(F.col("all") / TARGET_WORDS)
    spread = F.xxhash64("doc")
    outer = rows.where("root <> main").withColumn("query", F.lit(True)).withColumn("qb", F.pmod(spread, q_blocks)).withColumn("tb", F.explode(F.sequence(F.lit(0).cast("bigint"), t_blocks - 1)))
    inner = rows.withColumn("query", F.lit(False)).withColumn("tb", F.pmod(spread, t_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), q_blocks - 1)))
    cell = ["k", "qb", "tb"]
    return outer.unionByName(inner).drop("all", "most", "main", "words").repartition(*cell).sortWithinPartitions(*cell, "query", "doc")


def link_classes(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: classes of documents linked by Jaccard similarity >= percent / 100.

    A document's set are its distinct shingles of ``words`` words (A-Z in
    lower case); shorter texts are one shingle; null texts and texts without
    words have none and link with nothing. ``component_id`` is the smallest
    doc_id of the class. Rows that share a doc_id are one document with
    several texts; a null doc_id links with nothing and has a null class.
    Empty tables give empty results; other columns are not read.

    Steps: equal sets fall together by fingerprint. Each remaining set's
    parity sketch gives keys by size band and part (see band_keys), sorted by
    key in bounded runs. Pairs of a document and the first of a run are left
    out if the sketches' Hamming distance is too large; each document is then
    verified against one such partner, and against its others of another
    class. In buckets of three or more that still span classes, documents with
    too few such keys for a link go (see likely); the rest is searched in
    cells of bounded size, by the sketches and then exactly, until every pair
    of different classes in a bucket has been compared or joined. Equal and joined documents need no more pairs, so
    groups of copies cost rows in proportion to their size.
    """
    scratch = Scratch(frame.sparkSession, "neardup")
    n_parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    docs = scratch.save(rows.mapInArrow(_fingerprints(words, percent), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch array<bigint>, needs array<bigint>"), "docs")
    some = docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = scratch.save(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    stand = some.join(reps.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "n_shingles", "doc_id"], "left_semi")
    traits = scratch.save(stand.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch", "needs").dropDuplicates(["doc", "n", "sketch"]), "traits")

    kept = rows.join(traits.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    keys = kept.mapInArrow(_keys(words, percent), "k bigint, doc bigint, pivot bigint")
    ordered = keys.repartition(n_parts, F.when(F.col("doc") == F.col("pivot"), F.col("k")).otherwise(F.xxhash64("doc"))).sortWithinPartitions("k", "doc")
    members = scratch.save(ordered.mapInArrow(_runs, "k bigint, doc bigint, pivot bigint"), "members")

    pairs = scratch.save(plausible(members.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), traits, percent).distinct(), "pairs")

    def sets_of(docs: DataFrame) -> DataFrame:
        return rows.join(docs.distinct(), "doc_id", "left_semi").mapInArrow(_sets(words), "doc bigint, n bigint, shingles array<bigint>")

    sets = scratch.save(sets_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))), "sets")
    links = scratch.save(verified(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "links-1")

    def labelled(frame: DataFrame, roots: DataFrame, key: str, root: str) -> DataFrame:
        return frame.join(roots.select(F.col("doc").alias(key), F.col("root").alias(root)), key, "left").withColumn(root, F.coalesce(root, key))

    linked = links.select(F.col("a").alias("doc"), F.col("b").alias("root"))  # a row a document at most
    rest = labelled(labelled(pairs, linked, "a", "r1"), linked, "b", "r2").where("r1 <> r2").select("a", "b")
    links = links.unionByName(scratch.save(verified(rest, sets, percent), "links-2"))
    roots = components(links, scratch, "roots-1")

    # buckets of two have been compared; of the others, those that still span classes
    hot = F.count_if(F.col("c") > HOT)
    larger, seen = scratch.measured(members.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "larger", hot=hot)
    bucket = members.select("k", "doc").unionByName(members.select("k", F.col("pivot").alias("doc"))).distinct()
    spans = scratch.save(labelled(of_keys(bucket, larger, seen["hot"]).select("k", "doc"), roots, "doc", "root"), "spans")
    several, seen = scratch.measured(spans.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("k", "c"), "several", hot=hot)
    open_rows, left = scratch.measured(likely(of_keys(spans, several, seen["hot"]), traits), "open", n=F.count("*"))
    scratch.drop("members", "pairs", "sets", "larger", "spans", "several")
    more = roots.select(F.col("doc").alias("a"), F.col("root").alias("b"))
    if left["n"]:
        met = open_rows.join(traits.drop("needs"), "doc").withColumn("words", F.size("sketch") + ROW_WORDS)
        maybe = _cells(met, scratch, "cells-1").select("k", "qb", "tb", "query", "doc", "root", "n", "sketch").mapInArrow(_meet(percent, False), "k bigint, doc bigint").distinct()
        maybe = scratch.save(maybe.join(open_rows, ["k", "doc"]), "maybe")
        again = maybe.join(traits.drop("needs"), "doc").join(sets_of(maybe.select(F.col("doc").alias("doc_id"))).select("doc", "shingles"), "doc").withColumn("words", F.size("sketch") + F.size("shingles") + ROW_WORDS)
        last = _cells(scratch.save(again, "again"), scratch, "cells-2").select("k", "qb", "tb", "query", "doc", "root", "n", "sketch", "shingles").mapInArrow(_meet(percent, True), "a bigint, b bigint").distinct()
        more = more.unionByName(scratch.save(last, "links-3"))
    # rows that share a doc_id are one document
    own = docs.where("n_shingles > 0 AND doc_id IS NOT NULL").join(reps, ["f1", "f2", "n_shingles"]).select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("c")).where("c > 1")
    more = more.unionByName(scratch.save(own.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"), "same-id"))
    roots = components(more, scratch, "roots-2")
    scratch.drop("open", "cells-1", "maybe", "again", "cells-2")

    named = docs.select("doc_id", "n_shingles", "f1", "f2").join(reps, ["f1", "f2", "n_shingles"], "left").join(roots.withColumnRenamed("doc", "rep"), "rep", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))

"""Divergence of sources, Merkle manifests and host-level rules against brute force: nulls, empty and long texts, ties, repeats, hot groups, clashing columns, empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import PASSAGE, TEXTS, lower, prose
from walkrank.llm import divergence, merkle, quality

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def drawn(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in (rng.zipf(1.3, n) % 300).tolist())


AUDITED = [
    *((lang, f"s{i % 11}", drawn(100 * len(lang) + i, 40)) for lang in ("en", "fré") for i in range(60)),
    *(("en", "s0", drawn(i, 60)) for i in range(200, 260)),  # a hot source
    ("en", "none", None), ("en", "", ""), (None, None, "Alpha beta"), ("", "x", "alpha"), ("solo", "one", "a"), ("solo", "two", None), ("single", "one", "é"), ("en", "s1", "x " * 5000), ("en", "S1", "Ünï ünï ÜNÏ a1b2-c"), ("en", "s1", "x"), ("en", "s1", "x"),
]


def audited(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(TERM, lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in own.items():
            pairs = sorted((-sum(f(share(c, t), share(o, t)) for t in kept), i.encode(), i) for i, o in own.items() if i != s)
            terms = sorted((-f(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] > 0 and share(c, t) > share(whole, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, rank + 1) for rank, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("seats", "groups", "block", "least"), [(15, 4, 400_000, 10), (7, 1, 50, 3), (4, 1, 200, 1), (1, 1, 100, 10)])
def test_divergence(spark, monkeypatch, seats, groups, block, least):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    frame = spark.createDataFrame([(*r, 1, "x") for r in AUDITED], "lang string, source string, text string, value int, term string").repartition(5)
    got = divergence.audit(frame, least=least, top=10, seats=seats)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audited(AUDITED, least, 10)


def test_divergence_of_nothing(spark):
    frame = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(frame).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**14), st.integers(0, 10**15), st.integers(0, 10**10))
def test_shares_are_exact(count, more, terms):
    total = count + more
    assert int(divergence.shares(count, total, terms)) == 1 + 10**9 * (count + 2) // max(1, total + 2 * terms)


def test_vectors_are_packed_without_loss():
    at, n = np.array([0, 3, 70000]), np.array([1, 2**40, 7])
    for a, c in ((at, n), (at[:0], n[:0])):
        got = divergence.unpack(divergence.pack(a, c), len(a))
        assert got[0].tolist() == a.tolist() and got[1].tolist() == c.tolist()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest(rows, arity, claims):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, text), level by level in plain Python."""

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            run = i - i % arity
            yield level[run:i], level[i + 1 : run + arity]
            i //= arity

    groups = defaultdict(list)
    for d, s, t in rows:
        groups[s].append((d is not None, d or 0, H(told(d), told(s), told(t)), d, H(told(d), told(s), told(claims(d, t)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names}
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, d, own) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            proof = ""
            for before, after in [*path(trees[s], i), *path(upper, k)]:
                proof, own = proof + "".join(before + after), H(*before, own, *after)
            out.append((d, leaf, trees[s][-1][0], upper[-1][0], H(proof), own))
    return sorted(out, key=str)


MANIFESTED = [
    *((i, "hot", f"Text {i}") for i in range(300)), *((i, f"s{i % 37}", f"t{i}") for i in range(300, 420)),
    *((None, "hot", "again") for _ in range(40)), (7, None, "Null"), (8, None, None), (9, "", ""), (10, "é", "ünï"), (11, "z", "L" * 50000), (11, "z", "same"), (11, "z", "same"),
]


@pytest.mark.parametrize(("arity", "reach", "parts"), [(16, 3, 4), (2, 1, 7), (3, 1, 2)])
def test_merkle(spark, monkeypatch, tmp_path, arity, reach, parts):
    monkeypatch.setattr(merkle, "REACH", reach)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = np.random.default_rng(3).permutation(np.array(MANIFESTED, object)).tolist()
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, source string, text string, tree int, leaf string").repartition(3)
        own = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
        tampered = F.col("doc_id") % 5 == 0
        claim = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.when(tampered, F.lower("text")).otherwise(F.col("text")))
        built = merkle.build(frame.withColumn("claim", claim), own, keep=["doc_id", "claim"], arity=arity)
        built.write(f"file://{tmp_path}/m")
        for m in (built, merkle.Manifest.read(spark, f"file://{tmp_path}/m")):
            got = merkle.proofs(m).select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("row.claim"), F.col("path")))
            assert sorted(map(tuple, got.collect()), key=str) == manifest(rows, arity, lambda d, t: t.lower() if t is not None and d is not None and d % 5 == 0 else t)
        names = [(r.tree, r.name, r.n) for r in built.trees.orderBy("tree").collect()]
        assert names[:2] == [(0, None, 2), (1, "", 1)] and dict((n, c) for _, n, c in names)["hot"] == 340
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_manifests(spark):
    frame = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, source string, text string")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    alone = merkle.proofs(merkle.build(frame, leaf)).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in alone] == [(H("1:11:a1:x"),) * 3 + ([],)]
    nothing = merkle.build(frame.where("false"), leaf)
    assert nothing.root is None and merkle.proofs(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(2, 5), st.randoms())
def test_parents_need_no_order(n, arity, rng):
    """Children in any order, over two partitions whose frontiers meet, give every node once."""
    digests = [H(str(i)) for i in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    cut = rng.randrange(n + 1)
    nodes, waiting = [], []
    for part in (order[:cut], order[cut:]):
        held = merkle.Parents(0, n, arity)
        for i in part:
            nodes += held.arrive(0, i, digests[i])
        waiting += held.frontier()
    last = merkle.Parents(0, n, arity)
    for row in waiting:
        nodes += last.merge(row[3], row[4], row[7], row[8])
    assert not list(last.frontier())
    want, level = Counter(), digests
    while len(level) > 1:
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        want.update(level)
    assert Counter(r[6] for r in nodes) == want


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    hit = {p for i, g in enumerate(grams) if g in twice for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit))


LINED = ["a b\na b\n a b\na b \n\n\nc", "\n", "\n\nx\n", "x\nx", "x\r\nx\r\nx", "a a a a a a", "a b c d e a b c d e f", "#*$%&|<> #1", "é\né\n é é", PASSAGE + "\n" + PASSAGE, "y\n" * 3000]


def test_quality_counts(spark):
    texts = [*TEXTS, *LINED]
    frame = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, kept string").repartition(3)
    got = {r.doc_id: tuple(r)[2:] for r in quality.count_rules(frame.select("doc_id", "text", "kept", "n_words"), keep=["doc_id", "kept"]).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}
    assert quality.host_quality(frame.where("false"), host="kept", keep=["doc_id"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é#\n\r\t", max_size=40)), min_size=1, max_size=6))
def test_quality_counts_of_any_text(texts):
    import pyarrow as pa

    got = quality.count_batch(pa.array(texts, pa.string()))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [counted(t) for t in texts]


def test_hosts(spark):
    clean, junk = [prose(i, 60) for i in range(40)], "too few"
    rows = [(f"h{i % 8}", clean[i]) for i in range(40)] * 2
    rows += [("farm", junk)] * 60 + [("farm", t) for t in clean[:5]]  # most fail: all go
    rows += [("mixed", junk)] * 5 + [("mixed", t) for t in clean[:6]]  # under half: only its failures go
    rows += [("new", junk)]  # one document says little of a host
    rows += [(None, clean[0]), (None, None), (None, clean[1])]
    rows += [("symbols", t.replace(" ", " # ")) for t in clean] + [("symbols", clean[3])]  # no document fails alone
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, source string, text string").withColumn("host_rules", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in quality.host_quality(frame, keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, (host, text) in enumerate(rows):
        n_words, *_, n_repeat = counted(text)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        reasons = {"farm": ["short"], "symbols": ["symbols"]}.get(host, [])
        assert (got[i].base_failed, got[i].host_rules, got[i].kept) == (failed, reasons, not failed and not reasons), (host, text)
    rates = {r["__host"]: r for r in quality.judged(quality.host_rates(quality.count_rules(frame.select("doc_id", "text", F.col("source").alias("__host")), keep=["__host"]), "__host")).collect()}
    assert rates["farm"].rate_short > 0.5 > rates["mixed"].rate_short and rates["new"].rate_short < 1


def test_prior():
    # hosts that differ by chance alone lend all their strength; those that differ much, hardly any
    n, k = 100, 50
    for p, strength in ((0.2, 1000.0), (None, 10.0)):
        failed = [n * p] * k if p else [0, n] * (k // 2)
        mean, got = quality.prior(sum(failed), n * k, n * n * k, sum(f * f / n for f in failed), k)
        assert mean == pytest.approx(p or 0.5) and got == strength
    assert quality.prior(0.0, 0, 0.0, 0.0, 0) == (0.0, 1000.0) and quality.prior(3.0, 9, 81.0, 1.0, 1)[1] == 1000.0

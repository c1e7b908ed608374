"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.llm.scratch import bounded
from walkrank.llm.words import ALNUM, give_back, hashes, pieces, split

#: Buckets of hashed terms, factors of each, and most labelled rows that the model is fitted on.
BUCKETS, FACTORS, SAMPLE = 1 << 18, 4, 12_000
#: Rows of the sample that must hold a term for it to count; the power of the number of terms that scales a text.
SUPPORT, POWER = 5, 0.4
_EPOCHS, _BATCH, _RATE, _FACTOR_RATE, _L1, _L2, _POSITIVE = 10, 128, 4.0, 0.1, 0.05, 1e-4, 3.0
#: Length and decay of the factors that fitting starts from; a term's share of the largest in its direction to have any; steps to find them.
_START, _DECAY, _SHARE, _ROUNDS = 0.5, 1e-3, 0.35, 8


class Machine(NamedTuple):
    """Score: the logistic function of bias + n^-POWER * sum of weights + sum over pairs of the factors' products, over a text's n known terms."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    known: np.ndarray

    def score(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_raw(self, *_known(self.known, terms, at))[0], -30, 30)))


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each whole text's words (A-Z in lower case), and the rows' offsets in them."""
    words = split(column, ALNUM, lower=True)
    bucket = (hashes(words) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
    both = np.unique(words.row() * BUCKETS + bucket)
    return both % BUCKETS, np.searchsorted(both, np.arange(len(words.first)) * BUCKETS)


def _known(known: np.ndarray, terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = known[terms]
    return terms[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[at[1:]] - total[at[:-1]]


def _raw(m: Machine, terms: np.ndarray, at: np.ndarray):
    n = np.diff(at)
    x = np.repeat(np.maximum(n, 1) ** -POWER, n)
    v = m.factor[terms]
    s = _sums(v, at)
    return m.bias + _sums(m.weight[terms] * x, at) + 0.5 * (s**2 - _sums(v**2, at)).sum(axis=1), x, v, s


def _chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _chances(m: Machine, rows: list[np.ndarray], block: int = 512) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(_chance(_raw(m, *_flat(rows[lo : lo + block]))[0]) for lo in range(0, len(rows), block))])


def _loss(m: Machine, rows: list[np.ndarray], label: np.ndarray) -> float:
    p = _chances(m, rows)
    return float(-np.where(label == 1, _POSITIVE * np.log(p), np.log(1 - p)).sum())


def pair_directions(rows: list[np.ndarray], miss: np.ndarray, n_terms: int, rng: np.random.Generator) -> np.ndarray:
    """Factors to start from: along the leading directions in which pairs of terms go with what an additive model misses.

    Those are eigenvectors of the sum of miss * outer(x - mean, x - mean) over
    the rows, without its diagonal, scaled by the terms' spread; found by
    subspace iteration over the rows, so that no matrix of pairs is formed.
    """
    col, at = _flat(rows)
    row, n = np.repeat(np.arange(len(rows)), np.diff(at)), len(rows)
    share = np.bincount(col, minlength=n_terms) / n
    scale = 1 / np.sqrt(n * (share * (1 - share) + 0.01))
    miss = miss - miss.mean()
    alone = np.bincount(col, miss[row], n_terms)
    diagonal = alone * (1 - 2 * share) * scale**2

    def product(q: np.ndarray) -> np.ndarray:
        out = np.empty_like(q)
        for f in range(q.shape[1]):
            w = scale * q[:, f]
            met = np.bincount(col, (_sums(w[col], at) * miss)[row], n_terms)
            out[:, f] = scale * (met - alone * (share @ w) - share * (alone @ w)) - diagonal * q[:, f]
        return out

    q = np.linalg.qr(rng.normal(size=(n_terms, min(2 * FACTORS, n_terms))))[0]
    for _ in range(_ROUNDS):
        q = np.linalg.qr(product(q))[0]
    value, vector = np.linalg.eigh(q.T @ product(q))
    u = ((q @ vector) * (value > 0))[:, ::-1][:, :FACTORS]
    u /= np.maximum(np.abs(u).max(axis=0, initial=0), 1e-12)
    out = np.zeros((n_terms, FACTORS))
    out[:, : u.shape[1]] = _START * u * (np.abs(u) >= _SHARE)
    return out


def descend(rows: list[np.ndarray], label: np.ndarray, factor: np.ndarray, rng: np.random.Generator, epochs: int = _EPOCHS) -> Machine:
    """Logistic loss; weights by follow-the-leader steps with an L1 bound that leaves most at zero, factors that aren't zero by scaled gradients."""
    factor, live = factor.copy(), factor != 0
    weight, z, g2, gf = *np.zeros((3, len(factor))), np.full(factor.shape, 1e-4)
    known = np.ones(len(factor), bool)
    bias, g0 = 0.0, 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), _BATCH):
            of = order[lo : lo + _BATCH]
            flat, at = _flat([rows[i] for i in of])
            raw, x, v, s = _raw(Machine(bias, weight, factor, known), flat, at)
            miss = (_chance(raw) - label[of]) * np.where(label[of] == 1, _POSITIVE, 1.0)
            g0 += miss.mean() ** 2
            bias -= _RATE * miss.mean() / np.sqrt(g0)
            n = np.diff(at)
            each = np.repeat(miss, n) / len(of)
            u, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, each * x, len(u))
            z[u] += g - (np.sqrt(g2[u] + g * g) - np.sqrt(g2[u])) / _RATE * weight[u]
            g2[u] += g * g
            weight[u] = np.where(np.abs(z[u]) <= _L1, 0, -(z[u] - np.sign(z[u]) * _L1) / ((1e-3 + np.sqrt(g2[u])) / _RATE + _L2))
            for f in np.flatnonzero(live.any(axis=0)).tolist():
                g = (np.bincount(back, each * (np.repeat(s[:, f], n) - v[:, f]), len(u)) + _DECAY * factor[u, f]) * live[u, f]
                gf[u, f] += g * g
                factor[u, f] -= _FACTOR_RATE * g / np.sqrt(gf[u, f])
    return Machine(bias, weight, factor, known)


def fit(rows: list[np.ndarray], label: np.ndarray) -> Machine:
    """Weights, and factors for what they leave over. Without both labels every score is 0.

    Each half of the rows gives an additive model; what it misses in the other
    half shows which pairs of terms matter, and there factors start. They stay
    if the models of both halves lose less on the other half with them; then,
    weights and factors are fitted to all rows together.
    """
    rng = np.random.default_rng(5)
    known = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=BUCKETS) >= min(SUPPORT, max(1, len(rows) // 100))
    if len(set(label.tolist())) < 2:
        return Machine(-30.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), known)
    used = np.flatnonzero(known)  # all is fitted in these terms' places
    rows, n_terms = [np.searchsorted(used, r[known[r]]) for r in rows], len(used)
    half = rng.permutation(len(rows)) % 2
    parts = [np.flatnonzero(half == k) for k in (0, 1)]
    parts = parts if n_terms and all(len(set(label[p].tolist())) == 2 for p in parts) else []
    miss, lost, factor = np.zeros(len(rows)), [0.0, 0.0], np.zeros((n_terms, FACTORS))
    halves = [([rows[i] for i in p], label[p]) for p in parts]
    additive = [descend(*half, factor, rng) for half in halves]
    for k, (part, (own, y)) in enumerate(zip(parts, halves, strict=True)):
        miss[part] = (y - _chances(additive[1 - k], own)) * np.where(y == 1, _POSITIVE, 1.0)
        paired = descend(own, y, pair_directions(own, miss[part], n_terms, rng), rng, _EPOCHS + 2)
        lost[0] += _loss(additive[k], *halves[1 - k])
        lost[1] += _loss(paired, *halves[1 - k])
    if lost[1] < lost[0]:
        factor = pair_directions(rows, miss, n_terms, rng)
    found = descend(rows, label, factor, rng, _EPOCHS + 2 * bool(factor.any()))
    weight, factor = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    weight[used], factor[used] = found.weight, found.factor
    return Machine(found.bias, weight, factor, known)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0. A null id teaches neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(frame: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled rows, the first by a hash of the id. Ids labelled twice count as toxic if once so; null labels don't teach."""
    bounded(frame.sparkSession)
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # a sample of fixed size may be sent to every task
    rows = frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch in pieces(batches, "text"):
            flat, at = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["doc_id", "y", "terms"])

    found = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, terms array<int>")
    # one row an id, should documents repeat them
    got = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "terms"), F.size("terms")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    lists = got.column("terms").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    machine = fit([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], got.column("y").to_numpy() if got.num_rows else np.zeros(0))
    give_back()
    return machine


def score_toxicity(frame: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The rows with the score of each whole text, from 0 to 1; null and empty texts have that of no terms. One narrow pass; a column of that name is replaced, ``keep`` names those to return besides (all)."""
    bounded(frame.sparkSession)
    frame = frame.drop(score)
    keep = frame.columns if keep is None else keep
    types = {f.name: f for f in frame.schema.fields}
    used = np.flatnonzero(machine.known)
    sent = frame.sparkSession.sparkContext.broadcast((machine.bias, used, machine.weight[used], machine.factor[used]))
    schema = T.StructType([*(types[c] for c in keep), T.StructField(score, T.DoubleType())])

    def run(batches):
        bias, used, weight, factor = sent.value
        whole = Machine(bias, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), np.zeros(BUCKETS, bool))
        whole.weight[used], whole.factor[used], whole.known[used] = weight, factor, True
        for batch in pieces(batches, text):
            got = whole.score(*terms(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got)], names=[*keep, score])

    return frame.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)

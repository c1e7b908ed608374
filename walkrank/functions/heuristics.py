"""Heuristics of a hop as Column expressions, and their weighted sums.

They read these columns of a candidate hop, as far as they need them: cos,
degree, avg_degree, pheromone, max_pheromone, votes, n_agents, relevance,
relation, and query_id, agent_id, step, dst for draws. Missing pheromone
counts as 0, a missing degree as 0; without a vector cos is null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from walkrank.functions.rng import uniform

#: Mean degrees of the three known benchmark graphs. Fixed values.
MEAN_DEGREE = {"prime": 125.2, "amazon": 18.2, "mag": 43.5}


def cosine() -> Column:
    return F.col("cos")


def semantic() -> Column:
    return (F.col("cos") + 1.0) / 2.0


def log_degree() -> Column:
    return F.ln(1.0 + F.coalesce(F.col("degree"), F.lit(0)))


def saturating(mean_degree: Column | float | None = None) -> Column:
    """L / (L + A) of the logarithms of 1 + degree and 1 + mean degree; 0 where both are 0."""
    mean = F.col("avg_degree") if mean_degree is None else F.lit(mean_degree)
    top = log_degree()
    return F.coalesce(top / F.nullif(top + F.ln(1.0 + mean), F.lit(0.0)), F.lit(0.0))


def dataset_centrality(name: str) -> Callable[[], Column]:
    if name not in MEAN_DEGREE:
        raise ValueError(f"no dataset {name!r}: {', '.join(MEAN_DEGREE)}")
    return lambda: saturating(MEAN_DEGREE[name])


def level() -> Column:
    return F.coalesce(F.col("pheromone"), F.lit(0.0))


def _share() -> Column:
    return level() / F.greatest(F.col("max_pheromone"), F.lit(0.0001))


def repulsion() -> Column:
    return 1.0 - _share()


def jitter() -> Column:
    return uniform(F.col("query_id"), F.col("agent_id"), F.col("step"), F.col("dst"), "jitter")


def visited() -> Column:
    """May pass 1, as agents that come back vote again."""
    return F.col("votes") / F.col("n_agents")


def flat() -> Column:
    return F.lit(1.0)


def dep_semantic() -> Column:
    return F.when(semantic() > 0.5, (semantic() - 0.5) * 2.0).otherwise(0.0)


def dep_semantic_raw() -> Column:
    return F.greatest(F.lit(0.0), F.col("cos"))


def dep_explorer(base: float = 1.0, fresh: float = 2.0, crowded: float = 0.5) -> Column:
    return base * (fresh - (fresh - crowded) * _share())


def dep_collab(base: float = 1.0, gain: float = 1.0, cap: float = 5.0) -> Column:
    return base * F.least(1.0 + gain * level(), F.lit(cap))


def diversity() -> Column:
    """The prototype's: 1 + (maximum - level), where a node never read has 1."""
    return 1.0 + (F.col("max_pheromone") - F.coalesce(F.col("pheromone"), F.lit(1.0)))


def relevance() -> Column:
    return F.coalesce(F.col("relevance"), F.lit(0.0))


def relation_preference(weights: Mapping[str, float], other: float = 0.5) -> Callable[[], Column]:
    """Weights of edges by relation, ``other`` for those not named."""

    def of() -> Column:
        out = F.lit(other)
        for name, weight in weights.items():
            out = F.when(F.col("relation") == name, F.lit(weight)).otherwise(out)
        return out

    return of


NAMED: dict[str, Callable[[], Column]] = {
    "cosine": cosine, "semantic": semantic, "log_degree": log_degree, "centrality": saturating, "repulsion": repulsion, "jitter": jitter, "visited": visited,
    "flat": flat, "dep_hub": saturating, "dep_hub_raw": log_degree, "dep_semantic": dep_semantic, "dep_semantic_raw": dep_semantic_raw, "dep_explorer": dep_explorer, "dep_collab": dep_collab, "diversity": diversity, "relevance": relevance,
}


def _log_degree_of(c: Mapping[str, np.ndarray]) -> np.ndarray:
    return np.log(1.0 + c["degree"])


def _saturating_of(c: Mapping[str, np.ndarray]) -> np.ndarray:
    top = _log_degree_of(c)
    whole = top + np.log(1.0 + c["avg_degree"])
    return np.divide(top, whole, out=np.zeros_like(top), where=whole != 0)


#: The same over arrays, where no node has pheromones: of those that read cos, degree, avg_degree, relevance, votes and n_agents alone. A missing degree or relevance is 0 there.
OF_ARRAYS: dict[str, Callable[[Mapping[str, np.ndarray]], np.ndarray | float]] = {
    "cosine": lambda c: c["cos"], "semantic": lambda c: (c["cos"] + 1.0) / 2.0, "log_degree": _log_degree_of, "centrality": _saturating_of, "repulsion": lambda c: 1.0,
    "visited": lambda c: c["votes"] / c["n_agents"], "flat": lambda c: 1.0, "dep_hub": _saturating_of, "dep_hub_raw": _log_degree_of, "relevance": lambda c: c["relevance"],
}


@dataclass(frozen=True)
class Batched:
    """A heuristic as any callable over whole columns: it gets Arrow arrays of the columns it reads, by name, and gives a number for each row."""

    function: Callable[[dict[str, pa.Array]], Sequence[float] | np.ndarray | pa.Array]
    reads: tuple[str, ...]


def _batches(parts: list[tuple[Batched, float]]) -> Column:
    """The weighted sum of some batched heuristics, of which a task evaluates all in one pass over the union of what they read."""
    reads = sorted({c for part, _ in parts for c in part.reads})

    @F.arrow_udf("double")
    def total(*columns: pa.Array) -> pa.Array:
        named = dict(zip(reads, columns, strict=True))
        out = np.zeros(len(columns[0]))
        for part, weight in parts:
            found = part.function({c: named[c] for c in part.reads})
            out += weight * np.asarray(found.to_numpy(False) if isinstance(found, pa.Array) else found, np.float64)
        return pa.array(out, from_pandas=True)

    return total(*map(F.col, reads))


def weighted(strategies: Mapping) -> Column:
    """The weighted sum of named heuristics, of functions that return a Column, and of batched ones; null where one is."""
    total, parts = F.lit(0.0), []
    for what, weight in strategies.items():
        if isinstance(what, Batched):
            parts.append((what, float(weight)))
        else:
            total = total + (NAMED[what] if isinstance(what, str) else what)() * F.lit(float(weight))
    return total + _batches(parts) if parts else total


def over_arrays(strategies: Mapping) -> bool:
    """Whether ``weighted_arrays`` knows all of them."""
    return all(isinstance(what, str) and what in OF_ARRAYS for what in strategies)


def weighted_arrays(strategies: Mapping, columns: Mapping[str, np.ndarray]) -> np.ndarray | float:
    """``weighted`` over arrays, without pheromones; NaN where cos is."""
    total = 0.0
    for what, weight in strategies.items():
        total = total + OF_ARRAYS[what](columns) * float(weight)
    return total

"""Settings of a retrieval run, and the named profiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    """Strategies map a heuristic's name (or a function of a hop's columns) to its weight."""

    n_agents: int = 20
    steps: int = 4
    decay: float = 0.5
    initial_pool_size: int = 30
    start_subset: int = 10
    top_k: int = 20
    movement: Mapping = field(default_factory=lambda: {"semantic": 0.3, "centrality": 0.4, "repulsion": 0.3})
    ranking: Mapping = field(default_factory=lambda: {"visited": 0.6, "cosine": 0.4})
    deposit: Mapping = field(default_factory=lambda: {"flat": 1.0})
    pheromone: str = "off"
    floor: float = 0.001
    drop_slope: float = 0.05

    def but(self, **changes) -> Params:
        """With other values; None keeps the value, a strategy map is replaced as a whole."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


PROFILES = {
    "default": Params(),
    "high_exploration": Params(n_agents=50, steps=6, decay=0.2, initial_pool_size=50, start_subset=20, top_k=50, movement={"semantic": 0.2, "centrality": 0.2, "repulsion": 0.6}, ranking={"visited": 0.8, "cosine": 0.2}),
    "fast": Params(n_agents=10, steps=2, initial_pool_size=15, start_subset=5, top_k=5, movement={"semantic": 0.5, "centrality": 0.5, "repulsion": 0.0}, ranking={"visited": 0.5, "cosine": 0.5}),
    "benchmark": Params(movement={"semantic": 0.35, "centrality": 0.2, "repulsion": 0.4, "jitter": 0.05}, deposit={"dep_semantic": 1.0}),
}


def profile(name: str = "default", **changes) -> Params:
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}: {', '.join(PROFILES)}")
    return PROFILES[name].but(**changes)

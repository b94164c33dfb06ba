"""Settings of a corpus: one frozen object passed explicitly, no globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WalkConfig:
    """walks_per_vertex, length, seed: the corpus. p, q: second-order weights.

    segment_hops: hops between two materialisations of the walkers, so that
    neither the plan nor the carried path grows with the walk length.
    broadcast_edges: largest directed edge count for the broadcast strategy.
    merge_frequency: batches between two compactions of a corpus.
    snapshot_every: batches between two whole snapshots of a stored corpus;
    the batches between them are stored as what they change.
    """

    walks_per_vertex: int = 1
    length: int = 6
    seed: int = 42
    model: str = "deepwalk"
    p: float = 4.0
    q: float = 1.0
    sampler: str = "exact"
    segment_hops: int = 16
    broadcast_edges: int = 5_000_000
    merge_frequency: int = 1
    snapshot_every: int = 16

    def __post_init__(self):
        if self.length < 1 or self.walks_per_vertex < 1:
            raise ValueError("length and walks_per_vertex are at least 1")
        if self.model not in ("deepwalk", "node2vec"):
            raise ValueError(f"no model {self.model}")
        if self.sampler not in ("exact", "mh"):
            raise ValueError(f"no sampler {self.sampler}")

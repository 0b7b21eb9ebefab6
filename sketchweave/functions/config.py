"""Hyper-parameters of a model."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SketchConfig:
    """Shape of a Count-Sketch and of the learner on it.

    ``key_len`` is the number of leading bytes of a string feature that are
    hashed (a multiple of 4); two features with equal leading bytes share cells
    but stay different features.
    """

    n_rows: int = 3
    n_buckets: int = 4095
    n_classes: int = 1
    k: int = 50
    lr: float = 0.5
    key_len: int = 12
    eps: float = 1.05
    seeds: tuple[int, ...] = (16807, 282475249, 1622650073, 984943658, 1144108930)
    batch_rows: int = 10_000

    def __post_init__(self):
        if self.key_len % 4 or self.key_len <= 0:
            raise ValueError("key_len must be a positive multiple of 4")
        if not 1 <= self.n_rows <= len(self.seeds):
            raise ValueError(f"n_rows must be 1 to {len(self.seeds)}, the number of seeds")
        if self.n_buckets < 1 or self.n_classes < 1 or self.k < 1:
            raise ValueError("n_buckets, n_classes and k must be positive")

    def sign_seed(self, row: int) -> int:
        return (self.seeds[row] + 3) % (1 << 32)

    def but(self, **changes) -> "SketchConfig":
        return replace(self, **changes)

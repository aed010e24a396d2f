"""Penalties the consensus step of ADMM can apply to the d-sized consensus vector."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .passes import penalized_mask

KINDS = ("zero", "l1", "elastic_net", "lower_bound", "zero_set")


@dataclass(frozen=True)
class Penalty:
    """A penalty on the mean loss. l1 and elastic_net leave the intercept (last slot) free."""

    kind: str = "zero"
    lam: float = 0.0
    gamma: float = 0.0
    threshold: float = 0.0
    intercept: bool = True

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown penalty {self.kind!r}, expected one of {KINDS}")

    def prox(self, v: np.ndarray, weight: float) -> np.ndarray:
        """argmin of penalty(w) + weight/2 |w - v|^2."""
        if self.kind == "zero":
            return v
        if self.kind == "zero_set":
            return np.zeros_like(v)
        if self.kind == "lower_bound":
            return np.maximum(v, self.threshold)
        gamma = self.gamma if self.kind == "elastic_net" else 0.0
        shrunk = np.sign(v) * np.maximum(np.abs(v) - self.lam / weight, 0.0)
        mask = penalized_mask(len(v), self.intercept)
        return np.where(mask > 0, shrunk / (1.0 + gamma / weight), v)

    def value(self, w: np.ndarray) -> float:
        mask = penalized_mask(len(w), self.intercept)
        if self.kind == "l1":
            return float(self.lam * np.abs(w * mask).sum())
        if self.kind == "elastic_net":
            kept = w * mask
            return float(self.lam * np.abs(kept).sum() + self.gamma / 2 * (kept @ kept))
        return 0.0


Prox = Penalty | Callable[[np.ndarray, float], np.ndarray]


def prox_function(prox: Prox) -> Callable[[np.ndarray, float], np.ndarray]:
    return prox.prox if isinstance(prox, Penalty) else prox

"""Top-k tables, and the exact heap with hysteresis for ordered training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decimal digits of a weight's size that rank it; the feature breaks ties.
DIGITS = 12


def _rank(w: str):
    return F.round(F.abs(F.col(w)), DIGITS).desc()


def global_topk(weights: DataFrame, k: int, w: str = "w") -> DataFrame:
    """The k features of largest absolute weight."""
    return weights.orderBy(_rank(w), "feature").limit(k)


def topk_per_class(weights: DataFrame, k: int, w: str = "w") -> DataFrame:
    order = Window.partitionBy("class").orderBy(_rank(w), "feature")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def thresholds(model: DataFrame, k: int) -> DataFrame:
    """class, minimum: the smallest size in a full table, 0 in one that isn't full."""
    return model.groupBy("class").agg(F.when(F.count("*") < k, 0.0).otherwise(F.min(F.abs("w"))).alias("minimum"))


def full(model: DataFrame, k: int) -> DataFrame:
    """class, full: whether a class's table holds k features."""
    return model.groupBy("class").agg((F.count("*") >= k).alias("full"))


def lookup(features: DataFrame, model: DataFrame, on=("feature",)) -> DataFrame:
    """All rows of ``features`` with w, 0 for what the model doesn't hold."""
    return features.join(model.select(*on, "w"), list(on), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def members(features: DataFrame, model: DataFrame) -> DataFrame:
    return features.join(model.select("feature"), "feature", "left_semi")


def active_set(*models: DataFrame) -> DataFrame:
    """Features that any of the tables holds."""
    whole = models[0].select("feature")
    for m in models[1:]:
        whole = whole.unionByName(m.select("feature"))
    return whole.distinct()


class HystereticHeap:
    """Bounded set of the heaviest keys with lazily refreshed heap weights.

    The value of a held key is always the last one pushed.  Its heap weight
    follows only when it has moved by the factor ``eps`` (always, while the heap
    isn't full), and a new key must beat the minimum by that factor.
    """

    def __init__(self, capacity: int, eps: float = 1.05):
        self.capacity, self.eps = capacity, eps
        self.heap: list[tuple] = []  # (weight, key); a min-heap once full
        self.slot: dict = {}
        self.value: dict = {}

    def __len__(self) -> int:
        return len(self.heap)

    def __contains__(self, key) -> bool:
        return key in self.slot

    def get(self, key) -> float:
        return self.value.get(key, 0.0)

    def full(self) -> bool:
        return len(self.heap) >= self.capacity

    def minimum(self) -> float:
        return self.heap[0][0] if self.full() else 0.0

    def push(self, key, value: float) -> None:
        size = abs(value)
        if key in self.slot:
            self.value[key] = value
            i = self.slot[key]
            now = self.heap[i][0]
            if not self.full():
                self.heap[i] = (size, key)
            elif size >= now * self.eps or size <= now / self.eps:
                self.heap[i] = (size, key)
                self._up(i) if size < now else self._down(i)
        elif not self.full():
            self.slot[key], self.value[key] = len(self.heap), value
            self.heap.append((size, key))
            if self.full():
                for i in reversed(range(len(self.heap) // 2)):
                    self._down(i)
        elif size > self.minimum() * self.eps:
            gone = self.heap[0][1]
            del self.slot[gone], self.value[gone]
            self.heap[0] = (size, key)
            self.slot[key], self.value[key] = 0, value
            self._down(0)

    def _swap(self, i: int, j: int) -> None:
        self.heap[i], self.heap[j] = self.heap[j], self.heap[i]
        self.slot[self.heap[i][1]], self.slot[self.heap[j][1]] = i, j

    def _up(self, i: int) -> None:
        while i and self.heap[i][0] < self.heap[(i - 1) // 2][0]:
            self._swap(i, (i - 1) // 2)
            i = (i - 1) // 2

    def _down(self, i: int) -> None:
        while (j := 2 * i + 1) < len(self.heap):
            if j + 1 < len(self.heap) and self.heap[j + 1][0] < self.heap[j][0]:
                j += 1
            if self.heap[i][0] <= self.heap[j][0]:
                return
            self._swap(i, j)
            i = j

    def check(self) -> bool:
        """The heap order (once full) and both indexes."""
        ordered = all(self.heap[(i - 1) // 2][0] <= self.heap[i][0] for i in range(1, len(self.heap)))
        return (ordered or not self.full()) and all(self.heap[i][1] == k for k, i in self.slot.items()) and self.value.keys() == self.slot.keys()

    def items(self) -> list[tuple]:
        """(key, value), heaviest value first."""
        return sorted(self.value.items(), key=lambda x: (-abs(x[1]), x[0]))

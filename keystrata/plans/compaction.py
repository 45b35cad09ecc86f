"""Compaction plans: which runs to merge next, decided from run metadata alone.

Run metadata is one row for each file. Sizes by level are aggregated in Spark, the decision is taken on the few rows
that remain: one for each level.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MB = 1024 * 1024


@dataclass(frozen=True)
class Task:
    """Merge ``upper`` (runs of level ``upper_level``) and ``lower`` into ``lower_level``; ``bottom`` if nothing lies below."""

    upper_level: int
    upper: tuple[int, ...]
    lower_level: int
    lower: tuple[int, ...]
    bottom: bool

    @property
    def inputs(self) -> tuple[int, ...]:
        """All runs merged, newest first."""
        return self.upper + self.lower


class Strategy(Protocol):
    def plan(self, runs: DataFrame) -> Task | None: ...

    def flush_level(self) -> int: ...


def _ids(runs: DataFrame, condition) -> tuple[int, ...]:
    """Run ids from the newest to the oldest: by level, then by ``prio``."""
    return tuple(r["run_id"] for r in runs.where(condition).orderBy("level", "prio", F.desc("run_id")).select("run_id").collect())


def level_sizes(runs: DataFrame) -> dict[int, tuple[int, int]]:
    """level -> (files, bytes)."""
    rows = runs.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).collect()
    return {r["level"]: (r["files"], r["bytes"]) for r in rows}


def overlapping_ids(runs: DataFrame, chosen: tuple[int, ...], level: int) -> tuple[int, ...]:
    """Runs of ``level`` whose key range meets the range that the chosen runs span."""
    span = runs.where(F.col("run_id").isin(list(chosen))).agg(F.min("first_key"), F.max("last_key")).first()
    if span[0] is None:
        return ()
    return _ids(runs, (F.col("level") == level) & (F.col("last_key") >= span[0]) & (F.col("first_key") <= span[1]))


@dataclass(frozen=True)
class SimpleLeveled:
    """Merge two whole levels when the lower has too few files for the upper; sizes are numbers of files."""

    size_ratio_percent: int = 200
    l0_trigger: int = 2
    max_levels: int = 4

    def flush_level(self) -> int:
        return 0

    def plan(self, runs: DataFrame) -> Task | None:
        files = {k: v[0] for k, v in level_sizes(runs).items()}
        for level in range(self.max_levels):
            above, below = files.get(level, 0), files.get(level + 1, 0)
            if level == 0 and above < self.l0_trigger or not above:
                continue
            if below * 100 < self.size_ratio_percent * above:
                own = F.col("level")
                return Task(level, _ids(runs, own == level), level + 1, _ids(runs, own == level + 1), level + 1 == self.max_levels)
        return None


@dataclass(frozen=True)
class Leveled:
    """Levels with target sizes in bytes; the fullest level gives its oldest run to the next."""

    multiplier: int = 2
    l0_trigger: int = 4
    max_levels: int = 4
    base_mb: int = 128

    def flush_level(self) -> int:
        return 0

    def targets(self, sizes: dict[int, tuple[int, int]]) -> tuple[dict[int, int], int]:
        """Target bytes of every level, and the base level: the first with a target."""
        base = self.base_mb * MB
        target = {self.max_levels: max(sizes.get(self.max_levels, (0, 0))[1], base)}
        for level in range(self.max_levels - 1, 0, -1):
            target[level] = target[level + 1] // self.multiplier if target[level + 1] > base else 0
        return target, min(level for level, t in target.items() if t > 0)

    def plan(self, runs: DataFrame) -> Task | None:
        sizes = level_sizes(runs)
        if sizes.get(0, (0, 0))[0] >= self.l0_trigger:
            base = self.targets(sizes)[1]
            upper = _ids(runs, F.col("level") == 0)
            return Task(0, upper, base, overlapping_ids(runs, upper, base), base == self.max_levels)
        return self.pick(runs, sizes)

    def pick(self, runs: DataFrame, sizes: dict[int, tuple[int, int]] | None = None) -> Task | None:
        """The oldest run of the fullest level from 1 on, whatever level 0 holds."""
        sizes = level_sizes(runs) if sizes is None else sizes
        target, _ = self.targets(sizes)
        full = []
        for level in range(1, self.max_levels):
            real = sizes.get(level, (0, 0))[1]
            if real > target[level]:
                full.append((real / target[level] if target[level] else float("inf"), -level))
        if not full:
            return None
        level = -max(full)[1]
        oldest = runs.where(F.col("level") == level).agg(F.min("run_id")).first()[0]
        return Task(level, (oldest,), level + 1, overlapping_ids(runs, (oldest,), level + 1), level + 1 == self.max_levels)


@dataclass(frozen=True)
class Tiered:
    """Whole tiers merge into one; level numbers are tiers, the newest first, and sizes are numbers of files."""

    num_tiers: int = 3
    max_amplification_percent: int = 200
    size_ratio: int = 1
    min_merge_width: int = 2

    def flush_level(self) -> int:
        return 1

    def plan(self, runs: DataFrame) -> Task | None:
        sizes = level_sizes(runs)
        tiers = sorted(sizes)
        files = [sizes[t][0] for t in tiers]
        if len(tiers) < self.num_tiers:
            return None
        take = self._width(files)
        chosen = tiers[:take]
        return Task(chosen[0], _ids(runs, F.col("level").isin(chosen)), chosen[-1], (), take >= len(tiers))

    def _width(self, files: list[int]) -> int:
        """How many of the newest tiers to merge."""
        if sum(files[:-1]) * 100 >= self.max_amplification_percent * files[-1]:
            return len(files)
        total = 0
        for i in range(len(files) - 1):
            total += files[i]
            if total * 100 >= (100 + self.size_ratio) * files[i + 1] and i + 2 >= self.min_merge_width:
                return i + 2
        return min(len(files) - self.num_tiers + 2, len(files))


@dataclass(frozen=True)
class NoCompaction:
    """Never merges by itself; a full compaction can be asked for."""

    unused: tuple = field(default=())

    def flush_level(self) -> int:
        return 0

    def plan(self, runs: DataFrame) -> Task | None:
        return None


def full(runs: DataFrame) -> Task:
    """All runs into level 1."""
    return Task(0, _ids(runs, F.col("level") <= 0), 1, _ids(runs, F.col("level") >= 1), True)

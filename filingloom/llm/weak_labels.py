"""Expectation-maximisation over votes of heuristic labellers (1 good, 0 bad, null abstains)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VoteModel:
    """P(vote is bad | class, the rule votes) of each rule, and the share of good rows."""

    names: tuple[str, ...]
    prior_good: float
    bad_if_good: tuple[float, ...]
    bad_if_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds for good that a good and a bad vote of each rule add."""
        return [
            (math.log((1 - g) / (1 - b)), math.log(g / b))
            for g, b in zip(self.bad_if_good, self.bad_if_bad, strict=True)
        ]

    def log_odds(self, votes: list[int | None]) -> float:
        total = math.log(self.prior_good / (1 - self.prior_good))
        for vote, (good, bad) in zip(votes, self.weights(), strict=True):
            if vote is not None:
                total += good if vote else bad
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability of good as an expression over vote columns."""
        total = F.lit(math.log(self.prior_good / (1 - self.prior_good)))
        for name, (good, bad) in zip(self.names, self.weights(), strict=True):
            v = votes[name]
            total = total + F.when(v == 1, F.lit(good)).when(v == 0, F.lit(bad)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_patterns(
    names: tuple[str, ...], patterns: list[tuple[list[int | None], int]], rounds: int = 60, smooth: float = 1.0, max_false: float = 0.005,
    found: tuple[float, float] = (0.1, 0.5),
) -> VoteModel:
    """EM over (votes, count) patterns.

    It starts from rows with any bad vote as probably bad. A rule is taken to
    vote bad on at most ``max_false`` of the good rows, so classes can't swap
    and a kind of junk that one rule finds isn't explained away as good. Kinds of
    junk differ, so a rule is taken to find a share of the bad rows within
    ``found``: the good votes of rules for other kinds don't acquit a row, and in
    a small table a rare kind's rule keeps its say.
    An empty input gives the neutral model.
    """
    good = [0.05 if any(v == 0 for v in votes) else 0.95 for votes, _ in patterns]
    k = len(names)
    model = VoteModel(names, 0.5, (0.1,) * k, (0.5,) * k)
    for _ in range(rounds if patterns else 0):
        total = sum(c for _, c in patterns)
        n_good = sum(q * c for q, (_, c) in zip(good, patterns, strict=True))
        if_good, if_bad = [], []
        for j in range(k):
            sums = {(s, v): 0.0 for s in (0, 1) for v in (0, 1)}
            for q, (votes, c) in zip(good, patterns, strict=True):
                if votes[j] is not None:
                    sums[1, votes[j]] += q * c
                    sums[0, votes[j]] += (1 - q) * c
            g = (sums[1, 0] + smooth) / (sums[1, 0] + sums[1, 1] + 10 * smooth)
            b = (sums[0, 0] + smooth) / (sums[0, 0] + sums[0, 1] + 2 * smooth)
            g = min(g, max_false)
            if_good.append(g)
            if_bad.append(min(max(b, found[0]), found[1]))
        prior = min(max((n_good + smooth) / (total + 2 * smooth), 1e-3), 1 - 1e-3)
        model = VoteModel(names, prior, tuple(if_good), tuple(if_bad))
        new = [1 / (1 + math.exp(min(60.0, max(-60.0, -model.log_odds(votes))))) for votes, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(new, good, strict=True))
        good = new
        if moved < 1e-9:
            break
    return model


def fit(votes: DataFrame, names: tuple[str, ...], **settings) -> VoteModel:
    """Fit on all rows: at most 3 ** len(names) vote patterns with their counts reach the driver."""
    found = votes.groupBy(*names).agg(F.count("*").alias("_n")).collect()
    found = sorted(found, key=lambda r: tuple(-1 if r[n] is None else r[n] for n in names))
    return fit_patterns(names, [([r[n] for n in names], r["_n"]) for r in found], **settings)

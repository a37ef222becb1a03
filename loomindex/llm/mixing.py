"""Mixing sources to target weights by Poisson replication.

Each record's number of copies is a Poisson variable, found by inverting its distribution at a uniform
number that is a hash of the seed and the record's id, so that the mix is the same on any cluster and a
record's copies do not depend on which other records there are. The mean is chosen
per source so that the expected number of copies, cut off at the source's ``max_repeats``, is the rate
that its target share needs; a source at its limit gives every record exactly that often. Copies get a
hashed position that orders the whole mix: a global shuffle.

Scale: counts are column expressions on the scanned rows, per-source facts are one row per target; the
only shuffle of records is the one for the global order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_below(mean: float, most: int) -> list[float]:
    """P(N <= k) for k = 0 .. most - 1."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(most):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return out


def capped_mean(mean: float, most: int) -> float:
    """E[min(N, most)] = sum of P(N > k) for k < most."""
    return sum(1 - p for p in poisson_below(mean, most))


def mean_for_rate(rate: float, most: int) -> float:
    """The Poisson mean with which records are repeated ``rate`` times on average under the cut-off."""
    if rate >= most:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, most) < rate and high < 700:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, most) < rate else (low, middle)
    return high


def _uniform(*columns: Column) -> Column:
    """Uniform in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


class Mix:
    """The mix of ``sizes`` (doc_id, source, tokens) by ``targets`` (source, target_share, max_repeats).

    Without ``total_tokens`` the mix is as large as it can be with every share reached. With it, a source
    that would need more than ``max_repeats`` gives what it has, and the report shows the lower share.
    Shares of targets without tokens are spread over the others in proportion. Sources without target,
    null sources, and targets whose share or limit is null or not positive give nothing; empty tables
    give an empty mix.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17):
        good = targets.filter("source is not null and target_share > 0 and max_repeats > 0")
        good = good.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        there = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        # One row per target.
        rows = good.join(there, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
        usable = [r for r in rows if r.tokens > 0]
        whole = sum(r.target_share for r in usable)
        reach = min((r.max_repeats * r.tokens / (r.target_share / whole) for r in usable), default=0.0)
        total = reach if total_tokens is None else total_tokens
        self.facts = []
        for r in rows:
            share = r.target_share / whole if r.tokens else 0.0
            rate = float(min(share * total / r.tokens, r.max_repeats)) if r.tokens else 0.0
            mean = mean_for_rate(rate, r.max_repeats)
            below = [0.0] * r.max_repeats if math.isinf(mean) else poisson_below(mean, r.max_repeats)
            self.facts.append((r.source, float(r.target_share), share, r.max_repeats, int(r.tokens), rate, below, share * total))
        self.sizes, self.seed = sizes, seed
        schema = "source string, target_share double, wanted_share double, max_repeats int, source_tokens bigint, rate double, below array<double>, wanted_tokens double"
        self.table = sizes.sparkSession.createDataFrame(self.facts, schema)

    def records(self) -> DataFrame:
        """(position, doc_id, copy, source, tokens), one row per copy, in the order of position."""
        facts = F.broadcast(self.table.filter("rate > 0").select("source", "below"))  # one row per target
        drawn = self.sizes.join(facts, "source").withColumn("u", _uniform(F.lit(self.seed), F.col("doc_id")))
        drawn = drawn.withColumn("copies", F.size(F.filter("below", lambda p: p <= F.col("u")))).filter("copies > 0")
        out = drawn.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "tokens")
        return out.select(F.xxhash64(F.lit(self.seed + 1), "doc_id", "copy").alias("position"), "doc_id", "copy", "source", "tokens")

    def shuffled(self) -> DataFrame:
        return self.records().orderBy("position", "doc_id", "copy")

    def report(self) -> DataFrame:
        """Per target: target share, share wanted after spreading missing sources, share reached, how often it is used, and the tokens it falls short of what was wanted."""
        used = self.records().groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("most_copies"))
        total = used.agg(F.sum("tokens").alias("all_tokens"))
        # Both sides have one row per target at most.
        joined = self.table.join(used, "source", "left").select("*", F.lit(1).alias("one")).join(total.withColumn("one", F.lit(1)), "one", "left")
        return joined.select(
            "source",
            "target_share",
            F.round("wanted_share", 6).alias("wanted_share"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            "source_tokens",
            F.when(F.col("source_tokens") > 0, F.round(F.coalesce("tokens", F.lit(0)) / F.col("source_tokens"), 6)).alias("repeats"),
            "max_repeats",
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.round(F.greatest(F.col("wanted_tokens") - F.coalesce("tokens", F.lit(0)), F.lit(0.0)), 1).alias("shortfall"),
        )

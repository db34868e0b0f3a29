"""Mixing sources to target shares by Poisson replication.

Each document draws a number from a hash of its id and a seed, and the inverse of a Poisson distribution turns it into the number
of its copies, never more than its source allows. The mean of the distribution is set for each source so that the source's tokens
reach its share of the largest total that all sources can serve.
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.skew import bounded_rows
from recordloom.session import checkpointed

BINS = 4096
_ENCODER: dict = {}


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public tokenizer's vocabulary as the box offers it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    if path not in _ENCODER:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _ENCODER[path] = tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER[path]


def token_counts(text: Column, vocabulary: str) -> Column:
    """Number of tokens of a text; 0 for null and empty. Special strings in a text are ordinary text."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(vocabulary)
        return pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def capped_poisson(u: float, mean: float, cap: int) -> int:
    """The inverse of the Poisson distribution at ``u``, at most ``cap``."""
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < cap:
        k += 1
        p *= mean / k
        total += p
    return k


def poisson_steps(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0 .. cap-1: a draw u has as many copies as there are steps at or below it."""
    p, total, steps = math.exp(-mean), 0.0, []
    for k in range(cap):
        total += p
        steps.append(total if mean < 700 else 0.0)
        p *= mean / (k + 1)
    return steps


def planned_means(histogram: dict[str, list[float]], shares: dict[str, float], caps: dict[str, int]) -> dict[str, tuple[float, float]]:
    """For each source its Poisson mean and planned tokens, from the tokens by source and bin of the draw.

    The total is the largest that no source's cap forbids: min over sources of tokens * cap / share. Means are found by bisection
    over the histogram; a source that must give all its copies has an infinite mean.
    """
    tokens = {s: sum(h) for s, h in histogram.items()}
    served = [s for s in shares if shares[s] > 0 and tokens.get(s, 0) > 0]
    if not served:
        return {}
    total = min(tokens[s] * caps[s] / shares[s] for s in served)
    out = {}
    for s in served:
        want = total * shares[s]
        if want >= tokens[s] * caps[s] * (1 - 1e-9):
            out[s] = (math.inf, want)
            continue
        low, high = 0.0, 1.0

        def gives(mean: float, s: str = s) -> float:
            steps = poisson_steps(mean, caps[s])
            return sum(t * sum(1 for x in steps if x <= (k + 0.5) / BINS) for k, t in enumerate(histogram[s]) if t)

        while gives(high) < want and high < 700:
            high *= 2
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if gives(middle) < want else (low, middle)
        out[s] = (high, want)
    return out


def mixed(docs: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 17, source_limit: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(copies, shares). ``docs``: doc_id, source, text; ``targets``: source, target_share, max_repeats (a fixed list).

    copies: doc_id, source, copy_no, n_tokens in a globally random order (by hash). shares: source, target_share, max_repeats,
    n_docs, n_tokens (once each), n_copies, mixed_tokens, actual_share, most_copies. Documents of sources without a target, and
    sources with a share of zero, give no copy. Repeated doc_id draw the same number. Only BINS sums of tokens for each source of
    ``targets`` reach the driver.
    """
    goals = {r.source: r for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), source_limit, "the list of sources")}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sized = checkpointed(docs.where(F.col("source").isin(*goals)).select("doc_id", "source", token_counts(F.col("text"), vocabulary).alias("n_tokens"), draw.alias("u")))  # the tokens are counted once
    bins = sized.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("tokens"))
    histogram: dict[str, list[float]] = {s: [0.0] * BINS for s in goals}
    for r in bins.collect():  # at most BINS rows for each source of the list
        histogram[r.source][r.bin] += r.tokens or 0
    means = planned_means(histogram, {s: g.target_share for s, g in goals.items()}, {s: g.max_repeats for s, g in goals.items()})
    plan = docs.sparkSession.createDataFrame(
        [(s, float(g.target_share), int(g.max_repeats), poisson_steps(min(means.get(s, (0.0, 0.0))[0], 1e6), int(g.max_repeats)) if s in means else [2.0] * int(g.max_repeats)) for s, g in goals.items()],
        "source string, target_share double, max_repeats int, steps array<double>",
    )
    counted = sized.join(F.broadcast(plan), "source").withColumn("n_copies", F.size(F.filter("steps", lambda x: x <= F.floor(F.col("u") * BINS) / BINS + 0.5 / BINS)))
    copies = counted.where("n_copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    shuffled = copies.withColumn("_at", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")).sort("_at").select("doc_id", "source", "copy_no", "n_tokens")
    used = F.col("n_copies") * F.col("n_tokens")
    shares = counted.groupBy("source", "target_share", "max_repeats").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_copies").alias("n_copies"), F.sum(used).alias("mixed_tokens"), F.max("n_copies").alias("most_copies")
    )
    whole = shares.agg(F.sum("mixed_tokens").alias("whole"))  # one row
    shares = shares.join(F.broadcast(whole)).withColumn("actual_share", F.round(F.col("mixed_tokens") / F.col("whole"), 6)).drop("whole")
    return shuffled, shares

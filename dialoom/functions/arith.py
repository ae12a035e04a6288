"""Arithmetic of rewards, losses and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def combined_reward(profile: Column, task: Column, w_profile: float = 0.3, w_task: float = 0.7, task_only: bool = False) -> Column:
    """struct(total, failed): a weighted sum; any missing part fails and counts 0."""
    total = w_task * task if task_only else w_profile * profile + w_task * task
    return F.struct(F.coalesce(total, F.lit(0.0)).alias("total"), total.isNull().alias("failed"))


def clipped_loss(new: Column, old: Column, advantage: Column, eps: float = 0.2) -> Column:
    """Per token: -min(r A, clip(r) A) with r = exp(new - old)."""
    return F.transform(F.arrays_zip(new.alias("n"), old.alias("o")), lambda x: -F.least(F.exp(x["n"] - x["o"]) * advantage, F.greatest(F.lit(1 - eps), F.least(F.lit(1 + eps), F.exp(x["n"] - x["o"]))) * advantage))


def kl_terms(new: Column, ref: Column) -> Column:
    """Per token: exp(-d) + d - 1 with d = new - ref."""
    return F.zip_with(new, ref, lambda n, r: F.exp(r - n) + (n - r) - 1)


def masked_mean(values: Column, weights: Column) -> Column:
    """Sum of weighted values over the sum of weights, which counts as 1 at least."""
    zero = F.lit(0.0)
    total = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), zero, lambda a, x: a + x)
    return total / F.greatest(F.aggregate(weights, zero, lambda a, x: a + x), F.lit(1.0))


def learning_rate(step: Column, total: int, peak: float, floor: float, warmup: int) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, F.lit(peak) * step / F.lit(float(max(1, warmup)))).otherwise(F.lit(floor) + F.lit(0.5 * (peak - floor)) * (1 + F.cos(F.lit(math.pi) * progress)))


def left_truncated(prompt: Column, completion: Column, limit: int) -> Column:
    """struct(prompt, completion): the completion's tail, and as much of the prompt's tail as fits."""
    room = F.greatest(F.lit(0), limit - F.size(completion))
    tail = lambda a, n: F.when(n <= 0, F.slice(a, 1, 0)).when(F.size(a) <= n, a).otherwise(F.slice(a, -n, n))
    return F.struct(tail(prompt, room).alias("prompt"), tail(completion, F.lit(limit)).alias("completion"))


def aligned(prompt_len: Column, output: Column, advantage: Column) -> Column:
    """struct(weights, advantages): shifted by one, zero over the prompt."""
    zeros = F.array_repeat(F.lit(0.0), prompt_len - 1)
    return F.struct(F.concat(zeros, F.transform(output, lambda x: F.lit(1.0))).alias("weights"), F.concat(zeros, F.transform(output, lambda x: advantage)).alias("advantages"))


def steps(n_samples: Column, batch: int, epochs: int) -> Column:
    return (F.ceil(n_samples / batch) * epochs).cast("bigint")


def filled(values: Column) -> Column:
    """Missing log-probabilities as 0."""
    return F.transform(values, lambda x: F.coalesce(x, F.lit(0.0)))


def sft_datum(prompt: Column, completion: Column) -> Column:
    """struct(inputs, targets, weights): next-token pairs, weighted 0 in the prompt and 1 in the completion."""
    tokens = F.concat(prompt, completion)
    weights = F.concat(F.transform(prompt, lambda x: F.lit(0.0)), F.transform(completion, lambda x: F.lit(1.0)))
    n = F.size(tokens) - 1
    return F.struct(F.slice(tokens, 1, n).alias("inputs"), F.slice(tokens, 2, n).alias("targets"), F.slice(weights, 2, n).alias("weights"))

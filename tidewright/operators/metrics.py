"""Numeric operators: perplexity, schedules, top-k softmax and the small kernels of the models' inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import digest


def perplexity(df: DataFrame, loss: str, tokens: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n_tokens, loss (mean over tokens) and perplexity."""
    n = F.sum(tokens)
    mean = F.sum(F.col(loss) * F.col(tokens)) / n
    return df.groupBy(*by).agg(n.alias("n_tokens"), mean.alias("loss"), F.exp(mean).alias("perplexity"))


def mean_loss(df: DataFrame, loss: str, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """by, n (batches) and loss, the mean over batches whatever their tokens."""
    return df.groupBy(*by).agg(F.count(loss).alias("n"), F.avg(loss).alias("loss"))


def learning_rate(step: Column, peak: float, floor: float, warmup: int, decay: int) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    ratio = (step - warmup) / float(max(1, decay - warmup))
    cosine = floor + 0.5 * (1 + F.cos(F.lit(math.pi) * ratio)) * (peak - floor)
    return F.when(step < warmup, peak * (step + 1) / (warmup + 1)).when(step > decay, floor).otherwise(cosine)


def horizon(epochs: float, tokens: int, batch: int, block: int, accumulation: int = 1, most: int | None = None) -> int:
    """Steps for a number of epochs: rounded, one at least, ``most`` at most."""
    steps = max(1, round(epochs * tokens / (batch * block * accumulation)))
    return min(steps, most) if most else steps


def horizons(epochs: float, tokens: Column, batch: int, block: int, accumulation: int = 1, most: int | None = None) -> Column:
    """horizon() of a column of token counts."""
    steps = F.greatest(F.lit(1).cast("long"), F.bround(F.lit(epochs) * tokens / float(batch * block * accumulation)).cast("long"))
    return F.least(steps, F.lit(most).cast("long")) if most else steps


def draw(probabilities: Column, key: Column, seed: int) -> Column:
    """A place of an array of probabilities, drawn by a digest of ``key``: the first one up to which they sum to more than the draw.

    Rounding may leave the sum below 1; a draw beyond it takes the last place with a probability. Null for an empty array."""
    u = digest(key, seed) / float(1 << 48)
    step = lambda acc, p: F.struct((acc["sum"] + p).alias("sum"), (acc["at"] + 1).alias("at"), F.when((p > 0) & ~acc["done"], acc["at"]).otherwise(acc["place"]).alias("place"), (acc["done"] | (acc["sum"] + p > u)).alias("done"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("place"), F.lit(False).alias("done"))
    return F.aggregate(probabilities, start, step, lambda acc: acc["place"])


def until_end(ids: Column, end: int) -> Column:
    """Ids before the first end token, all of them if there is none."""
    return F.when(F.array_contains(ids, end), F.slice(ids, 1, F.array_position(ids, end).cast("int") - 1)).otherwise(ids)


def top_k_softmax(values: Column, k: int, temperature: float = 1.0) -> Column:
    """Softmax of an array with all below the k-th largest value at 0; ties with the k-th stay."""
    scaled = F.transform(values, lambda v: v.cast("double") / temperature)

    def soft(a: Column) -> Column:
        top, cut = F.array_max(a), F.element_at(F.sort_array(a, False), F.least(F.lit(k), F.size(a)))
        e = F.transform(a, lambda v: F.when(v >= cut, F.exp(v - top)).otherwise(0.0))
        return F.element_at(F.transform(F.array(e), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, y: s + y))), 1)

    return F.element_at(F.transform(F.array(scaled), soft), 1)


def rms_norm(values: Column, eps: float = 1e-5) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.element_at(F.transform(F.array(F.sqrt(squares / F.size(values) + eps)), lambda r: F.transform(values, lambda v: v.cast("double") / r)), 1)


def rotary(positions: DataFrame, dim: int, base: float = 10_000.0) -> DataFrame:
    """id, pair, cos, sin of the rotary table for each position (id) and pair of dimensions."""
    angle = F.col("id") / F.pow(F.lit(base), 2.0 * F.col("pair") / dim)
    return positions.select("id", F.explode(F.sequence(F.lit(0), F.lit(dim // 2 - 1))).alias("pair")).select("id", "pair", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def count_label(n: Column) -> Column:
    """A count with B, M or K, one digit, as model sizes are named."""
    f = lambda d, s: F.concat(F.format_string("%.1f", n / d), F.lit(s))
    return F.when(n >= 1e9, f(1e9, "B")).when(n >= 1e6, f(1e6, "M")).when(n >= 1e3, f(1e3, "K")).otherwise(n.cast("string"))


def best_so_far(df: DataFrame, step: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The least value up to each step; one run's steps are one group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(value).over(w))

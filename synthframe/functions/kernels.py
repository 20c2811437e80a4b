"""Small numeric kernels of generative models: noise schedules on the driver, densities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_betas(steps: int) -> list[float]:
    """Noise variances rising evenly from 1e-4 to 0.02, both scaled by 1000 / steps."""
    scale = 1000 / steps
    low, high = scale * 1e-4, scale * 0.02
    return [low + (high - low) * k / (steps - 1) for k in range(steps)] if steps > 1 else [low]


def cosine_betas(steps: int, shift: float = 0.008, most: float = 0.999) -> list[float]:
    """1 - a(t + 1) / a(t) for the squared-cosine signal level a, capped."""

    def level(t: float) -> float:
        return math.cos((t + shift) / (1 + shift) * math.pi / 2) ** 2

    return [min(most, 1 - level((k + 1) / steps) / level(k / steps)) for k in range(steps)]


def sigma_grid(steps: int, least: float = 0.002, most: float = 80.0, rho: float = 7.0) -> list[float]:
    """Noise levels from most to least, even in the rho-th root, and 0 at the end."""
    a, b = most ** (1 / rho), least ** (1 / rho)
    return [(a + k / max(steps - 1, 1) * (b - a)) ** rho for k in range(steps)] + [0.0]


def embedding_width(cardinality: int) -> int:
    return int(min(600, 1.6 * math.sqrt(cardinality)))


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b), without overflow."""
    m = F.greatest(a, b)
    return m + F.ln(F.exp(a - m) + F.exp(b - m))


def log_one_minus_exp(a: Column) -> Column:
    """ln(1 - e^a) of a negative a; a floor keeps it finite at 0."""
    return F.ln(1 - F.exp(a) + F.lit(1e-40))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of e^x over an array."""
    m = F.array_max(values)
    return m + F.ln(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def log_one_hot(index: Column, size: int, floor: float = 1e-30) -> Column:
    """Array of ln(one-hot), with a floor for the zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == index, F.lit(0.0)).otherwise(F.lit(math.log(floor))))


def argmax(values: Column) -> Column:
    """0-based index of the (first) maximum of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def softmax(values: Column) -> Column:
    total = log_sum_exp(values)
    return F.transform(values, lambda x: F.exp(x - total))


def normal_kl(mean_1: Column, log_var_1: Column, mean_2: Column, log_var_2: Column) -> Column:
    """Kullback-Leibler divergence of two normals from means and log variances."""
    return 0.5 * (log_var_2 - log_var_1 - 1.0 + F.exp(log_var_1 - log_var_2) + F.pow(mean_1 - mean_2, 2) * F.exp(-log_var_2))


def tanh_normal_cdf(x: Column) -> Column:
    """The normal distribution function's tanh approximation."""
    return 0.5 * (1 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * F.pow(x, 3))))

"""Noise that is a function of a seed and a row's key, so a task that runs again adds the same; each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *key: Column) -> Column:
    """In (0, 1), from 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key])), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def uniform_sql(seed: str, *key: str) -> str:
    return f"((CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def laplace(u: Column, scale: float) -> Column:
    """The inverse distribution function at u."""
    return -F.lit(scale) * F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5))


def laplace_sql(u: str, scale: float) -> str:
    return f"(-{float(scale)!r} * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


def noisy_count(value: Column, u: Column, epsilon: float, sensitivity: float = 1.0) -> Column:
    """Rounded half to even, not below zero."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return F.greatest(F.lit(0), F.bround(value + laplace(u, sensitivity / epsilon), 0)).cast("bigint")


def noisy_count_sql(value: str, u: str, epsilon: float, sensitivity: float = 1.0) -> str:
    return f"CAST(greatest(0, round_even({value} + {laplace_sql(u, sensitivity / epsilon)}, 0)) AS BIGINT)"


def truth_share(epsilon: float) -> float:
    """How often a randomized response is true."""
    return math.exp(epsilon) / (1 + math.exp(epsilon))


def response(value: Column, u: Column, epsilon: float) -> Column:
    return F.when(u < truth_share(epsilon), value).otherwise(~value)


def response_sql(value: str, u: str, epsilon: float) -> str:
    return f"CASE WHEN {u} < {truth_share(epsilon)!r} THEN {value} ELSE NOT ({value}) END"

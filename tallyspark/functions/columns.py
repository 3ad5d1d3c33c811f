"""Column expressions: all of them compile to built-in Spark expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chance to play by status, exact names first, then parts of compound ones in this order.
STATUS_PROBABILITY = (
    ("OUT", 0.0), ("OUT FOR SEASON", 0.0), ("OUT INDEFINITELY", 0.0), ("SUSPENDED", 0.0), ("DOUBTFUL", 0.25), ("QUESTIONABLE", 0.5), ("GTD", 0.5),
    ("GAME TIME DECISION", 0.5), ("DAY-TO-DAY", 0.5), ("DAY TO DAY", 0.5), ("PROBABLE", 0.85), ("AVAILABLE", 1.0), ("ACTIVE", 1.0),
)
UNKNOWN_STATUS = 0.7
#: Of the error function's rational approximation (absolute error under 1.5e-7).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def fixed(c: Column, scale: float = 1e6) -> Column:
    """A double as a whole number of millionths, for comparison between engines whose sums differ in the last bits."""
    return F.floor(c * F.lit(scale) + F.lit(0.37)).cast("long")


def clip(c: Column, low=None, high=None) -> Column:
    """c within bounds, which may be columns; null stays null."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    return F.when(c.isNotNull(), out)


def ratio(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    return a / (b + F.lit(epsilon))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: infinite or NaN where b is 0, in ANSI mode too."""
    by_zero = F.when(a > 0, F.when(F.isnan(a), a).otherwise(float("inf"))).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, by_zero).otherwise(a / b)


def number(c: Column) -> Column:
    """The number that a text holds, null if it holds none."""
    return F.expr("1") * c.try_cast("double")


def finite(c: Column, value: float = 0.0) -> Column:
    """c with nulls, NaN and infinities replaced."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(value)).otherwise(c)


def minutes(text: Column) -> Column:
    """mm:ss or a plain number of minutes, within 0 and 60; null for anything else."""
    t = F.trim(text)
    colon = F.split_part(t, F.lit(":"), F.lit(1)).try_cast("double") + F.split_part(t, F.lit(":"), F.lit(2)).try_cast("double") / 60
    plain = F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    return clip(F.when(t.rlike(r"^[0-9]+:[0-9]+$"), colon).otherwise(plain), 0.0, 60.0)


def first_positive(*chain: Column, default: float) -> Column:
    """The first value above 0 of a chain, else the default."""
    return F.coalesce(*[F.when(c > 0, c) for c in chain], F.lit(default))


def ladder(*steps: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first step whose condition holds."""
    (test, value), *rest = steps
    out = F.when(test, F.lit(value) if not isinstance(value, Column) else value)
    for test, value in rest:
        out = out.when(test, F.lit(value) if not isinstance(value, Column) else value)
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def status_probability(status: Column) -> Column:
    s = F.upper(F.trim(status))
    exact = [(s == name, p) for name, p in STATUS_PROBABILITY]
    partial = [(s.contains(name), p) for name, p in STATUS_PROBABILITY]
    return ladder(*exact, *partial, otherwise=UNKNOWN_STATUS)


def position(reb: Column, ast: Column, blk: Column) -> Column:
    return ladder(((reb >= 8) & (blk >= 1.5), "C"), (reb >= 7, "PF"), (ast >= 6, "PG"), (ast >= 3, "SG"), otherwise="SF")


def rest_multiplier(rest: Column, three_in_four: Column, back_to_back: Column) -> Column:
    return ladder((three_in_four, 0.96), (back_to_back, 0.975), (rest == 2, 1.0), (rest == 3, 1.01), (rest >= 4, 1.005), otherwise=1.0)


def recommendation(p_over: Column) -> Column:
    edge = F.abs(p_over - 0.5)
    side = F.when(p_over > 0.5, F.lit("OVER")).otherwise(F.lit("UNDER"))
    return F.when(edge > 0.15, F.concat(F.lit("STRONG "), side)).when(edge > 0.05, side).otherwise(F.lit("PASS"))


def confidence(count: Column) -> Column:
    return ladder((count >= 20, 1.0), (count >= 10, 0.95), (count >= 5, 0.85), (count >= 1, 0.7), otherwise=0.5)


def rank_text(rank: Column) -> Column:
    return ladder((rank <= 5, "elite"), (rank <= 10, "good"), (rank <= 20, "average"), (rank <= 25, "poor"), otherwise="weak")


def season_label(day: Column) -> Column:
    """2024-25 for October 2024 to September 2025."""
    first = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def fourier(day: Column, k: int) -> tuple[Column, Column]:
    angle = F.dayofyear(day) * F.lit(2 * math.pi * k / 365)
    return F.sin(angle), F.cos(angle)


def norm_cdf(z: Column) -> Column:
    p, *a = ERF
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = reduce(lambda acc, k: acc * t + F.lit(k), reversed(a[:-1]), F.lit(a[-1])) * t
    half = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


def norm_cdf_sql(z: str) -> str:
    p, *a = ERF
    x = f"(abs({z})/{math.sqrt(2)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE/(1.0+{p!r}::DOUBLE*{x}))"
    poly = repr(a[-1]) + "::DOUBLE"
    for k in reversed(a[:-1]):
        poly = f"({poly}*{t}+{k!r}::DOUBLE)"
    half = f"(0.5::DOUBLE*{poly}*{t}*exp(-{x}*{x}))"
    return f"(CASE WHEN ({z})>=0 THEN 1.0-{half} ELSE {half} END)"


def uniform(*key) -> Column:
    """A number in (0, 1) that depends on the key alone, the same in any engine with md5."""
    parts = [F.lit(k) if not isinstance(k, Column) else k.cast("string") for k in key]
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(*key) -> Column:
    """A standard normal draw that depends on the key alone (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(*key, "r"))) * F.cos(F.lit(2 * math.pi) * uniform(*key, "a"))


def uniform_sql(*key: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"((CAST(('0x'||substr(md5(concat_ws('|', {parts})),1,13)) AS BIGINT)::DOUBLE + 0.5)/{float(1 << 52)!r}::DOUBLE)"


def normal_sql(*key: str) -> str:
    r, a = "'r'", "'a'"
    return f"(sqrt(-2.0::DOUBLE*ln({uniform_sql(*key, r)}))*cos({2 * math.pi!r}::DOUBLE*{uniform_sql(*key, a)}))"


def fixed_sql(e: str) -> str:
    return f"CAST(floor(({e})*1e6::DOUBLE+0.37::DOUBLE) AS BIGINT)"

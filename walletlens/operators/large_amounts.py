"""Sums of amounts of any size, exact whatever their order (A1, A2, P5).

``numbers.exact_sum`` adds up money in decimals and leaves out amounts of ``LARGE`` and more, which no fixed
number of digits can hold beside cents. Groups that hold such an amount are summed anew here, all their
amounts as the binary numbers they are: each is cut into whole numbers of 32 bits at fixed places, one place
per power of 2^32, sums per (group, place) are combined before the shuffle, and the at most ``PLACES`` sums of
a group are rounded once. The result is that of ``math.fsum``.

Whether there are any is asked first by a filter on the amount alone, which the statistics of Parquet files
answer without reading rows: a table without large amounts pays for its footers and keeps its plan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from walletlens.functions.numbers import LARGE

#: Bits of a place, and the weight of the first: finite doubles are multiples of 2^-1074.
PLACE_BITS, LOWEST = 32, -1088
#: Places that hold the digits of a double of any size, and those that one double touches.
PLACES, TOUCHED = 67, 3


def is_large(amount: Column) -> Column:
    """Amounts that ``exact_sum`` leaves out, NaN and infinities among them; reaches a Parquet scan as a filter."""
    return (amount >= LARGE) | (amount <= -LARGE)


def large_groups(t: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys with an amount that is large."""
    return t.filter(is_large(F.col("amount"))).select(*keys).distinct()


def _scaled(x: Column, power: Column) -> Column:
    """x times a power of two, in two exact steps, as one factor might be beyond a double."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def _digits(x: Column) -> Column:
    """The parts (place, digit) of a finite double: whole numbers below 2^34 whose weighted sum is the double."""

    def parts(place: Column, scaled: Column) -> Column:
        rest, out = scaled, []
        for k in range(TOUCHED):
            digit = F.when(rest < 0, F.ceil(rest)).otherwise(F.floor(rest))
            out.append(F.struct((place - k).alias("place"), digit.cast("decimal(12,0)").alias("digit")))
            rest = (rest - digit) * float(1 << PLACE_BITS)
        return F.filter(F.array(*out), lambda part: part["digit"] != 0)

    # The logarithm may be off by one place's edge, which the first digit has room for.
    place = F.floor((F.log2(F.abs(x)) - LOWEST) / PLACE_BITS).cast("int")
    found = F.array(F.struct(place.alias("place"), _scaled(x, -(place * PLACE_BITS + LOWEST)).alias("scaled")))
    return F.flatten(F.transform(found, lambda v: parts(v["place"], v["scaled"])))


@F.arrow_udf(DoubleType())
def _rounded(places: pa.Array, digits: pa.Array) -> pa.Array:
    """The double nearest to a sum of digits at their places; infinite beyond the largest."""
    out = []
    for at, found in zip(places.to_pylist(), digits.to_pylist(), strict=True):
        total = sum(int(digit) << (PLACE_BITS * place) for place, digit in zip(at, found, strict=True))
        try:
            out.append(total / (1 << -LOWEST))
        except OverflowError:
            out.append(float("inf") if total > 0 else float("-inf"))
    return pa.array(out, pa.float64())


def float_sums(t: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group the sums of the named expressions over its rows, each rounded once; null where all are null.

    With a NaN or an infinity in it, a sum is what adding them up gives.
    """
    value = F.array(*[F.struct(F.lit(name).alias("sum_name"), x.cast("double").alias("x")) for name, x in sums.items()])
    rows = t.select(*keys, F.inline(value)).filter("x IS NOT NULL")
    finite = F.abs("x") < float("inf")
    parts = F.when(finite & (F.col("x") != 0), _digits(F.col("x")))
    parts = F.coalesce(parts, F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("decimal(12,0)").alias("digit"))))
    odd = F.when(~finite, F.col("x"))
    rows = rows.select(*keys, "sum_name", odd.alias("odd"), F.inline(parts))
    binned = rows.groupBy(*keys, "sum_name", "place").agg(F.sum("digit").alias("digit"), F.sum("odd").alias("odd"))
    whole = binned.groupBy(*keys, "sum_name").agg(
        F.collect_list("place").alias("places"), F.collect_list("digit").alias("digits"), F.sum("odd").alias("odd")
    )
    total = F.coalesce("odd", _rounded("places", "digits"))
    whole = whole.select(*keys, "sum_name", total.alias("total"))
    named = [F.max(F.when(F.col("sum_name") == name, F.col("total"))).alias(name) for name in sums]
    return whole.groupBy(*keys).agg(*named)


def has_large(t: DataFrame) -> bool:
    """Whether any amount is large: a job over the amounts alone, which skips row groups by their statistics."""
    return not t.filter(is_large(F.col("amount"))).isEmpty()


def corrected(totals: DataFrame, t: DataFrame, *parts: tuple[list[str], dict[str, Column]]) -> DataFrame:
    """``totals`` with sums taken anew in groups with a large amount.

    Each part names the keys of its groups and the columns of ``totals`` that sum these expressions over the
    rows of ``t``. Where no amount is large, which is asked first, the plan of ``totals`` stays as it is.
    """
    if not has_large(t):
        return totals
    for keys, sums in parts:
        found = float_sums(t.join(large_groups(t, keys), keys, "left_semi"), keys, sums)
        names = [*keys, *sums]
        anew = found.select(*[F.col(name).alias(f"large_{name}") for name in names])
        same = [F.col(key).eqNullSafe(F.col(f"large_{key}")) for key in keys]
        joined = totals.join(anew, same, "left")
        totals = joined.select(
            *[F.coalesce(f"large_{name}", name).alias(name) if name in sums else F.col(name) for name in totals.columns]
        )
    return totals

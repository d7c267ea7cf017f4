"""Number expressions: exact two-decimal rounding, lenient parsing, guarded ratios."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from walletlens.schema import MONEY

_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

# Up to here a double holds every whole number of cents.
_CENTS_EXACT_BELOW = 9.0e13
# Up to here the part before the point fits into 64 bits.
_WHOLE_BELOW = float(1 << 63)
_SPLITTER = float((1 << 27) + 1)


# From here on doubles are too far apart for four decimals; ``operators.large_amounts`` sums such amounts.
LARGE = float(1 << 39)


def exact_sum(amount: Column) -> Column:
    """Exact decimal sum of an amount column; sums of doubles would depend on the row order.

    An amount is a whole number of ten-thousandths plus what is left of it beyond four
    decimals (nothing, for money). Both are summed as whole numbers in parts of 20 bits, none of
    which overflows below 8e12 rows; that costs a fraction of summing decimals. The sum has
    eight decimals and may reach 1e22.
    Amounts of ``LARGE`` and more (in size), NaN and infinities are left out: ``large_amounts.corrected``
    takes the sums of their groups anew.
    """
    amount = F.when(F.abs(amount) < LARGE, amount)
    units = F.rint(amount * 10000.0)
    rest = F.rint((amount - units / 10000.0) * 1e12).cast("bigint")
    units = units.cast("bigint")
    bits = F.lit((1 << 20) - 1)
    high = F.sum(F.shiftright(units, 40)).cast("decimal(19,0)") * F.lit(Decimal(1 << 40))
    middle = F.sum(F.shiftright(units, 20).bitwiseAND(bits)).cast("decimal(19,0)") * F.lit(Decimal(1 << 20))
    low = F.sum(units.bitwiseAND(bits)).cast("decimal(19,0)")
    # Spark drops decimals of a sum that might need more than 38 digits, hence the narrower types.
    total = ((high + middle + low).cast("decimal(26,0)") * F.lit(Decimal("0.0001"))).cast("decimal(26,4)")
    beyond = F.sum(F.shiftright(rest, 20)).cast("decimal(19,0)") * F.lit(Decimal(1 << 20))
    beyond = (beyond + F.sum(rest.bitwiseAND(bits)).cast("decimal(19,0)")).cast("decimal(24,0)")
    beyond = (beyond * F.lit(Decimal("1E-12"))).cast("decimal(24,12)")
    return (total + beyond).cast(MONEY)


def no_money() -> Column:
    return F.lit(0).cast(MONEY)


def parse_amount(text: Column) -> Column:
    """P5: the text as a double; whatever is no number becomes 0.0, infinities stay."""
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(0.0))


def _cents(x: Column) -> Column:
    """The number of cents in x, rounded on its exact binary value, ties to the even cent.

    Spark's ``round`` and ``format_string`` round the shortest decimal text half up, which
    differs for values such as 0.125 or 2.675. Here the nearest whole number of cents is
    corrected by the exact product: x is split into two halves of 26 bits, whose multiples
    of 100 are exact, so the sign of what lies beyond half a cent is exact as well.
    """
    cents = F.rint(x * 100.0)
    high = x * _SPLITTER - (x * _SPLITTER - x)
    low = (x - high) * 100.0
    beyond = high * 100.0 - cents
    return (
        F.when((beyond - 0.5) + low > 0, cents + 1)
        .when((beyond + 0.5) + low < 0, cents - 1)
        .otherwise(cents)
    )


def round_cents(x: Column) -> Column:
    """the double that ``two_decimals`` reads as."""
    return F.when(F.abs(x) < _CENTS_EXACT_BELOW, _cents(x) / 100.0).otherwise(two_decimals(x).cast("double"))


def two_decimals(x: Column) -> Column:
    """the double as text with two decimals; what rounds to zero keeps its sign.

    The part before the point is cut off exactly, so the cents of the rest are rounded alike at
    every size. From 2^63 on the digits are Java's shortest ones, followed by zeros.
    """
    size = F.abs(x)
    whole = F.floor(size)
    cents = _cents(size - whole.cast("double")).cast("int")
    carried = F.when(cents == 100, whole + 1).otherwise(whole).cast("string")
    text = F.concat(F.when(x < 0, "-").otherwise(""), carried, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(size < _WHOLE_BELOW, text).otherwise(F.format_string("%.2f", x))


def share_percent(part: Column, total: Column) -> Column:
    """Part of total in percent; null unless the total is positive."""
    return F.when(total > 0, part / total * 100)


def ratio(part: Column, total: Column) -> Column:
    """part / total; null unless the total is positive."""
    return F.when(total > 0, part / total)

"""Exact arithmetic on decimal strings of up to 78 digits, by built-in functions.

A number is split into three limbs of 26 digits, each a decimal(38, 0): sums of limbs stay exact for about
10^12 rows of a group. Digits beyond a limb are carried by slicing the limb's text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS, LIMB = 78, 26
ZERO_ADDRESS = "0x" + "0" * 40


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def canonical(value: Column) -> Column:
    """Without leading zeros; at least one digit stays, and a sign."""
    return F.regexp_replace(F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")


def is_canonical(value: Column) -> Column:
    return value.rlike("^(0|[1-9][0-9]{0,77})$")


def is_nonzero(value: Column) -> Column:
    return value.rlike("[1-9]")


def is_negative(value: Column) -> Column:
    return value.startswith("-") & is_nonzero(value)


def magnitude(value: Column) -> Column:
    return F.regexp_replace(value, "^-", "")


def sort_key(value: Column) -> Column:
    """Text that sorts like the signed number."""
    digits = F.lpad(magnitude(value), DIGITS, "0")
    return F.when(is_negative(value), F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))


def limbs(value: Column) -> list[Column]:
    """High, middle and low limb of an unsigned number."""
    digits = F.lpad(magnitude(value), DIGITS, "0")
    return [F.substring(digits, 1 + LIMB * k, LIMB).cast("decimal(38,0)") for k in range(3)]


def joined(high: Column, middle: Column, low: Column) -> Column:
    """The canonical text of limbs that may each have up to 38 digits."""

    def padded(total: Column) -> Column:
        return F.lpad(total.cast("decimal(38,0)").cast("string"), 38, "0")

    def carry(text: Column) -> Column:
        return F.substring(text, 1, 38 - LIMB).cast("decimal(38,0)")

    def rest(text: Column) -> Column:
        return F.substring(text, 39 - LIMB, LIMB)

    def with_middle(low_text: Column) -> Column:
        return bound(padded(middle + carry(low_text)), lambda m: canonical(F.concat((high + carry(m)).cast("decimal(38,0)").cast("string"), rest(m), rest(low_text))))

    return bound(padded(low), with_middle)


def _limb_struct(value: Column) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(limbs(value), "hml", strict=True)))


def added(a: Column, b: Column) -> Column:
    """Sum of two unsigned numbers."""
    return bound(F.struct(_limb_struct(a).alias("a"), _limb_struct(b).alias("b")), lambda s: joined(*((s["a"][n] + s["b"][n]).cast("decimal(38,0)") for n in "hml")))


def _difference(a: Column, b: Column) -> Column:
    """a - b for a >= b."""
    base = F.lit("1" + "0" * LIMB).cast("decimal(38,0)")

    def up(x: Column) -> Column:
        return F.when(x < 0, x + base).otherwise(x).cast("decimal(38,0)")

    def minus(s: Column) -> Column:
        low = (s["a"]["l"] - s["b"]["l"]).cast("decimal(38,0)")
        middle = (s["a"]["m"] - s["b"]["m"] - F.when(low < 0, 1).otherwise(0)).cast("decimal(38,0)")
        return bound(middle, lambda m: joined((s["a"]["h"] - s["b"]["h"] - F.when(m < 0, 1).otherwise(0)).cast("decimal(38,0)"), up(m), up(low)))

    return bound(F.struct(_limb_struct(a).alias("a"), _limb_struct(b).alias("b")), minus)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for signed numbers."""
    ka, kb = sort_key(a), sort_key(b)
    return F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0)


def _pair(a: Column, b: Column, use) -> Column:
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: use(s["a"], s["b"]))


def subtracted(a: Column, b: Column) -> Column:
    """a - b, signed, of unsigned numbers."""
    return _pair(a, b, lambda x, y: F.when(compared(x, y) >= 0, _difference(x, y)).otherwise(F.concat(F.lit("-"), _difference(y, x))))


def saturating_sub(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: F.when(compared(x, y) >= 0, _difference(x, y)).otherwise(F.lit("0")))


def signed_added(a: Column, b: Column) -> Column:
    """Sum of two signed numbers."""

    def summed(x: Column, y: Column) -> Column:
        nx, ny, mx, my = is_negative(x), is_negative(y), magnitude(x), magnitude(y)
        return F.when(nx & ny, F.concat(F.lit("-"), added(mx, my))).when(nx, subtracted(my, mx)).when(ny, subtracted(mx, my)).otherwise(added(mx, my))

    return _pair(a, b, summed)


def total(value: Column) -> Column:
    """Aggregate: the exact sum of signed numbers; null without rows. Three sums of signed limbs; the sign is settled once."""
    sign = F.when(value.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    parts = F.struct(*(F.sum((x.cast("decimal(27,0)") * sign).cast("decimal(28,0)")).cast("decimal(38,0)").alias(n) for n, x in zip("hml", limbs(value), strict=True)))
    base = F.lit("1" + "0" * LIMB).cast("decimal(38,0)")

    def down(x: Column) -> Column:
        """x / base, rounded down, from the digits: a decimal quotient would be rounded."""
        digits = F.lpad(F.abs(x).cast("string"), 38, "0")
        high = F.substring(digits, 1, 38 - LIMB).cast("decimal(38,0)")
        return F.when(x < 0, -(high + (F.substring(digits, 39 - LIMB, LIMB) != "0" * LIMB).cast("int"))).otherwise(high).cast("decimal(38,0)")

    def settled(s: Column) -> Column:
        """The lower limbs from 0 to base; the highest has the sign."""

        def with_low(k: Column) -> Column:
            low, middle = (s["l"] - k * base).cast("decimal(38,0)"), (s["m"] + k).cast("decimal(38,0)")
            return bound(down(middle), lambda q: F.struct((s["h"] + q).cast("decimal(38,0)").alias("h"), (middle - q * base).cast("decimal(38,0)").alias("m"), low.alias("l")))

        return bound(down(s["l"]), with_low)

    def text(s: Column) -> Column:
        minus = F.struct(*((-s[n]).cast("decimal(38,0)").alias(n) for n in "hml"))
        shown = lambda n: joined(n["h"], n["m"], n["l"])
        return bound(settled(s), lambda n: F.when(n["h"] < 0, F.concat(F.lit("-"), bound(minus, lambda m: bound(settled(m), shown)))).otherwise(shown(n)))

    return F.when(F.count(value) > 0, bound(parts, text))


_PART = 15


def from_hex(word: Column) -> Column:
    """Decimal text of 64 hexadecimal digits, by built-in functions: four 64-bit parts times powers, in limbs of 15 digits."""
    short = F.conv(F.substring(word, 49, 16), 16, 10)

    def summed(parts: Column) -> Column:
        limbs_ = []
        for j in range(4):
            terms = [F.get(parts, F.lit(3 - k)) * F.lit(str((1 << 64 * k) // 10 ** (_PART * j) % (10**_PART if j < 3 else 10**38))).cast("decimal(15,0)") for k in range(4) if (1 << 64 * k) >= 10 ** (_PART * j)]
            limbs_.append(sum(terms[1:], terms[0]).cast("decimal(38,0)"))

        def carried(k: int, low: list[Column], over: Column | None) -> Column:
            total = limbs_[k] if over is None else (limbs_[k] + over).cast("decimal(38,0)")
            if k == 3:
                return canonical(F.concat(total.cast("string"), *low))
            return bound(F.lpad(total.cast("string"), 38, "0"), lambda t: carried(k + 1, [F.substring(t, 39 - _PART, _PART), *low], F.substring(t, 1, 38 - _PART).cast("decimal(38,0)")))

        return carried(0, [], None)

    parts = F.array(*(F.conv(F.substring(word, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)))
    return F.when(F.substring(word, 1, 48) == "0" * 48, short).otherwise(bound(parts, summed))


@F.pandas_udf(T.StringType())
def hex_to_decimal(values: pd.Series) -> pd.Series:
    """Decimal text of 0x-prefixed hexadecimal of any width; null stays null."""
    return values.map(lambda x: None if x is None else str(int(x, 16)))


@F.pandas_udf(T.StringType())
def decimal_to_hex(values: pd.Series) -> pd.Series:
    """Hexadecimal text, 0x-prefixed and without leading zeros, of decimal text of any width."""
    return values.map(lambda x: None if x is None else hex(int(x)))


def _variants(raw: str) -> list[str]:
    text = raw.strip().lower()
    try:
        number = int(text, 16) if text.startswith("0x") else int(text)
    except ValueError:
        return [text]
    return list(dict.fromkeys([text, str(number), hex(number)]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def proposal_id_variants(values: pd.Series) -> pd.Series:
    """The forms under which a proposal id may be stored: as given, decimal and hexadecimal."""
    return values.map(lambda x: None if x is None else _variants(x))


def compact_amount(value: Column, decimals: int = 18) -> Column:
    """The whole part of value / 10^decimals; a negative value below one is -0."""
    digits = magnitude(value)
    whole = F.when(F.length(digits) > decimals, F.substring(digits, F.lit(1), F.length(digits) - decimals)).otherwise(F.lit("0"))
    sign = F.when(is_negative(value), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole)

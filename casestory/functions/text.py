"""Column-level text helpers (all JVM-side expressions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def english_list(arr) -> Column:
    """T8: 'a' | 'a and b' | 'a, b, and c'."""
    a = _c(arr)
    n = F.size(a)
    return (F.when(n == 1, F.element_at(a, 1))
            .when(n == 2, F.array_join(a, " and "))
            .otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "),
                                F.lit(", and "), F.element_at(a, -1))))


def italian_list(arr) -> Column:
    """T5 list form: 'a e b' | 'a, b, e c'."""
    a = _c(arr)
    n = F.size(a)
    return (F.when(n == 1, F.element_at(a, 1))
            .when(n == 2, F.array_join(a, " e "))
            .otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "),
                                F.lit(", e "), F.element_at(a, -1))))


def capitalize_first(x) -> Column:
    """Upper-case the first character, leave the rest untouched ('' stays '')."""
    c = _c(x)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def shorten(x, n: int = 50) -> Column:
    """Cut labels longer than ``n`` characters and add '...'."""
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def thousands(n) -> Column:
    """Integer with ',' thousands separators (Python's ``f'{n:,}'``)."""
    return F.format_number(_c(n).cast("long"), 0)


def py_str(x) -> Column:
    """Text of a double as Python's ``str`` prints it.

    Spark's and Python's shortest digits agree, their notation does not: Spark turns to
    scientific notation below 1e-3 and from 1e7 on ("5.0E-4", "1.2345678E7"), Python below 1e-4
    and from 1e16 on ("5e-05", "1e+16"). The digits are re-set in Python's notation.
    """
    c = _c(x)
    s = c.cast("string")
    mant = F.substring_index(s, "E", 1)
    exp = F.substring_index(s, "E", -1).try_cast("int")  # null without an exponent, also where it is computed ahead of the tests
    sign = F.when(F.startswith(mant, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    m = F.regexp_replace(mant, "^-", "")
    digits = F.regexp_replace(m, "\\.", "")
    # 1e7 <= |x| < 1e16: digits shifted left by exp, padded with zeros
    frac_part = F.substring(digits, exp + 2, F.lit(64))
    large = F.concat(F.rpad(digits, exp + 1, "0"), F.lit("."), F.when(F.length(frac_part) == 0, F.lit("0")).otherwise(frac_part))
    # 1e-4 <= |x| < 1e-3: zeros before the digits, without a closing zero
    bare = F.regexp_replace(digits, "(?<=.)0+$", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), bare)
    # beyond: mantissa without ".0", exponent with a sign and two digits at least
    sci = F.concat(F.regexp_replace(m, "\\.0$", ""), F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
                   F.lpad(F.abs(exp).cast("string"), F.greatest(F.length(F.abs(exp).cast("string")), F.lit(2)), F.lit("0")))
    is_sci = F.contains(s, F.lit("E"))
    return (F.when(c.isNull(), F.lit(None))
            .when(is_sci & (exp >= 7) & (exp < 16), F.concat(sign, large))
            .when(is_sci & (exp == -4), F.concat(sign, small))
            .when(is_sci, F.concat(sign, sci))
            .otherwise(s))


def try_cast(x, typ: str) -> Column:
    """Cast that gives null instead of failing (ANSI mode)."""
    return _c(x).try_cast(typ)

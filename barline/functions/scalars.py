"""Scalar column expressions. All run inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN and infinities never leave an operator: undefined cells are NULL."""
    return F.when(~F.isnan(c), c)


def is_point(c: Column) -> Column:
    """True where a chart point has a numeric value."""
    return c.isNotNull() & ~F.isnan(c)


def safe(cond: Column) -> Column:
    """Three-valued condition to two-valued: unknown counts as False."""
    return F.coalesce(cond, F.lit(False))


def all_of(*conds: Column) -> Column:
    out = safe(conds[0])
    for c in conds[1:]:
        out = out & safe(c)
    return out


def any_of(*conds: Column) -> Column:
    out = safe(conds[0])
    for c in conds[1:]:
        out = out | safe(c)
    return out


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL for a zero denominator (also under ANSI mode)."""
    return num / F.nullif(den, F.lit(0.0))


def log_distance(a: Column, b: Column) -> Column:
    """ln(1 + (a-b)/b); NULL for b = 0 or a non-positive ratio, of which ``log1p`` makes NULL."""
    return F.log1p(ratio(a - b, b))


def clip_low(c: Column, floor: float = 0.0) -> Column:
    """Lower bound that keeps NULL as NULL (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


# Values closer than this, relative to the larger, count as equal. Band edges of evenly split
# windows meet the price exactly; without a tolerance the last bit of a sum would decide.
TIE = 1e-9


def relation(x: Column, y: Column) -> Column:
    """Sign of x - y: 1, 0 for a tie, -1; NULL if either is undefined."""
    gap = F.lit(TIE) * F.greatest(F.abs(x), F.abs(y))
    return F.when(F.abs(x - y) <= gap, F.lit(0.0)).otherwise(F.signum(x - y))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def js_round(c: Column) -> Column:
    """Rounding to whole numbers with ties going up, also for negatives (-2.5 -> -2)."""
    return F.floor(c + F.lit(0.5)).cast("double")


def epoch_seconds(d: Column) -> Column:
    """Of midnight UTC, whatever the session's zone."""
    return F.unix_date(d.cast("date")).cast("bigint") * 86400


def day_label(d: Column) -> Column:
    """dd/MM/yyyy, '-' where there is no date."""
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit("-"))


def iso_day(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def signed_percent(c: Column) -> Column:
    """Two decimals with the sign of the unrounded value: ``+1.25%``, ``-0.00%``."""
    sign = F.when(c >= 0, F.lit("+")).otherwise(F.lit("-"))
    return F.concat(sign, F.format_string("%.2f", F.abs(F.round(c, 2))), F.lit("%"))


def render_map(m: Column) -> Column:
    """``k: v, k: v`` in key order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "
    )


def normal_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str]:
    """(from, to) for ``translate``: each letter whose canonical decomposition is one base
    letter plus marks of U+0300..U+036F maps to the base; the marks themselves are dropped."""
    marks = {chr(i) for i in range(0x300, 0x370)}
    src, dst = [], []
    for i in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        ch = chr(i)
        if ch in marks or 0xD800 <= i < 0xE000:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] not in marks and set(parts[1:]) <= marks:
            src.append(ch)
            dst.append(parts[0])
    src += ["đ", "Đ"]
    dst += ["d", "D"]
    return "".join(src) + "".join(sorted(marks)), "".join(dst)


def strip_accents(c: Column) -> Column:
    """Remove diacritics, including the crossed d of Vietnamese."""
    src, dst = _accent_tables()
    return F.translate(c, src, dst)


def matches_text(term: str, *cols: Column) -> Column:
    """Case-insensitive containment in any column, with or without diacritics."""
    low = F.lower(F.lit(term))
    plain = strip_accents(low)
    tests = []
    for c in cols:
        lc = F.lower(c)
        tests.append(lc.contains(low))
        tests.append(strip_accents(lc).contains(plain))
    return any_of(*tests)


def _beta_series(x: Column, a: float, b: float, terms: int = 54) -> Column:
    """Regularised incomplete beta I_x(a, b) for 0 <= x <= 1/2 by its power series."""
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    coef, coefs = 1.0, []
    for k in range(terms):
        coefs.append(coef / (a + k))
        coef *= (1.0 - b + k) / (k + 1)
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return F.pow(x, F.lit(a)) * acc * F.lit(math.exp(-log_beta))


def student_t_balance(z2: Column, df: float) -> Column:
    """P(|T| <= |z|) of Student's t, given z² — that is, |2·CDF(z) − 1|.

    Equals I_x(1/2, df/2) with x = z²/(df+z²); the half of the unit interval nearer zero is
    always the one expanded, so the series converges at least like 2^-k.
    """
    x = z2 / (F.lit(df) + z2)
    y = F.lit(df) / (F.lit(df) + z2)
    low = F.least(x, y)
    small = _beta_series(low, 0.5, df / 2.0)
    large = F.lit(1.0) - _beta_series(low, df / 2.0, 0.5)
    return F.when(x <= 0.5, small).otherwise(large)


def exact_sum(amount: Column) -> Column:
    """Sum of amounts of money, each taken to 8 decimals, so that it does not depend on the order in which
    tasks finish. Where one is not finite or beyond 10^20, the plain sum of doubles."""
    exact = amount.try_cast("decimal(28,8)")
    whole = F.count(amount) == F.count(exact)
    return F.when(whole, F.sum(exact).cast("double")).otherwise(F.sum(amount))

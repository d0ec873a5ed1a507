"""Column expressions for cleaning, dates, keys and hashing. All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- amounts -----------------------------------------------------------------

def parse_amount(c) -> Column:
    """Amount text with thousands commas and blanks; a lone dash and a null are 0."""
    text = F.regexp_replace(col(c).cast("string"), "[, ]", "")
    return F.when(text.isNull() | (text == "-"), F.lit(0.0)).otherwise(text.cast("double"))


def signed_log(c) -> Column:
    return F.signum(col(c)) * F.ln(F.abs(col(c)))


def finite_or(c, default=None) -> Column:
    """Replace NaN and both infinities."""
    x = col(c)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def fixed_round(c, digits: int = 2) -> Column:
    """Round with the tie point moved off the decimal grid.

    Sums of doubles depend on the order of addition; a plain round at an exact
    half would then differ from run to run.
    """
    scale = 10**digits
    return F.floor(col(c) * F.lit(float(scale)) + F.lit(0.5013)) / F.lit(float(scale))


# --- keys --------------------------------------------------------------------

def key_year(c) -> Column:
    return F.substring(col(c).cast("string"), 1, 4)


def fund_coin(c) -> Column:
    """Fifth character of a fund code; null when the code is too short."""
    digit = F.substring(col(c), 5, 1)
    return F.when(digit != "", digit.cast("int"))


# --- dates -------------------------------------------------------------------

def month_end(year, month) -> Column:
    return F.last_day(F.make_date(col(year), col(month), F.lit(1)))


def month_end_of(date) -> Column:
    return F.last_day(col(date).cast("date"))


def day_first_date(c) -> Column:
    """Day-first dates with dot, slash or dash; unreadable text is null."""
    text = F.regexp_replace(col(c), "[/-]", ".")
    return F.try_to_timestamp(text, F.lit("d.M.yyyy")).cast("date")


def serial_day(c) -> Column:
    """Spreadsheet day number (day 0 is 1899-12-30)."""
    return F.date_add(F.lit("1899-12-30").cast("date"), col(c).cast("int"))


def compact_year(c) -> Column:
    return F.substring(col(c), 1, 4).cast("int")


def compact_month(c) -> Column:
    return F.substring(col(c), 5, 2).cast("int")


def absolute_month(year, month) -> Column:
    return col(year) * 12 + col(month)


def months_between_parts(year, month, from_year, from_month) -> Column:
    return (col(year) - col(from_year)) * 12 + (col(month) - col(from_month))


def relative_month(year, month, from_year, from_month) -> Column:
    """Months since the order, never below zero."""
    return F.greatest(months_between_parts(year, month, from_year, from_month), F.lit(0))


# --- binning -----------------------------------------------------------------

def equal_width_bin(c, low, high, bins: int) -> Column:
    """Right-closed equal-width bin 1..bins; the minimum falls into bin 1."""
    width = (col(high) - col(low)) / F.lit(float(bins))
    raw = F.ceil(F.try_divide(col(c) - col(low), width))
    return F.when(col(c).isNotNull(), F.coalesce(F.least(F.lit(bins), F.greatest(F.lit(1), raw)), F.lit(1)))


def human_size(c) -> Column:
    """Byte count as text with the largest fitting unit."""
    size = col(c)
    chain = None
    for power, unit in ((3, "G"), (2, "M"), (1, "K")):
        step = 1024**power
        text = F.format_string(f"%.2f{unit}", size.cast("double") / F.lit(float(step)))
        chain = F.when(size >= step, text) if chain is None else chain.when(size >= step, text)
    return chain.otherwise(F.concat(size.cast("string"), F.lit("B")))


# --- repeatable random numbers -------------------------------------------------

def hash_uniform(*cols, seed: int = 0) -> Column:
    """Uniform in [0, 1) that depends on the row's values only, not on partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(*[col(c) for c in cols], F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(2**53))


def hash_normal(*cols, seed: int = 0) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u = hash_uniform(*cols, seed=seed) + F.lit(2.0**-54)
    v = hash_uniform(*cols, seed=seed + 1_000_003)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)

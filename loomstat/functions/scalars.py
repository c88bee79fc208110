"""Scalar functions as native column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: What counts as a blank identifier, in lower case.
BLANK_IDS = ("", "nan", "none", "<na>", "null", "na")

#: Words that make a column binary or a grade, in lower case.
CODES = {
    "true": 1.0, "false": 0.0, "yes": 1.0, "no": 0.0, "t": 1.0, "f": 0.0, "y": 1.0, "n": 0.0,
    "male": 1.0, "female": 0.0, "i": 1.0, "ii": 2.0, "iii": 3.0, "iv": 4.0, "0": 0.0, "1": 1.0,
}

#: Family names that are written in capitals.
ABBREVIATIONS = ("glcm", "glrlm", "glszm", "gldzm", "ngtdm", "ngldm", "ivh")

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
EDGES = r"^(?U)\s+|(?U)\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """The value, NULL for NaN: aggregates skip NULL, but NaN would spoil them."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def finite(c: Column | str) -> Column:
    """The value, NULL for NaN and infinities."""
    c = known(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: Column | str) -> Column:
    """A string as a number, NULL where it is none; type suffixes are no numbers."""
    return F.when(col(c).cast("string").rlike(NUMBER), known(F.expr("1.0") * F.trim(col(c).cast("string")).try_cast("double")))


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c).cast("string"), EDGES, "")


def normalized_id(c: Column | str, lower: bool = False) -> Column:
    """One space for each run of white space, none at the ends; blank identifiers become NULL."""
    text = F.regexp_replace(stripped(c), r"(?U)\s+", " ")
    text = F.lower(text) if lower else text
    return F.when(~F.lower(text).isin(*BLANK_IDS), text)


def clinical_code(c: Column | str) -> Column:
    """The code of a binary word or grade, else NULL."""
    pairs = [F.lit(x) for kv in CODES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(stripped(c)))


def fisher_interval(r: Column | str, n: Column | str, rank: bool = False, z: float = 1.96) -> tuple[Column, Column]:
    """Confidence limits of a correlation from ``n`` pairs; wider for rank correlations. NULL for n <= 3 or |r| = 1."""
    r, n = col(r), col(n)
    wide = F.sqrt(1 + r * r / 2) if rank else F.lit(1.0)
    fits = (n > 3) & (F.abs(r) < 1)
    half = F.lit(z) * wide / F.sqrt(F.when(fits, n - 3).cast("double"))
    center = F.atanh(F.when(fits, r))
    return F.tanh(center - half), F.tanh(center + half)


def fisher_mean(r: Column | str) -> Column:
    """Aggregate: the mean of correlations on Fisher's scale."""
    edge = 0.999999999999
    return F.tanh(F.avg(F.atanh(F.greatest(F.lit(-edge), F.least(F.lit(edge), col(r))))))


def minus_log10(p: Column | str) -> Column:
    """-log10 with the least positive double in place of 0."""
    return -F.log10(F.greatest(col(p), F.lit(5e-324)))


def family_name(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.lower(c).isin(*ABBREVIATIONS), F.upper(c)).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))))


def discretization_label(c: Column | str) -> Column:
    """"None", or the number without a fraction where it has none."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), "None").when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def threshold_category(value: Column | str, thresholds: list[float]) -> Column:
    """How many of at most four thresholds the value reaches."""
    if len(thresholds) > 4:
        raise ValueError("at most four thresholds")
    out = F.lit(0)
    for t in sorted(thresholds):
        out = out + F.when(col(value) >= t, 1).otherwise(0)
    return F.when(col(value).isNotNull(), out)


def histogram_bin(value: Column | str, low: float = 0.0, width: float = 0.05, bins: int = 20) -> Column:
    """The bin from 0; the last one holds its upper edge too, and values outside have none."""
    value = col(value)
    at = F.floor((value - low) / width).cast("int")
    high = low + width * bins
    return F.when((value >= low) & (value <= high), F.least(at, F.lit(bins - 1)))


def yeo_johnson(x: Column | str, power: Column | str) -> Column:
    x, p = col(x), col(power)
    up = F.when(F.abs(p) > 1e-12, (F.pow(F.greatest(x, F.lit(0.0)) + 1, p) - 1) / F.when(F.abs(p) > 1e-12, p)).otherwise(F.log1p(F.greatest(x, F.lit(0.0))))
    q = 2 - p
    down = F.when(F.abs(q) > 1e-12, -(F.pow(1 - F.least(x, F.lit(0.0)), q) - 1) / F.when(F.abs(q) > 1e-12, q)).otherwise(-F.log1p(-F.least(x, F.lit(0.0))))
    return F.when(x >= 0, up).otherwise(down)


def short_error(c: Column | str) -> Column:
    """A message on one line, 300 characters at most."""
    return F.substring(F.trim(F.regexp_replace(col(c), r"\s+", " ")), 1, 300)


def feature_seed(feature: str, base: int = 42) -> int:
    """A seed below 2^32 that depends on the feature's name and the base only."""
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8, key=str(base).encode()).digest(), "big") % (1 << 32)


@F.pandas_udf(LongType())
def seed_of(feature: pd.Series) -> pd.Series:
    return feature.map(feature_seed)

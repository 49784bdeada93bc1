"""Arithmetic of the risk model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swaymeter.fixed_values import FSI_MAX, FSI_MIN
from swaymeter.functions.base import ColumnOrName, clip01, col

NO_ELECTION = 999


def combine_risk(base: ColumnOrName, context: ColumnOrName) -> Column:
    """Content signal lifted by the contextual one, limited to 0..1."""
    return clip01(col(base) + (F.lit(1.0) - col(base)) * col(context))


def risk_band(score: ColumnOrName) -> Column:
    s = col(score)
    return (F.when(s.isNull(), F.lit("N/A")).when(s > 0.7, F.lit("High"))
            .when(s > 0.4, F.lit("Medium")).otherwise(F.lit("Low")))


def guide_band(score: ColumnOrName) -> Column:
    """Bands of the user guide, on the score rounded to two places."""
    s = F.round(col(score), 2)
    return (F.when(s.isNull(), F.lit("N/A")).when(s <= 0.30, F.lit("Low"))
            .when(s <= 0.60, F.lit("Moderate")).otherwise(F.lit("High")))


def presence(debt: ColumnOrName, mil: ColumnOrName, res: ColumnOrName, disinfo: ColumnOrName) -> Column:
    """1.0 for a strong, 0.5 for a weak and 0.2 for no foothold."""
    debt, mil, res, disinfo = map(col, (debt, mil, res, disinfo))
    return (F.when((debt > 0) | (mil >= 0.33) | (res >= 0.10), F.lit(1.0))
            .when((mil > 0) | (res > 0) | (disinfo > 0.15), F.lit(0.5)).otherwise(F.lit(0.2)))


def months_to_election(election: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Whole months left, 0 when the day has come or gone, 999 when no date is known."""
    e, a = F.to_date(col(election)), F.to_date(col(as_of))
    months = ((F.year(e) - F.year(a)) * 12 + (F.month(e) - F.month(a))
              - F.when(F.dayofmonth(e) < F.dayofmonth(a), 1).otherwise(0))
    return F.when(e.isNull(), F.lit(NO_ELECTION)).when(e <= a, F.lit(0)).otherwise(F.greatest(F.lit(0), months))


def election_proximity(months: ColumnOrName) -> Column:
    m = col(months)
    return F.when(m < NO_ELECTION, F.lit(1.0) - F.least(m, F.lit(24)) / F.lit(24.0)).otherwise(F.lit(0.0))


def fsi_norm(raw: ColumnOrName, low: float = FSI_MIN, high: float = FSI_MAX) -> Column:
    return clip01((col(raw) - F.lit(low)) / F.lit(high - low))


def debt_ratio(debt: ColumnOrName, gdp: ColumnOrName) -> Column:
    return F.when(col(gdp) > 0, clip01(col(debt) / col(gdp))).otherwise(F.lit(0.0))


def ppi_estimate(n: ColumnOrName, sum_conf: ColumnOrName, correction: ColumnOrName, share: ColumnOrName) -> Column:
    """Mean confidence plus the anchor-based correction, limited to 0..1."""
    n = col(n)
    return clip01(col(sum_conf) / n + F.coalesce(col(correction), F.lit(0.0)) / (n * col(share)))

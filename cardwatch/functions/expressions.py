"""Column expressions shared by the operators. All of them stay inside code generation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column.

    A TIMESTAMP_NTZ is read as it stands, so the session time zone and its clock changes have no influence.
    """
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(F.col(name))
    gap = F.expr(f"`{name}` - TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    seconds = F.extract(F.lit("SECOND"), gap)
    return (
        F.extract(F.lit("DAY"), gap).cast("long") * DAY_US
        + F.extract(F.lit("HOUR"), gap).cast("long") * HOUR_US
        + F.extract(F.lit("MINUTE"), gap).cast("long") * MINUTE_US
        + (seconds * 1_000_000).cast("long")
    )


def as_instant(df: DataFrame, name: str) -> Column:
    """A timestamp column as TIMESTAMP, which watermarks require; a TIMESTAMP_NTZ is taken as UTC."""
    return F.timestamp_micros(epoch_micros(df, name))


def without_zone(instant: Column) -> Column:
    """The UTC wall clock of an instant as TIMESTAMP_NTZ, whatever the session time zone."""
    seconds = (F.unix_micros(instant).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def cents(amount: Column) -> Column:
    """Whole cents, so that sums are exact and windows can add and take away without residue; null for NaN and
    infinities."""
    return F.round(amount * 100).try_cast("long")


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom as a double, and ``otherwise`` where the bottom is zero or null."""
    value = F.when(bottom != 0, top.cast("double") / bottom.cast("double"))
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def clean_number(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(number)


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def is_high_risk_country(country: Column) -> Column:
    return flag(country.isin(S.HIGH_RISK_COUNTRIES))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2) * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def decision(score: Column, threshold: float = S.BLOCK_THRESHOLD) -> Column:
    return (
        F.when(score >= threshold, F.lit("BLOCK"))
        .when(score >= threshold * S.REVIEW_RATIO, F.lit("REVIEW"))
        .otherwise(F.lit("APPROVE"))
    )


def risk_level(decided: Column) -> Column:
    return F.when(decided == "BLOCK", F.lit("HIGH")).when(decided == "REVIEW", F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def reason(score: Column, decided: Column) -> Column:
    percent = F.format_string("%.1f", score * 100)
    lead = F.when(decided == "BLOCK", F.lit("High")).when(decided == "REVIEW", F.lit("Moderate")).otherwise(F.lit("Low"))
    tail = (
        F.when(decided == "BLOCK", F.lit("multiple suspicious signals"))
        .when(decided == "REVIEW", F.lit("requires manual review"))
        .otherwise(F.lit("transaction approved"))
    )
    return F.concat(lead, F.lit(" fraud score ("), percent, F.lit("%) - "), tail)


def drift_status(psi: Column) -> Column:
    return (
        F.when(psi < S.PSI_MODERATE, F.lit("Stable"))
        .when(psi < S.PSI_SIGNIFICANT, F.lit("Moderate Drift"))
        .otherwise(F.lit("Significant Drift"))
    )


def drift_action(psi: Column) -> Column:
    return (
        F.when(psi < S.PSI_MODERATE, F.lit("None"))
        .when(psi < S.PSI_SIGNIFICANT, F.lit("Investigate"))
        .otherwise(F.lit("Retrain Required"))
    )

"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def null_if_not_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def correlation(a: str, b: str) -> Column:
    """Pearson's coefficient as an aggregate; null where either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def scaled_round(x: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: scaled, halves away from 0, scaled back. Spark's own rounds the shortest decimal form, which may lie at the other side of a half."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def heart_rate(rr_s: Column) -> Column:
    """Beats a minute of an interval in seconds."""
    return 60.0 / F.greatest(rr_s, F.lit(TINY))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def unit_score(x: Column, low: float, high: float, inverse: bool = False) -> Column:
    """(x - low) / (high - low) within 0 and 1, or one less that."""
    s = clip((x - low) / (high - low), 0.0, 1.0)
    return 1.0 - s if inverse else s


def snr_db(signal_power: Column, noise_power: Column) -> Column:
    """Ratio of powers in decibels: infinite without noise, else minus infinite without signal; null for a negative ratio."""
    return F.when(noise_power == 0, F.lit(float("inf"))).when(signal_power == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(signal_power / noise_power))


def three_bins(x: Column, t1: float, t2: float, higher_is_better: bool = True) -> Column:
    """Class 1 (best) to 3 by two cut points; null stays null."""
    if higher_is_better:
        return F.when(x >= t1, 1).when(x >= t2, 2).when(x.isNotNull(), 3)
    return F.when(x <= t1, 1).when(x <= t2, 2).when(x.isNotNull(), 3)


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "t", "yes", "y")


def recording_name(patient: Column, enrollment: Column, recording: Column) -> Column:
    """P%02d, the enrollment letter if any, _R%02d."""
    return F.format_string("P%02d%s_R%02d", patient.cast("bigint"), F.coalesce(enrollment, F.lit("")), recording.cast("bigint"))


# Fixed value: names of aligned interval files.
RR_FILE = r"(?i)^p(\d+)([abc])?_r(\d+)_(.+)_rr_aligned\.csv$"
RECORDING_FILE = r"(?i)p(?:atient)?\s*(\d+)([abc])?.*?r(?:ecording)?\s*(\d+)"


def parse_rr_file(name: Column, strict: bool = False) -> Column:
    """struct(patient_id, enrollment_id, recording_id, algo_id) of a file name or path; null, or an error, where it doesn't match."""
    base = F.regexp_extract(name, r"([^/\\]+)$", 1)
    part = lambda i: F.regexp_extract(base, RR_FILE, i)
    parsed = F.struct(
        part(1).try_cast("bigint").alias("patient_id"),
        F.nullif(F.lower(part(2)), F.lit("")).alias("enrollment_id"),
        part(3).try_cast("bigint").alias("recording_id"),
        F.lower(part(4)).alias("algo_id"),
    )
    bad = F.raise_error(F.concat(F.lit("not an aligned interval file: "), name)) if strict else None
    return F.when(base.rlike(RR_FILE), parsed).otherwise(bad)


def parse_recording_file(name: Column) -> Column:
    part = lambda i: F.regexp_extract(name, RECORDING_FILE, i)
    return F.when(
        name.rlike(RECORDING_FILE),
        F.struct(part(1).try_cast("bigint").alias("patient_id"), F.nullif(F.lower(part(2)), F.lit("")).alias("enrollment_id"), part(3).try_cast("bigint").alias("recording_id")),
    )


def seconds_since_midnight(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def is_night(ts: Column, start: int = 22, end: int = 6) -> Column:
    return (F.hour(ts) >= start) | (F.hour(ts) < end)


def epoch_seconds(number: Column) -> Column:
    """Epoch seconds from seconds, or from milliseconds above 1e12; null for what is no epoch."""
    return F.when(number > 1e12, number / 1000.0).when(number > 1e9, number)


def local_from_utc(ts_ntz: Column, zone: str = "Europe/Copenhagen") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_ntz)


def epoch_of_local(ts_ntz: Column, zone: str = "Europe/Copenhagen") -> Column:
    return F.unix_micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), ts_ntz).cast("timestamp")) / 1e6


def parse_date(text: Column) -> Column:
    """Dates written dd.mm.yy, dd.mm.yyyy, dd/mm/yyyy, dd-mm-yyyy or yyyy-mm-dd."""
    text = F.trim(text)
    formats = {r"^\d{2}\.\d{2}\.\d{2}$": "dd.MM.yy", r"^\d{2}\.\d{2}\.\d{4}$": "dd.MM.yyyy", r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy", r"^\d{2}-\d{2}-\d{4}$": "dd-MM-yyyy", r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd"}
    return F.coalesce(*(F.when(text.rlike(p), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for p, f in formats.items()))


def parse_time_seconds(cell: Column) -> Column:
    """Seconds of the day of a cell: h:mm[:ss] (with dots or colons), or a fraction of a day."""
    cell = F.trim(cell.cast("string"))
    clock = F.split(F.regexp_replace(cell, r"\.", ":"), ":")
    seconds = clock[0].try_cast("bigint") * 3600 + clock[1].try_cast("bigint") * 60 + F.coalesce(F.get(clock, F.lit(2)).try_cast("bigint"), F.lit(0))
    number = cell.try_cast("double")
    return F.when(number.between(0.0, 0.9999999), F.round(number * 86400).cast("bigint")).when(cell.rlike(r"^\d{1,2}[:.]\d{2}([:.]\d{2})?$"), seconds)


def date_and_time(day: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_date(day).cast("bigint") * 86_400_000_000 + seconds.cast("bigint") * 1_000_000).cast("timestamp_ntz")


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def best_start(*columns: Column) -> Column:
    return F.coalesce(*columns)

"""Epoch normalisation, local calendar fields and event time columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_ZONE = "Asia/Shanghai"
MS_FLOOR = 1_000_000_000_000  # smaller epochs are counted in seconds
SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_epoch(raw: Column | str) -> Column:
    """Epoch that may carry a fraction (or be text), cut to a long."""
    return _col(raw).try_cast("double").try_cast("bigint")


def epoch_ms(raw: Column | str) -> Column:
    """Epoch in seconds or milliseconds, as milliseconds; null stays null."""
    c = _col(raw)
    return F.when(c < MS_FLOOR, c * SECOND_MS).otherwise(c)


def epoch_ms_or_now(raw: Column | str, now_ms: Column | None = None) -> Column:
    """As :func:`epoch_ms`, with missing values taking the processing time."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return epoch_ms(F.coalesce(_col(raw), now))


def ntz_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a zone-less timestamp, read in the session zone (UTC)."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def local_time(ms: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """Wall-clock time of an instant in ``zone``, whatever the session zone.

    A timestamp is shown in the session zone, so that shift is taken out first;
    both shifts have literal zones and stay inside code generation.
    """
    shown_as_utc = F.to_utc_timestamp(event_time(ms), F.current_timezone())
    return F.from_utc_timestamp(shown_as_utc, zone).cast("timestamp_ntz")


def local_date(ms: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """``yyyy-MM-dd`` in the given zone."""
    return local_time(ms, zone).cast("date").cast("string")


def local_datetime(ms: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the given zone."""
    whole = _col(ms) - F.pmod(_col(ms), F.lit(SECOND_MS))
    return local_time(whole, zone).cast("string")


def local_hour(ms: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.hour(local_time(ms, zone))


def event_time(ms: Column | str) -> Column:
    """TIMESTAMP of an epoch in milliseconds, fit for ``withWatermark``."""
    return F.timestamp_millis(_col(ms))


def event_time_of_field(json_text: Column | str, field: str) -> Column:
    """Event time from a named JSON field; a missing or bad value counts as 0."""
    raw = F.get_json_object(_col(json_text), f"$.{field}")
    return event_time(F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint")))


def event_time_of_block(block_ts: Column | str, fallback_ts: Column | str) -> Column:
    """Event time from a block timestamp in seconds, else the record's own."""
    return F.timestamp_seconds(F.coalesce(_col(block_ts), _col(fallback_ts)))


def event_time_of_first(items: Column | str) -> Column:
    """Event time from the first element's ``window_start_time``."""
    return event_time(F.get(_col(items), F.lit(0))["window_start_time"])


def event_time_or_now(ms: Column | str) -> Column:
    return event_time(F.coalesce(_col(ms), F.unix_millis(F.current_timestamp())))


def sales_event_time(ts_text: Column | str, insert_time: Column | str) -> Column:
    """Event time of a sale.

    Text with at most ten characters before the fraction is in seconds, longer
    text in milliseconds; blank text falls back to the insert time.
    """
    text = _col(ts_text)
    digits = F.regexp_replace(text, r"\.\d+", "")
    number = text.try_cast("double")
    from_text = F.when(
        F.char_length(digits) <= 10, (number * SECOND_MS).try_cast("bigint")
    ).otherwise(number.try_cast("bigint"))
    ms = F.when(text.isNotNull() & (text != ""), from_text).otherwise(_col(insert_time))
    return event_time(ms)

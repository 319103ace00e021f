"""Calendar and clock features.

Timestamps are ``TIMESTAMP_NTZ`` wall clocks. Keys used for grouping, joining
or filtering are built from date and clock fields only, so they do not depend
on the session time zone. Text labels go through ``date_format``, which needs
the session zone to be UTC (``trailmill.session`` pins it).
"""

from __future__ import annotations

SEASON_YEAR = 2025  # Fixed value: the year all months are folded into.
REFRESH_ZONE = "America/New_York"  # Fixed value.
MINUTE_LABEL = "yyyy-MM-dd hh:mm a"

# English names in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def wall_clock(iso_text: str) -> str:
    """ISO text to a naive timestamp; zone and sub-seconds are dropped."""
    return f"try_cast(substring({iso_text}, 1, 19) as timestamp_ntz)"


def second_of_day(ts: str) -> str:
    return f"(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"


def whole_second(ts: str) -> str:
    """Drop sub-seconds of a naive timestamp."""
    return f"cast(date_trunc('SECOND', {ts}) as timestamp_ntz)"


def wrap_day(seconds: str) -> str:
    """Duration modulo 24 h, as a clock face would show it."""
    return f"pmod({seconds}, 86400L)"


def as_interval(seconds: str) -> str:
    """Seconds as DAY TO SECOND interval, for callers that want the type."""
    return f"make_dt_interval(0, 0, 0, cast({seconds} as decimal(18, 6)))"


def nearest_hour(ts: str) -> str:
    """Hour 0-23 nearest to the start; half past goes to the even hour."""
    return f"cast(pmod(rint({second_of_day(ts)} / 3600D), 24D) as int)"


def hour_number(ts: str) -> str:
    """Whole hours since 1970-01-01 00:00 on the same wall clock."""
    return f"(cast(unix_date(to_date({ts})) as bigint) * 24 + hour({ts}))"


def clock24(ts: str) -> str:
    return f"date_format({ts}, 'HH:mm:ss')"


def clock12(ts: str) -> str:
    return f"date_format({ts}, 'hh:mm a')"


def _named(names: tuple[str, ...], position: str) -> str:
    texts = ", ".join(f"'{name}'" for name in names)
    return f"element_at(array({texts}), {position})"


def weekday_number(ts: str) -> str:
    """Monday is 0."""
    return f"weekday({ts})"


def weekday_name(ts: str) -> str:
    return _named(WEEKDAYS, f"weekday({ts}) + 1")


def month_name(ts: str) -> str:
    return _named(MONTHS, f"month({ts})")


def month_start(ts: str) -> str:
    return f"trunc({ts}, 'MM')"


def season_month(ts: str) -> str:
    return f"make_date({SEASON_YEAR}, month({ts}), 1)"


def month_label(ts: str) -> str:
    return f"date_format({ts}, 'MMM yyyy')"


def day_text(ts: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd')"


def iso_text(ts: str) -> str:
    return f"date_format(cast({ts} as timestamp_ntz), \"yyyy-MM-dd'T'HH:mm:ss\")"


def minute_label(ts: str) -> str:
    return f"date_format({ts}, '{MINUTE_LABEL}')"


def minute_label_parsed(label: str) -> str:
    return f"to_timestamp_ntz({label}, '{MINUTE_LABEL}')"


def refresh_stamp(utc: str) -> str:
    """New York clock label of a naive UTC time."""
    return minute_label(f"convert_timezone('UTC', '{REFRESH_ZONE}', {utc})")


def refresh_time(label: str) -> str:
    """Naive UTC time behind a refresh stamp."""
    return f"convert_timezone('{REFRESH_ZONE}', 'UTC', {minute_label_parsed(label)})"


UTC_NOW = "localtimestamp()"  # The session zone is UTC.


def minute_label_rank(ts: str) -> str:
    """Integer that sorts exactly as the minute label's text does.

    The text puts 12-hour digits before the AM/PM mark, so "09:00 AM" sorts
    after "02:00 PM". Ranking integers keeps the search for the largest label
    a primitive hash aggregate instead of formatting a string per row.
    """
    hour12 = f"((hour({ts}) + 11) % 12 + 1)"
    clock = f"{hour12} * 120 + minute({ts}) * 2 + if(hour({ts}) >= 12, 1, 0)"
    return f"(cast(unix_date(to_date({ts})) as bigint) * 2048 + {clock})"


def minute_label_time(rank: str) -> str:
    """The naive timestamp behind a ``minute_label_rank``."""
    clock = f"pmod({rank}, 2048L)"
    day = f"cast(({rank} - {clock}) div 2048 as int)"
    hour = f"({clock} div 120) % 12 + ({clock} % 2) * 12"
    minutes = f"cast(({hour}) * 60 + ({clock} % 120) div 2 as int)"
    midnight = f"cast(date_from_unix_date({day}) as timestamp_ntz)"
    return f"timestampadd(MINUTE, {minutes}, {midnight})"

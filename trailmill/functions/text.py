"""Presentation text and duration text."""

from __future__ import annotations

from trailmill.functions.numeric import half_even

def hours2(seconds: str) -> str:
    """Seconds as hours with two decimals."""
    return half_even(f"{seconds} / 3600D")


def hours_minutes(seconds: str) -> str:
    """``25 hrs 1 min``; hours are unbounded."""
    return f"concat({seconds} div 3600, ' hrs ', ({seconds} % 3600) div 60, ' min')"


def duration_text(seconds: str) -> str:
    """``0 days 01:02:03``, the form durations take in stored records."""
    clock = [f"({seconds} % 86400) div 3600", f"({seconds} % 3600) div 60", f"{seconds} % 60"]
    hour, minute, second = (f"lpad(cast({part} as string), 2, '0')" for part in clock)
    return f"concat({seconds} div 86400, ' days ', {hour}, ':', {minute}, ':', {second})"


def duration_seconds(text: str) -> str:
    """Seconds behind ``[N days ]HH:MM:SS``; NULL when the text is neither."""
    days = f"if(contains({text}, ' day'), substring_index({text}, ' day', 1), '0')"
    clock = f"substring_index({text}, ' ', -1)"
    hour, minute = (f"split_part({clock}, ':', {i})" for i in (1, 2))
    second = f"substring_index(split_part({clock}, ':', 3), '.', 1)"
    days, hour, minute, second = (f"try_cast({x} as bigint)" for x in (days, hour, minute, second))
    return f"({days} * 86400 + {hour} * 3600 + {minute} * 60 + {second})"


def grouped_hundredths(units: str) -> str:
    """Integer hundredths as grouped decimal text, one trailing zero dropped."""
    value = f"cast(cast({units} as decimal(20, 0)) * 0.01BD as decimal(22, 2))"
    return f"regexp_replace(format_number({value}, 2), '0$', '')"


def grouped_integer(n: str) -> str:
    return f"format_number({n}, 0)"


def ordered_weekday(number: str, name: str) -> str:
    """``1-Monday``."""
    return f"concat({number} + 1, '-', {name})"

"""Column expressions shared by the jobs (no Python UDFs)."""

from worklens.functions.calendar import (
    in_work_hours,
    month_start,
    ntz,
    weekday,
)
from worklens.functions.names import (
    BINARY,
    BROWSER_RESOURCE_NAMES,
    COLLATED,
    LOCK_SCREEN_FRAGMENT,
    NOCASE,
    TITLE_DELIMITERS,
    Names,
    contains_name,
    is_blank,
    key_in,
    left_of,
    name_key,
    not_lock_screen,
    site_name,
    without_prefix,
)
from worklens.functions.timetext import clock_time, duration_text, seconds_since, truncated_avg

__all__ = [
    "BINARY", "BROWSER_RESOURCE_NAMES", "COLLATED", "LOCK_SCREEN_FRAGMENT", "NOCASE", "Names", "TITLE_DELIMITERS",
    "clock_time", "contains_name", "duration_text", "in_work_hours", "is_blank", "key_in",
    "left_of", "month_start", "name_key", "not_lock_screen", "ntz", "seconds_since",
    "site_name", "truncated_avg", "weekday", "without_prefix",
]

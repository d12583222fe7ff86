"""Time-zone aware session windows as column expressions (daylight saving included)."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ClockWindow:
    """Half-open local-clock window; it may cross midnight."""

    name: str
    timezone: str
    start_minute: int
    end_minute: int
    weekdays: tuple[int, ...] | None = None

    @property
    def crosses_midnight(self) -> bool:
        return self.start_minute > self.end_minute


# The default research sessions and named windows.
MAJOR_SESSIONS = (
    ClockWindow("asia", "Asia/Tokyo", 540, 1080),
    ClockWindow("london", "Europe/London", 480, 1020),
    ClockWindow("new_york", "America/New_York", 480, 1020),
)
NAMED_WINDOWS = (
    ClockWindow("asian_kz_20_00_et", "America/New_York", 1200, 0),
    ClockWindow("london_kz_02_05_et", "America/New_York", 120, 300),
    ClockWindow("london_core_02_04_et", "America/New_York", 120, 240),
    ClockWindow("new_york_kz_07_10_et", "America/New_York", 420, 600),
    ClockWindow("new_york_kz_0830_1100_et", "America/New_York", 510, 660),
    ClockWindow("london_close_10_12_et", "America/New_York", 600, 720),
    ClockWindow("new_york_lunch_11_13_et", "America/New_York", 660, 780),
)
# Fixed value: the trading day turns at 17:00 New York time.
TRADING_DAY = ClockWindow("trading_day", "America/New_York", 1020, 1020)


def local_time(ts: Column, timezone: str) -> Column:
    return F.from_utc_timestamp(ts, timezone)


def _clock(local: Column) -> Column:
    """Seconds since local midnight (the session time zone is UTC, so this is plain arithmetic)."""
    return F.pmod(F.unix_seconds(local), F.lit(86400))


def _after_midnight(local: Column, w: ClockWindow) -> Column:
    if not w.crosses_midnight:
        return F.lit(False)
    return _clock(local) < w.end_minute * 60


def contains(ts: Column, w: ClockWindow) -> Column:
    local = local_time(ts, w.timezone)
    clock = _clock(local)
    lo, hi = w.start_minute * 60, w.end_minute * 60
    inside = (clock >= lo) | (clock < hi) if w.crosses_midnight else (clock >= lo) & (clock < hi)
    if w.weekdays is None:
        return inside
    return inside & F.weekday(instance_date(ts, w)).isin(*w.weekdays)


def instance_date(ts: Column, w: ClockWindow) -> Column:
    """Local date on which the window containing (or nearest before) ``ts`` started."""
    local = local_time(ts, w.timezone)
    shift = F.when(_after_midnight(local, w), 1).otherwise(0)
    return F.date_sub(F.to_date(local), shift)


def _utc_of(day: Column, minute: int, timezone: str) -> Column:
    local = day.cast("timestamp") + F.make_dt_interval(mins=F.lit(minute))
    return F.to_utc_timestamp(local, timezone)


def window_bounds(day: Column, w: ClockWindow) -> tuple[Column, Column]:
    """UTC start and end of the window instance that starts on local date ``day``."""
    end_day = F.date_add(day, 1) if w.start_minute >= w.end_minute else day
    return _utc_of(day, w.start_minute, w.timezone), _utc_of(end_day, w.end_minute, w.timezone)


def active_names(ts: Column, windows=MAJOR_SESSIONS) -> Column:
    """Name-sorted array of the windows open at ``ts``."""
    ordered = sorted(windows, key=lambda w: w.name)
    return F.array_compact(
        F.array(*[F.when(contains(ts, w), F.lit(w.name)) for w in ordered])
    )


def regime_label(active: Column) -> Column:
    return (
        F.when(F.size(active) == 0, "outside_major_sessions")
        .when(F.size(active) == 1, F.concat(F.array_join(active, "_"), F.lit("_only")))
        .otherwise(F.concat(F.array_join(active, "_"), F.lit("_overlap")))
    )


def classify(df: DataFrame, ts: str = "open_time", major=MAJOR_SESSIONS, named=NAMED_WINDOWS) -> DataFrame:
    """Label each row by its own clock: membership, active names, regime, named windows."""
    t = F.col(ts)
    membership = F.create_map(
        *[x for w in sorted(major, key=lambda w: w.name) for x in (F.lit(w.name), contains(t, w))]
    )
    clocks = F.create_map(
        *[
            x
            for w in sorted((*major, *named), key=lambda w: w.name)
            for x in (F.lit(w.name), local_time(t, w.timezone).cast("timestamp_ntz"))
        ]
    )
    return df.withColumns(
        {
            "session_membership": membership,
            "active_sessions": active_names(t, major),
            "active_named_windows": active_names(t, named),
            "local_times": clocks,
        }
    ).withColumn("regime", regime_label(F.col("active_sessions")))


def instance_of(ts: Column, name: Column, windows=MAJOR_SESSIONS) -> Column:
    """Instance date for a session named by a column."""
    out = F.lit(None).cast("date")
    for w in windows:
        out = F.when(name == w.name, instance_date(ts, w)).otherwise(out)
    return out


def sole_session_minutes(ts: Column, windows=MAJOR_SESSIONS) -> tuple[Column, Column, Column]:
    """(name, minutes since open, minutes to close) when exactly one session is open, else NULLs."""
    active = active_names(ts, windows)
    name = F.when(F.size(active) == 1, F.get(active, F.lit(0)))
    since = until = F.lit(None).cast("long")
    for w in windows:
        lo, hi = window_bounds(instance_date(ts, w), w)
        since = F.when(name == w.name, F.floor((F.unix_seconds(ts) - F.unix_seconds(lo)) / 60)).otherwise(since)
        until = F.when(name == w.name, F.floor((F.unix_seconds(hi) - F.unix_seconds(ts)) / 60)).otherwise(until)
    return name, since, until

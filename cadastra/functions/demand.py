"""Trip-making of buildings, zones and gateways as Spark SQL expressions."""

from __future__ import annotations

# Periods, modes, shares and rates of the demand model.
PERIODS = ("AM_Peak", "PM_Peak", "Midday", "Night")
PERIOD_SHARE = {"AM_Peak": 0.35, "PM_Peak": 0.40, "Midday": 0.15, "Night": 0.10}
MODES = ("car", "two_wheeler", "bus", "metro", "walking", "other")
DEFAULT_SPLIT = {"car": 0.25, "two_wheeler": 0.35, "bus": 0.20, "metro": 0.10, "walking": 0.08, "other": 0.02}
PROFILE_KEYS = {"car": "car", "two_wheeler": "twoWheeler", "bus": "bus", "metro": "metro", "walking": "walk", "other": "other"}
RESIDENT_TRIPS = 2.0
EMPLOYEE_TRIPS = 1.5
ZONE_RESIDENT_TRIPS = 1.8
ZONE_EMPLOYEE_TRIPS = 1.2
IMPORTANT_CATEGORIES = ("office", "IT", "commercial", "retail", "hospital", "school", "college", "hotel",
                        "government", "mixed_use")


def default_split() -> str:
    return "named_struct(" + ", ".join(f"'{m}', {DEFAULT_SPLIT[m]}D" for m in MODES) + ")"


def clock_period(text: str) -> str:
    """Period of a clock time ``H:MM``; null when unset or not a time."""
    h = f"try_cast(regexp_extract({text}, '^([0-9]{{1,2}}):[0-9]{{2}}', 1) as int)"
    return (f"case when {h} >= 7 and {h} < 11 then 'AM_Peak' when {h} >= 11 and {h} < 16 then 'Midday'"
            f" when {h} >= 16 and {h} < 21 then 'PM_Peak' when {h} >= 0 and {h} <= 23 then 'Night' end")


def profile_split(split: str) -> str:
    """Percentages to fractions of their own total; null when nothing was entered."""
    part = {m: f"greatest(0D, coalesce({split}.{PROFILE_KEYS[m]}, 0D))" for m in MODES}
    total = "(" + " + ".join(part.values()) + ")"
    fields = ", ".join(f"'{m}', {part[m]} / {total}" for m in MODES)
    return f"case when {split} is not null and {total} > 0 then named_struct({fields}) end"


def has_trip_overrides(gen: str, departs: str, arrives: str) -> str:
    """True when a profile changes trips; ``departs`` and ``arrives`` are its peak periods."""
    return (f"({departs} is not null or {arrives} is not null or greatest(coalesce({gen}.dailyTrips, 0D),"
            f" coalesce({gen}.amPeakTrips, 0D), coalesce({gen}.pmPeakTrips, 0D)) > 0)")


def is_explicit(own: str, split: str) -> str:
    """Buildings the demand model treats one by one (columns as in the building table)."""
    names = ", ".join(f"'{c}'" for c in IMPORTANT_CATEGORIES)
    return (f"(coalesce(category in ({names}), false) or coalesce(employees, 0) > 100 or coalesce(residents, 0) > 150"
            f" or coalesce(source in ('manual', 'municipal', 'surveyed'), false) or {own} or {split} is not null)")


def trip_events(gen: str, own: str, leave: str, arrive: str) -> str:
    """Array of (role, period, trips) a building starts (origin) and draws (destination).

    Without own settings people leave home in the morning peak and return in the
    evening one, employees the other way round. With them (``own``) the peaks are
    ``leave`` and ``arrive`` and the counts those of ``gen`` where given.
    """
    by_res = f"greatest(0D, coalesce(double(residents), 0D)) * {RESIDENT_TRIPS}D"
    by_emp = f"greatest(0D, coalesce(double(employees), 0D)) * {EMPLOYEE_TRIPS}D"

    def event(role, period, trips):
        return f"named_struct('role', '{role}', 'period', {period}, 'trips', {trips})"

    def volume(period):
        given = f"case {period} when 'AM_Peak' then {gen}.amPeakTrips when 'PM_Peak' then {gen}.pmPeakTrips end"
        share = f"case {period} " + " ".join(f"when '{p}' then {s}D" for p, s in PERIOD_SHARE.items()) + " end"
        daily = f"case when {gen}.dailyTrips > 0 then {gen}.dailyTrips else {by_res} + {by_emp} end"
        return f"case when {given} > 0 then {given} else {daily} * {share} end"
    am, pm = f"{PERIOD_SHARE['AM_Peak']}D", f"{PERIOD_SHARE['PM_Peak']}D"
    usual = ", ".join([event("origin", "'AM_Peak'", f"{by_res} * {am}"), event("destination", "'PM_Peak'", f"{by_res} * {pm}"),
                       event("destination", "'AM_Peak'", f"{by_emp} * {am}"), event("origin", "'PM_Peak'", f"{by_emp} * {pm}")])
    mine = ", ".join([event("origin", leave, volume(leave)), event("destination", arrive, volume(arrive))])
    return f"case when {own} then array({mine}) else array({usual}) end"

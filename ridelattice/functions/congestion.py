"""Volume/capacity by hour and direction, and the resulting link times."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Link-time curve, incident delay, scenario scales
ALPHA = 0.15
BETA = 4.0
MAX_MULTIPLIER = 5.0
INCIDENT_DELAY = 8.0
SCENARIO_SCALE = {
    "no_congestion": 0.0,
    "mild_congestion": 0.5,
    "moderate_congestion": 1.0,
    "severe_congestion": 2.0,
    "asymmetric_directional": 1.0,
}
# peak window (from, to), then (base, rise) per direction
MORNING = (7.5, 9.5, {"inbound": (0.70, 0.55), "outbound": (0.40, 0.20), "neutral": (0.60, 0.35)})
EVENING = (16.5, 19.0, {"outbound": (0.75, 0.60), "inbound": (0.45, 0.20), "neutral": (0.65, 0.40)})
MIDDAY = (11.0, 14.0, 0.65)
SHOULDER = (6.0, 21.0, 0.45)
NIGHT = 0.20
# name parts that decide the direction of an edge
INBOUND_PARTS = ("beale", "fremont", "1st", "2nd")
OUTBOUND_PARTS = ("4th", "3rd")


def edge_direction(u_name: Column, v_name: Column) -> Column:
    """Ordered name rules: inbound, outbound or neutral."""

    def has(name: Column, parts: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        return hit

    both = lambda word: u_name.contains(word) & v_name.contains(word)
    return (
        F.when(both("howard"), "inbound")
        .when(both("folsom"), "outbound")
        .when(has(v_name, INBOUND_PARTS) & ~has(u_name, INBOUND_PARTS), "inbound")
        .when(has(v_name, OUTBOUND_PARTS) & ~has(u_name, OUTBOUND_PARTS), "outbound")
        .when(u_name.contains("market") | v_name.contains("mission"), "inbound")
        .otherwise("neutral")
    )


def _peak(hour: Column, direction: Column, window: tuple) -> Column:
    start, end, shapes = window
    bump = F.sin((hour - start) / (end - start) * math.pi)
    out = F.when(direction == "neutral", shapes["neutral"][0] + shapes["neutral"][1] * bump)
    for name in ("inbound", "outbound"):
        out = out.when(direction == name, shapes[name][0] + shapes[name][1] * bump)
    return out


def volume_capacity(hour: Column, direction: Column, scenario: str | Column) -> Column:
    """Diurnal volume/capacity ratio; ``hour`` is fractional, 0..24."""
    base = (
        F.when(hour.between(MORNING[0], MORNING[1]), _peak(hour, direction, MORNING))
        .when(hour.between(EVENING[0], EVENING[1]), _peak(hour, direction, EVENING))
        .when(hour.between(MIDDAY[0], MIDDAY[1]), MIDDAY[2])
        .when(hour.between(SHOULDER[0], SHOULDER[1]), SHOULDER[2])
        .otherwise(NIGHT)
    )
    if isinstance(scenario, str):
        return base * SCENARIO_SCALE.get(scenario, 1.0)
    scale = F.lit(1.0)
    for name, value in SCENARIO_SCALE.items():
        scale = F.when(scenario == name, value).otherwise(scale)
    return base * scale


def link_seconds(free_s: Column, hour: Column, direction: Column, scenario: str | Column) -> Column:
    """Travel seconds of a link: volume-delay curve, multiplier held within 1..5."""
    if isinstance(scenario, str) and scenario == "no_congestion":
        return free_s
    vc = volume_capacity(hour, direction, scenario)
    return free_s * F.least(F.lit(MAX_MULTIPLIER), F.greatest(F.lit(1.0), 1.0 + ALPHA * F.pow(vc, F.lit(BETA))))


#: Directions in the order of the columns of :func:`link_factors`.
DIRECTIONS = ("inbound", "outbound", "neutral")


def link_factors(hour: np.ndarray, scenario: str) -> np.ndarray:
    """The multiplier of :func:`link_seconds` at every hour (0..24) for every direction, for use inside Python workers."""
    if scenario == "no_congestion":
        return np.ones((len(hour), len(DIRECTIONS)))
    rest = np.select([(hour >= MIDDAY[0]) & (hour <= MIDDAY[1]), (hour >= SHOULDER[0]) & (hour <= SHOULDER[1])], [MIDDAY[2], SHOULDER[2]], NIGHT)
    vc = np.repeat(rest[:, None], len(DIRECTIONS), axis=1)
    for start, end, shapes in (EVENING, MORNING):
        at = np.flatnonzero((hour >= start) & (hour <= end))
        bump = np.sin((hour[at] - start) / (end - start) * math.pi)
        for i, d in enumerate(DIRECTIONS):
            vc[at, i] = shapes[d][0] + shapes[d][1] * bump
    return np.clip(1.0 + ALPHA * np.power(vc * SCENARIO_SCALE.get(scenario, 1.0), BETA), 1.0, MAX_MULTIPLIER)

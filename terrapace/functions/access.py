"""Who may use a street: tags, directions, surfaces and speed limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinematics import lookup
from .numbers import col

# Tag classes.
DENIED = ("no", "private", "customers")
ALLOWED = ("yes", "designated", "permissive", "official")
PEDESTRIAN_ONLY = ("footway", "pedestrian", "steps", "corridor")
NON_MOTORISED = (*PEDESTRIAN_ONLY, "path", "cycleway", "bridleway")
CONTROLLED = ("motorway", "motorway_link", "trunk", "trunk_link")
ONE_WAY = ("yes", "1", "true")

# Smoothness of surfaces.
SURFACE_QUALITY = {"paved": 0.90, "asphalt": 1.00, "concrete": 0.95, "concrete:plates": 0.85, "paving_stones": 0.82, "sett": 0.68, "cobblestone": 0.55, "compacted": 0.62, "fine_gravel": 0.58, "gravel": 0.42, "pebblestone": 0.38, "ground": 0.30, "dirt": 0.22, "earth": 0.22, "mud": 0.08, "sand": 0.08, "grass": 0.18, "wood": 0.72, "metal": 0.70}


def tag(x) -> Column:
    return F.lower(F.trim(F.coalesce(col(x), F.lit(""))))


def surface_quality(surface) -> Column:
    t = tag(surface)
    return F.when(t == "", 0.65).otherwise(lookup(t, SURFACE_QUALITY, 0.50))


def mode_of(category) -> Column:
    return F.when(col(category) == "pedestrian", "foot").when(col(category) == "micromobility", "bicycle").otherwise("motor_vehicle")


def road_rank(highway) -> Column:
    """1 for motorways and trunk roads to 5 for the least."""
    h = F.regexp_replace(tag(highway), "_link$", "")
    return F.when(h.isin("motorway", "trunk"), 1).when(h == "primary", 2).when(h.isin("secondary", "tertiary"), 3).when(h.isin("residential", "living_street", "unclassified"), 4).otherwise(5)


def speed_limit_kmh(text) -> Column:
    """The first word of a limit as a number, miles converted; null for words and for nothing positive."""
    t = tag(text)
    number = F.split(t, r"\s+")[0].try_cast("double")
    kmh = F.when(t.contains("mph"), number * 1.609344).otherwise(number)
    ok = ~t.isin("", "none", "signals", "variable", "walk") & (kmh > 0) & (kmh < F.lit(float("inf")))
    return F.when(ok, kmh)


MODES = {"pedestrian": "foot", "micromobility": "bicycle", "vehicle": "motor_vehicle"}


def mode_access(mode: str, edge: dict[str, Column]) -> Column:
    """Why a directed edge is closed to a mode (foot, bicycle or motor_vehicle); null where it is open.

    edge: cleaned tags highway, access, foot, bicycle, motor_vehicle, oneway_bicycle, oneway_foot and
    oneway, against_oneway, reverse_of_two_way (booleans). Direction decides first, then the mode's
    own tag, the general tag, and the highway's class.
    """
    highway = F.when(edge["highway"] == "", "unclassified").otherwise(edge["highway"])
    general, modal = edge["access"], edge[mode]
    against, oneway, back = (F.coalesce(edge[k], F.lit(False)) for k in ("against_oneway", "oneway", "reverse_of_two_way"))
    closed = modal.isin(*DENIED)
    open_ = modal.isin(*ALLOWED)
    by_tag = F.when(closed, F.concat(F.lit(f"{mode}="), modal)).when((modal == "") & general.isin(*DENIED), F.concat(F.lit("access="), general))
    if mode == "motor_vehicle":
        return F.when(against, "against one-way traffic").otherwise(F.coalesce(by_tag, F.when(~open_ & highway.isin(*NON_MOTORISED), F.concat(highway, F.lit(" excludes motor vehicles")))))
    way = edge["oneway_bicycle" if mode == "bicycle" else "oneway_foot"]
    wrong = F.when(against & (way != "no"), "against one-way traffic") if mode == "bicycle" else F.when(against & way.isin(*ONE_WAY), "oneway:foot=yes")
    wrong = F.coalesce(wrong, F.when(~against & ~oneway & back & way.isin(*ONE_WAY), f"oneway:{mode}=yes"))
    by_class = F.when(~open_ & highway.isin(*CONTROLLED), F.concat(highway, F.lit(f" excludes {mode}")))
    if mode == "bicycle":
        by_class = F.coalesce(by_class, F.when(~open_ & highway.isin("steps", "corridor"), F.concat(highway, F.lit(" excludes bicycles"))))
    return F.coalesce(wrong, by_tag, by_class)


def reasons(edge: dict[str, Column]) -> Column:
    """Map from mode to why a directed edge is closed to it: tags are cleaned, and the rules decided, once for all profiles."""
    clean = {k: edge[k] if k in ("oneway", "against_oneway", "reverse_of_two_way") else tag(edge[k]) for k in edge}
    return F.create_map(*(x for mode in MODES.values() for x in (F.lit(mode), mode_access(mode, clean))))


def decision(why: Column, profile_key, lit) -> Column:
    """struct(allowed, reason, penalty) of a profile, from why its mode is kept out (null: it isn't)."""
    dark = (col(profile_key) == "night_walk") & (tag(lit) == "no")
    reason = F.coalesce(why, F.when(dark, "unlit night-walk link").otherwise("allowed"))
    return F.struct(why.isNull().alias("allowed"), reason.alias("reason"), F.when(why.isNull() & dark, 2.0).otherwise(1.0).alias("penalty"))


def edge_access(profile_key, category, edge: dict[str, Column]) -> Column:
    """struct(allowed, reason, penalty) of a directed edge for a profile; edge as in mode_access(), with lit, tags as they come."""
    clean = {k: edge[k] if k in ("oneway", "against_oneway", "reverse_of_two_way") else tag(edge[k]) for k in edge}
    why = F.when(mode_of(category) == "foot", mode_access("foot", clean)).when(mode_of(category) == "bicycle", mode_access("bicycle", clean)).otherwise(mode_access("motor_vehicle", clean))
    return decision(why, profile_key, edge["lit"])

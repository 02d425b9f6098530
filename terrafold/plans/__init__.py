"""Registered queries over the logical tables."""

from terrafold.plans import context, core, feeds, fire_weather, measures, more, places, profiles, recommend, records, shapes, streams
from terrafold.plans.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "context", "core", "feeds", "fire_weather", "measures", "more", "places", "profiles", "recommend", "records", "shapes", "streams"]

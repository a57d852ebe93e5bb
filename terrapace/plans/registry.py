"""All queries of the library but the corpus operators."""

from . import assets, choices, context, corridor, costs, equity, grids, journeys, matching, network, places, polyline, relief, scalar, tradeoffs, trips

QUERIES, ORACLES = {}, {}
for _plan in (assets, choices, context, corridor, costs, equity, grids, journeys, matching, network, places, polyline, relief, scalar, tradeoffs, trips):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES

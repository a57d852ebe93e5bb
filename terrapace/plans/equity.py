"""Queries of the accessibility and equity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import equity, running
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}


def _scores(spark, sf_dir):
    return equity.access_scores(view(spark, sf_dir, "zones"), view(spark, sf_dir, "facilities"))


def _rounded(df, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


_SQL = f"""{with_views('zones', 'facilities')},
near AS (SELECT zone_id, facility_id, population, capacity, (exp(-0.5e0 * pow(d / 1500e0, 2)) - exp(-0.5e0)) / (1 - exp(-0.5e0)) AS w FROM
 (SELECT z.*, f.facility_id, f.capacity, {sql_haversine('f.lon', 'f.lat', 'z.lon', 'z.lat')} AS d FROM zones z, facilities f) WHERE d <= 1500),
ratio AS (SELECT facility_id, CASE WHEN sum(population * w) > 0 THEN any_value(capacity) / sum(population * w) ELSE 0 END AS r FROM near GROUP BY 1),
s AS (SELECT z.zone_id, z.population, coalesce(x.score, 0e0) AS score FROM zones z LEFT JOIN (SELECT zone_id, sum(r * w) AS score FROM near JOIN ratio USING (facility_id) GROUP BY 1) x USING (zone_id)),
r AS (SELECT *, sum(population) OVER o / sum(population) OVER () AS p, sum(population * score) OVER o / sum(population * score) OVER () AS a, row_number() OVER o AS i, count(*) OVER () AS n, median(score) OVER () AS m,
 sum(population * score) OVER () / sum(population) OVER () AS mean, population / sum(population) OVER () AS share FROM s WINDOW o AS (ORDER BY round(score, 9), zone_id ROWS UNBOUNDED PRECEDING))
"""
QUERIES["e2sfca_scorecard"] = lambda spark, sf_dir: _rounded(equity.scorecard(_scores(spark, sf_dir)), score=6, pct_rank=6)
ORACLES["e2sfca_scorecard"] = _SQL + "SELECT zone_id, round(score, 6) AS score, round(100 * p, 6) AS pct_rank, CASE WHEN score <= 0.0001e0 THEN 'Transit Desert' WHEN score < 0.5e0 * m THEN 'Underserved' WHEN score < 1.5e0 * m THEN 'Adequate' ELSE 'Mobility Oasis' END AS tier FROM r"
QUERIES["a15_inequality"] = lambda spark, sf_dir: _rounded(equity.inequality(_scores(spark, sf_dir)), gini=6, theil=6, palma=6, mean=6, median=6)
ORACLES["a15_inequality"] = _SQL + """, q AS (SELECT *, coalesce(lag(p) OVER (ORDER BY i), 0) AS p0, coalesce(lag(a) OVER (ORDER BY i), 0) AS a0 FROM r)
SELECT round(1 - sum((p - p0) * (a + a0)), 6) AS gini, round(greatest(0e0, sum(CASE WHEN score > 0 THEN share * score / mean * ln(score / mean) ELSE 0 END)), 6) AS theil,
 round(sum(CASE WHEN p >= 0.9e0 THEN score * population ELSE 0 END) / sum(CASE WHEN p <= 0.4e0 THEN score * population ELSE 0 END), 6) AS palma, round(any_value(mean), 6) AS mean, round(any_value(m), 6) AS median FROM q"""
QUERIES["a16_lorenz"] = lambda spark, sf_dir: equity.lorenz(_scores(spark, sf_dir))
ORACLES["a16_lorenz"] = _SQL + "SELECT round(p, 4) AS pop_share, round(a, 4) AS acc_share FROM r WHERE (i - 1) % greatest(1, n // 20) = 0 OR i = n UNION ALL SELECT 0e0, 0e0"
QUERIES["a20_tier_counts"] = lambda spark, sf_dir: equity.scorecard(_scores(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("zones"))
ORACLES["a20_tier_counts"] = _SQL + "SELECT CASE WHEN score <= 0.0001e0 THEN 'Transit Desert' WHEN score < 0.5e0 * m THEN 'Underserved' WHEN score < 1.5e0 * m THEN 'Adequate' ELSE 'Mobility Oasis' END AS tier, count(*) AS zones FROM r GROUP BY 1"
QUERIES["a14_gini"] = lambda spark, sf_dir: _rounded(equity.gini(view(spark, sf_dir, "zones"), "population"), gini=6)
ORACLES["a14_gini"] = with_views("zones") + " SELECT round(2 * sum(i * population) / (count(*) * sum(population)) - (count(*) + 1e0) / count(*), 6) AS gini FROM (SELECT population, row_number() OVER (ORDER BY population) AS i FROM zones)"


def _median(spark, sf_dir):
    numbered = running.running_totals(view(spark, sf_dir, "zones").select("population", "zone_id"), ["population", "zone_id"], {"position": "1L"})
    return running.median(numbered, "population", "position").select(F.round("median", 6).alias("median"))


QUERIES["a19_median"] = _median
ORACLES["a19_median"] = with_views("zones") + " SELECT round(median(population), 6) AS median FROM zones"

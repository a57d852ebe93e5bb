"""Queries of map matching: every track on the streets of the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import matching
from ..sources.fixtures import view, with_views
from .scalar import sql_haversine

QUERIES, ORACLES = {}, {}
RADIUS_M = 35.0


def _points(spark, sf_dir):
    return view(spark, sf_dir, "tracks").select("track_id", "seq", "lon", "lat")


def _candidates(spark, sf_dir):
    found = matching.edge_candidates(_points(spark, sf_dir), view(spark, sf_dir, "grid_segments"), RADIUS_M)
    return found.select("track_id", "seq", "place", "u", "v", F.round("residual_m", 3).alias("residual_m"), F.round("share", 4).alias("share"), F.round("z", 3).alias("z"))


def _matched(spark, sf_dir):
    nodes = view(spark, sf_dir, "grid_nodes").select(F.col("node_id").alias("node"), "lon", "lat", "z")
    return matching.match_tracks(_points(spark, sf_dir), view(spark, sf_dir, "grid_segments"), nodes, RADIUS_M)


QUERIES["j12_edge_candidates"] = _candidates
QUERIES["g25_matched_points"] = lambda spark, sf_dir: _matched(spark, sf_dir).select("track_id", "seq", "u", "v", rounded("lon", 7).alias("lon"), rounded("lat", 7).alias("lat"), F.round("residual_m", 3).alias("residual_m"))
QUERIES["g25_map_matching"] = lambda spark, sf_dir: matching.match_summary(_matched(spark, sf_dir)).select("track_id", "points", *(F.round(c, 3).alias(c) for c in ("mean_error_m", "metres", "gain_m")))

_D = sql_haversine
_CANDIDATES = f"""{with_views('grid_segments', 'tracks')},
pts AS MATERIALIZED (SELECT * FROM (SELECT track_id, seq, lon, lat, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY track_id) AS m FROM tracks) WHERE m > 1),
feet AS (SELECT *, CASE WHEN ex * ex + ey * ey >= 1e-12 THEN greatest(0e0, least(1e0, ((plon - lon1) * k * ex + (plat - lat1) * ey) / (ex * ex + ey * ey))) ELSE 0e0 END AS share
 FROM (SELECT p.track_id, p.seq, p.lon AS plon, p.lat AS plat, g.*, cos(radians((lat1 + lat2) / 2)) AS k, (lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) AS ex, lat2 - lat1 AS ey
 FROM tracks p JOIN grid_segments g ON p.lon >= least(lon1, lon2) - 0.0005e0 AND p.lon <= greatest(lon1, lon2) + 0.0005e0 AND p.lat >= least(lat1, lat2) - 0.0005e0 AND p.lat <= greatest(lat1, lat2) + 0.0005e0)),
spots AS (SELECT *, lon1 + share * (lon2 - lon1) AS lon, lat1 + share * (lat2 - lat1) AS lat, z1 + share * (z2 - z1) AS z, {_D('lon1', 'lat1', 'lon2', 'lat2')} AS len FROM feet),
near AS (SELECT *, {_D('plon', 'plat', 'lon', 'lat')} AS r FROM spots),
found AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seq ORDER BY cast(round(r * 1000) AS BIGINT), u, v) AS place FROM near WHERE r <= {RADIUS_M}) WHERE place <= 10)"""
ORACLES["j12_edge_candidates"] = _CANDIDATES + " SELECT track_id, seq, place, u, v, round(r, 3) AS residual_m, round(share, 4) AS share, round(z, 3) AS z FROM found"
_MATCHED = f"""{_CANDIDATES},
bare AS MATERIALIZED (SELECT p.track_id, p.seq, p.lon AS plon, p.lat AS plat, arg_min(g.node_id, struct_pack(d := {_D('p.lon', 'p.lat', 'g.lon', 'g.lat')}, n := g.node_id)) AS node FROM pts p ANTI JOIN found f USING (track_id, seq), grid_nodes g GROUP BY ALL),
cand AS (SELECT track_id, seq, plon, plat, u, v, lon, lat, z, r, share, len, place FROM found UNION ALL
 SELECT track_id, seq, plon, plat, node, node, lon, lat, z, {_D('plon', 'plat', 'lon', 'lat')}, 0e0, 1e0, 1 FROM bare JOIN grid_nodes ON node_id = node),
c AS MATERIALIZED (SELECT c.*, p.n, CASE WHEN u = v THEN 0 ELSE -15 * cast(round(r * 1000) AS BIGINT) * cast(round(r * 1000) AS BIGINT) END AS emit FROM cand c JOIN pts p USING (track_id, seq)),
hops AS MATERIALIZED (SELECT b.track_id, b.n, a.place AS i, b.place AS j, b.emit, {_D('a.plon', 'a.plat', 'b.plon', 'b.plat')} AS straight, {_D('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS apart,
 CASE WHEN least(a.u, a.v) = least(b.u, b.v) AND greatest(a.u, a.v) = greatest(b.u, b.v) THEN abs(b.share - CASE WHEN a.u = b.u THEN a.share ELSE 1 - a.share END) * b.len END AS same,
 a.u AS au, a.v AS av, a.share * a.len AS ou, (1 - a.share) * a.len AS ov, b.u AS bu, b.v AS bv, b.share * b.len AS iu, (1 - b.share) * b.len AS iv
 FROM c a JOIN c b ON b.track_id = a.track_id AND b.n = a.n + 1),
ways AS MATERIALIZED (SELECT track_id, n, i, j, 3 * straight + {4 * RADIUS_M} AS bound, unnest([au, au, av, av]) AS tree, unnest([bu, bv, bu, bv]) AS node, unnest([ou, ou, ov, ov]) AS o, unnest([iu, iv, iu, iv]) AS t FROM hops WHERE same IS NULL),
w AS MATERIALIZED (SELECT u, v, min({_D('lon1', 'lat1', 'lon2', 'lat2')}) AS c FROM (SELECT u, v, lon1, lat1, lon2, lat2 FROM grid_segments UNION ALL SELECT v, u, lon1, lat1, lon2, lat2 FROM grid_segments) GROUP BY 1, 2),
starts AS MATERIALIZED (SELECT tree, max(bound - o) AS most FROM ways GROUP BY 1),
reach(tree, node, c) USING KEY (tree, node) AS (SELECT tree, tree AS node, 0e0 AS c FROM starts WHERE most >= 0 UNION
 SELECT p.tree, w.v, min(p.c + w.c) FROM reach p JOIN w ON w.u = p.node JOIN starts s ON s.tree = p.tree LEFT JOIN recurring.reach r ON r.tree = p.tree AND r.node = w.v WHERE p.c + w.c <= s.most AND (r.c IS NULL OR p.c + w.c < r.c) GROUP BY 1, 2),
along AS MATERIALIZED (SELECT track_id, n, i, j, min(o + c + t) AS d FROM ways JOIN reach USING (tree, node) WHERE o + c <= bound GROUP BY 1, 2, 3, 4),
moves AS MATERIALIZED (SELECT track_id, n, i, j, emit - 165649 * abs(cast(round(straight * 1000) AS BIGINT) - cast(round(coalesce(same, d, 3 * straight + {4 * RADIUS_M} + apart) * 1000) AS BIGINT)) AS score FROM hops LEFT JOIN along USING (track_id, n, i, j)),
vit AS (SELECT track_id, n, place AS j, emit::BIGINT AS s, 0::BIGINT AS b FROM c WHERE n = 0 UNION ALL
 SELECT m.track_id, m.n, m.j, max(v.s + m.score)::BIGINT, arg_max(m.i, struct_pack(s := v.s + m.score, i := -m.i)) FROM vit v JOIN moves m ON m.track_id = v.track_id AND m.n = v.n + 1 AND m.i = v.j GROUP BY 1, 2, 3),
way AS (SELECT track_id, n, arg_max(j, struct_pack(s := s, i := -j)) AS j FROM vit JOIN (SELECT track_id, max(n) AS n FROM pts GROUP BY 1) USING (track_id, n) GROUP BY 1, 2 UNION ALL
 SELECT v.track_id, v.n - 1, v.b FROM way y JOIN vit v ON v.track_id = y.track_id AND v.n = y.n AND v.j = y.j WHERE v.n > 0),
matched AS (SELECT c.* FROM way JOIN c ON c.track_id = way.track_id AND c.n = way.n AND c.place = way.j)"""
ORACLES["g25_matched_points"] = _MATCHED + " SELECT track_id, seq, u, v, round(lon, 7) AS lon, round(lat, 7) AS lat, round(r, 3) AS residual_m FROM matched"
ORACLES["g25_map_matching"] = (
    _MATCHED
    + f" SELECT b.track_id, count(*) AS points, round(avg(b.r), 3) AS mean_error_m, round(sum(CASE WHEN a.n >= 0 THEN {_D('a.lon', 'a.lat', 'b.lon', 'b.lat')} END), 3) AS metres, round(sum(greatest(0e0, b.z - a.z)), 3) AS gain_m FROM matched b LEFT JOIN matched a ON a.track_id = b.track_id AND a.n = b.n - 1 GROUP BY 1"
)

"""Vector search over embeddings, and geography over points derived from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import vectors as V
from ..operators import knn as K
from .base import Registry, table

R = Registry()


def _e(s, d):
    return table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _q(s, d, i=7):
    return [float(x) for x in table(s, d, "embeddings").where(f"vec_id = {i}").first()["embedding"]]


_QV = "(select embedding::double[] as q from embeddings where vec_id = 7)"
_DOT = "list_dot_product(embedding::double[], q)"
_D2 = "list_sum([(x - y) * (x - y) for x, y in list_zip(a, b)])"
_SIM = {
    "euclidean": "1 / (1 + pow(list_distance(embedding::double[], q), 2))",
    "dot_product": f"greatest(0, (1 + {_DOT}) / 2)",
    "cosine": "greatest(0, (1 + list_cosine_similarity(embedding::double[], q)) / 2)",
    "maximum_inner_product": f"case when {_DOT} < 0 then 1 / (1 - {_DOT}) else {_DOT} + 1 end",
}
for _n, _s in _SIM.items():
    R.add(f"knn_{_n}", f"select doc_id, round(score, 6) as score from (select vec_id as doc_id, {_s} as score from embeddings, {_QV}) order by score desc, doc_id limit 10")(lambda s, d, f=_n: K.knn(_e(s, d), "embedding", _q(s, d), 10, f).withColumn("score", F.round("score", 6)))
    R.add(f"vector_scores_{_n}", f"select vec_id as doc_id, round({_s}, 6) as score from embeddings, {_QV}")(lambda s, d, f=_n: K.scores(_e(s, d), "embedding", _q(s, d), f).withColumn("score", F.round("score", 6)))
R.add("knn_filtered", f"select doc_id, round(score, 6) as score from (select vec_id as doc_id, {_SIM['cosine']} as score from embeddings, {_QV} where label = 2) order by score desc, doc_id limit 10")(lambda s, d: K.knn(_e(s, d), "embedding", _q(s, d), 10, "cosine", where=F.col("label") == 2).withColumn("score", F.round("score", 6)))
R.add("vector_threshold", f"select vec_id as doc_id, round({_SIM['cosine']}, 6) as score from embeddings, {_QV} where {_SIM['cosine']} >= 0.6")(lambda s, d: K.above(_e(s, d), "embedding", _q(s, d), 0.6, "cosine").withColumn("score", F.round("score", 6)))
R.add("knn_diversified", f"select doc_id, parent, round(score, 6) as score from (select vec_id as doc_id, label as parent, {_SIM['cosine']} as score, row_number() over (partition by label order by {_SIM['cosine']} desc, vec_id) as r from embeddings, {_QV}) where r = 1 order by score desc, doc_id limit 3")(lambda s, d: K.diversified(_e(s, d), "embedding", _q(s, d), 3, "label", "cosine").withColumn("score", F.round("score", 6)))
_BYTES = "[round(x * 100)::int for x in embedding]"
R.add("knn_bytes", f"select doc_id, round(score, 6) as score from (select vec_id as doc_id, 0.5 + list_dot_product({_BYTES}::double[], b) / (64 * 32768.0) as score from embeddings, (select {_BYTES}::double[] as b from embeddings where vec_id = 7)) order by score desc, doc_id limit 10")(
    lambda s, d: K.knn_bytes(_e(s, d).withColumn("v", F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int"))), "v", [int(r) for r in table(s, d, "embeddings").where("vec_id = 7").select(F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int")).alias("v")).first()["v"]], 10, "dot_product").withColumn("score", F.round("score", 6))
)
R.add("vector_normalise", "select vec_id as doc_id, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings")(lambda s, d: _e(s, d).select("doc_id", F.round(F.get(V.normalise(F.col("embedding")), 0), 6).alias("first")))
R.add("vector_quantised", "select vec_id as doc_id, floor((least(greatest(embedding[1]::double, -0.4), 0.4) + 0.4) / (0.8 / 127) + 0.5)::int as first from embeddings")(lambda s, d: _e(s, d).select("doc_id", F.get(V.quantise(F.col("embedding"), -0.4, 0.4), 0).alias("first")))
R.add("knn_approximate")(lambda s, d: K.approximate(_e(s, d), "embedding", _q(s, d), 10, 6, 3))

# Points: latitude and longitude made from a part's key and size.
_PT = "(select p_partkey as doc_id, (p_partkey * 37 % 1700) / 10.0 - 85 as lat, (p_partkey * 91 + p_size * 13) % 3600 / 10.0 - 180 as lon from part)"


def _points(s, d):
    return table(s, d, "part").selectExpr("p_partkey as doc_id", "(p_partkey * 37 % 1700) / 10.0D - 85 as lat", "(p_partkey * 91 + p_size * 13) % 3600 / 10.0D - 180 as lon")


_HAV = "2 * 6371008.7714 * asin(sqrt(least(1, pow(sin((radians({1}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({1})) * pow(sin(radians({0} - lon) / 2), 2))))"
_D = _HAV.format(10, 40)
R.add("geo_box", f"select doc_id from {_PT} where lat between -10 and 45 and lon between 20 and 100")(lambda s, d: _points(s, d).where(geo.in_box(F.col("lat"), F.col("lon"), -10, 45, 20, 100)).select("doc_id"))
R.add("geo_box_dateline", f"select doc_id from {_PT} where lat between -10 and 45 and (lon >= 170 or lon <= -150)")(lambda s, d: _points(s, d).where(geo.in_box(F.col("lat"), F.col("lon"), -10, 45, 170, -150)).select("doc_id"))
R.add("geo_distance", f"select doc_id from {_PT} where {_D} <= 2500000")(lambda s, d: _points(s, d).where(geo.within_distance(F.col("lat"), F.col("lon"), 40, 10, 2_500_000)).select("doc_id"))
R.add("geo_distance_range", f"select doc_id from {_PT} where {_D} between 1000000 and 2500000")(lambda s, d: _points(s, d).where(geo.haversine(F.col("lat"), F.col("lon"), 40, 10).between(1e6, 2.5e6)).select("doc_id"))
R.add("geo_distance_sort", f"select doc_id, round({_D}, 3) as metres from {_PT} order by {_D}, doc_id limit 20")(lambda s, d: _points(s, d).select("doc_id", geo.haversine(F.col("lat"), F.col("lon"), 40, 10).alias("m")).orderBy("m", "doc_id").limit(20).select("doc_id", F.round("m", 3).alias("metres")))
_TRI = [(0.0, 0.0), (0.0, 80.0), (60.0, 40.0), (0.0, 0.0)]
R.add("geo_polygon", f"select doc_id from {_PT} where lat >= 0 and lat <= 60 and lon >= lat * 40 / 60 and lon <= 80 - lat * 40 / 60")(lambda s, d: _points(s, d).where(geo.in_polygon(F.col("lat"), F.col("lon"), _TRI)).select("doc_id"))
R.add("geo_polygon_hole", f"select doc_id from {_PT} where lat between 0 and 50 and lon between 0 and 80 and not (lat > 10 and lat < 30 and lon > 20 and lon < 60)")(lambda s, d: _points(s, d).where(geo.in_polygon(F.col("lat"), F.col("lon"), [(0.0, 0.0), (0.0, 80.0), (50.0, 80.0), (50.0, 0.0), (0.0, 0.0)], [[(10.0, 20.0), (10.0, 60.0), (30.0, 60.0), (30.0, 20.0), (10.0, 20.0)]])).select("doc_id"))
R.add("xy_distance", "select p_partkey as doc_id from part where sqrt(pow(p_size - 20, 2) + pow(p_retailprice / 100 - 10, 2)) <= 5")(lambda s, d: table(s, d, "part").where(geo.euclidean(F.col("p_size"), F.col("p_retailprice") / 100, 20, 10) <= 5).selectExpr("p_partkey doc_id"))
R.add("xy_distance_sort", "select p_partkey as doc_id from part order by sqrt(pow(p_size - 20, 2) + pow(p_retailprice / 100 - 10, 2)), p_partkey limit 10")(lambda s, d: table(s, d, "part").orderBy(geo.euclidean(F.col("p_size"), F.col("p_retailprice") / 100, 20, 10), "p_partkey").limit(10).selectExpr("p_partkey doc_id"))
R.add("geo_encode", f"select doc_id, least(floor(lat / (180.0 / 4294967296)), 2147483647)::bigint as y, least(floor(lon / (360.0 / 4294967296)), 2147483647)::bigint as x from {_PT}")(lambda s, d: _points(s, d).select("doc_id", geo.encode_latitude(F.col("lat")).alias("y"), geo.encode_longitude(F.col("lon")).alias("x")))
R.add("geo_heatmap", f"select least(floor((90 - lat) / 22.5), 7)::int as row, least(floor((lon + 180) / 22.5), 15)::int as col, count(*)::bigint as count from {_PT} group by 1, 2")(lambda s, d: _points(s, d).groupBy(*[c.alias(n) for c, n in zip(geo.heatmap_cell(F.col("lat"), F.col("lon"), 8, 16), ("row", "col"), strict=True)]).agg(F.count("*").alias("count")))
R.add("geo_quad_grid", f"select ((least(floor((90 - lat) / 180 * 2), 1) * 2 + least(floor((lon + 180) / 360 * 2), 1))::int)::varchar as cell, count(*)::bigint as count from {_PT} group by 1")(lambda s, d: _points(s, d).groupBy(geo.quad_cell(F.col("lat"), F.col("lon"), 1).alias("cell")).agg(F.count("*").alias("count")))
R.add("geo_quad_prefix", f"select count(*)::bigint as n from {_PT} where lat > 45 and lon < -90")(lambda s, d: _points(s, d).where(geo.quad_cell(F.col("lat"), F.col("lon"), 6).startswith("00")).agg(F.count("*").alias("n")))
def _bit(k: int) -> str:
    """The k-th bit of a point's geohash of three characters: longitude's 8 and latitude's 7 bits in turn."""
    return f"(x >> {7 - k // 2}) % 2" if k % 2 == 0 else f"(y >> {6 - k // 2}) % 2"


_CHARS = " || ".join(f"substring('{geo.BASE32}', (" + " + ".join(f"{16 >> k} * ({_bit(5 * i + k)})" for k in range(5)) + " + 1)::bigint, 1)" for i in range(3))
R.add("geo_geohash", f"select {_CHARS} as cell, count(*)::bigint as count from (select least(floor((lon + 180) / 360 * 256), 255)::bigint as x, least(floor((lat + 90) / 180 * 128), 127)::bigint as y from {_PT}) group by 1")(lambda s, d: _points(s, d).groupBy(geo.geohash(F.col("lat"), F.col("lon"), 3).alias("cell")).agg(F.count("*").alias("count")))
_RECT = "(select p_partkey as doc_id, p_size as y1, p_size + 4 as y2, p_partkey % 50 as x1, p_partkey % 50 + 6 as x2 from part)"
_REL = {"intersects": "(y1 <= 30 and y2 >= 20 and x1 <= 30 and x2 >= 10)", "is_within": "(y1 >= 20 and y2 <= 30 and x1 >= 10 and x2 <= 30)", "contains": "(y1 <= 20 and y2 >= 30 and x1 <= 10 and x2 >= 30)"}
_REL["is_disjoint_to"] = f"not {_REL['intersects']}"
_REL["equals"] = "(y1 = 20 and y2 = 30 and x1 = 10 and x2 = 30)"
_REL["overlaps"] = f"({_REL['intersects']} and not {_REL['is_within']} and not {_REL['contains']})"
for _n, _s in _REL.items():
    R.add(f"bbox_{_n}", f"select doc_id from {_RECT} where {_s}")(lambda s, d, o=_n: _rects(s, d).where(geo.box_relation((F.col("y1"), F.col("x1")), (F.col("y2"), F.col("x2")), (20, 10), (30, 30), o)).select("doc_id"))
R.add("bbox_overlap_ratio", f"select doc_id, round((w * h / 24.0) * (w * h / 200.0), 6) as ratio from (select doc_id, greatest(0, least(y2, 30) - greatest(y1, 20)) as h, greatest(0, least(x2, 30) - greatest(x1, 10)) as w from {_RECT})")(lambda s, d: _rects(s, d).select("doc_id", F.round(geo.overlap_ratio((F.col("y1"), F.col("x1")), (F.col("y2"), F.col("x2")), (20, 10), (30, 30)), 6).alias("ratio")))
# Shapes hold their edges, so that touching is intersecting and a shared edge may be within.
R.add("geo_shape_relation", f"select doc_id, case when {_REL['is_within']} then 'within' when {_REL['contains']} then 'contains' when {_REL['intersects']} then 'intersects' else 'disjoint' end as relation from {_RECT}")(
    lambda s, d: _rects(s, d).select("doc_id", geo.shape_relation(F.concat(F.lit("ENVELOPE("), F.concat_ws(",", "x1", "x2", "y2", "y1"), F.lit(")")), "ENVELOPE(10,30,30,20)").alias("relation"))
)
R.add("geo3d_arc", f"select doc_id from {_PT} where cos(radians(lat)) * cos(radians(lon)) >= cos(0.5)")(lambda s, d: _points(s, d).where(geo.arc_distance(geo.to_xyz(F.col("lat"), F.col("lon")), (1.0, 0.0, 0.0)) <= 0.5).select("doc_id"))
R.add("geo3d_ellipsoid", f"select doc_id, round((6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2))) * cos(radians(lat)) * cos(radians(lon)), 2) as x from {_PT}")(lambda s, d: _points(s, d).select("doc_id", F.round(geo.ellipsoid_xyz(F.col("lat"), F.col("lon"))[0], 2).alias("x")))


def _rects(s, d):
    return table(s, d, "part").selectExpr("p_partkey as doc_id", "p_size as y1", "p_size + 4 as y2", "p_partkey % 50 as x1", "p_partkey % 50 + 6 as x2")


QUERIES, ORACLES = R.queries, R.oracles

"""Sequences, splits, encoders and scalers on the given tables."""

from pyspark.sql import functions as F

from headway.catalog.base import query, r6, rounded
from headway.catalog.windowed import GRID, grid, order
from headway.operators import scaling as sc, sequences as sq, splits as sp
from headway.operators.spans import daily, hourly


def _win(part: str, n: int = 11, extra: str = "") -> str:
    """First input, last input and last target of every full window of eleven rows."""
    return f"""SELECT obs_id, {extra} delay AS x_first, lead(delay, 7) OVER w AS x_last, lead(delay, {n - 1}) OVER w AS y_last, lead(hour_of_day, 7) OVER w AS h_last,
lead(obs_id, {n - 1}) OVER w AS end_id FROM obs WINDOW w AS (PARTITION BY {part} ORDER BY ts, obs_id)"""


def shown(d, keys):
    return d.select(
        *keys, F.col("first_obs_id").alias("obs_id"), F.get(F.get("x", F.lit(0)), F.lit(0)).alias("x_first"),
        F.get(F.get("x", F.lit(7)), F.lit(0)).alias("x_last"), F.get("y", F.lit(2)).alias("y_last"),
        F.get(F.get("x", F.lit(7)), F.lit(1)).cast("int").alias("h_last"), F.col("last_obs_id").alias("end_id"),
        F.size("x").alias("steps"), F.size("y").alias("targets"),
    )


FEATS = ["delay", "hour_of_day"]


@query("qs1_route_windows", "obs", f", w AS ({_win('route_id, direction_id', extra='route_id, direction_id,')}) SELECT *, 8 AS steps, 3 AS targets FROM w WHERE end_id IS NOT NULL")
def _(t):
    d = sq.windows(t.obs, ["route_id", "direction_id"], ["ts", "obs_id"], hourly("ts"), FEATS, "delay", marks=["obs_id"])
    return shown(d, ["route_id", "direction_id"])


@query("qs2_stop_windows", "obs", f", w AS ({_win('direction_id, stop_id', extra='direction_id, stop_id,')}) SELECT *, 8 AS steps, 3 AS targets FROM w WHERE end_id IS NOT NULL")
def _(t):
    d = sq.windows(t.obs, ["direction_id", "stop_id"], ["ts", "obs_id"], daily("ts"), FEATS, "delay", marks=["obs_id"])
    return shown(d, ["direction_id", "stop_id"])


@query("qs3_latest_windows", "obs", """, r AS (SELECT *, row_number() OVER (PARTITION BY stop_id, route_id ORDER BY ts DESC, obs_id DESC) AS rn FROM obs)
SELECT stop_id, route_id, round(sum(delay) + 1e-9, 6) AS total, min(obs_id) AS first_obs_id, max(obs_id) AS last_obs_id FROM r WHERE rn <= 8 GROUP BY 1, 2 HAVING count(*) = 8""")
def _(t):
    d = sq.windows(t.obs, ["stop_id", "route_id"], ["ts", "obs_id"], [], FEATS, "delay", mode="latest", marks=["obs_id"])
    total = F.aggregate(F.transform("x", lambda s: F.get(s, F.lit(0))), F.lit(0.0), lambda a, v: a + v)
    return d.select("stop_id", "route_id", r6(total).alias("total"), "first_obs_id", "last_obs_id")


@query("qs4_trip_windows", "upd", """, o AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS len, lead(price, 5) OVER w AS end_price, lead(stop_sequence, 5) OVER w AS end_stop_sequence,
lead(delay, 3) OVER w AS x_last, lead(delay, 5) OVER w AS y_last FROM upd WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, feed_time, price))
SELECT trip_id, stop_sequence AS start_stop_sequence, end_stop_sequence, price AS start_price, x_last, y_last FROM o WHERE end_price IS NOT NULL AND len >= 8""")
def _(t):
    d = sq.windows(t.upd, ["trip_id"], ["stop_sequence", "feed_time", "price"], None, ["delay", "pred"], "delay", 4, 2, min_len=8, marks=["stop_sequence", "price"])
    return d.select("trip_id", F.col("first_stop_sequence").alias("start_stop_sequence"), F.col("last_stop_sequence").alias("end_stop_sequence"),
                    F.col("first_price").alias("start_price"), F.get(F.get("x", F.lit(3)), F.lit(0)).alias("x_last"), F.get("y", F.lit(1)).alias("y_last"))


def past(t, n=3, features=()):
    d = t.upd.withColumn("route", F.col("trip_id") % 40)
    return sq.past_trips(d, "route", "trip_id", "feed_time", "stop_sequence", "delay", n, features=features)


PAST = """, c AS (SELECT trip_id % 40 AS route, trip_id, stop_sequence, arg_min(delay, (feed_time, delay)) AS v, min(feed_time) AS t FROM upd GROUP BY 1, 2, 3),
tr AS (SELECT route, trip_id, min(t) AS first_time FROM c GROUP BY 1, 2), sl AS (SELECT DISTINCT route, stop_sequence FROM c),
m AS (SELECT tr.route, tr.trip_id, tr.first_time, sl.stop_sequence, coalesce(last_value(c.v IGNORE NULLS) OVER (PARTITION BY tr.route, tr.trip_id ORDER BY sl.stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v
 FROM tr JOIN sl USING (route) LEFT JOIN c ON c.route = tr.route AND c.trip_id = tr.trip_id AND c.stop_sequence = sl.stop_sequence),
a AS (SELECT route, trip_id, first_time, sum(v) AS s, sum(v * v) AS ss, max(v) AS mx, count(*) AS n FROM m GROUP BY 1, 2, 3),
p AS (SELECT route, trip_id, s AS own, count(*) OVER w AS have, sum(s) OVER w AS s, sum(ss) OVER w AS ss, max(mx) OVER w AS mx, sum(n) OVER w AS n, lag(s, 1) OVER o / n AS near, lag(s, 3) OVER o / n AS far FROM a
 WINDOW w AS (PARTITION BY route ORDER BY first_time, trip_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY route ORDER BY first_time, trip_id))"""


@query("qs5_past_trips", "upd", PAST + """ SELECT route, trip_id, round(s / n + 1e-9, 6) AS past_mean, round(sqrt(greatest(ss / n - (s / n) * (s / n), 0)) + 1e-9, 4) AS past_std, round(near - far + 1e-9, 6) AS past_trend,
round(mx + 1e-9, 6) AS past_max, round(own + 1e-9, 6) AS target_sum, tf.price AS target_price, coalesce(tf.gap, 0) AS target_gap FROM p
JOIN (SELECT trip_id % 40 AS route, trip_id, arg_min(price, (feed_time, stop_sequence, price)) AS price, arg_min(pred, (feed_time, stop_sequence, pred)) FILTER (WHERE pred > 0) AS gap FROM upd GROUP BY 1, 2) tf USING (route, trip_id) WHERE have = 3""")
def _(t):
    d = t.upd.withColumns({"route": F.col("trip_id") % 40, "gap": F.when(F.col("pred") > 0, F.col("pred"))})
    d = sq.past_trips(d, "route", "trip_id", "feed_time", "stop_sequence", "delay", 3, features=["price", "gap"])
    own = F.aggregate("target", F.lit(0.0), lambda a, v: a + v)
    d = d.select("route", "trip_id", "past_mean", F.round(F.col("past_std") + 1e-9, 4).alias("past_std"), "past_trend", "past_max", own.alias("target_sum"), F.get("features", F.lit(0)).alias("target_price"), F.get("features", F.lit(1)).alias("target_gap"))
    return rounded(d, "past_mean", "past_trend", "past_max", "target_sum")


@query("qs6_stop_lists", "upd", "SELECT trip_id, array_to_string(list_sort(list(DISTINCT stop_sequence)), '|') AS stops FROM upd GROUP BY 1")
def _(t):
    return sq.stop_lists(t.upd, "trip_id", "stop_sequence").select("trip_id", F.array_join(F.transform("stops", lambda v: v.cast("string")), "|").alias("stops"))


@query("qs7_grid_windows", "obs", GRID + """, w AS (SELECT route_id, ts, observed, delay AS next, lag(delay, 6) OVER o AS oldest, lag(delay, 1) OVER o AS newest, lag(ts, 6) OVER o AS t6 FROM f WINDOW o AS (PARTITION BY route_id ORDER BY ts))
SELECT route_id, ts, observed, round(next + 1e-9, 6) AS next, round(oldest + 1e-9, 6) AS oldest, round(newest + 1e-9, 6) AS newest FROM w WHERE t6 IS NOT NULL""")
def _(t):
    d = sq.grid_windows(grid(t), ["route_id"], "ts", "delay", daily("ts"))
    return rounded(d.select("route_id", "ts", "observed", "next", F.get("past", F.lit(0)).alias("oldest"), F.get("past", F.lit(5)).alias("newest")), "next", "oldest", "newest")


@query("qs8_stop_edges", "obs", ", e AS (SELECT stop_id AS src, lead(stop_id) OVER (PARTITION BY route_id ORDER BY ts, obs_id) AS dst FROM obs) SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL AND src <> dst")
def _(t):
    return sq.stop_edges(t.obs, ["route_id"], ["ts", "obs_id"], hourly("ts"), "stop_id")


@query("qs8_source_mask", "upd", """, e AS (SELECT stop_id AS src, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence, price) AS dst FROM upd), s AS (SELECT DISTINCT src FROM e WHERE dst IS NOT NULL AND src <> dst)
SELECT s_suppkey AS stop_id, CASE WHEN src IS NULL THEN 0 ELSE 1 END AS node_mask FROM supplier LEFT JOIN s ON src = s_suppkey""")
def _(t):
    e = sq.stop_edges(t.upd, ["trip_id"], ["stop_sequence", "price"], None, "stop_id")
    return sq.source_mask(t.stops, e, "stop_id")


@query("t01_split_temporal", "obs", "SELECT obs_id, CASE WHEN row_number() OVER (ORDER BY ts, obs_id) <= floor((SELECT count(*) FROM obs) * 0.9) THEN 'train' ELSE 'test' END AS split FROM obs")
def _(t):
    return sp.split_temporal(t.obs, order(), hourly("ts")).select("obs_id", "split")


@query("t02_split_groups", "upd", """, g AS (SELECT DISTINCT part_id FROM upd), r AS (SELECT part_id, CASE WHEN row_number() OVER (ORDER BY md5(part_id || '|42'), part_id) <= floor((SELECT count(*) FROM g) * 0.8) THEN 'train' ELSE 'test' END AS split FROM g)
SELECT trip_id, stop_sequence, price, split FROM upd JOIN r USING (part_id)""")
def _(t):
    return sp.split_groups(t.upd, ["part_id"]).select("trip_id", "stop_sequence", "price", "split")


@query("t03_split_stratified", "obs", """, n AS (SELECT route_id, count(*) AS n FROM obs GROUP BY 1) SELECT obs_id, CASE WHEN row_number() OVER (PARTITION BY route_id ORDER BY md5(obs_id || '|42'), obs_id) <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM obs JOIN n USING (route_id)""")
def _(t):
    return sp.split_stratified(t.obs, ["route_id"], ["obs_id"]).select("obs_id", "split")


@query("t04_split_random", "obs", "SELECT obs_id, CASE WHEN row_number() OVER (ORDER BY md5(obs_id || '|42'), obs_id) <= floor((SELECT count(*) FROM obs) * 0.9) THEN 'train' ELSE 'test' END AS split FROM obs")
def _(t):
    return sp.split_random(t.obs, ["obs_id"]).select("obs_id", "split")


@query("t05_split_method", "trips", "SELECT trip_id, CASE WHEN row_number() OVER (ORDER BY start_date, trip_id) <= floor((SELECT count(*) FROM trips) * 0.75) THEN 'train' ELSE 'test' END AS split FROM trips")
def _(t):
    d = sp.split(t.trips, "temporal", order=[F.col("start_date"), F.col("trip_id")], slices=[F.col("start_date")], ratio=0.75)
    return d.select("trip_id", "split")


@query("t06_split_dates", "trips", """, d AS (SELECT DISTINCT start_date FROM trips), i AS (SELECT start_date, row_number() OVER (ORDER BY start_date) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT trip_id, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.85e0) THEN 'valid' ELSE 'test' END AS split FROM trips JOIN i USING (start_date)""")
def _(t):
    return sp.split_dates(t.trips, "start_date").select("trip_id", "split")


@query("t07_trip_split", "upd", """, g AS (SELECT DISTINCT trip_id FROM upd), r AS (SELECT trip_id, CASE WHEN row_number() OVER (ORDER BY md5(trip_id || '|42'), trip_id) <= floor((SELECT count(*) FROM g) * 0.9) THEN 'train' ELSE 'test' END AS split FROM g)
SELECT split, count(*) AS n_rows, count(DISTINCT trip_id) AS n_trips FROM upd JOIN r USING (trip_id) GROUP BY 1""")
def _(t):
    d = sp.split_groups(t.upd, ["trip_id"], 0.9)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trip_id").alias("n_trips"))


FOLDS = """, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM obs), i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
f AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold), b AS (SELECT fold, 10 + fold * CAST(floor((n - 10 - 1) / 4) AS BIGINT) AS te, n FROM f, (SELECT max(n) AS n FROM i)),
x AS (SELECT fold, 'train' AS role, day FROM b, i WHERE i.i < te UNION ALL SELECT fold, 'test', day FROM b, i WHERE i.i >= te + 1 AND i.i < least(te + 4, b.n))"""


def folds(t):
    return sp.cv_folds(t.obs.withColumn("day", F.to_date("ts")), "day", 4, 10, 3, 1)


@query("t08_cv_folds", "obs", FOLDS + " SELECT * FROM x")
def _(t):
    return folds(t)


@query("t08_cv_folds_sliding", "obs", """, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM obs), i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
f AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold), b AS (SELECT fold, fold * greatest(1, (n - 14) // 2) AS s FROM f, (SELECT max(n) AS n FROM i))
SELECT fold, 'train' AS role, day FROM b, i WHERE i.i >= s AND i.i < s + 10 UNION ALL SELECT fold, 'test', day FROM b, i WHERE i.i >= s + 11 AND i.i < s + 14""")
def _(t):
    return sp.cv_folds(t.obs.withColumn("day", F.to_date("ts")), "day", 3, 10, 3, 1, "sliding")


@query("t09_split_report", "obs", """, g AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(obs_id || '|42'), obs_id) <= floor((SELECT count(*) FROM obs) * 0.9) THEN 'train' ELSE 'test' END AS split FROM obs),
sh AS (SELECT count(*) AS shared_groups FROM (SELECT stop_id FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT split, count(*) AS n_rows, count(DISTINCT stop_id) AS n_groups, count(*) FILTER (WHERE gappy IS NULL) AS n_null, round(avg(gappy) + 1e-9, 6) AS mean, round(stddev_samp(gappy) + 1e-9, 6) AS std,
min(gappy) AS "min", max(gappy) AS "max", round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM obs) + 1e-9, 6) AS share, max(shared_groups) AS shared_groups FROM g, sh GROUP BY 1""")
def _(t):
    return rounded(sp.split_report(sp.split_random(t.obs, ["obs_id"]), ["stop_id"], "gappy"), "mean", "std", "share")


@query("t10_fold_report", "obs", FOLDS + ", c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM obs GROUP BY 1) SELECT fold, role, min(day) AS first_date, max(day) AS last_date, count(*) AS n_dates, CAST(sum(c) AS BIGINT) AS n_rows FROM x JOIN c USING (day) GROUP BY 1, 2")
def _(t):
    return sp.fold_report(t.obs.withColumn("day", F.to_date("ts")), folds(t), "day")


@query("c06_label_encode", "", """WITH k AS (SELECT DISTINCT event_type AS x FROM events), c AS (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS code FROM k WHERE x <> 'view')
SELECT event_id, coalesce(code, -1) AS event_type_encoded FROM events LEFT JOIN c ON x = event_type""")
def _(t):
    e = t.raw("events")
    codes = sc.label_fit(e.where("event_type <> 'view'"), "event_type")
    return sc.label_apply(e, "event_type", codes).select("event_id", "event_type_encoded")


@query("c08_standard_scale", "upd", ", s AS (SELECT avg(delay) AS m, stddev_pop(delay) AS d FROM upd WHERE flag = 'A') SELECT trip_id, stop_sequence, price, round((delay - m) / d + 1e-9, 6) AS delay FROM upd, s")
def _(t):
    fit = sc.standard_fit(t.upd.where("flag = 'A'"), ["delay"])
    return rounded(sc.standard_apply(t.upd, fit, ["delay"]).select("trip_id", "stop_sequence", "price", "delay"), "delay")


@query("c08_standard_scale_steps", "", """WITH v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS d FROM v GROUP BY 1)
SELECT vec_id, round(sum(abs((v - m) / d)) + 1e-9, 4) AS total FROM v JOIN s USING (i) GROUP BY 1""")
def _(t):
    e = t.raw("embeddings").select("vec_id", F.array(F.transform("embedding", lambda v: v.cast("double"))).alias("x"))
    d = sc.standard_apply_steps(e, sc.standard_fit_steps(e))
    total = F.aggregate(F.transform(F.flatten("x"), lambda v: F.abs(v)), F.lit(0.0), lambda a, v: a + v)
    return d.select("vec_id", F.round(total + 1e-9, 4).alias("total"))


@query("c09_robust_scale", "upd", """, q AS (SELECT quantile_cont(delay, 0.5) AS m, quantile_cont(delay, 0.75) - quantile_cont(delay, 0.25) AS iqr FROM upd) SELECT trip_id, stop_sequence, price, round((delay - m) / iqr + 1e-9, 6) AS delay FROM upd, q""")
def _(t):
    d = sc.robust_apply(t.upd, sc.robust_fit(t.upd, ["delay", "pred"]), ["delay"])
    return rounded(d.select("trip_id", "stop_sequence", "price", "delay"), "delay")


@query("c10_poly2", "upd", "SELECT trip_id, stop_sequence, price, round(delay + delay * delay + pred + delay * pred + pred * pred + 1e-9, 4) AS total FROM upd")
def _(t):
    from pyspark.ml.functions import vector_to_array

    d = sc.poly2(sc.flatten_vector(t.upd, ["delay", "pred"]), "features")
    total = F.aggregate(vector_to_array("poly"), F.lit(0.0), lambda a, v: a + v)
    return d.select("trip_id", "stop_sequence", "price", F.round(total + 1e-9, 4).alias("total"))


@query("c11_flatten_vector", "", "SELECT vec_id, CAST(len(embedding) + 1 AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) + label + 1e-9, 5) AS total FROM embeddings")
def _(t):
    from pyspark.ml.functions import vector_to_array

    d = sc.flatten_vector(t.raw("embeddings"), ["embedding", "label"]).withColumn("v", vector_to_array("features"))
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + v)
    return d.select("vec_id", F.size("v").alias("width"), F.round(total + 1e-9, 5).alias("total"))

"""Queries of statistics, thresholds, selection, scaling, grids and information."""

import numpy as np
from pyspark.sql import functions as F

from cohortlake.functions.columns import component_count, sampling_interval
from cohortlake.operators import features as X
from cohortlake.operators import information as I
from cohortlake.operators import thresholds as T
from cohortlake.operators.aggregates import Mergeable
from cohortlake.plans import data as D
from cohortlake.plans.base import query, table


class ClassGap(Mergeable):
    """Mean of the values of class 1 less that of class 0."""

    def zero(self):
        return np.zeros(4)

    def update(self, state, values):
        x, y = values.T
        return state + [(y == 0).sum(), x[y == 0].sum(), (y == 1).sum(), x[y == 1].sum()]

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return state[3] / state[2] - state[1] / state[0]


def _round(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in cols})


@query("sample_stats", f"""WITH {D.FEAT}, m AS (SELECT sample_id, avg(value) AS mu, var_pop(value) AS v FROM feat GROUP BY 1)
SELECT sample_id, round(max(value), 6) + 0.0 AS max, round(min(value), 6) + 0.0 AS min, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var, round(median(value), 6) + 0.0 AS median,
 round(avg(pow(value - mu, 4)) / pow(any_value(v), 2) - 3, 6) + 0.0 AS kurtosis, round(avg(pow(value - mu, 3)) / pow(any_value(v), 1.5), 6) + 0.0 AS skewness FROM feat JOIN m USING (sample_id) GROUP BY 1""")
def q_stats(spark, sf):
    return _round(X.sample_stats(D.features(spark, sf)), "max", "min", "mean", "var", "median", "kurtosis", "skewness")


@query("hist3d", """WITH p AS (SELECT l_returnflag AS sample_id, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem),
 e AS (SELECT sample_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p GROUP BY 1),
 h AS (SELECT sample_id, least(floor((x - x0) / (x1 - x0) * 3), 2)::INT AS ax, least(floor((y - y0) / (y1 - y0) * 3), 2)::INT AS ay, least(floor((z - z0) / (z1 - z0) * 3), 2)::INT AS az, count(*) AS n FROM p JOIN e USING (sample_id) GROUP BY 1, 2, 3, 4)
SELECT sample_id, ax::INT AS bx, ay::INT AS "by", az::INT AS bz, coalesce(n, 0) AS n FROM (SELECT sample_id, ax, ay, az FROM e, range(0, 3) a(ax), range(0, 3) b(ay), range(0, 3) c(az)) LEFT JOIN h USING (sample_id, ax, ay, az)""")
def q_hist3d(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return X.hist3d(p, 3)


@query("feature_moments", f"WITH {D.FEAT}, {D.MOM} SELECT feature_id, y, n, round(mean, 6) + 0.0 AS mean, round(v * n, 5) + 0.0 AS m2 FROM mom")
def q_moments(spark, sf):
    return _round(_round(X.moments(D.features(spark, sf), D.labels(spark, sf)), "mean"), "m2", n=5)


@query("train_moments", f"WITH {D.FEAT} SELECT f.fold::INT AS fold, feature_id, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value) * count(*), 5) + 0.0 AS m2 FROM feat, range(0, 4) f(fold) WHERE sample_id % 4 <> f.fold GROUP BY 1, 2")
def q_train(spark, sf):
    lab = D.labels(spark, sf).select("sample_id", (F.col("sample_id") % 4).cast("int").alias("fold"))
    by = X.moments(D.features(spark, sf), lab, ("fold", "feature_id"))
    return _round(_round(X.train_moments(by, ("feature_id",)), "mean"), "m2", n=5)


@query("pearson_features", f"WITH {D.FEAT} SELECT feature_id, round(corr(value, y), 6) + 0.0 AS measure FROM feat JOIN lab USING (sample_id) GROUP BY 1")
def q_pearson(spark, sf):
    return _round(X.pearson_features(X.moments(D.features(spark, sf), D.labels(spark, sf))), "measure")


_PAIR = "pair AS (SELECT a.feature_id, a.n AS na, b.n AS nb, a.mean AS ma, b.mean AS mb, a.v AS va, b.v AS vb FROM mom a JOIN mom b ON a.feature_id = b.feature_id AND a.y < b.y)"


@query("bhattacharyya_features", f"WITH {D.FEAT}, {D.MOM}, {_PAIR} SELECT feature_id, round(greatest(max(0.25 * pow(ma - mb, 2) / (va + vb) + 0.5 * ln((va + vb) / (2 * sqrt(va) * sqrt(vb)))), 0), 6) + 0.0 AS measure FROM pair GROUP BY 1")
def q_bhatt(spark, sf):
    return _round(X.bhattacharyya_features(X.moments(D.features(spark, sf), D.labels(spark, sf))), "measure")


@query("welch_features", f"WITH {D.FEAT}, {D.MOM}, {_PAIR} SELECT feature_id, round(greatest(max((ma - mb) / sqrt(va * va / na + vb * vb / nb)), 0), 5) + 0.0 AS measure FROM pair GROUP BY 1")
def q_welch(spark, sf):
    return _round(X.welch_features(X.moments(D.features(spark, sf), D.labels(spark, sf))), "measure", n=5)


@query("welch_features_standard", f"WITH {D.FEAT}, {D.MOM}, {_PAIR} SELECT feature_id, round(greatest(max((ma - mb) / sqrt(va / na + vb / nb)), 0), 5) + 0.0 AS measure FROM pair GROUP BY 1")
def q_welch2(spark, sf):
    return _round(X.welch_features(X.moments(D.features(spark, sf), D.labels(spark, sf)), "standard"), "measure", n=5)


@query("feature_selection", f"WITH {D.FEAT}, c AS (SELECT feature_id, abs(corr(value, y)) AS r FROM feat JOIN lab USING (sample_id) GROUP BY 1), q AS (SELECT quantile_cont(r, 0.8) AS cut FROM c) SELECT feature_id, round(CASE WHEN r >= cut THEN r ELSE 0 END, 6) + 0.0 AS measure FROM c, q")
def q_selection(spark, sf):
    return _round(X.feature_selection(D.features(spark, sf), D.labels(spark, sf), "pearson", "percentile", 80), "measure")


@query("distance_features", f"WITH {D.FEAT} SELECT feature_id, round(avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0), 6) + 0.0 AS measure FROM feat JOIN lab USING (sample_id) GROUP BY 1")
def q_distance(spark, sf):
    return _round(X.distance_features(D.features(spark, sf), D.labels(spark, sf), lambda x, y: x[y == 1].mean() - x[y == 0].mean()), "measure")


@query("distance_features_merged", f"WITH {D.FEAT}, c AS (SELECT feature_id, 1 - corr(value, y) AS r FROM feat JOIN lab USING (sample_id) GROUP BY 1), e AS (SELECT feature_id, sqrt(sum((value - y) * (value - y))) AS e FROM feat JOIN lab USING (sample_id) GROUP BY 1), g AS (SELECT feature_id, avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0) AS g FROM feat JOIN lab USING (sample_id) GROUP BY 1) SELECT feature_id, round(r, 6) + 0.0 AS correlation, round(e, 6) + 0.0 AS euclidean, round(g, 6) + 0.0 AS gap FROM c JOIN e USING (feature_id) JOIN g USING (feature_id)")
def q_distance_merged(spark, sf):
    """Two named distances, and a user's aggregate that is merged from tasks."""
    f, y = D.features(spark, sf), D.labels(spark, sf)
    out = X.distance_features(f, y, "correlation").withColumnRenamed("measure", "correlation")
    for name, measure in (("euclidean", "euclidean"), ("gap", ClassGap())):
        out = out.join(X.distance_features(f, y, measure).withColumnRenamed("measure", name), "feature_id")
    return _round(out, "correlation", "euclidean", "gap")


@query("create_feature_sets", f"WITH {D.FEAT} SELECT sample_id, round(max(value), 6) + 0.0 AS max, round(min(value), 6) + 0.0 AS min FROM feat GROUP BY 1")
def q_sets(spark, sf):
    return _round(X.create_feature_sets(D.features(spark, sf), "stats").select("sample_id", "max", "min"), "max", "min")


@query("value_histogram", f"WITH {D.PRICES} SELECT grp, least(greatest(trunc(value * (50 / 800.0::DOUBLE) - 950.0::DOUBLE * (50 / 800.0::DOUBLE))::INT, 0), 49) AS bin, count(*) AS n FROM vals GROUP BY 1, 2")
def q_hist(spark, sf):
    return T.value_histogram(D.prices(spark, sf), 950, 1750, 50)


@query("rank_threshold", f"WITH {D.PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value, feature_id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM vals) SELECT grp, feature_id, CASE WHEN rn <= greatest(floor(n * 90 / 100.0) - 1, 0) THEN 0 ELSE value END AS value FROM r")
def q_rank(spark, sf):
    return T.rank_threshold(D.prices(spark, sf), 90).select("grp", "feature_id", "value")


@query("percentile_threshold", f"WITH {D.PRICES}, q AS (SELECT grp, quantile_cont(value, 0.9) AS cut FROM vals GROUP BY 1) SELECT grp, feature_id, CASE WHEN value >= cut THEN value ELSE 0 END AS value FROM vals JOIN q USING (grp)")
def q_percentile(spark, sf):
    return T.percentile_threshold(D.prices(spark, sf), 90).select("grp", "feature_id", "value")


_ROBUST1 = """ends AS (SELECT grp, min(value) AS lo, max(value) AS hi, count(*) AS n FROM vals GROUP BY 1),
 hist AS (SELECT grp, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, b, count(*) AS c FROM (SELECT grp, lo, hi, n, least(greatest(trunc(value * (1000 / (hi - lo)) - lo * (1000 / (hi - lo)))::INT, 0), 999) AS b FROM vals JOIN ends USING (grp)) GROUP BY grp, b),
 cum AS (SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY b) AS up, sum(c) OVER (PARTITION BY grp ORDER BY b DESC) AS down FROM hist),
 lim AS (SELECT grp, any_value(lo) + min(b) FILTER (up >= n / 50.0) * (any_value(hi - lo) / 1000.0::DOUBLE) AS t2, any_value(lo) + (max(b) FILTER (down >= n / 50.0) + 1) * (any_value(hi - lo) / 1000.0::DOUBLE) AS t98 FROM cum GROUP BY grp)"""


@query("robust_limits", f"WITH {D.PRICES}, {_ROBUST1} SELECT grp, round(t2, 5) + 0.0 AS t2, round(t98, 5) + 0.0 AS t98 FROM lim")
def q_robust(spark, sf):
    return _round(T.robust_limits(D.prices(spark, sf)), "t2", "t98", n=5)


@query("robust_min", f"WITH {D.PRICES}, {_ROBUST1} SELECT grp, round(t2, 5) + 0.0 AS value FROM lim")
def q_rmin(spark, sf):
    return _round(T.robust_min(D.prices(spark, sf)), "value", n=5)


@query("robust_max", f"WITH {D.PRICES}, {_ROBUST1} SELECT grp, round(t98, 5) + 0.0 AS value FROM lim")
def q_rmax(spark, sf):
    return _round(T.robust_max(D.prices(spark, sf)), "value", n=5)


@query("robust_range_threshold", f"WITH {D.PRICES}, {_ROBUST1} SELECT grp, feature_id, CASE WHEN value >= t2 + 0.5 * (t98 - t2) THEN value ELSE 0 END AS value FROM vals JOIN lim USING (grp)")
def q_rrange(spark, sf):
    return T.robust_range_threshold(D.prices(spark, sf), 50).select("grp", "feature_id", "value")


@query("apply_threshold", f"WITH {D.PRICES}, q AS (SELECT grp, quantile_cont(value, 0.5) AS cut FROM vals GROUP BY 1) SELECT grp, feature_id, CASE WHEN value >= cut THEN value ELSE 0 END AS value FROM vals JOIN q USING (grp)")
def q_apply(spark, sf):
    return T.apply_threshold(D.prices(spark, sf), "percentile", 50).select("grp", "feature_id", "value")


@query("standardize", f"WITH {D.FEAT}, s AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM feat WHERE sample_id % 5 <> 0 GROUP BY 1) SELECT sample_id, feature_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + 0.0 AS value FROM feat JOIN s USING (feature_id)")
def q_standardize(spark, sf):
    f = D.features(spark, sf)
    return _round(X.standardize(f, f.filter("sample_id % 5 <> 0")).select("sample_id", "feature_id", "value"), "value", n=5)


@query("minmax_scale", f"WITH {D.FEAT}, s AS (SELECT feature_id, min(value) AS a, max(value) AS b FROM feat GROUP BY 1) SELECT sample_id, feature_id, round((value - a) / (b - a), 6) + 0.0 AS value FROM feat JOIN s USING (feature_id)")
def q_minmax(spark, sf):
    return _round(X.minmax_scale(D.features(spark, sf)).select("sample_id", "feature_id", "value"), "value")


@query("encode_labels", "SELECT c_custkey, c_mktsegment AS score, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS y FROM customer")
def q_encode(spark, sf):
    return X.encode_labels(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("score"))).select("c_custkey", "score", "y")


def _samples(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y"))


@query("assign_folds_stratified", "SELECT vec_id AS sample_id, label AS y, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def q_folds(spark, sf):
    return X.assign_folds(_samples(spark, sf), 5)


@query("assign_folds_plain", "SELECT vec_id AS sample_id, label AS y, (ntile(7) OVER (ORDER BY vec_id) - 1)::INT AS fold FROM embeddings")
def q_folds2(spark, sf):
    return X.assign_folds(_samples(spark, sf), 7, "plain")


@query("assign_folds_loo", "SELECT vec_id AS sample_id, label AS y, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS fold FROM embeddings")
def q_folds3(spark, sf):
    return X.assign_folds(_samples(spark, sf), 0, "loo")


@query("makespread", "WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part) SELECT p_partkey, pos IN (SELECT ceil(i * (SELECT count(*) FROM part) / 5.0) FROM range(0, 5) r(i)) AS chosen FROM n")
def q_makespread(spark, sf):
    return X.makespread(table(spark, sf, "part").select("p_partkey"), 5, "p_partkey")


@query("takespread", "WITH n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey FROM supplier), c AS (SELECT s_suppkey, row_number() OVER (ORDER BY pos) - 1 AS place FROM n WHERE pos IN (SELECT ceil(i * (SELECT count(*) FROM supplier) / 4.0) FROM range(0, 4) r(i))) SELECT place, s_suppkey FROM c")
def q_takespread(spark, sf):
    got = X.takespread(table(spark, sf, "supplier").select("s_suppkey"), 4, "s_suppkey")
    return spark.createDataFrame(list(enumerate(got)), "place long, s_suppkey long")


@query("spread", "WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part) SELECT p_partkey FROM n WHERE pos IN (SELECT ceil(i * (SELECT count(*) FROM part) / 7.0) FROM range(0, 7) r(i))")
def q_spread(spark, sf):
    return X.spread(table(spark, sf, "part").select("p_partkey"), 7, "p_partkey").select("p_partkey")


_GRID = "g AS (SELECT user_id, ts::DATE AS day, sum(value) AS value FROM events GROUP BY 1, 2), full_ AS (SELECT user_id, day, g.value FROM (SELECT unnest(range((SELECT min(user_id) FROM g), (SELECT max(user_id) FROM g) + 1)) AS user_id) CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM g)::TIMESTAMP, (SELECT max(day) FROM g)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) LEFT JOIN g USING (user_id, day))"


def _grid(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))


@query("fill_grid", f"WITH {_GRID} SELECT user_id, day, round(coalesce(value, 0), 4) + 0.0 AS value FROM full_")
def q_fill(spark, sf):
    return _round(X.fill_grid(_grid(spark, sf), ["user_id", "day"], "value"), "value", n=4)


@query("fill_grid_forward", f"WITH {_GRID} SELECT user_id, day, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) + 0.0 AS value FROM full_")
def q_ffill(spark, sf):
    return _round(X.fill_grid(_grid(spark, sf), ["user_id", "day"], "value", how="ffill"), "value", n=4)


@query("fill_grid_backward", f"WITH {_GRID} SELECT user_id, day, round(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) + 0.0 AS value FROM full_")
def q_bfill(spark, sf):
    return _round(X.fill_grid(_grid(spark, sf), ["user_id", "day"], "value", how="bfill"), "value", n=4)


@query("dense_blocks", f"WITH {_GRID} SELECT user_id, list(round(coalesce(value, 0), 4) + 0.0 ORDER BY day) AS block FROM full_ GROUP BY 1")
def q_dense(spark, sf):
    out = X.dense_blocks(X.fill_grid(_grid(spark, sf), ["user_id", "day"], "value"), "user_id", ["day"], "value")
    return out.withColumn("block", F.transform("block", lambda v: F.round(v, 4) + 0.0))


@query("stack_volumes", f"WITH {D.VOX}, a AS (SELECT i, j, k, value FROM vox WHERE volume_id = 'A' UNION ALL SELECT i + 32, j, k, value FROM vox WHERE volume_id = 'N' UNION ALL SELECT i + 64, j, k, value FROM vox WHERE volume_id = 'R') SELECT i::INT AS i, j::INT AS j, k::INT AS k, coalesce(value, 0) AS value FROM (SELECT * FROM range(0, 96) x(i), range(0, 32) y(j), range(0, 8) z(k)) LEFT JOIN a USING (i, j, k)")
def q_stack(spark, sf):
    v, size = D.vox(spark, sf), {"i": 32, "j": 32, "k": 8}
    return X.stack_volumes([v.filter(F.col("volume_id") == name) for name in ("A", "N", "R")], "i", [size] * 3)


@query("distribution", f"WITH {D.EVENTS} SELECT grp, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 8) + 0.0 AS p FROM ev GROUP BY 1, 2")
def q_dist(spark, sf):
    return _round(I.distribution(D.events(spark, sf), "event_type", "grp"), "p", n=8)


_H = "h AS (SELECT grp, -sum(p * log2(p)) AS entropy FROM (SELECT grp, event_type, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS p FROM ev GROUP BY 1, 2) GROUP BY 1)"
_CH = "e AS (SELECT grp, min(value) AS a, max(value) AS b, greatest(floor(count(*) / 10), 1) AS nb FROM ev GROUP BY 1), bx AS (SELECT grp, CASE WHEN value >= b THEN nb + 1 ELSE floor((value - a) / (b - a) * nb) + 1 END AS bx, event_type, count(*) AS n FROM ev JOIN e USING (grp) GROUP BY 1, 2, 3), pj AS (SELECT grp, n / sum(n) OVER (PARTITION BY grp) AS pxy, sum(n) OVER (PARTITION BY grp, bx) / sum(n) OVER (PARTITION BY grp) AS px FROM bx), ch AS (SELECT grp, sum(pxy * log2(px / pxy)) AS c FROM pj GROUP BY 1)"


@query("entropy", f"WITH {D.EVENTS}, {_H} SELECT grp, round(entropy, 6) + 0.0 AS entropy FROM h")
def q_entropy(spark, sf):
    return _round(I.entropy(D.events(spark, sf), "event_type", "grp"), "entropy")


@query("conditional_entropy", f"WITH {D.EVENTS}, {_CH} SELECT grp, round(c, 6) + 0.0 AS conditional_entropy FROM ch")
def q_cond(spark, sf):
    return _round(I.conditional_entropy(D.events(spark, sf), "value", "event_type", "grp"), "conditional_entropy")


@query("mutual_information", f"WITH {D.EVENTS}, {_H}, {_CH} SELECT grp, round(entropy - c, 6) + 0.0 AS mutual_information FROM h JOIN ch USING (grp)")
def q_mi(spark, sf):
    return _round(I.mutual_information(D.events(spark, sf), "value", "event_type", "grp"), "mutual_information")


@query("mutual_information_hist2d", """WITH p AS (SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT grp, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM p GROUP BY 1),
 b AS (SELECT grp, least(floor((x - xa) / (xb - xa) * 10), 9) AS bx, least(floor((y - ya) / (yb - ya) * 10), 9) AS cy, count(*) AS n FROM p JOIN e USING (grp) GROUP BY 1, 2, 3),
 s AS (SELECT grp, n, sum(n) OVER (PARTITION BY grp, bx) AS nx, sum(n) OVER (PARTITION BY grp, cy) AS ny, sum(n) OVER (PARTITION BY grp) AS nn FROM b)
SELECT grp, round(sum(n / nn * ln((n * nn)::DOUBLE / (nx * ny))), 6) + 0.0 AS mutual_information FROM s GROUP BY 1""")
def q_mi2(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return _round(I.mutual_information_hist2d(p, "x", "y", "grp"), "mutual_information")


@query("component_count", "SELECT label, floor(count(*) * 0.15)::INT AS n_comps FROM embeddings GROUP BY 1")
def q_comps(spark, sf):
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", component_count("n", share=15).alias("n_comps"))


@query("sampling_interval", "SELECT vec_id, embedding[64] AS tr FROM embeddings")
def q_tr(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", sampling_interval("embedding").alias("tr"))

"""Queries of fold metrics, summaries, votes, learning and text formats."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlake.operators import crossval as C
from cohortlake.operators import evaluation as E
from cohortlake.operators import learning as L
from cohortlake.plans import data as D
from cohortlake.operators.tables import new_path
from cohortlake.plans.base import query, table
from cohortlake.sources.text import svmperf_line

_CM = "cm AS (SELECT config_id, fold, sum((y_true = 1 AND y_pred = 1)::INT)::DOUBLE AS tp, sum((y_true = 0 AND y_pred = 1)::INT)::DOUBLE AS fp, sum((y_true = 0 AND y_pred = 0)::INT)::DOUBLE AS tn, sum((y_true = 1 AND y_pred = 0)::INT)::DOUBLE AS fn FROM pred GROUP BY 1, 2)"
_R = "CASE WHEN {1} > 0 THEN {0} / ({1}) ELSE 0 END"
_ACC, _SENS, _SPEC, _PREC, _F1 = (_R.format(*x) for x in (("(tp + tn)", "tp + fp + tn + fn"), ("tp", "tp + fn"), ("tn", "tn + fp"), ("tp", "tp + fp"), ("2 * tp", "2 * tp + fp + fn")))
_FM = f"fm AS (SELECT config_id, fold, {_ACC} AS acc, {_SENS} AS sens, {_SPEC} AS spec, {_PREC} AS prec, {_F1} AS f1, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (({_SENS}) + ({_SPEC})) / 2 END AS auc FROM cm)"
_NAMES = ["acc", "sens", "spec", "prec", "f1", "auc"]


def _round(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in cols})


@query("fold_metrics", f"WITH {D.PRED}, {_CM}, {_FM} SELECT config_id, fold, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _NAMES)} FROM fm")
def q_folds(spark, sf):
    return _round(E.fold_metrics(D.predictions(spark, sf)), _NAMES)


_SVM = ["accuracy", "precision", "recall", "specificity", "brier"]


@query("svm_metrics", f"WITH {D.PRED}, {_CM}, c AS (SELECT config_id, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cm GROUP BY 1) SELECT config_id, round(100 * ({_ACC}), 6) + 0.0 AS accuracy, round(100 * ({_PREC}), 6) + 0.0 AS precision, round(100 * ({_SENS}), 6) + 0.0 AS recall, round(100 * ({_SPEC}), 6) + 0.0 AS specificity, round((fp + fn) / (tp + fp + tn + fn), 6) + 0.0 AS brier FROM c")
def q_svm(spark, sf):
    p = D.predictions(spark, sf).select("config_id", (2 * F.col("y_true") - 1).alias("label"), (F.col("y_pred") - 0.5).alias("score"))
    return _round(E.svm_metrics(p), _SVM)


def _metrics(spark, sf):
    return E.fold_metrics(D.predictions(spark, sf)).select(F.lit("d").alias("dataset"), F.col("config_id").alias("cl"), F.lit("none").alias("presel"), (F.col("fold") % 2).alias("thr"), *_NAMES)


_MET = "met AS (SELECT 'd' AS dataset, config_id AS cl, 'none' AS presel, fold % 2 AS thr, acc, sens, spec, prec, f1, auc FROM fm)"


@query("metric_curves", f"WITH {D.PRED}, {_CM}, {_FM}, {_MET} SELECT dataset, presel, cl, thr, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}_mean, round(var_pop({c}), 6) + 0.0 AS {c}_var' for c in _NAMES)} FROM met GROUP BY ALL")
def q_curves(spark, sf):
    return _round(E.metric_curves(_metrics(spark, sf)), [f"{c}_{k}" for c in _NAMES for k in ("mean", "var")])


@query("summary_table", f"WITH {D.PRED}, {_CM}, {_FM}, {_MET} SELECT dataset, cl, presel, printf('%.2f (%.2f)', max(m), max(v)) AS text FROM (SELECT dataset, cl, presel, thr, avg(acc) AS m, var_pop(acc) AS v FROM met GROUP BY ALL) GROUP BY 1, 2, 3")
def q_summary(spark, sf):
    return E.summary_table(_metrics(spark, sf))


_LOG = "lgamma(r + 1) - lgamma({0} + 1) - lgamma(r - {0} + 1) + lgamma(n - r + 1) - lgamma(s - {0} + 1) - lgamma(n - r - s + {0} + 1) - lgamma(n + 1) + lgamma(s + 1) + lgamma(n - s + 1)"


@query("fold_significance", f"""WITH {D.PRED}, {_CM}, t AS (SELECT *, tp + fp AS r, tp + fn AS s, tp + fp + fn + tn AS n FROM cm),
 x AS (SELECT *, unnest(range(greatest(0, r + s - n)::BIGINT, least(r, s)::BIGINT + 1))::DOUBLE AS v FROM t),
 p AS (SELECT config_id, fold, least(1, sum(exp({_LOG.format('v')})) FILTER ({_LOG.format('v')} <= {_LOG.format('tp')} + 1e-7)) AS p FROM x GROUP BY 1, 2),
 o AS (SELECT config_id, CASE WHEN sum(fp) * sum(fn) > 0 THEN sum(tp) * sum(tn) / (sum(fp) * sum(fn)) END AS odds_ratio FROM cm GROUP BY 1)
SELECT config_id, round(avg(p), 6) + 0.0 AS p, round(any_value(odds_ratio), 6) + 0.0 AS odds_ratio FROM p JOIN o USING (config_id) GROUP BY 1""")
def q_fisher(spark, sf):
    return _round(E.fold_significance(D.predictions(spark, sf)), ["p", "odds_ratio"])


@query("localization_votes", f"WITH {D.SEL}, n AS (SELECT config_id, count(DISTINCT fold) AS n FROM sel GROUP BY 1) SELECT config_id, feature_id, round(count(DISTINCT fold) / any_value(n), 6) + 0.0 AS vote FROM sel JOIN n USING (config_id) WHERE weight > 0 GROUP BY 1, 2")
def q_votes(spark, sf):
    return _round(E.localization_votes(D.selections(spark, sf)), ["vote"])


@query("rogers_tanimoto_matrix", f"WITH {D.SEL}, s AS (SELECT DISTINCT config_id, feature_id FROM sel WHERE weight > 0), z AS (SELECT config_id, count(*) AS n FROM s GROUP BY 1), t AS (SELECT x.config_id AS a, y.config_id AS b, count(*) AS t FROM s x JOIN s y USING (feature_id) GROUP BY 1, 2) SELECT p.config_id AS a, q.config_id AS b, round(2 * (p.n + q.n - 2 * coalesce(t, 0)) / (20000 + p.n + q.n - 2 * coalesce(t, 0)), 6) + 0.0 AS value FROM z p CROSS JOIN z q LEFT JOIN t ON t.a = p.config_id AND t.b = q.config_id")
def q_rogers(spark, sf):
    return _round(E.rogers_tanimoto_matrix(D.selections(spark, sf), 20000), ["value"])


@query("write_svmperf_lines", "SELECT vec_id, printf('%+d', CASE WHEN label % 2 = 0 THEN -1 ELSE 1 END) || ' ' || array_to_string(list_transform(range(1, len(embedding) + 1), lambda i: i || ':' || printf('%.4f', embedding[i]::DOUBLE)), ' ') AS line FROM embeddings")
def q_svmline(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select("vec_id", svmperf_line(F.when(F.col("label") % 2 == 0, -1).otherwise(1), x).alias("line"))


@query("write_arff_lines", """SELECT -67::BIGINT + i AS "at", v AS value FROM (SELECT unnest(['@RELATION demo'] || list_transform(range(0, 64), lambda x: '@ATTRIBUTE f' || x || ' NUMERIC') || ['@ATTRIBUTE class {0,1}', '@DATA']) AS v, unnest(range(0, 67)) AS i) UNION ALL SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%6.4f', x)), ',') || ',' || (label % 2) FROM embeddings""")
def q_arff(spark, sf):
    from cohortlake.sources.text import arff_lines

    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"))
    return arff_lines(rows, [f"f{i}" for i in range(64)], "demo", [0, 1])


@query("load_matrix", f"WITH {D.VOX}, {D.MASK} SELECT sample_id, y, i || ',' || j || ',' || k AS feature_id, value FROM (SELECT (row_number() OVER (ORDER BY volume_id) - 1)::INT AS sample_id, volume_id, (dense_rank() OVER (ORDER BY CASE volume_id WHEN 'R' THEN 'old' ELSE 'new' END) - 1)::INT AS y FROM (SELECT DISTINCT volume_id FROM vox)) JOIN (SELECT volume_id, i, j, k, value FROM vox SEMI JOIN mask USING (i, j, k)) USING (volume_id)")
def q_load(spark, sf):
    v = D.vox(spark, sf)
    s = spark.createDataFrame([(0, "A", "new"), (1, "N", "new"), (2, "R", "old")], "sample_id int, path string, score string")
    return L.load_matrix(s, v, D.mask(spark, sf))


def _labelled(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 2).alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"))


_CV = """fx AS (SELECT vec_id AS sample_id, label % 2 AS y, (vec_id % 3)::INT AS own, (generate_subscripts(embedding, 1) - 1)::INT AS feature_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
 st AS (SELECT f.fold::INT AS fold, feature_id, avg(x) AS mu, CASE WHEN var_pop(x) > 0 THEN sqrt(var_pop(x)) ELSE 1 END AS sd FROM fx, range(0, 3) f(fold) WHERE own <> f.fold GROUP BY 1, 2),
 zx AS (SELECT fold, sample_id, y, own = fold AS is_test, feature_id, (x - mu) / sd AS z FROM fx JOIN st USING (feature_id)),
 mo AS (SELECT fold, feature_id, y, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM zx WHERE NOT is_test GROUP BY ALL),
 pr AS (SELECT a.fold, a.feature_id, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM mo a JOIN mo b ON a.fold = b.fold AND a.feature_id = b.feature_id AND a.y < b.y)"""
_MEASURES = {
    "pearson": "SELECT fold, feature_id, abs(corr(z, y)) AS r FROM zx WHERE NOT is_test GROUP BY ALL",
    "bhattacharyya": "SELECT fold, feature_id, greatest(max(0.25 * pow(ma - mb, 2) / (va + vb) + 0.5 * ln((va + vb) / (2 * sqrt(va) * sqrt(vb)))), 0) AS r FROM pr GROUP BY ALL",
    "welcht": "SELECT fold, feature_id, greatest(max((ma - mb) / sqrt(va * va / na + vb * vb / nb)), 0) AS r FROM pr GROUP BY ALL",
}


def _bayes(tag: str, method: str, thr: float) -> str:
    """CTEs of one configuration with a Gaussian of diagonal covariance for each class: predictions in pd{tag}."""
    return f"""ms{tag} AS ({_MEASURES[method]}), cu{tag} AS (SELECT fold, quantile_cont(r, {thr / 100}) AS cut FROM ms{tag} GROUP BY 1),
 me{tag} AS (SELECT fold, feature_id, CASE WHEN r >= cut THEN r ELSE 0 END AS measure FROM ms{tag} JOIN cu{tag} USING (fold)),
 nv{tag} AS (SELECT fold, feature_id, y, m, v + 1e-6 AS v FROM mo SEMI JOIN (SELECT * FROM me{tag} WHERE measure > 0) s USING (fold, feature_id)),
 pi{tag} AS (SELECT fold, y, ln(any_value(n) / sum(any_value(n)) OVER (PARTITION BY fold)) AS prior FROM mo GROUP BY fold, y),
 sc{tag} AS (SELECT z.fold, z.sample_id, z.y AS y_true, n.y AS c, any_value(prior) - 0.5 * sum(ln(v) + (z - m) * (z - m) / v) AS s FROM zx z JOIN nv{tag} n ON n.fold = z.fold AND n.feature_id = z.feature_id JOIN pi{tag} p ON p.fold = z.fold AND p.y = n.y WHERE z.is_test GROUP BY ALL),
 pd{tag} AS (SELECT fold, sample_id, any_value(y_true)::INT AS y_true, arg_max(c, s)::INT AS y_pred, 1 / (1 + exp(least(max(s) FILTER (c = 0) - max(s) FILTER (c = 1), 700))) AS p1 FROM sc{tag} GROUP BY 1, 2)"""


_DIAG = [{"nComponents": 1, "covarianceType": "diag"}]


@query("cross_validate", f"WITH {_CV}, {_bayes('', 'pearson', 50)} SELECT fold, sample_id, y_true, y_pred, round(p1, 5) + 0.0 AS p1 FROM pd")
def q_cv(spark, sf):
    """One Gaussian for each class, on the features that correlate with it in the other folds."""
    cv = L.cross_validate(D.features(spark, sf), _labelled(spark, sf), "gmm", L.Preselection("pearson", "percentile", 50), grid=_DIAG)
    return cv.predictions.select("fold", "sample_id", "y_true", "y_pred", (F.round(F.col("probabilities")[1], 5) + 0.0).alias("p1"))


@query("cross_validate_measures", f"WITH {_CV}, {_bayes('', 'welcht', 60)} SELECT fold, feature_id, round(mu, 6) + 0.0 AS center, round(sd, 6) + 0.0 AS width, round(measure, 5) + 0.0 AS measure FROM me JOIN st USING (fold, feature_id)")
def q_cv_measures(spark, sf):
    """Scaling and preselection of all folds, from one scan."""
    found = C.fold_measures(D.features(spark, sf), _labelled(spark, sf), L.Preselection("welcht", "percentile", 60))
    return found.select("fold", "feature_id", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("center", 6), ("width", 6), ("measure", 5))])


@query("cross_validate_table", f"""WITH {_CV}, {_bayes('', 'bhattacharyya', 50)}, w AS (SELECT fold, y, sum(any_value(n)) OVER (PARTITION BY fold) / (2.0::DOUBLE * any_value(n)) AS w FROM mo GROUP BY fold, y)
SELECT z.fold, sample_id, z.y, is_test, round(CASE WHEN is_test THEN 1 ELSE any_value(w) END, 6) + 0.0 AS weight, list(round(z, 5) + 0.0 ORDER BY feature_id) AS x FROM zx z JOIN w ON w.fold = z.fold AND w.y = z.y SEMI JOIN (SELECT * FROM me WHERE measure > 0) s ON s.fold = z.fold AND s.feature_id = z.feature_id GROUP BY z.fold, sample_id, z.y, is_test""")
def q_cv_table(spark, sf):
    """Each sample once for each fold, scaled, chosen and weighted by that fold's training rows."""
    f, lab = D.features(spark, sf), _labelled(spark, sf)
    rows = C.training_table(f, lab, C.fold_measures(f, lab, L.Preselection("bhattacharyya", "percentile", 50)))
    x = F.transform(vector_to_array("features"), lambda v: F.round(v, 5) + 0.0)
    return rows.select("fold", "sample_id", F.col("y").cast("int").alias("y"), "is_test", (F.round("weight", 6) + 0.0).alias("weight"), x.alias("x"))


_CONFIGS = [("bhatt_50", "gmm", "bhattacharyya", 50.0), ("pearson_60", "gmm", "pearson", 60.0), ("welch_70", "gmm", "welcht", 70.0)]
_PREDS = "pred AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS config_id, * FROM pd_{i}" for i, c in enumerate(_CONFIGS)) + ")"


@query("run_experiments", f"WITH {_CV}, {', '.join(_bayes(f'_{i}', c[2], c[3]) for i, c in enumerate(_CONFIGS))}, {_PREDS}, {_CM}, {_FM} SELECT config_id, fold, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _NAMES)} FROM fm")
def q_run(spark, sf):
    """Three configurations; the results table has one of them already when all are asked for."""
    results = L.ResultsTable(spark, new_path(spark, "experiments"))
    configs = spark.createDataFrame(_CONFIGS, "config_id string, cl string, prefs string, prefs_thr double")
    for part in (configs.filter("config_id = 'pearson_60'"), configs):
        out = L.run_experiments(D.features(spark, sf), _labelled(spark, sf), part, results, grid=_DIAG)
    return _round(out, _NAMES)

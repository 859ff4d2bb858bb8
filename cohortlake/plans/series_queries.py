"""Queries of time series, connectivity and endmembers."""

from pyspark.sql import functions as F

from cohortlake.operators import endmembers as N
from cohortlake.operators import timeseries as T
from cohortlake.plans import data as D
from cohortlake.plans.base import query, table


def _round(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in cols})


def _some(spark, sf):
    return D.series(spark, sf).filter("roi <> 0")


@query("mean_timeseries", f"WITH {D.SERIES} SELECT volume_id, roi, t::INT AS t, round(x, 6) + 0.0 AS x FROM ml WHERE roi <> 0")
def q_mean(spark, sf):
    return _round(T.mean_timeseries(_some(spark, sf)), "x")


_CORR = "cor AS (SELECT a.volume_id, a.roi AS roi_a, b.roi AS roi_b, corr(a.x, b.x) AS value FROM ml a JOIN ml b USING (volume_id, t) WHERE a.roi <> 0 AND b.roi <> 0 GROUP BY 1, 2, 3)"


@query("roi_pairs", f"WITH {D.SERIES}, {_CORR} SELECT volume_id, roi_a, roi_b FROM cor")
def q_pairs(spark, sf):
    return T.roi_pairs(T.select_timeseries(_some(spark, sf), "mean")).select("volume_id", "roi_a", "roi_b")


@query("correlation", f"WITH {D.SERIES}, {_CORR} SELECT volume_id, roi_a, roi_b, round(value, 6) + 0.0 AS value FROM cor")
def q_corr(spark, sf):
    return _round(T.correlation_long(T.mean_timeseries(_some(spark, sf))), "value")


@query("connectivity_matrix", f"WITH {D.SERIES}, {_CORR} SELECT volume_id, roi_a, roi_b, round(value, 6) + 0.0 AS value FROM cor")
def q_matrix(spark, sf):
    return _round(T.functional_connectivity(D.series(spark, sf)), "value")


@query("edge_list", f"WITH {D.SERIES}, {_CORR} SELECT roi_a AS a, roi_b AS b, round(value, 6) + 0.0 AS weight FROM cor WHERE value > 0 AND roi_a <> roi_b")
def q_edges(spark, sf):
    m = T.correlation_long(T.mean_timeseries(_some(spark, sf)))
    return _round(T.edge_list(m), "weight")


@query("is_symmetric", f"WITH {D.SERIES}, {_CORR} SELECT bool_and(abs(a.value - b.value) <= 1e-8 + 1e-5 * abs(b.value)) AS symmetric FROM cor a JOIN cor b ON a.volume_id = b.volume_id AND a.roi_a = b.roi_b AND a.roi_b = b.roi_a")
def q_sym(spark, sf):
    return T.is_symmetric(T.correlation_long(T.mean_timeseries(_some(spark, sf))))


@query("normalize_series_zscore", f"WITH {D.SERIES}, s AS (SELECT voxel_id, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY 1) SELECT voxel_id, t::INT AS t, round((x - m) / s, 5) + 0.0 AS x FROM long JOIN s USING (voxel_id)")
def q_z(spark, sf):
    out = D.series(spark, sf).select("voxel_id", F.posexplode(T.normalize_series("ts", "zscore")).alias("t", "x"))
    return _round(out, "x", n=5)


@query("normalize_series_percent", f"WITH {D.SERIES}, s AS (SELECT voxel_id, avg(x + 10) AS m FROM long GROUP BY 1) SELECT voxel_id, t::INT AS t, round(((x + 10) / m - 1) * 100, 5) + 0.0 AS x FROM long JOIN s USING (voxel_id)")
def q_percent(spark, sf):
    s = D.series(spark, sf).withColumn("ts", F.transform("ts", lambda v: v + 10))
    return _round(s.select("voxel_id", F.posexplode(T.normalize_series("ts", "percent")).alias("t", "x")), "x", n=5)


_SEED = f"WITH {D.SERIES}, one AS (SELECT roi, t, avg(x) AS x FROM long GROUP BY 1, 2), sc AS (SELECT a.roi AS seed, b.roi AS target, corr(a.x, b.x) AS value FROM one a JOIN one b USING (t) WHERE a.roi IN (1, 2) AND b.roi > 2 GROUP BY 1, 2)"


def _one(spark, sf):
    """All series as one scan."""
    return _some(spark, sf).withColumn("volume_id", F.lit("v"))


def _seeds(spark, sf):
    m = T.mean_timeseries(_one(spark, sf))
    return m.filter("roi in (1, 2)").select(F.col("roi").alias("seed"), "t", "x"), m.filter("roi > 2").select(F.col("roi").alias("target"), "t", "x")


@query("seed_correlation", f"{_SEED} SELECT seed, target, round(value, 6) + 0.0 AS value FROM sc")
def q_seed(spark, sf):
    return _round(T.seed_correlation(*_seeds(spark, sf)), "value")


@query("mean_seed_correlation", f"{_SEED} SELECT round(avg(value), 6) + 0.0 AS value FROM sc")
def q_mseed(spark, sf):
    return _round(T.mean_seed_correlation(*_seeds(spark, sf)), "value")


def _seed_arrays(spark, sf):
    a = T.as_arrays(T.mean_timeseries(_one(spark, sf)))
    return a.filter("roi in (1, 2)").select(F.col("roi").alias("seed"), "ts"), a.filter("roi > 2").select(F.col("roi").alias("target"), "ts")


def _coherence(series: str, key: str) -> str:
    """``spec``: the spectrum of each series' Hann windows; ``coh``: for each pair the mean coherence of bins 1 to 15."""
    scan, same = ("volume_id, ", "a.volume_id = b.volume_id AND ") if key == "volume_id, roi" else ("", "")
    return f"""spec AS (SELECT {key}, s, f, sum(x * w * cos(2 * pi() * f * (t - s) / 32)) AS re, -sum(x * w * sin(2 * pi() * f * (t - s) / 32)) AS im
 FROM (SELECT {key}, s, t, x, 0.5 - 0.5 * cos(2 * pi() * (t - s) / 32) AS w FROM {series}, (SELECT unnest([0, 16, 32]) AS s) WHERE t >= s AND t < s + 32), range(1, 16) r(f) GROUP BY ALL),
 coh AS (SELECT {scan}roi_a, roi_b, avg(CASE WHEN xx * yy > 0 THEN (re * re + im * im) / (xx * yy) ELSE 0 END) AS value
 FROM (SELECT {"a." + scan if scan else ""}a.roi AS roi_a, b.roi AS roi_b, a.f, avg(a.re * b.re + a.im * b.im) AS re, avg(a.re * b.im - a.im * b.re) AS im, avg(a.re * a.re + a.im * a.im) AS xx, avg(b.re * b.re + b.im * b.im) AS yy
 FROM spec a JOIN spec b ON {same}a.s = b.s AND a.f = b.f WHERE a.roi <> 0 AND b.roi <> 0 GROUP BY ALL) GROUP BY ALL)"""


_SEED_COH = f"WITH {D.SERIES}, one AS (SELECT roi, t, avg(x) AS x FROM long GROUP BY 1, 2), {_coherence('one', 'roi')}"


@query("seed_coherence", f"{_SEED_COH} SELECT roi_a AS seed, roi_b AS target, round(value, 6) + 0.0 AS value FROM coh WHERE roi_a IN (1, 2) AND roi_b > 2")
def q_scoh(spark, sf):
    return _round(T.seed_coherence(*_seed_arrays(spark, sf), nfft=32), "value")


@query("mean_seed_coherence", f"{_SEED_COH} SELECT round(avg(value), 6) + 0.0 AS value FROM coh WHERE roi_a IN (1, 2) AND roi_b > 2")
def q_mscoh(spark, sf):
    return _round(T.mean_seed_coherence(*_seed_arrays(spark, sf), nfft=32), "value")


@query("coherence", f"WITH {D.SERIES}, {_coherence('ml', 'volume_id, roi')} SELECT volume_id, roi_a, roi_b, round(value, 6) + 0.0 AS value FROM coh")
def q_coh(spark, sf):
    return _round(T.functional_connectivity(D.series(spark, sf), measure="coherence", nfft=32), "value")


@query("granger_causality", f"""WITH {D.SERIES}, z AS (SELECT volume_id, roi, t, x - avg(x) OVER (PARTITION BY volume_id, roi) AS x FROM ml WHERE roi <> 0),
 n AS (SELECT *, lead(x) OVER (PARTITION BY volume_id, roi ORDER BY t) AS y FROM z),
 r AS (SELECT volume_id, a.roi AS roi_a, b.roi AS roi_b, avg(a.x * a.x) AS aa, avg(a.x * b.x) AS ab, avg(b.x * b.x) AS bb, coalesce(sum(a.y * a.x), 0) / count(*) AS a1a, coalesce(sum(a.y * b.x), 0) / count(*) AS a1b, coalesce(sum(b.y * a.x), 0) / count(*) AS b1a, coalesce(sum(b.y * b.x), 0) / count(*) AS b1b
 FROM n a JOIN n b USING (volume_id, t) WHERE a.roi <> b.roi GROUP BY 1, 2, 3),
 c AS (SELECT *, (a1a * bb - a1b * ab) / (aa * bb - ab * ab) AS c11, (a1b * aa - a1a * ab) / (aa * bb - ab * ab) AS c12, (b1a * bb - b1b * ab) / (aa * bb - ab * ab) AS c21, (b1b * aa - b1a * ab) / (aa * bb - ab * ab) AS c22 FROM r),
 e AS (SELECT *, aa - c11 * a1a - c12 * a1b AS n11, ab - c11 * b1a - c12 * b1b AS n12, bb - c21 * b1a - c22 * b1b AS n22 FROM c),
 s AS (SELECT volume_id, roi_a, roi_b, c21 * c21 * n11 + 2 * n12 * c21 * (cos(pi() * k / 128) - c11) + n22 * (1 + c11 * c11 - 2 * c11 * cos(pi() * k / 128)) AS whole, (n11 - n12 * n12 / n22) * c21 * c21 AS part FROM e, range(1, 128) q(k))
SELECT volume_id, roi_a, roi_b, round(avg(ln(whole / (whole - part))), 6) + 0.0 AS value FROM s GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT volume_id, roi, roi, 0.0::DOUBLE FROM z""")
def q_granger(spark, sf):
    return _round(T.functional_connectivity(D.series(spark, sf), measure="granger"), "value")


@query("eigen_timeseries_energy", f"""WITH {D.SERIES}, mv AS (SELECT volume_id, voxel_id, avg(x) AS mu FROM long WHERE roi <> 0 GROUP BY 1, 2)
SELECT volume_id, roi, t::INT AS t, round(sum((x - mu) * (x - mu)), 5) + 0.0 AS energy FROM long JOIN mv USING (volume_id, voxel_id) GROUP BY 1, 2, 3""")
def q_eigen_energy(spark, sf):
    """All components of a region together hold the energy of its centred series, at each time."""
    e = T.eigen_timeseries(_some(spark, sf), 64)
    flat = e.select("volume_id", "roi", F.posexplode("ts").alias("t", "v")).groupBy("volume_id", "roi", "t").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    return flat.withColumn("energy", F.round("energy", 5) + 0.0)


@query("eigen_timeseries")
def q_eigen(spark, sf):
    return T.eigen_timeseries(_some(spark, sf), 2)


_SINC = "CASE WHEN j = 0 THEN 1.0 ELSE sin(pi() * {0} * j) / (pi() * {0} * nullif(j, 0)) END"
_TAPS = f"h AS (SELECT j, (0.4 * ({_SINC.format(0.4)}) - 0.04 * ({_SINC.format(0.04)})) * (0.54 + 0.46 * cos(2 * pi() * j / 16)) AS h FROM range(-8, 9) r(j))"
_ONCE = "{0} AS (SELECT voxel_id, q.t, sum(x * h) AS x FROM {1} JOIN (SELECT t, j, h, CASE WHEN t + j < 0 THEN -t - j WHEN t + j > 63 THEN 126 - t - j ELSE t + j END AS u FROM h, range(0, 64) g(t)) q ON {1}.t = q.u GROUP BY 1, 2)"


@query("filter_series", f"WITH {D.SERIES}, m AS (SELECT voxel_id, avg(x) AS m FROM long WHERE roi <> 0 GROUP BY 1), z AS (SELECT voxel_id, t, x - m AS x FROM long JOIN m USING (voxel_id)), {_TAPS}, {_ONCE.format('y', 'z')}, {_ONCE.format('w', 'y')} SELECT voxel_id, t::INT AS t, round(x + m, 6) + 0.0 AS x FROM w JOIN m USING (voxel_id)")
def q_filter(spark, sf):
    out = T.filter_series(_some(spark, sf), 0.01, 0.1, order=16)
    return _round(out.select("voxel_id", F.posexplode("ts").alias("t", "x")), "x")


@query("filtered_set", f"""WITH {D.SERIES}, bands AS (SELECT 'low' AS band, 0.0 AS lb, 0.08 AS ub UNION ALL SELECT 'high', 0.08, 0.25),
 g AS (SELECT band, d, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * cos(2 * pi() * k * d / 64)) / 64 AS g FROM bands, range(0, 33) q(k), range(0, 64) r(d) WHERE k = 0 OR k / 128.0 BETWEEN lb AND ub GROUP BY 1, 2)
SELECT volume_id || ':original' AS volume_id, roi, t::INT AS t, round(x, 6) + 0.0 AS x FROM ml WHERE roi <> 0
UNION ALL SELECT volume_id || ':' || band, roi, v.t::INT, round(sum(x * g), 6) + 0.0 FROM ml, range(0, 64) v(t), g WHERE roi <> 0 AND d = (v.t - ml.t + 64) % 64 GROUP BY volume_id, band, roi, v.t""")
def q_set(spark, sf):
    s = T.filtered_set(_some(spark, sf), [("low", None, 0.08), ("high", 0.08, None)])
    means = T.select_timeseries(s.withColumn("volume_id", F.concat_ws(":", "volume_id", "band")), "mean")
    return _round(means.select("volume_id", "roi", F.posexplode("ts").alias("t", "x")), "x")


_D = "d AS (SELECT generate_subscripts(embedding, 1) - 1 AS p, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT * FROM d), lam AS (SELECT a.p::INT AS b, c.p::INT AS c, min(a.x - c.x) AS w, max(a.x - c.x) AS m FROM e a JOIN e c USING (vec_id) GROUP BY 1, 2)"


def _samples(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


@query("lattice_memories", f"WITH {_D} SELECT b, c, round(w, 6) + 0.0 AS w, round(m, 6) + 0.0 AS m FROM lam")
def q_lam(spark, sf):
    return _round(N.lattice_memories(_samples(spark, sf)), "w", "m")


@query("wm_endmembers", f"WITH {_D}, uv AS (SELECT p::INT AS c, max(x) AS u, min(x) AS v FROM e GROUP BY 1) SELECT 'w' AS kind, c AS col, b, round(w + u, 6) + 0.0 AS value FROM lam JOIN uv USING (c) UNION ALL SELECT 'm', c, b, round(m + v, 6) + 0.0 FROM lam JOIN uv USING (c) UNION ALL SELECT 'u', 0, c, round(u, 6) + 0.0 FROM uv UNION ALL SELECT 'v', 0, c, round(v, 6) + 0.0 FROM uv")
def q_wm(spark, sf):
    return _round(N.wm_endmembers(_samples(spark, sf)), "value")


def _ids(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "place int, id long")


def _steps(n: int) -> str:
    """CTEs of ``n`` targets: each the sample of most energy outside the span of those before, by inner products."""
    out = ["s0 AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS r FROM embeddings)", "t0 AS (SELECT * FROM s0 ORDER BY round(r, 12) DESC, vec_id LIMIT 1)"]
    for k in range(1, n):
        d = f"list_inner_product(s.x, t.x)" + "".join(f" - s.d{j} * t.d{j} / t.e{j}" for j in range(1, k))
        kept = "".join(f", s.d{j}, t.e{j}" for j in range(1, k))
        out.append(f"s{k} AS (SELECT s.vec_id, s.x{kept}, {d} AS d{k}, t.r AS e{k}, s.r - ({d}) * ({d}) / t.r AS r FROM s{k - 1} s, t{k - 1} t)")
        out.append(f"t{k} AS (SELECT * FROM s{k} ORDER BY round(r, 12) DESC, vec_id LIMIT 1)")
    return ", ".join(out)


@query("atgp", f"WITH {_steps(4)} " + " UNION ALL ".join(f"SELECT {k}::INT AS place, vec_id AS id FROM t{k}" for k in range(4)))
def q_atgp(spark, sf):
    return _ids(spark, N.atgp(_samples(spark, sf), 4))


@query("nfindr")
def q_nfindr(spark, sf):
    return _ids(spark, N.nfindr(_samples(spark, sf), 4))


@query("virtual_dimensionality")
def q_vd(spark, sf):
    return spark.createDataFrame(list(N.virtual_dimensionality(_samples(spark, sf)).items()), "rate double, n int")


@query("ilsia")
def q_ilsia(spark, sf):
    return N.induce(_samples(spark, sf), "ilsia", ["label"])


@query("eiha")
def q_eiha(spark, sf):
    return N.induce(_samples(spark, sf), "eiha", ["label"])


@query("cca_endmembers")
def q_cca(spark, sf):
    """On the sums of the eight blocks of eight dimensions: fewer than the samples of a label have."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.aggregate(F.slice("x", b * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, v: a + v))
    return N.induce_cone(_samples(spark, sf).withColumn("x", blocks), ["label"], 3)

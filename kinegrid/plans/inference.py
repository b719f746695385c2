"""Queries of bands, rank statistics, functional data, clustering, classification, series features and plot tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinegrid.operators import align, density, fda, geometry, medoids, ml, plotdata, shapley, stats, tsc
from kinegrid.plans import lenses as L
from kinegrid.plans.movement import _MOVES, _axis, _samples

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WINDOWS = L.TRIALS + """, a AS (SELECT t.session_id, t.idx, t.error, f.frame - ch AS o, f.lin_vel AS v FROM trials t JOIN frames f ON f.session_id = t.session_id AND f.frame >= ch - 5 AND f.frame < ch + 6)"""


def _aligned(spark, sf):
    t = L.trials(spark, sf)
    return align.aligned_windows(t, L.frames(spark, sf), before=5, after=6, at="ch").join(t.select("session_id", "idx", "error"), ["session_id", "idx"])


@query("WITH " + _WINDOWS + ' SELECT error, CAST(o AS INT) AS "offset", round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM a GROUP BY 1, 2')
def q28_band(spark, sf):
    b = plotdata.band(_aligned(spark, sf), ["error", "offset"])
    return b.select("error", "offset", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query("WITH " + L.CURVES + " SELECT label, CAST(k AS BIGINT) AS k, round(avg(y), 6) AS mean, count(*) AS n FROM curves GROUP BY 1, 2")
def q29_mean_curves(spark, sf):
    return fda.mean_curves(L.curves(spark, sf), ["label"]).select("label", "k", F.round("mean", 6).alias("mean"), "n")


@query("SELECT r.l_returnflag, s.l_linestatus, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) r CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s LEFT JOIN lineitem l ON l.l_returnflag = r.l_returnflag AND l.l_linestatus = s.l_linestatus GROUP BY 1, 2")
def q30_crosstab(spark, sf):
    return ml.crosstab(L.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_RANKED = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _MEASURES) + ", l_returnflag FROM lineitem)"


@query("WITH " + _RANKED + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def q31_spearman_matrix(spark, sf):
    return stats.spearman_matrix(L.table(spark, sf, "lineitem"), _MEASURES).select("a", "b", F.round("rho", 6).alias("rho"))


@query("WITH " + _RANKED + ", c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_extendedprice, l_tax) AS bc FROM r) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial_r FROM c")
def q32_partial_rank(spark, sf):
    return stats.partial_rank_correlation(L.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_tax").select(F.round("partial_r", 6).alias("partial_r"))


@query(
    """WITH r AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS g, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS r FROM lineitem),
 s AS (SELECT l_linestatus, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, coalesce(sum(r) FILTER (g = 1), 0) AS s FROM r GROUP BY 1)
 SELECT l_linestatus, n1, n0, s - n1 * (n1 + 1) / 2.0 AS u, round(2 * (s - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0) - 1, 6) AS effect FROM s"""
)
def q33_rank_biserial(spark, sf):
    rows = L.table(spark, sf, "lineitem").withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return stats.rank_biserial(rows, "l_extendedprice", "g", ["l_linestatus"]).withColumn("effect", F.round("effect", 6))


def _one(spark, **values):
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query()
def q34_permutation(spark, sf):
    t = L.trials(spark, sf)
    a = stats.perm_partial_p(t, "rt", "ce", "ch", n_perm=1000)
    b = stats.perm_diff_partial(t, "rt", "ce", "ch", "choice", n_perm=1000)
    c = stats.perm_diff_biserial(t, "rt", "error", "choice", n_perm=1000)
    return _one(spark, partial=a["observed"], partial_p=a["p"], diff_partial=b["observed"], diff_partial_p=b["p"], diff_biserial=c["observed"], diff_biserial_p=c["p"])


@query()
def q34b_main_effect(spark, sf):
    t = L.trials(spark, sf)
    rho, p = stats.partial_spearman(t, "rt", "ce", "cue")
    return _one(spark, **stats.condition_main_effect(t, "rt", "choice"), partial_rho=rho, partial_p=p)


@query()
def q34c_bootstrap_ci(spark, sf):
    return stats.bootstrap_mean_ci(L.trials(spark, sf), "rt", ["cue"])


_WARPS = "w AS (SELECT idx, k, grid AS t, power(grid, 1 + abs(y)) AS gamma FROM curves)"


@query("WITH " + L.CURVES + ", " + _WARPS + ", d AS (SELECT idx, t, gamma - t AS d, lag(gamma - t) OVER (PARTITION BY idx ORDER BY k) AS d0, lag(t) OVER (PARTITION BY idx ORDER BY k) AS t0 FROM w) SELECT idx, round(coalesce(sum((d + d0) / 2 * (t - t0)), 0), 6) AS lag FROM d GROUP BY 1")
def q35_warping_lag(spark, sf):
    w = L.curves(spark, sf).select("idx", "k", F.col("grid").alias("t"), F.pow("grid", 1 + F.abs("y")).alias("gamma"))
    return fda.warping_lag(w).select("idx", F.round("lag", 6).alias("lag"))


@query("WITH " + L.CURVES + " SELECT CAST(a.k AS INT) AS k1, CAST(b.k AS INT) AS k2, round(covar_samp(a.y, b.y), 6) AS cov FROM curves a JOIN curves b ON a.idx = b.idx AND a.k <= b.k GROUP BY 1, 2")
def q36_curve_covariance(spark, sf):
    return fda.covariance(L.packed_curves(spark, sf), 64).select("k1", "k2", F.round("cov", 6).alias("cov"))


@query()
def q36b_fpca(spark, sf):
    scored, model = fda.fpca(L.packed_curves(spark, sf), 4, weighted=True)
    ratio = F.array(*[F.lit(float(r)) for r in model["ratio"]])
    return scored.select("idx", "scores", ratio.alias("ratio"))


def _few(spark, sf):
    """Speed curves of movements with two frames on both sides, on 50 points."""
    from kinegrid.operators.curves import packed_curves
    from kinegrid.plans.reports import padded_curves

    rows = packed_curves(padded_curves(spark, sf), ["y"]).withColumn("key", F.col("session_id") * 100_000 + F.col("idx"))
    return rows.select(F.col("key").alias("idx"), "y")


@query()
def q37_registration(spark, sf):
    out, info = fda.elastic_register(_few(spark, sf))
    return out.withColumn("rounds", F.lit(info["rounds"]))


@query()
def q37b_amplitude_phase(spark, sf):
    out, _ = fda.elastic_register(_few(spark, sf))
    return fda.amplitude_phase_scores(out)


@query()
def q37c_shift_lag(spark, sf):
    return fda.shift_lag(_few(spark, sf))


def _near(spark, sf):
    return L.packed_curves(spark, sf).where("idx < 300")


_PAIRS = L.CURVES + ", d AS (SELECT a.idx AS i, b.idx AS j, a.label AS li, b.label AS lj, sqrt(sum((a.y - b.y) * (a.y - b.y))) AS d FROM curves a JOIN curves b ON a.k = b.k AND a.idx <> b.idx GROUP BY ALL)"


@query("WITH " + _PAIRS + ", m AS (SELECT i, li, lj, avg(d) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT i, li, max(m) FILTER (lj = li) AS a, min(m) FILTER (lj <> li) AS b FROM m GROUP BY 1, 2) SELECT i, li AS cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM s")
def q38_silhouette(spark, sf):
    return ml.exact_silhouettes(L.packed_curves(spark, sf)).withColumn("s", F.round("s", 6))


@query("WITH " + _PAIRS + ", s AS (SELECT li AS cluster, i, sum(CASE WHEN lj = li THEN d ELSE 0 END) AS s FROM d GROUP BY 1, 2) SELECT cluster, arg_min(i, struct_pack(s := round(s, 9), i := i)) AS medoid FROM s GROUP BY 1")
def q38b_medoids(spark, sf):
    return ml.exact_medoids(L.packed_curves(spark, sf))


@query()
def q38c_kmedoids(spark, sf):
    labels, _, inertia = medoids.kmedoids(L.packed_curves(spark, sf), 3)
    return labels.select("i", "cluster", F.round("d", 6).alias("d")).withColumn("inertia", F.lit(round(inertia, 6)))


@query()
def q38d_suggest_k(spark, sf):
    """Mean silhouette of the best of three starts for each k."""
    found = medoids.suggest_k(L.packed_curves(spark, sf), n_init=3)
    return spark.createDataFrame(list(found.items()), "k int, silhouette double")


@query()
def q38e_cluster_timeseries(spark, sf):
    """Embeddings as two channels of 32 values, clustered under move-split-merge."""
    c = L.curves(spark, sf).select("idx", F.when(F.col("k") < 32, "a").otherwise("b").alias("channel"), (F.col("k") % 32).alias("k"), "y")
    return medoids.cluster_timeseries(c, 3, keys=["idx"], n_init=1, max_iter=5)[0]


@query("WITH c AS (SELECT * FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM c" for i, a in enumerate(_MEASURES) for b in _MEASURES[i:]))
def q39_correlation_matrix(spark, sf):
    return ml.correlations(L.table(spark, sf, "lineitem"), _MEASURES).select("a", "b", F.round("r", 6).alias("r"))


@query()
def q39b_pca_varimax(spark, sf):
    scored, _ = ml.pca_ordination(L.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_MEASURES), _MEASURES)
    return scored


def _table(spark, sf):
    """The measure table, kept as its fits read it several times."""
    return geometry.build_measure_table(L.trials(spark, sf), L.frames(spark, sf), _axis(spark, sf)).persist()


@query()
def q39c_density_clusters(spark, sf):
    t = _table(spark, sf)
    return density.cluster_measures(t, ["path_len_cm", "tortuosity", "dev_unchosen_cm", "peak_lin_vel"], ["session_id", "idx"])


@query()
def q39d_correlation_clusters(spark, sf):
    t = _table(spark, sf)
    names = ["path_len_norm", "tortuosity", "dev_unchosen_norm", "peak_lin_vel", "t_choice", "t_commit"]
    return spark.createDataFrame(ml.correlation_clusters(stats.spearman_matrix(t, names), names, 3))


@query("WITH c AS (SELECT error, count(*) AS n FROM (" + "WITH " + L.TRIALS + " SELECT * FROM trials) GROUP BY 1), f AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold) SELECT error, fold, n // 5 + (fold <= n % 5)::BIGINT AS n FROM c CROSS JOIN f")
def q40_fold_sizes(spark, sf):
    f = ml.stratified_folds(L.trials(spark, sf), "error", ["session_id", "idx"])
    return f.groupBy("error", "fold").agg(F.count(F.lit(1)).alias("n"))


def _features(spark, sf, target):
    t, names = ml.feature_matrix(_table(spark, sf).drop("cue" if target == "error" else "error"), target)
    return t, [n for n in names if n != target]


@query()
def q40b_classifier(spark, sf):
    """Mean absolute Shapley value of each measure for the outcome, and balanced accuracy on the rows held out."""
    t, names = _features(spark, sf, "error")
    importance, _, score = shapley.classifier_importance(t, names, "error", ["session_id", "idx"], rounds=ROUNDS)
    return importance.withColumn("balanced_accuracy", F.lit(score))


@query()
def q40c_shapley_values(spark, sf):
    """Shapley values of the held-out trials for each of the cues."""
    t, names = _features(spark, sf, "cue")
    return shapley.classifier_importance(t, names, "cue", ["session_id", "idx"], rounds=CUE_ROUNDS)[1]


@query()
def q40d_cross_validation(spark, sf):
    """Balanced accuracy of each of five stratified folds."""
    t, names = _features(spark, sf, "error")
    scores = ml.cross_val_score(t, names, "error", ["session_id", "idx"], rounds=FOLD_ROUNDS)
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "fold int, balanced_accuracy double")


#: Rounds of boosting in registered queries; the operators' default is 200.
ROUNDS, CUE_ROUNDS, FOLD_ROUNDS = 20, 5, 5


_SHAPE = (0.5, -0.25, 0.125, 0.75, -0.5, 0.0, 0.25)


@query(
    "WITH " + L.CURVES + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s}::DOUBLE)" for i, s in enumerate(_SHAPE)) + """) AS v(o, s)), w AS (SELECT idx, k - o AS start, sum((y - s) * (y - s)) AS d FROM curves CROSS JOIN q WHERE k - o BETWEEN 0 AND 57 GROUP BY 1, 2) SELECT idx, round(min(d), 6) AS d FROM w GROUP BY 1"""
)
def q41_window_distance(spark, sf):
    return L.packed_curves(spark, sf).select("idx", F.round(tsc.window_distance(F.col("y"), list(_SHAPE)), 6).alias("d"))


@query()
def q41b_random_kernels(spark, sf):
    return tsc.multirocket_features(L.packed_curves(spark, sf))


@query()
def q41c_shapelets(spark, sf):
    return tsc.shapelet_transform(L.packed_curves(spark, sf).select("idx", "label", "y"), "label")[0]


@query()
def q41d_shapelet_summary(spark, sf):
    return tsc.shapelet_transform(L.packed_curves(spark, sf).select("idx", "label", "y"), "label")[1]


@query("WITH " + _MOVES + " SELECT session_id, idx FROM trials EXCEPT SELECT session_id, idx FROM moves")
def q42_exclusions(spark, sf):
    return geometry.exclusions(L.trials(spark, sf), _samples(spark, sf).select("session_id", "idx").distinct())[0]


@query("WITH " + _MOVES + ", n AS (SELECT max(m) AS n FROM moves), t AS (SELECT DISTINCT session_id, idx FROM moves), g AS (SELECT unnest(range(10000)) AS k) SELECT t.session_id, t.idx, CAST(g.k AS INT) AS k, m.x FROM t CROSS JOIN n JOIN g ON g.k < n.n LEFT JOIN moves m ON m.session_id = t.session_id AND m.idx = t.idx AND m.k = g.k")
def q43_padded_paths(spark, sf):
    from kinegrid.operators.curves import packed_curves

    rows = plotdata.padded(packed_curves(_samples(spark, sf), ["x", "y"]), ["session_id", "idx"])
    return rows.select("session_id", "idx", F.posexplode("x").alias("k", "x"))


@query("WITH " + L.TRIALS + ", p AS (SELECT session_id, idx, (row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1) // 4 AS panel, ce FROM trials) SELECT p.session_id, idx, panel, f.y AS u, f.x AS v FROM p JOIN frames f ON f.session_id = p.session_id AND f.frame = p.ce")
def q44_panels_and_view(spark, sf):
    t = plotdata.panels(L.trials(spark, sf), 4)
    f = plotdata.VIEWS["paper"].apply(L.frames(spark, sf))
    return t.join(f.select("session_id", F.col("frame").alias("ce"), "u", "v"), ["session_id", "ce"]).select("session_id", "idx", "panel", "u", "v")


@query("WITH " + L.FRAMES + ", g AS (SELECT session_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM frames GROUP BY 1), h AS (SELECT *, greatest(x1 - x0, y1 - y0) * 0.55::DOUBLE AS h FROM g) SELECT session_id, round((x0 + x1) / 2 - h, 6) AS x_low, round((x0 + x1) / 2 + h, 6) AS x_high, round((y0 + y1) / 2 - h, 6) AS y_low, round((y0 + y1) / 2 + h, 6) AS y_high FROM h")
def q44b_equal_limits(spark, sf):
    lim = plotdata.equal_limits(L.frames(spark, sf), ["session_id"])
    return lim.select("session_id", *[F.round(c, 6).alias(c) for c in lim.columns if c != "session_id"])


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) * 25 / (hi - lo)), 24) AS BIGINT) AS bin, count(*) AS n FROM lineitem CROSS JOIN e GROUP BY 1")
def q45_histogram(spark, sf):
    return plotdata.histogram(L.table(spark, sf, "lineitem"), "l_extendedprice")

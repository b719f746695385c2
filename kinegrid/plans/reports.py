"""Queries of functional-data reports, keypoint curves, trends and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinegrid.operators import align, curves, fda, geometry, ml, plotdata, pose, registration, shapes, stats
from kinegrid.plans import lenses as L
from kinegrid.plans.kinematics import _pose as pose_nodes
from kinegrid.plans.movement import _MOVES, _PEAK, _arc, _on_grid, _samples
from kinegrid.streaming import trials

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SCORED = ("l_quantity", "l_extendedprice", "l_discount")


def _contrast(j: int, c: str) -> str:
    ranks = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
    return f"""SELECT {j + 1} AS component, round(avg(s) FILTER (g = 1) - avg(s) FILTER (g = 0), 5) AS mean_difference, coalesce(sum(r) FILTER (g = 1), 0) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2.0 AS u, round(corr(r, q), 6) AS cue_rho
 FROM (SELECT {c} AS s, (l_returnflag <> 'R')::INT AS g, {ranks(c)} AS r, {ranks('l_linenumber')} AS q FROM lineitem)"""


@query(" UNION ALL ".join(_contrast(j, c) for j, c in enumerate(_SCORED)))
def q52_component_contrasts(spark, sf):
    rows = L.table(spark, sf, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _SCORED]).alias("scores"), (F.col("l_returnflag") == "R").cast("int").alias("error"), F.col("l_linenumber").alias("cue"))
    table = fda.component_contrasts(rows, len(_SCORED))
    return table.select("component", F.round("mean_difference", 5).alias("mean_difference"), "u", F.round("cue_rho", 6).alias("cue_rho"))


_NODES = L.TRIALS + """, nodes AS (SELECT session_id, frame, 'a' AS node, x, y FROM frames UNION ALL SELECT session_id, frame, 'b' AS node, y AS x, x / 2 AS y FROM frames),
 d AS (SELECT session_id, node, frame, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) * 0.099930755788::DOUBLE * 25 AS s FROM nodes WINDOW w AS (PARTITION BY session_id, node ORDER BY frame)),
 v AS (SELECT session_id, node, frame, coalesce(s, lag(s) OVER (PARTITION BY session_id, node ORDER BY frame)) AS s FROM d),
 ends AS (SELECT session_id, max(frame) AS last FROM frames GROUP BY 1),
 ok AS (SELECT session_id, idx, ce - 2 AS a, ch - ce + 4 AS m FROM trials JOIN ends USING (session_id) WHERE ce >= 2 AND ch + 1 <= last AND ch - ce + 4 >= 6),
 g AS (SELECT ok.*, CAST(k AS BIGINT) AS k, k * (m - 1) / 49.0::DOUBLE AS pos FROM ok, (SELECT unnest(range(50)) AS k))"""


@query("WITH " + _NODES + " SELECT g.session_id, g.idx, lo.node, g.k, round(lo.s + (hi.s - lo.s) * (pos - floor(pos)), 5) AS y FROM g JOIN v lo ON lo.session_id = g.session_id AND lo.frame = a + CAST(floor(pos) AS BIGINT) JOIN v hi ON hi.session_id = g.session_id AND hi.node = lo.node AND hi.frame = a + least(CAST(floor(pos) AS BIGINT) + 1, m - 1)")
def q53_keypoint_speeds(spark, sf):
    f = L.frames(spark, sf)
    nodes = f.select("session_id", "frame", F.lit("a").alias("node"), "x", "y").union(f.select("session_id", "frame", F.lit("b"), "y", F.col("x") / 2))
    c = curves.keypoint_speed_curves(L.trials(spark, sf), pose.node_speed(nodes))
    return c.select("session_id", "idx", "node", "k", F.round("y", 5).alias("y"))


@query(
    """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), e AS (SELECT min(x) AS a, max(x) AS b FROM r), p AS (SELECT CAST(k AS INT) AS k, a + (b - a) * k / 24.0::DOUBLE AS x FROM e, (SELECT unnest(range(25)) AS k)),
 s AS (SELECT k, p.x, r.x - p.x AS u, y FROM r CROSS JOIN p), h AS (SELECT k, quantile_disc(abs(u), 2.0 / 3) AS h FROM s GROUP BY 1), w AS (SELECT s.*, power(1 - power(least(abs(u) / h, 1), 3), 3) AS w FROM s JOIN h USING (k)),
 t AS (SELECT k, x, count(*) FILTER (w > 0) AS n, sum(w) AS s, sum(w * u) AS su, sum(w * u * u) AS suu, sum(w * y) AS sv, sum(w * u * y) AS suv FROM w GROUP BY 1, 2) SELECT k, round(x, 6) AS x, n, round((sv * suu - su * suv) / (s * suu - su * su), 4) AS y FROM t"""
)
def q54_local_trend(spark, sf):
    t = plotdata.local_trend(L.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select("k", F.round("x", 6).alias("x"), "n", F.round("y", 4).alias("y"))


@query("WITH " + L.TRIALS + " SELECT session_id, idx, target, choice, error, cue, rt FROM trials")
def q55_trial_meta(spark, sf):
    return geometry.trial_meta(L.trials(spark, sf))


def _windows(spark, sf):
    f = L.frames(spark, sf)
    return align.trial_windows(L.trials(spark, sf), align.session_lengths(f), entry="ce", choice="ch"), f


def padded_curves(spark, sf):
    """(session_id, idx, k, grid, y): speeds from two frames before each movement to two after it, on 50 points."""
    return curves.movement_curves(curves.movement_segments(*_windows(spark, sf))[0], "lin_vel")


_WINDOWS = L.TRIALS + """, n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1), w AS (SELECT t.*, greatest(ce - 10, 0) AS w_start, least(ch + 20, n) AS w_end FROM trials t JOIN n USING (session_id)),
 whole AS (SELECT * FROM w WHERE w_end - w_start >= 3), seg AS (SELECT session_id, idx, ce - 2 AS a, least(w_end, ch + 2) - ce + 2 AS m FROM whole WHERE ce - w_start >= 2 AND ch < w_end)"""


@query(
    "WITH " + _WINDOWS + """, g AS (SELECT seg.*, k, k / 49.0::DOUBLE AS grid, k * (m - 1) / 49.0::DOUBLE AS pos FROM seg, (SELECT CAST(unnest(range(50)) AS BIGINT) AS k) WHERE m >= 5)
 SELECT g.session_id, g.idx, g.k, round(grid, 6) AS grid, round(lo.lin_vel + (hi.lin_vel - lo.lin_vel) * (pos - floor(pos)), 5) AS y FROM g JOIN frames lo ON lo.session_id = g.session_id AND lo.frame = a + CAST(floor(pos) AS BIGINT) JOIN frames hi ON hi.session_id = g.session_id AND hi.frame = a + least(CAST(floor(pos) AS BIGINT) + 1, m - 1)"""
)
def q57_movement_curves(spark, sf):
    return padded_curves(spark, sf).select("session_id", "idx", "k", F.round("grid", 6).alias("grid"), F.round("y", 5).alias("y"))


@query("WITH " + _WINDOWS + " SELECT session_id, idx FROM whole WHERE ce - w_start < 2 OR ch >= w_end")
def q57b_clipped_trials(spark, sf):
    return curves.movement_segments(*_windows(spark, sf))[1]


@query("WITH " + _WINDOWS + ", c AS (SELECT session_id, idx, m >= 5 AND ce >= 1 AS registered FROM seg JOIN trials USING (session_id, idx)) SELECT t.session_id, t.idx, coalesce(c.registered, false) AS registered FROM trials t LEFT JOIN c USING (session_id, idx) WHERE ce >= 1 AND ch - ce + 1 >= 4")
def q56_fda_columns(spark, sf):
    """Measured trials, and whether the registration gave them a lag and a score."""
    table = _samples(spark, sf).select("session_id", "idx").distinct()
    found, _ = fda.registered_table(padded_curves(spark, sf))
    joined = fda.with_fda_columns(table, found)
    return joined.select("session_id", "idx", (F.col("fda_lag").isNotNull() & F.col("fda_score1").isNotNull()).alias("registered"))


EVENTS = ("view", "purchase")


def locked_events(spark, sf):
    """(event, session_id, idx, k, t, y): speeds around the view and the purchase of each trial, cut in one job."""
    w, f = _windows(spark, sf)
    named = w.select("session_id", "idx", "w_start", "w_end", F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.col(c).alias("frame")) for e, c in zip(EVENTS, ("ce", "ch"), strict=True)])).alias("e"))
    return curves.event_locked_curves(named.select("session_id", "idx", "w_start", "w_end", "e.*"), f, keys=("event", "session_id", "idx"))


def _locked_packed(spark, sf):
    return curves.packed_curves(locked_events(spark, sf), ["y"], ("event", "session_id", "idx"))


_LOCKED = _WINDOWS + """, e AS (SELECT 'view' AS event, session_id, idx, ce AS z, w_start, w_end FROM whole UNION ALL SELECT 'purchase', session_id, idx, ch, w_start, w_end FROM whole),
 lock AS (SELECT event, e.session_id, e.idx, f.frame - z + 10 AS k, f.lin_vel AS y FROM e JOIN frames f ON f.session_id = e.session_id AND f.frame >= z - 10 AND f.frame < z + 10 WHERE z - 10 >= w_start AND z + 10 <= w_end)"""


@query("WITH " + _LOCKED + " SELECT event, k, count(*) AS n, round(avg(y), 6) AS mean_y FROM lock GROUP BY ALL")
def q58_event_lock_means(spark, sf):
    """The mean curve of each event's lock."""
    return plotdata.event_lock_means(_locked_packed(spark, sf), ["y"]).select("event", "k", "n", F.round("mean_y", 6).alias("mean_y"))


def _behaviour(spark, sf):
    return L.trials(spark, sf).select("session_id", "idx", "rt", "cue")


@query()
def q58b_compare_event_locks(spark, sf):
    """n, first component's share and rank correlations with reaction time and cue, of one registration of all events."""
    table, _ = registration.compare_event_locks(_locked_packed(spark, sf), _behaviour(spark, sf))
    return table.select("event", "n", *[F.round(c, 3).alias(c) for c in ("pc1_var", "lag_rt", "lag_cue", "amp1_cue", "amp1_rt")])


@query()
def q58c_event_locked_fda(spark, sf):
    """Lag and scores of each curve; templates by event and choice, all together."""
    c = _locked_packed(spark, sf).join(L.trials(spark, sf).select("session_id", "idx", "choice"), ["session_id", "idx"])
    rows, _ = registration.register_groups(c, ["event", "session_id", "idx"], ["event", "choice"])
    return rows.select("event", "choice", "session_id", "idx", "lag", "amp", "phase", "joint")


@query()
def q58d_registered_lock_means(spark, sf):
    """Raw and registered mean curves of each event's lock."""
    rows, _ = registration.register_groups(_locked_packed(spark, sf), ["session_id", "idx"], ["event"], joint=False)
    return plotdata.event_lock_means(rows, ["y", "registered"])


_SPEARMAN = lambda c: f"rank() OVER (PARTITION BY choice ORDER BY {c}) + (count(*) OVER (PARTITION BY choice, {c}) - 1) / 2.0 AS r_{c}"


@query("WITH " + L.TRIALS + ", s AS (SELECT choice, ch - ce AS lag, ce % 7 AS amp1, rt, cue FROM trials), r AS (SELECT choice, " + ", ".join(map(_SPEARMAN, ("lag", "amp1", "rt", "cue"))) + " FROM s) SELECT choice, round(corr(r_lag, r_rt), 6) AS lag_rt, round(corr(r_lag, r_cue), 6) AS lag_cue, round(corr(r_amp1, r_cue), 6) AS amp1_cue, round(corr(r_amp1, r_rt), 6) AS amp1_rt FROM r GROUP BY 1")
def q58e_lock_correlations(spark, sf):
    """The comparison's rank correlations, of stand-ins for lag and score, within each choice."""
    t = L.trials(spark, sf).select("choice", (F.col("ch") - F.col("ce")).alias("lag"), (F.col("ce") % 7).alias("amp1"), "rt", "cue")
    found = registration.lock_correlations(t, ["choice"])
    return found.select("choice", *[F.round(c, 6).alias(c) for c in found.columns if c != "choice"])


@query()
def q59_convergence_report(spark, sf):
    """Whether lag and first score are the same after 20 and 40 rounds; the second fit goes on from the first one's templates."""
    return registration.convergence_report(curves.packed_curves(padded_curves(spark, sf), ["y"]), ["session_id", "idx"])


def _decision_paths(spark, sf):
    """Paths in the decision frame on 20 points."""
    paths = curves.decision_frame_paths(_samples(spark, sf), geometry.decision_axis(L.ports(spark, sf)), 20)
    return curves.packed_curves(paths, ["u", "v"])


@query()
def q60_elastic_shapes(spark, sf):
    """Shape scores of each path around the mean shape of its choice."""
    paths = _decision_paths(spark, sf).join(L.trials(spark, sf).select("session_id", "idx", "choice"), ["session_id", "idx"])
    return shapes.elastic_shapes(paths, by=["choice"])[0].select("session_id", "idx", "choice", "scores", "distance")


@query()
def q60b_shape_contrasts(spark, sf):
    scores, _ = shapes.elastic_shapes(_decision_paths(spark, sf))
    return shapes.shape_contrasts(scores, L.trials(spark, sf))


@query()
def q60c_shape_modes(spark, sf):
    """Mean path, shares of variance, and the paths 1.5 deviations along each component."""
    return shapes.elastic_shapes(_decision_paths(spark, sf))[1]


_LIMIT = 600.0


def event_log(spark, sf):
    """The events as a log of entries (views), choices (purchases) and exits (all others)."""
    kind = F.when(F.col("event_type") == "view", "entry").when(F.col("event_type") == "purchase", "choice").otherwise("exit")
    return L.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", kind.alias("kind"))


@query(
    f"""WITH r AS (SELECT user_id AS session_id, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'entry' WHEN 'purchase' THEN 'choice' ELSE 'exit' END AS kind FROM events),
 g AS (SELECT *, sum((kind = 'entry')::INT) OVER (PARTITION BY session_id ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS trial FROM r),
 s AS (SELECT session_id, trial, min(t) FILTER (kind = 'entry') AS e FROM g WHERE trial > 0 GROUP BY 1, 2), n AS (SELECT *, lead(e) OVER (PARTITION BY session_id ORDER BY trial) AS nx FROM s),
 o AS (SELECT session_id, trial, e, nx, min(t) FILTER (kind = 'choice') AS c, min(t) FILTER (kind = 'exit') AS x FROM g JOIN n USING (session_id, trial) WHERE t <= e + {int(_LIMIT * 1e6)} GROUP BY ALL)
 SELECT session_id, e AS entry, CASE WHEN c IS NULL OR x < c THEN x END AS exit, c AS choice, CASE WHEN c IS NOT NULL THEN 'choice' WHEN nx <= e + {int(_LIMIT * 1e6)} THEN 'abandoned' ELSE 'timeout' END AS outcome FROM o"""
)
def q61_closed_trials(spark, sf):
    """Trials closed by a choice, the next entry or a time-out of ten minutes; a stream of the same log gives the same rows."""
    found = trials.closed_trials(event_log(spark, sf), limit_s=_LIMIT)
    return found.select("session_id", *[F.unix_micros(c).alias(c) for c in ("entry", "exit", "choice")], "outcome")


@query("WITH " + L.TRIALS + " SELECT session_id, idx, CASE idx WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS place FROM trials WHERE idx IN (7, 2, 30)")
def q62_select_trials(spark, sf):
    return plotdata.select_trials(L.trials(spark, sf), (7, 2, 30)).select("session_id", "idx", "place")


@query("WITH " + _MOVES + ", " + _arc("moves", "src") + ", " + _on_grid(50, ("lin_vel",)) + " SELECT session_id, idx, k, round(lin_vel, 5) AS y FROM gr")
def q63_arclength_signal(spark, sf):
    return curves.arclength_signal(_samples(spark, sf), "lin_vel").select("session_id", "idx", "k", F.round("y", 5).alias("y"))


@query(
    "WITH " + _WINDOWS + """, seg5 AS (SELECT session_id, idx FROM seg WHERE m >= 5), lk AS (SELECT w.session_id, w.idx, f.frame - ch + 10 AS k, f.lin_vel AS y FROM whole w JOIN frames f ON f.session_id = w.session_id AND f.frame >= ch - 10 AND f.frame < ch + 10 WHERE ch - 10 >= w_start AND ch + 10 <= w_end),
 g AS (SELECT seg.*, CAST(k AS BIGINT) AS k, k * (m - 1) / 49.0::DOUBLE AS pos FROM seg, (SELECT unnest(range(50)) AS k) WHERE m >= 5),
 mv AS (SELECT g.session_id, g.idx, g.k, lo.lin_vel + (hi.lin_vel - lo.lin_vel) * (pos - floor(pos)) AS y FROM g JOIN frames lo ON lo.session_id = g.session_id AND lo.frame = a + CAST(floor(pos) AS BIGINT) JOIN frames hi ON hi.session_id = g.session_id AND hi.frame = a + least(CAST(floor(pos) AS BIGINT) + 1, m - 1)),
 both_ AS (SELECT session_id, idx FROM seg5 INTERSECT SELECT session_id, idx FROM lk)
 SELECT session_id, idx, 'movement' AS channel, k, round(y, 3) AS y FROM mv SEMI JOIN both_ USING (session_id, idx) UNION ALL SELECT session_id, idx, 'purchase', k, round(y, 3) FROM lk SEMI JOIN both_ USING (session_id, idx)"""
)
def q64_assembled_channels(spark, sf):
    """Movement and purchase-locked curves of the trials that have both."""
    locked = locked_events(spark, sf).where("event = 'purchase'")
    found = curves.assemble_channels({"movement": padded_curves(spark, sf), "purchase": locked})
    return found.select("session_id", "idx", "channel", "k", F.round(F.col("y").cast("double"), 3).alias("y"))


@query("WITH " + L.FRAMES + ' SELECT session_id, round(1.1::DOUBLE * max(abs(lin_vel)), 6) AS "limit" FROM frames GROUP BY 1')
def q65_shared_limit(spark, sf):
    return plotdata.shared_limit(L.frames(spark, sf), "lin_vel", ["session_id"]).select("session_id", F.round("limit", 6).alias("limit"))


@query()
def q66_cluster_check(spark, sf):
    """Silhouette, smallest share and flag of the best k-means split of the first three shape scores for each k."""
    scores, _ = shapes.elastic_shapes(_decision_paths(spark, sf), n=3)
    rows = scores.select(*[F.get("scores", F.lit(j)).alias(f"s{j}") for j in range(3)])
    return spark.createDataFrame([tuple(r.values()) for r in ml.cluster_check(rows, ["s0", "s1", "s2"])], "k int, silhouette double, min_fraction double, flag string")


@query()
def q67_fpca_summary(spark, sf):
    """Contrasts of the components of movement curves by outcome and cue, with their shares of variance."""
    packed = curves.packed_curves(padded_curves(spark, sf), ["y"]).join(L.trials(spark, sf).select("session_id", "idx", "error", "cue"), ["session_id", "idx"])
    found = fda.fpca_summary(packed)
    share = F.array(*[F.lit(float(r)) for r in found["ratio"]])
    return found["table"].withColumn("share", F.get(share, F.col("component") - 1))


@query(
    "WITH " + L.TRIALS + """, r AS (SELECT rt, choice, rank() OVER (ORDER BY rt) + (count(*) OVER (PARTITION BY rt) - 1) / 2.0 AS r FROM trials WHERE rt IS NOT NULL), s AS (SELECT count(*) FILTER (choice = 1) AS n1, count(*) FILTER (choice = 0) AS n0, sum(r) FILTER (choice = 1) AS s, median(rt) FILTER (choice = 1) AS m1, median(rt) FILTER (choice = 0) AS m0 FROM r)
 SELECT s - n1 * (n1 + 1) / 2.0 AS u, round(2 * (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1, 6) AS effect, round(m1, 6) AS median_1, round(m0, 6) AS median_0 FROM s"""
)
def q68_main_effect(spark, sf):
    """U, effect and medians of the reaction times of both choices (their p-value is in q34b)."""
    found = stats.condition_main_effect(L.trials(spark, sf), "rt", "choice")
    return spark.createDataFrame([tuple(None if found[k] is None else round(float(found[k]), 6) for k in ("u", "effect", "median_1", "median_0"))], "u double, effect double, median_1 double, median_0 double")


@query(
    "WITH " + _PEAK + """, g AS (SELECT s.session_id, any_value(lw.peak_k) AS p, coalesce(max(CASE WHEN low AND lw.k < lw.peak_k THEN lw.k END), min(CASE WHEN low THEN lw.k END), 0) AS r FROM (SELECT DISTINCT session_id FROM s) s JOIN lw USING (session_id) GROUP BY 1)
 SELECT s.session_id, s.k, s.v AS lin_vel, coalesce(s.k = p, false) AS is_peak, s.k = CASE WHEN p IS NULL THEN 0 ELSE r END AS is_rest FROM s JOIN g USING (session_id) WHERE s.k < 40"""
)
def q69_velocity_profiles(spark, sf):
    """The first 40 speeds of each session with its first peak and the rest before it marked."""
    s = L.frames(spark, sf).select("session_id", F.col("frame").alias("k"), "lin_vel").withColumn("start", F.lit(4))
    marks = curves.figure_trials(s, start="start", keys=["session_id"])
    return plotdata.velocity_profiles(s.where("k < 40").drop("start"), marks, keys=["session_id"])


@query("WITH " + L.PORTS + _WINDOWS[len(L.TRIALS) :] + " SELECT w.session_id, w.idx, f.frame - w_start AS k, f.frame - ch AS t_choice, round(sqrt((x - left_x) * (x - left_x) + (y - left_y) * (y - left_y)), 5) AS d_left, round(sqrt((x - right_x) * (x - right_x) + (y - right_y) * (y - right_y)), 5) AS d_right FROM whole w JOIN frames f ON f.session_id = w.session_id AND f.frame >= w_start AND f.frame < w_end LEFT JOIN ports p ON p.session_id = w.session_id")
def q70_trial_panels(spark, sf):
    """Each frame of each trial's window with its distances to both choice ports."""
    w, f = _windows(spark, sf)
    found = plotdata.trial_panel(w, f, L.ports(spark, sf))
    return found.select("session_id", "idx", "k", "t_choice", F.round("d_left", 5).alias("d_left"), F.round("d_right", 5).alias("d_right"))


@query("WITH " + _MOVES + " SELECT m.session_id, m.idx, m.k, round(f.x - 3, 6) AS x, round(f.y + f.event_id % 5, 6) AS y FROM moves m JOIN frames f ON f.session_id = m.session_id AND f.frame = m.ce + m.k")
def q71_node_paths(spark, sf):
    """The path of one node through each movement."""
    found = geometry.node_samples(L.trials(spark, sf), pose_nodes(spark, sf), "left")
    return found.select("session_id", "idx", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))

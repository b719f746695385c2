"""Queries of ports, trial geometry, curves and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinegrid.operators import align, curves, geometry, plotdata
from kinegrid.operators import pose as pose_ops
from kinegrid.operators.geometry import GAUSS
from kinegrid.plans import lenses as L

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *keys, places=6):
    return df.select(*keys, *[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys])


def _r(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


_PORT = ("center_x", "center_y", "left_x", "left_y", "right_x", "right_y")
_MOVES = L.PORTS + """, ok AS (SELECT *, ch - ce + 1 AS m FROM trials WHERE ce >= 1 AND ch - ce + 1 >= 4),
moves AS (SELECT o.session_id, o.idx, o.ce, o.ch, o.choice, o.error, o.m, f.frame - o.ce AS k, f.x, f.y, f.lin_vel FROM ok o JOIN frames f ON f.session_id = o.session_id AND f.frame BETWEEN o.ce AND o.ch)"""


def _arc(source: str, name: str) -> str:
    return f"""{name}_s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM {source} WINDOW w AS (PARTITION BY session_id, idx ORDER BY k)),
{name} AS (SELECT *, sum(step) OVER (PARTITION BY session_id, idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS arc FROM {name}_s)"""


def _smooth(sigma: float, name: str) -> str:
    taps = ", ".join(f"({o}, {GAUSS[sigma][abs(o)]}::DOUBLE)" for o in range(1 - len(GAUSS[sigma]), len(GAUSS[sigma])))
    return f"""{name}_t AS (SELECT * FROM (VALUES {taps}) AS v(o, weight)), {name}_i AS (SELECT a.*, weight, ((k + o) % (2 * m) + 2 * m) % (2 * m) AS p FROM moves a CROSS JOIN {name}_t),
{name} AS (SELECT i.session_id, i.idx, i.choice, i.m, i.k, sum(weight * b.x) AS x, sum(weight * b.y) AS y FROM {name}_i i JOIN moves b ON b.session_id = i.session_id AND b.idx = i.idx AND b.k = CASE WHEN p >= i.m THEN 2 * i.m - 1 - p ELSE p END GROUP BY ALL)"""


def _samples(spark, sf):
    return geometry.movement_samples(L.trials(spark, sf), L.frames(spark, sf))


def _axis(spark, sf):
    return geometry.decision_axis(L.ports(spark, sf))


@query("WITH " + L.PORTS + " SELECT session_id, " + _r(*_PORT) + " FROM ports")
def q15_ports(spark, sf):
    return rounded(L.ports(spark, sf), "session_id")


@query("WITH " + L.PORTS + " SELECT session_id, " + _r("center_x", "center_y", "ux", "uy", "d_right", "d_left", "scale") + " FROM axis")
def q16_axis_scale(spark, sf):
    return rounded(_axis(spark, sf), "session_id")


_PATH = """ends AS (SELECT session_id, idx, choice, max(arc) AS total, arg_max(x, k) AS bx, arg_max(y, k) AS "by", arg_min(x, k) AS ax, arg_min(y, k) AS ay FROM arcs GROUP BY ALL),
p AS (SELECT e.*, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS disp, abs(CASE WHEN choice = 1 THEN d_right ELSE d_left END) AS d, scale FROM ends e JOIN axis USING (session_id))
SELECT session_id, idx, round(total * scale, 6) AS path_len_cm, round(total / nullif(d, 0), 6) AS path_len_norm, round(total / nullif(disp, 0), 6) AS tortuosity FROM p"""


@query("WITH " + _MOVES + ", " + _arc("moves", "arcs") + ", " + _PATH)
def q17_path_length(spark, sf):
    return rounded(geometry.path_measures(_samples(spark, sf), _axis(spark, sf)), "session_id", "idx")


_ALONG = """pr AS (SELECT a.*, CASE WHEN choice = 1 THEN 1 ELSE -1 END * ((x - center_x) * ux + (y - center_y) * uy) AS along, abs(CASE WHEN choice = 1 THEN d_right ELSE d_left END) AS d_chosen, scale, max(arc) OVER (PARTITION BY session_id, idx) AS total FROM arcs a JOIN axis USING (session_id))"""


@query(
    "WITH " + _MOVES + ", " + _arc("moves", "arcs") + ", " + _ALONG + """, g AS (SELECT session_id, idx, max(-along) AS dev, arg_max(k, struct_pack(v := -along, k := -k)) AS i_dev, max(k) AS last, min(CASE WHEN along >= 0.5 * d_chosen THEN k END) AS c, min(CASE WHEN arc >= 0.2::DOUBLE * total THEN k END) AS l, any_value(scale) AS scale, any_value(d_chosen) AS d FROM pr GROUP BY 1, 2)
 SELECT session_id, idx, round(dev * scale, 6) AS dev_unchosen_cm, round(dev / nullif(d, 0), 6) AS dev_unchosen_norm, i_dev, round(i_dev / 25, 6) AS t_dev, round(coalesce(c, last) / 25, 6) AS t_commit, coalesce(l, last) AS i_land FROM g"""
)
def q18_landmarks(spark, sf):
    return rounded(geometry.landmark_measures(_samples(spark, sf), _axis(spark, sf)), "session_id", "idx")


@query(
    "WITH " + _MOVES + """, av AS (SELECT session_id, frame, y - 49.5::DOUBLE AS ang_vel FROM frames), pk AS (SELECT session_id, idx, ce, max(lin_vel) AS peak_lin_vel, arg_max(k, struct_pack(v := lin_vel, k := -k)) AS i_peak, arg_max(lin_vel, k) AS vel_choice, max(k) AS last FROM moves GROUP BY 1, 2, 3),
 n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1), nr AS (SELECT p.session_id, p.idx, f.frame - ce - i_peak AS lag, f.ang_vel FROM pk p JOIN n USING (session_id) JOIN av f ON f.session_id = p.session_id AND f.frame BETWEEN greatest(greatest(ce - 10, 0), ce + i_peak - 3) AND least(least(ce + last + 20, n) - 1, ce + i_peak + 3)),
 tn AS (SELECT session_id, idx, arg_max(ang_vel, struct_pack(v := abs(ang_vel), f := -lag)) AS peak_ang_vel, arg_max(lag, struct_pack(v := abs(ang_vel), f := -lag)) AS lag FROM nr GROUP BY 1, 2)
 SELECT session_id, idx, round(peak_lin_vel, 6) AS peak_lin_vel, round(i_peak / 25, 6) AS t_peak_lin_vel, round(peak_ang_vel, 6) AS peak_ang_vel, round(lag / 25, 6) AS ang_peak_lag, round(vel_choice, 6) AS vel_choice, round(last / 25, 6) AS t_choice FROM pk JOIN tn USING (session_id, idx)"""
)
def q19_velocity_peaks(spark, sf):
    f = L.frames(spark, sf)
    w = align.trial_windows(L.trials(spark, sf), align.session_lengths(f), entry="ce", choice="ch")
    s = geometry.movement_samples(w, f)
    return rounded(geometry.velocity_measures(s, f.withColumn("ang_vel", F.col("y") - 49.5)), "session_id", "idx")


@query("WITH " + _MOVES + ", " + _smooth(1.5, "sm") + " SELECT session_id, idx, k, " + _r("x", "y", places=4) + " FROM sm")
def q20_smoothed_paths(spark, sf):
    return geometry.smooth(_samples(spark, sf)).select("session_id", "idx", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _on_grid(n: int, values: tuple[str, ...], name: str = "gr") -> str:
    cols = ", ".join(f"lo.{v} + (hi.{v} - lo.{v}) * CASE WHEN hi.arc > lo.arc THEN (g - lo.arc) / (hi.arc - lo.arc) ELSE 0 END AS {v}" for v in values)
    return f"""tt AS (SELECT session_id, idx, max(arc) AS total, max(k) AS last FROM src GROUP BY 1, 2), gg AS (SELECT tt.*, gk, CASE WHEN gk = {n - 1} THEN total ELSE gk * total / {n - 1}::DOUBLE END AS g FROM tt, (SELECT unnest(range({n})) AS gk) WHERE total > 0),
lo_ AS (SELECT gg.session_id, gg.idx, gk, g, last, max(s.k) AS k0 FROM gg JOIN src s ON s.session_id = gg.session_id AND s.idx = gg.idx AND s.arc <= g GROUP BY ALL),
{name} AS (SELECT lo_.session_id, lo_.idx, gk AS k, {cols} FROM lo_ JOIN src lo ON lo.session_id = lo_.session_id AND lo.idx = lo_.idx AND lo.k = k0 JOIN src hi ON hi.session_id = lo_.session_id AND hi.idx = lo_.idx AND hi.k = least(k0 + 1, last))"""


@query("WITH " + _MOVES + ", " + _arc("moves", "src") + ", " + _on_grid(50, ("x", "y")) + " SELECT session_id, idx, k, " + _r("x", "y") + " FROM gr")
def q21_arc_resample(spark, sf):
    return rounded(curves.arclength_resample(_samples(spark, sf), 50), "session_id", "idx", "k")


@query(
    "WITH " + _MOVES + ", " + _smooth(1.0, "sm") + ", " + _arc("sm", "arcs") + ", " + _ALONG + ", src AS (SELECT session_id, idx, k, arc, -along / nullif(d_chosen, 0) AS v FROM pr), " + _on_grid(50, ("v",)) + " SELECT session_id, idx, k, round(v, 5) AS y FROM gr"
)
def q22_deviation_curves(spark, sf):
    return rounded(curves.deviation_curves(_samples(spark, sf), _axis(spark, sf)), "session_id", "idx", "k", places=5)


_LOCKED = L.TRIALS + """, n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1), w AS (SELECT t.*, greatest(ce - 10, 0) AS w_start, least(ch + 20, n) AS w_end FROM trials t JOIN n USING (session_id)),
lock AS (SELECT w.session_id, w.idx, f.frame - ch + 5 AS k, f.lin_vel AS y FROM w JOIN frames f ON f.session_id = w.session_id AND f.frame >= ch - 5 AND f.frame < ch + 5 WHERE ch - 5 >= w_start AND ch + 5 <= w_end AND w_end - w_start >= 3)"""


def _locked(spark, sf):
    f = L.frames(spark, sf)
    w = align.trial_windows(L.trials(spark, sf), align.session_lengths(f), entry="ce", choice="ch")
    return curves.event_locked_curves(w, f, at="ch", pre_s=0.2, post_s=0.2)


@query("WITH " + _LOCKED + " SELECT session_id, idx, k, round((k - 5) / 25, 6) AS t, y FROM lock")
def q23_event_locked_curves(spark, sf):
    return _locked(spark, sf).select("session_id", "idx", "k", F.round("t", 6).alias("t"), "y")


@query(
    "WITH " + _MOVES + ", " + _arc("moves", "src") + ", " + _on_grid(40, ("x", "y")) + """ SELECT g.session_id, g.idx, g.k, round((y - center_y) * ux - (x - center_x) * uy, 5) AS u, round(CASE WHEN choice = 1 THEN 1 ELSE -1 END * ((x - center_x) * ux + (y - center_y) * uy), 5) AS v
 FROM gr g JOIN axis USING (session_id) JOIN trials t ON t.session_id = g.session_id AND t.idx = g.idx"""
)
def q24_decision_frame_paths(spark, sf):
    return rounded(curves.decision_frame_paths(_samples(spark, sf), _axis(spark, sf)), "session_id", "idx", "k", places=5)


@query("WITH " + _MOVES + _LOCKED[len(L.TRIALS) :] + " SELECT session_id, idx FROM moves WHERE m >= 5 INTERSECT SELECT session_id, idx FROM lock")
def q25_channel_trials(spark, sf):
    moves = curves.movement_curves(_samples(spark, sf), "lin_vel", 10)
    return curves.channel_trials([moves, _locked(spark, sf)])


def _session_series(spark, sf):
    return L.frames(spark, sf).select("session_id", F.col("frame").alias("k"), "lin_vel")


_PEAK = L.FRAMES + """, s AS (SELECT session_id, frame AS k, lin_vel AS v, lag(lin_vel) OVER w AS a, lead(lin_vel) OVER w AS b, lead(lin_vel, 2) OVER w AS c FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
pk AS (SELECT session_id, min(k) AS peak_k, arg_min(v, k) AS peak FROM s WHERE k >= 4 AND k < 34 AND v > a AND v > b AND v > 9 GROUP BY 1),
lw AS (SELECT s.session_id, k, peak_k, k >= 1 AND k < 15 AND c IS NOT NULL AND v < a AND v < b AND v < CASE WHEN peak IS NULL THEN 6 ELSE 0.2::DOUBLE * peak END AS low FROM s LEFT JOIN pk USING (session_id))"""


@query("WITH " + _PEAK + " SELECT session_id, any_value(peak_k) AS peak_k, coalesce(max(CASE WHEN low AND k < peak_k THEN k END), min(CASE WHEN low THEN k END), 0) AS rest_k FROM lw GROUP BY 1")
def q26_peak_and_rest(spark, sf):
    s = _session_series(spark, sf).withColumn("start", F.lit(4))
    peaks = curves.first_peak(s, start="start", keys=["session_id"])
    return curves.rest_minimum(s, peaks, keys=["session_id"]).join(peaks, "session_id", "left").select("session_id", "peak_k", "rest_k")


@query("WITH " + _PEAK + """, g AS (SELECT s.session_id, any_value(lw.peak_k) AS lmax_idx, coalesce(max(CASE WHEN low AND lw.k < lw.peak_k THEN lw.k END), min(CASE WHEN low THEN lw.k END), 0) AS r FROM (SELECT DISTINCT session_id FROM s) s JOIN lw USING (session_id) GROUP BY 1)
 SELECT g.session_id, round(peak, 6) AS localmax, lmax_idx, CASE WHEN lmax_idx IS NULL THEN 0 ELSE r END AS localmin FROM g LEFT JOIN pk USING (session_id)""")
def q49_figure_trials(spark, sf):
    """First peak, its place and the rest before it, as figures use them."""
    s = _session_series(spark, sf).withColumn("start", F.lit(4))
    return rounded(curves.figure_trials(s, start="start", keys=["session_id"]), "session_id")


_Q = "quantile_cont(rt, [1.0 / 3, 2.0 / 3, 0.01, 0.99])"


@query("WITH " + L.TRIALS + f" SELECT session_id, round({_Q}[1], 6) AS q0, round({_Q}[2], 6) AS q1, round({_Q}[3], 6) AS q2, round({_Q}[4], 6) AS q3 FROM trials GROUP BY 1")
def q50_reaction_time_shares(spark, sf):
    """Terciles and display limits of each session's reaction times."""
    return rounded(plotdata.shares(L.trials(spark, sf), "rt", (1 / 3, 2 / 3, 0.01, 0.99), ["session_id"]), "session_id")


@query("WITH " + L.TRIALS + " SELECT session_id, arg_min(idx, struct_pack(a := rt, b := idx)) AS least, arg_max(idx, struct_pack(a := rt, b := -idx)) AS greatest FROM trials GROUP BY 1")
def q51_extreme_trials(spark, sf):
    """The fastest and the slowest trial of each session."""
    return plotdata.extreme_trials(L.trials(spark, sf), "rt", ["session_id"])


@query(
    "WITH " + L.TRIALS + """, a AS (SELECT t.session_id, t.idx, f.frame - ch AS o, f.lin_vel AS v FROM trials t JOIN frames f ON f.session_id = t.session_id AND f.frame >= ch - 5 AND f.frame < ch + 6),
 g AS (SELECT session_id, idx, max(v) AS p, arg_max(o, struct_pack(v := v, o := -o)) AS w, max(v) FILTER (o < 0) AS b, max(v) FILTER (o >= 0) AS f FROM a GROUP BY 1, 2)
 SELECT session_id, idx, CASE WHEN p >= 40 THEN p END AS peak_velocity, CASE WHEN p >= 40 THEN w + 5 END AS peak_frame, CASE WHEN p >= 40 THEN round(w / 25, 6) END AS peak_time, CASE WHEN b >= 40 THEN b END AS pre_event_peak, CASE WHEN f >= 40 THEN f END AS post_event_peak FROM g"""
)
def q27_epoch_peaks(spark, sf):
    w = align.aligned_windows(L.trials(spark, sf), L.frames(spark, sf), before=5, after=6, at="ch")
    return curves.epoch_peaks(w, window_before=5, floor=40.0).withColumn("peak_time", F.round("peak_time", 6))


@query(
    "WITH " + L.FRAMES + """, d AS (SELECT session_id, frame, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) * 0.099930755788::DOUBLE * 25 AS s FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame))
 SELECT session_id, frame, round(coalesce(s, lag(s) OVER (PARTITION BY session_id ORDER BY frame)), 6) AS speed FROM d"""
)
def q27b_node_speed(spark, sf):
    rows = L.frames(spark, sf).withColumn("node", F.lit("body"))
    return pose_ops.node_speed(rows).select("session_id", "frame", F.round("speed", 6).alias("speed"))


def _signals(spark, sf):
    """Frames with a heading and an angular velocity."""
    return L.frames(spark, sf).withColumn("ang_vel", (F.col("event_id") * 37 % 101 - 50).cast("double")).withColumn("head_angle", F.col("event_id") % 63 / 10)


def _windowed_trials(spark, sf):
    return L.trials(spark, sf).withColumns({"w_start": F.greatest(F.col("ce") - 2, F.lit(0)), "w_end": F.col("ch") + 2, "sampling": F.col("rt") / 2})


_MEASURES = (
    "WITH " + _MOVES.replace("f.lin_vel FROM ok o", "f.lin_vel, (f.event_id * 37 % 101 - 50)::DOUBLE AS ang_vel, (f.event_id % 63) / 10 AS head_angle, o.target, o.cue, o.rt FROM ok o") + ", " + _arc("moves", "arcs") + ", " + _ALONG
    + ", " + _smooth(1.5, "sm") + ", " + _arc("sm", "sarcs")
    + """, g AS (SELECT session_id, idx, any_value(target) AS target, any_value(choice) AS choice, any_value(error) AS error, any_value(cue) AS cue, any_value(rt) AS rt, any_value(ce) AS ce, any_value(ch) AS ch,
 max(-along) AS dev, arg_max(k, struct_pack(v := -along, k := -k)) AS i_dev, max(k) AS last, min(CASE WHEN along >= 0.5 * d_chosen THEN k END) AS c, arg_min(head_angle, CASE WHEN arc >= 0.2::DOUBLE * total THEN k END) AS head,
 any_value(scale) AS scale, any_value(d_chosen) AS d, max(lin_vel) AS peak, arg_max(k, struct_pack(v := lin_vel, k := -k)) AS i_peak, arg_max(lin_vel, k) AS vel_choice FROM pr GROUP BY 1, 2),
e AS (SELECT session_id, idx, max(arc) AS total, sqrt((arg_max(x, k) - arg_min(x, k)) * (arg_max(x, k) - arg_min(x, k)) + (arg_max(y, k) - arg_min(y, k)) * (arg_max(y, k) - arg_min(y, k))) AS disp FROM sarcs GROUP BY 1, 2),
tn AS (SELECT g.session_id, g.idx, f.frame - (ce + i_peak) AS lag, (f.event_id * 37 % 101 - 50)::DOUBLE AS av FROM g JOIN frames f ON f.session_id = g.session_id AND f.frame BETWEEN greatest(ce - 2, 0, ce + i_peak - 3) AND least(ch + 1, ce + i_peak + 3)),
tp AS (SELECT session_id, idx, arg_max(av, struct_pack(v := abs(av), f := -lag)) AS peak_ang_vel, arg_max(lag, struct_pack(v := abs(av), f := -lag)) AS lag FROM tn GROUP BY 1, 2)
SELECT session_id, idx, target, choice, error, cue, round(rt / 2, 6) AS sampling, round(rt, 6) AS rt, round(vel_choice, 6) AS vel_choice, round(peak, 6) AS peak_lin_vel, round(i_peak / 25, 6) AS t_peak_lin_vel, round(last / 25, 6) AS t_choice,
 round(coalesce(c, last) / 25, 6) AS t_commit, round(dev * g.scale, 5) AS dev_unchosen_cm, round(dev / nullif(d, 0), 5) AS dev_unchosen_norm, i_dev, round(i_dev / 25, 6) AS t_dev,
 round(CASE WHEN choice = 1 THEN 1 ELSE -1 END * (cos(head) * ux + sin(head) * uy), 5) AS head_to_chosen, round(total / nullif(disp, 0), 4) AS tortuosity, round(total * g.scale, 4) AS path_len_cm, round(total / nullif(d, 0), 4) AS path_len_norm,
 peak_ang_vel, round(lag / 25, 6) AS ang_peak_lag FROM g JOIN e USING (session_id, idx) JOIN axis USING (session_id) LEFT JOIN tp USING (session_id, idx)"""
)


@query(_MEASURES)
def q46_measure_table(spark, sf):
    """Every scalar measure of every measurable trial."""
    t = geometry.build_measure_table(_windowed_trials(spark, sf), _signals(spark, sf), _axis(spark, sf))
    places = {"tortuosity": 4, "path_len_cm": 4, "path_len_norm": 4, "dev_unchosen_cm": 5, "dev_unchosen_norm": 5, "head_to_chosen": 5}
    return t.select(*[F.round(c, places.get(c, 6)).alias(c) if k == "double" and c != "peak_ang_vel" else F.col(c) for c, k in t.dtypes])


@query(
    "WITH " + _MOVES + ", " + _smooth(1.5, "sm") + ", " + _arc("sm", "arcs") + """, ends AS (SELECT session_id, idx, max(arc) AS total FROM arcs GROUP BY 1, 2), mv AS (SELECT m.session_id, m.idx, any_value(error) AS error, max(lin_vel) AS peak, max(-CASE WHEN choice = 1 THEN 1 ELSE -1 END * ((x - center_x) * ux + (y - center_y) * uy)) * any_value(scale) AS dev, any_value(scale) AS scale FROM moves m JOIN axis USING (session_id) GROUP BY 1, 2)
 SELECT error, count(*) AS n_trials, round(avg(total * scale), 5) AS mean_path_len_cm, round(avg(peak), 5) AS mean_peak_lin_vel, round(avg(dev), 5) AS mean_dev_unchosen_cm FROM mv JOIN ends USING (session_id, idx) GROUP BY 1"""
)
def flagship_outcome_summary(spark, sf):
    """Mean path length, peak velocity and deviation by outcome, from events to measures."""
    t = geometry.build_measure_table(L.trials(spark, sf), L.frames(spark, sf), _axis(spark, sf))
    mean = lambda c: F.round(F.avg(c), 5).alias(f"mean_{c}")
    return t.groupBy("error").agg(F.count(F.lit(1)).alias("n_trials"), mean("path_len_cm"), mean("peak_lin_vel"), mean("dev_unchosen_cm"))

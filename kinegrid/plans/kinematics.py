"""Queries of the behavioural log, pose cleaning, kinematics and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinegrid.functions.expr import SG_END, SG_INSIDE, SG_START, by, lerp_at
from kinegrid.operators import align, behavior, pose
from kinegrid.plans import lenses as L

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, sf):
    f = L.trials(spark, sf)
    return f.select("session_id", F.col("ce").alias("absolute_trial"), "time", (F.col("target") * 50 + F.col("ce") - 20).cast("double").alias("sample"), F.col("rt").alias("latency"), F.col("target").alias("presented"), F.col("choice").alias("response"), "cue")


_LOG = L.TRIALS + """, log AS (SELECT session_id, ce AS absolute_trial, "time", CAST(target * 50 + ce - 20 AS DOUBLE) AS sampling, rt, target, choice, row_number() OVER (PARTITION BY session_id ORDER BY ce) AS n FROM trials),
cut AS (SELECT *, first_value("time") OVER (PARTITION BY session_id ORDER BY absolute_trial) AS t0_anchor, CAST(target <> choice AS INT) AS error FROM log WHERE n > 2),
ok AS (SELECT * FROM cut WHERE sampling >= 0),
lim AS (SELECT session_id, quantile_cont(sampling, 0.95) AS s95, quantile_cont(rt, 0.95) AS r95 FROM ok GROUP BY 1),
clean AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.session_id ORDER BY absolute_trial) - 1 AS idx FROM ok JOIN lim USING (session_id) WHERE sampling <= s95 AND rt <= r95)"""


@query("WITH " + _LOG + ' SELECT session_id, CAST(idx AS BIGINT) AS idx, absolute_trial, round(sampling, 6) AS sampling, round(rt, 6) AS rt, error, round(t0_anchor, 3) AS t0_anchor FROM clean')
def q01_behavior_filter(spark, sf):
    c = behavior.clean_behavior(_log(spark, sf), trial_offset=2)
    return c.select("session_id", F.col("idx").cast("long").alias("idx"), "absolute_trial", F.round("sampling", 6).alias("sampling"), F.round("rt", 6).alias("rt"), "error", F.round("t0_anchor", 3).alias("t0_anchor"))


def _gappy(spark, sf):
    return L.frames(spark, sf).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("x")))


_GAPPY = L.FRAMES + ", g AS (SELECT session_id, frame, CASE WHEN event_id % 7 <> 0 THEN x END AS x FROM frames)"


@query(
    "WITH " + _GAPPY + """, b AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS f0,
 first_value(x IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS f1 FROM g
 WINDOW p AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT session_id, frame, round(coalesce(x, v0 + (v1 - v0) * (frame - f0) / nullif(f1 - f0, 0), v0, v1), 6) AS x FROM b"""
)
def q02_fill_missing(spark, sf):
    return pose.fill_missing(_gappy(spark, sf), ["x"]).select("session_id", "frame", F.round("x", 6).alias("x"))


def _sg_sql(c: str) -> str:
    def taps(coefs, first):
        terms = [f"{v} * {'lead' if first + k > 0 else 'lag'}({c}, {abs(first + k)}) OVER w" if first + k else f"{v} * {c}" for k, v in enumerate(coefs) if v]
        return "(" + " + ".join(terms) + ") / 252.0"

    ends = " ".join(f"WHEN i = {k} THEN {taps(SG_START[k], -k)} WHEN i = n - {3 - k} THEN {taps(SG_END[k], -4 - k)}" for k in range(3))
    return f"CASE WHEN n < 7 THEN NULL {ends} ELSE {taps(SG_INSIDE, -3)} END"


_SG = L.FRAMES + f""", c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM frames),
d AS (SELECT session_id, frame, {_sg_sql('x')} AS dx, {_sg_sql('y')} AS dy FROM c WINDOW w AS (PARTITION BY session_id ORDER BY frame))"""


@query("WITH " + _SG + " SELECT session_id, frame, round(sqrt(dx * dx + dy * dy) * 2.5, 6) AS speed FROM d")
def q03_sg_velocity(spark, sf):
    return pose.velocity(L.frames(spark, sf), scale=0.1, fps=25, into="v").select("session_id", "frame", F.round("v", 6).alias("speed"))


_TAU = "(2 * pi())"
_WRAP = lambda e: f"(({e} + pi()) - {_TAU} * floor(({e} + pi()) / {_TAU}) - pi())"
_ANGLES = L.FRAMES + f""", h AS (SELECT session_id, frame, {_WRAP('atan2(y - 49.5, x - 20.5)')} AS a FROM frames),
s AS (SELECT *, a - lag(a) OVER (PARTITION BY session_id ORDER BY frame) AS d FROM h),
m AS (SELECT *, {_WRAP('d')} AS m0 FROM s), m2 AS (SELECT *, CASE WHEN m0 = -pi() AND d > 0 THEN pi() ELSE m0 END AS m FROM m),
u AS (SELECT session_id, frame, a, a + sum(coalesce(CASE WHEN abs(d) < pi() THEN 0 ELSE m - d END, 0)) OVER (PARTITION BY session_id ORDER BY frame) AS un FROM m2)"""


@query(
    "WITH " + _ANGLES + """, l AS (SELECT *, lag(un) OVER w AS u0, lead(un) OVER w AS u1 FROM u WINDOW w AS (PARTITION BY session_id ORDER BY frame))
 SELECT session_id, frame, round(a, 6) AS head_angle, round(CASE WHEN u0 IS NULL THEN (u1 - un) / 0.04 WHEN u1 IS NULL THEN (un - u0) / 0.04 ELSE (u1 - u0) / 0.08 END, 4) AS ang_vel FROM l"""
)
def q04_heading(spark, sf):
    rows = L.frames(spark, sf).withColumn("hx", F.col("x") - 20.5).withColumn("hy", F.col("y") - 49.5)
    return pose.angular_measures(rows).select("session_id", "frame", F.round("head_angle", 6).alias("head_angle"), F.round("ang_vel", 4).alias("ang_vel"))


@query(
    "WITH " + L.FRAMES + """, d AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) > 40 AS far, lag(x) OVER w IS NOT NULL AND lead(x) OVER w IS NOT NULL AS inr FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
 h AS (SELECT *, coalesce(inr AND (far OR lead(far) OVER w), false) AS hit FROM d WINDOW w AS (PARTITION BY session_id ORDER BY frame))
 SELECT session_id, frame, hit OR coalesce(lag(hit) OVER w AND lead(hit) OVER w, false) AS flagged FROM h WINDOW w AS (PARTITION BY session_id ORDER BY frame)"""
)
def q05_outlier_flags(spark, sf):
    return pose.outlier_flags(L.frames(spark, sf), 40.0).select("session_id", "frame", "flagged")


@query()
def q05b_clean_outliers(spark, sf):
    rows = L.frames(spark, sf).select("session_id", "frame", "x", "y")
    return pose.clean_outliers(rows, 60.0)


@query(
    "WITH " + L.FRAMES + """, v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN x END AS a, CASE WHEN event_id % 5 <> 0 THEN y END AS b, CASE WHEN event_id % 35 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS c FROM frames),
 n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, (abs(a - b) >= 10)::INT AS ab, (abs(a - c) >= 10)::INT AS ac, (abs(b - c) >= 10)::INT AS bc FROM v)
 SELECT event_id, round(CASE n WHEN 0 THEN NULL WHEN 1 THEN coalesce(a, b, c) WHEN 2 THEN CASE WHEN coalesce(ab, ac, bc) = 1 THEN least(a, b, c) ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / 2 END
 ELSE CASE WHEN (ab + ac = 2)::INT + (ab + bc = 2)::INT + (ac + bc = 2)::INT = 1 THEN CASE WHEN ab + ac = 2 THEN (b + c) / 2 WHEN ab + bc = 2 THEN (a + c) / 2 ELSE (a + b) / 2 END ELSE (a + b + c) / 3 END END, 6) AS v FROM n"""
)
def q06_node_consensus(spark, sf):
    e = F.col("event_id")
    nodes = [F.when(e % 7 != 0, F.col("x")), F.when(e % 5 != 0, F.col("y")), F.when(e % 35 != 0, (e % 100).cast("double"))]
    return L.frames(spark, sf).select("event_id", F.round(pose.node_consensus(nodes), 6).alias("v"))


@query(
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
 SELECT event_id, round(CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (value - med) / mad END, 6) AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type)"""
)
def q07_robust_z(spark, sf):
    return pose.robust_z(L.table(spark, sf, "events"), "value", ["event_type"], "z").select("event_id", F.round("z", 6).alias("z"))


@query(
    "WITH " + L.CURVES + """, p AS (SELECT a.idx, a.label, a.k // 2 AS j, a.y AS x, b.y AS y FROM curves a JOIN curves b ON a.idx = b.idx AND b.k = a.k + 1 WHERE a.k % 2 = 0),
 r AS (SELECT label, j, avg(x) AS rx, avg(y) AS ry FROM p GROUP BY 1, 2) SELECT idx, round(avg((x - rx) * (x - rx) + (y - ry) * (y - ry)), 6) AS msd FROM p JOIN r USING (label, j) GROUP BY 1"""
)
def q08_msd(spark, sf):
    c = L.packed_curves(spark, sf).select("idx", "label", "y", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    paths = c.select("idx", "label", "j", F.get("y", F.col("j") * 2).alias("x"), F.get("y", F.col("j") * 2 + 1).alias("y"))
    ref = paths.groupBy("label", "j").agg(F.avg("x").alias("rx"), F.avg("y").alias("ry"))
    return pose.mean_squared_displacement(paths, ref, ["idx"], ["label", "j"]).select("idx", F.round("msd", 6).alias("msd"))


@query(
    """WITH w AS (SELECT g, g * 63.0::DOUBLE / 49 AS p, least(CAST(floor(g * 63.0::DOUBLE / 49) AS BIGINT), 62) AS lo FROM (SELECT unnest(range(50)) AS g))
 SELECT vec_id AS idx, CAST(g AS BIGINT) AS g, round(embedding[lo + 1]::DOUBLE + (embedding[lo + 2]::DOUBLE - embedding[lo + 1]::DOUBLE) * (p - lo), 6) AS y FROM embeddings, w"""
)
def q09_resample(spark, sf):
    rows = L.packed_curves(spark, sf).select("idx", "y", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("g"))
    return rows.select("idx", F.col("g").cast("long").alias("g"), F.round(lerp_at(F.col("y"), F.col("g") * 63.0 / 49), 6).alias("y"))


@query("WITH " + _LOG + """ SELECT session_id, CAST(idx AS BIGINT) AS idx, CAST(floor(("time" - t0_anchor + 5.32) * 25) AS BIGINT) AS f_entry, CAST(floor(("time" + sampling + rt - t0_anchor + 5.32) * 25) AS BIGINT) AS f_choice FROM clean""")
def q10_event_frames(spark, sf):
    rows = behavior.clean_behavior(_log(spark, sf), trial_offset=2).withColumn("retrieval", F.lit(0.3))
    out = behavior.event_frames(rows, 5.32)
    return out.select("session_id", F.col("idx").cast("long").alias("idx"), F.col("f_center_entry").alias("f_entry"), F.col("f_choice_entry").alias("f_choice"))


@query(
    "WITH " + L.TRIALS + """, n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1), w AS (SELECT t.*, greatest(ce - 10, 0) AS s, least(ch + 20, n) AS e FROM trials t JOIN n USING (session_id))
 SELECT w.session_id, w.idx, count(*) AS n_samples, round(sum(f.x), 4) AS sum_x, min(f.frame) AS first_frame FROM w JOIN frames f ON f.session_id = w.session_id AND f.frame >= w.s AND f.frame < w.e WHERE e - s >= 3 GROUP BY 1, 2"""
)
def q11_trial_slices(spark, sf):
    f = L.frames(spark, sf)
    w = align.trial_windows(L.trials(spark, sf), align.session_lengths(f), entry="ce", choice="ch")
    s = align.trial_samples(w, f)
    return s.groupBy("session_id", "idx").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("x"), 4).alias("sum_x"), F.min("frame").alias("first_frame"))


@query("WITH " + L.TRIALS + """, o AS (SELECT CAST(unnest(range(-5, 6)) AS INT) AS "offset") SELECT t.session_id, t.idx, o."offset", f.lin_vel AS value FROM trials t CROSS JOIN o LEFT JOIN frames f ON f.session_id = t.session_id AND f.frame = t.ch + o."offset\"""")
def q12_aligned_windows(spark, sf):
    return align.aligned_windows(L.trials(spark, sf), L.frames(spark, sf), before=5, after=6, at="ch")


@query(
    "WITH " + L.FRAMES + """, t AS (SELECT session_id, frame, frame * 0.7::DOUBLE + y / 100 AS "time" FROM frames), b AS (SELECT *, first_value("time") OVER (PARTITION BY session_id ORDER BY "time") AS t1, max("time") OVER (PARTITION BY session_id) AS tn FROM t)
 SELECT session_id, frame, CAST(floor(("time" - t1 + 0.4) * 25) + 2 AS BIGINT) AS standard, CAST(trunc(-0.4 + "time" * 29.407498) - 1 + 2 - trunc("time" / (tn * 0.25)) * round_even(("time" - t1) / (0.08 * 100), 0) AS BIGINT) AS decayed FROM b"""
)
def q13_frame_sync(spark, sf):
    t = L.frames(spark, sf).select("session_id", "frame", (F.col("frame") * 0.7 + F.col("y") / 100).alias("time"))
    a = behavior.synchronized_frames(t, 0.4, extra=2).withColumnRenamed("sync_frame", "standard")
    return behavior.synchronized_frames(a, 0.4, extra=2, decay=True, start=0.25, interval=0.08).select("session_id", "frame", "standard", F.col("sync_frame").alias("decayed"))


def _offset_inputs(spark, sf):
    t = L.trials(spark, sf).select("session_id", "idx", (F.col("ce") * 0.4).alias("t_entry"), (F.col("ce") * 0.4 + 0.1).alias("t_exit"), (F.col("ch") * 0.4 + 0.2).alias("t_choice"))
    return t, L.frames(spark, sf)


@query(
    "WITH " + L.TRIALS + """, g AS (SELECT unnest(range(17)) AS k), n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1),
 p AS (SELECT session_id, frame + 1 AS at, sum(lin_vel) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS total FROM frames),
 c AS (SELECT session_id, idx, k, 0.0::DOUBLE + k * 0.5::DOUBLE AS f0, CAST(floor((ce * 0.4::DOUBLE + f0) * 2) AS BIGINT) AS fe, CAST(floor((ce * 0.4::DOUBLE + 0.1::DOUBLE + f0) * 2) AS BIGINT) AS fx0, CAST(floor((ch * 0.4::DOUBLE + 0.2::DOUBLE + f0) * 2) AS BIGINT) AS fc FROM trials CROSS JOIN g),
 v AS (SELECT c.*, fx0 AS fx FROM c JOIN n USING (session_id) WHERE fe > 1 AND fc < n - 1 AND fx0 > fe AND fc > fx0),
 s AS (SELECT v.session_id, v.k, v.f0, count(*) AS n_valid, avg((c.total - x.total) / (fc - fx)) - avg((x.total - e.total) / (fx - fe)) AS score FROM v JOIN p e ON e.session_id = v.session_id AND e.at = fe JOIN p x ON x.session_id = v.session_id AND x.at = fx JOIN p c ON c.session_id = v.session_id AND c.at = fc GROUP BY 1, 2, 3 HAVING count(*) >= 2)
 SELECT session_id, round(arg_max(f0, struct_pack(s := round(score, 9), k := -k)), 6) AS f0, round(max(score), 6) AS score FROM s GROUP BY 1"""
)
def q14_offset_search(spark, sf):
    t, f = _offset_inputs(spark, sf)
    best = align.best_offset(align.offset_scores(t, f, 0.0, 8.0, 0.5, fps=2, least=2))
    return best.select("session_id", F.round("f0", 6).alias("f0"), F.round("score", 6).alias("score"))


_REFINED = L.TRIALS + """, n AS (SELECT session_id, max(frame) + 1 AS n FROM frames GROUP BY 1),
 p AS (SELECT session_id, frame + 1 AS at, sum(lin_vel) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS total FROM frames),
 t AS (SELECT session_id, idx, ce * 0.4::DOUBLE AS te, ce * 0.4::DOUBLE + 0.1::DOUBLE AS tx, ch * 0.4::DOUBLE + 0.2::DOUBLE AS tc FROM trials),
 a AS (SELECT session_id, 0.0::DOUBLE AS low, 0.5::DOUBLE AS step, CAST(greatest(ceil(greatest(0.5::DOUBLE, n / 2.0::DOUBLE - max(tc) - 1) / 0.5::DOUBLE) - 1, 0) AS BIGINT) AS m FROM t JOIN n USING (session_id) GROUP BY session_id, n)"""


def _scan(starts: str, name: str) -> str:
    return f""", {name}_c AS (SELECT t.*, k, low + k * step AS f0, CAST(floor((te + low + k * step) * 2) AS BIGINT) AS fe, CAST(floor((tx + low + k * step) * 2) AS BIGINT) AS fx, CAST(floor((tc + low + k * step) * 2) AS BIGINT) AS fc FROM t JOIN {starts} USING (session_id), (SELECT unnest(range(20000)) AS k) WHERE k <= m),
 {name}_v AS (SELECT c.*, least(fc, fx + 1) AS fm FROM {name}_c c JOIN n USING (session_id) WHERE fe > 1 AND fc < n - 1 AND fx > fe AND least(fc, fx + 1) > fx),
 {name}_s AS (SELECT v.session_id, v.k, v.f0, avg((z.total - x.total) / (fm - fx)) - avg((x.total - e.total) / (fx - fe)) AS score FROM {name}_v v JOIN p e ON e.session_id = v.session_id AND e.at = fe JOIN p x ON x.session_id = v.session_id AND x.at = fx JOIN p z ON z.session_id = v.session_id AND z.at = fm GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 {name} AS (SELECT s.session_id, coalesce(f0, low) AS f0 FROM {starts} s LEFT JOIN (SELECT session_id, arg_max(f0, struct_pack(s := round(score, 9), k := -k)) AS f0 FROM {name}_s GROUP BY 1) USING (session_id))"""


@query(
    "WITH " + _REFINED + _scan("a", "coarse") + """, b AS (SELECT session_id, greatest(0.0::DOUBLE, f0 - 0.5::DOUBLE) AS low, 0.02::DOUBLE AS step, CAST(greatest(ceil((f0 + 0.5::DOUBLE - greatest(0.0::DOUBLE, f0 - 0.5::DOUBLE)) / 0.02::DOUBLE) - 1, 0) AS BIGINT) AS m FROM coarse)"""
    + _scan("b", "fine") + " SELECT session_id, round(f0, 6) AS f0 FROM fine"
)
def q14b_offset_refined(spark, sf):
    t, f = _offset_inputs(spark, sf)
    return align.estimate_offset(t, f, fps=2, least=2).select("session_id", F.round("f0", 6).alias("f0"))


def _pose(spark, sf):
    """Three nodes around each frame's position."""
    a, b = F.col("event_id") % 5, F.col("event_id") % 3
    node = lambda n, x, y: F.struct(F.lit(n).alias("node"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    nodes = F.array(node("head", F.col("x"), F.col("y")), node("left", F.col("x") - 3, F.col("y") + a), node("right", F.col("x") + 4, F.col("y") - b))
    return L.frames(spark, sf).select("session_id", "frame", F.explode(nodes).alias("n")).select("session_id", "frame", "n.*")


_POSE = L.FRAMES + """, f2 AS (SELECT session_id, frame, (x + (x - 3) + (x + 4)) / 3 AS x, (y + (y + event_id % 5) + (y - event_id % 3)) / 3 AS y,
 x - ((x - 3) + (x + 4)) / 2 AS hx, y - ((y + event_id % 5) + (y - event_id % 3)) / 2 AS hy FROM frames)"""
_SERIES = (
    "WITH " + _POSE + _SG[len(L.FRAMES) :].replace("FROM frames)", "FROM f2)") + _ANGLES[len(L.FRAMES) :].replace("h AS (", "hd AS (", 1).replace("atan2(y - 49.5, x - 20.5)", "atan2(hy, hx)").replace("FROM frames)", "FROM f2)").replace("FROM h)", "FROM hd)")
    + """, l AS (SELECT *, lag(un) OVER w AS u0, lead(un) OVER w AS u1 FROM u WINDOW w AS (PARTITION BY session_id ORDER BY frame))
SELECT session_id, frame, round(f2.x, 6) AS x, round(f2.y, 6) AS y, round(sqrt(dx * dx + dy * dy) * 2.5, 5) AS lin_vel, round(a, 6) AS head_angle,
 round(CASE WHEN u0 IS NULL THEN (u1 - un) / 0.04 WHEN u1 IS NULL THEN (un - u0) / 0.04 ELSE (u1 - u0) / 0.08 END, 4) AS ang_vel FROM f2 JOIN d USING (session_id, frame) JOIN l USING (session_id, frame)"""
).replace("AS n FROM frames", "AS n FROM f2")


@query(_SERIES)
def q47_session_series(spark, sf):
    """Centroid, speed, heading and angular velocity from the nodes of a pose."""
    t = pose.session_series(_pose(spark, sf), left="left", right="right", heading="head", scale=0.1)
    places = {"lin_vel": 5, "ang_vel": 4}
    return t.select("session_id", "frame", *[F.round(c, places.get(c, 6)).alias(c) for c in t.columns[2:]])


_EPOCHS = " UNION ALL ".join(
    f"SELECT session_id, idx, '{e}' AS event, {at} AS at, unnest(range(-{b}, {a})) AS o FROM trials"
    for (e, (b, a)), at in zip(align.EPOCHS.items(), ("ce - 3", "ce", "ch", "ch + 2"), strict=True)
)


@query(
    "WITH " + L.TRIALS + ", w AS (" + _EPOCHS + """) SELECT event, CAST(o AS INT) AS "offset", count(*) AS n_windows, count(lin_vel) AS n, round(avg(lin_vel), 6) AS mean_velocity
 FROM w LEFT JOIN frames f ON f.session_id = w.session_id AND f.frame = w.at + w.o GROUP BY 1, 2"""
)
def q48_epoch_velocities(spark, sf):
    """Mean speed around each of the four events, over their epochs."""
    at = {"center_entry": F.col("ce") - 3, "center_exit": F.col("ce"), "choice_entry": F.col("ch"), "reward_entry": F.col("ch") + 2}
    events = L.trials(spark, sf).select("session_id", "idx", F.explode(F.array(*[F.struct(F.lit(e).alias("event"), c.alias("frame")) for e, c in at.items()])).alias("e")).select("session_id", "idx", "e.*")
    found = align.epoch_velocities(events, L.frames(spark, sf))
    return found.groupBy("event", "offset").agg(F.count("*").alias("n_windows"), F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_velocity"))

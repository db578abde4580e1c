"""The track table as plain SQL, in steps that the checks of other queries build on."""
from __future__ import annotations

from curbstream.sources.fixture import DUCK_RAW, FRAME_US, HEIGHT, N_FRAMES, WIDTH

VEH = "(2, 3, 5, 7)"
SIZE = "sqrt(greatest(x2 - x1, 1e0) * greatest(y2 - y1, 1e0))"
EDGE = f"(y1 <= 3.6e0 OR y2 >= {HEIGHT} - 3.6e0 OR x1 <= 6.4e0 OR x2 >= {WIDTH} - 6.4e0)"
SCALE = "greatest(sc_min, sc_a + sc_b * {y})"


def savgol(cte: str, rows: str, cols: dict[str, str]) -> str:
    """Smoothed columns of ``rows`` (video_id, track_id, i, n, h) by a self join over the clamped window."""
    sums = ", ".join(f"sum(b.{c}) AS {o}0, sum((b.i - a.cc) * b.{c}) AS {o}1, sum((b.i - a.cc) * (b.i - a.cc) * b.{c}) AS {o}2" for o, c in cols.items())
    m2, m4, w = "(h * (h + 1) * (2 * h + 1) / 3e0)", "(h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15e0)", "(2 * h + 1)"
    den = f"({w} * {m4} - {m2} * {m2})"
    x = "(i - cc)"
    outs = ", ".join(
        f"CASE WHEN h = 0 THEN {c} ELSE ({m4} * {o}0 - {m2} * {o}2) / {den} + {x} * ({o}1 / {m2} + {x} * ({w} * {o}2 - {m2} * {o}0) / {den}) END AS {o}" for o, c in cols.items()
    )
    return f"""{cte}_c AS (SELECT *, least(greatest(i, h), n - 1 - h) AS cc FROM {rows}),
  {cte}_s AS (SELECT a.video_id, a.track_id, a.i, {sums} FROM {cte}_c a JOIN {cte}_c b ON a.video_id = b.video_id AND a.track_id = b.track_id AND b.i BETWEEN a.cc - a.h AND a.cc + a.h GROUP BY 1, 2, 3),
  {cte} AS (SELECT c.* EXCLUDE (cc), {outs} FROM {cte}_c c JOIN {cte}_s USING (video_id, track_id, i))"""


def grad(v: str, t: str = "tt") -> str:
    hs, hd = f"({t} - lag({t}) OVER w)", f"(lead({t}) OVER w - {t})"
    fm, fp = f"lag({v}) OVER w", f"lead({v}) OVER w"
    return f"CASE WHEN lag({t}) OVER w IS NULL THEN ({fp} - {v}) / {hd} WHEN lead({t}) OVER w IS NULL THEN ({v} - {fm}) / {hs} ELSE ({hs} * {hs} * {fp} + ({hd} * {hd} - {hs} * {hs}) * {v} - {hd} * {hd} * {fm}) / ({hs} * {hd} * ({hd} + {hs})) END"


RAW = f"raw AS ({DUCK_RAW})"
DEDUPED = f"""{RAW}, dd AS (SELECT * FROM raw WHERE conf >= 0.1e0 QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY ord) = 1)"""


def majority(out: str, rows: str) -> str:
    return f"""{out} AS (SELECT video_id, track_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY w DESC, cls) AS k FROM
    (SELECT video_id, track_id, cls, round(sum(CASE WHEN conf > 0 THEN conf ELSE 0.01e0 END), 9) AS w FROM {rows} GROUP BY 1, 2, 3)) WHERE k = 1)"""


SCALED = f"""{DEDUPED}, {majority("mj0", "dd")},
  anch AS (SELECT dd.* EXCLUDE (cls), mj0.cls, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, {SIZE} AS size, {EDGE} AS edge FROM dd JOIN mj0 USING (video_id, track_id)),
  sv AS (SELECT video_id, foot_y, size, cls = 2 AS car, x1 > 2 AND y1 > 2 AND x2 < {WIDTH} - 2 AND y2 < {HEIGHT} - 2 AS uncut FROM anch WHERE cls IN {VEH}),
  sm AS (SELECT video_id, count(*) FILTER (WHERE car AND uncut) AS nc, count(*) FILTER (WHERE uncut) AS nu FROM sv GROUP BY 1),
  su AS (SELECT sv.* FROM sv JOIN sm USING (video_id) WHERE CASE WHEN nc >= 30 THEN car AND uncut WHEN nu > 0 THEN uncut ELSE true END),
  sr AS (SELECT video_id, min(foot_y) AS y0, (max(foot_y) + 1e-6 - min(foot_y)) / 10 AS step, count(*) AS n_all, quantile_cont(size, 0.5) AS m FROM su GROUP BY 1),
  sb AS (SELECT video_id, y0 + (least(floor((foot_y - y0) / step), 9) + 0.5e0) * step AS x, quantile_cont(size, 0.5) AS y, count(*) AS n FROM su JOIN sr USING (video_id) GROUP BY 1, 2 HAVING count(*) >= 5),
  sc AS (SELECT video_id, count(*) AS nb, sum(n * x) / sum(n) AS xm, sum(n * y) / sum(n) AS ym FROM sb GROUP BY 1),
  sl AS (SELECT video_id, sum(n * (x - xm) * (y - ym)) / sum(n * (x - xm) * (x - xm)) AS slope FROM sb JOIN sc USING (video_id) GROUP BY 1),
  scale AS (SELECT v.video_id, CASE WHEN m IS NULL THEN 0.08e0 * {HEIGHT} WHEN n_all >= 30 AND nb >= 2 AND slope >= 0 THEN ym - slope * xm ELSE m END AS sc_a,
    CASE WHEN n_all >= 30 AND nb >= 2 AND slope >= 0 THEN slope ELSE 0e0 END AS sc_b, CASE WHEN m IS NULL THEN 0.02e0 * {HEIGHT} ELSE m * 0.25e0 END AS sc_min
    FROM (SELECT DISTINCT video_id FROM raw) v LEFT JOIN sr USING (video_id) LEFT JOIN sc USING (video_id) LEFT JOIN sl USING (video_id))"""
LAGGED = "dt_us, disp, ratio"
PIECES = f"""{SCALED},
  lg AS (SELECT dd.*, (dd.x1 + dd.x2) / 2 AS foot_x, dd.y2 AS foot_y, sqrt(greatest(dd.x2 - dd.x1, 1e0) * greatest(dd.y2 - dd.y1, 1e0)) AS size,
    (dd.y1 <= 3.6e0 OR dd.y2 >= {HEIGHT} - 3.6e0 OR dd.x1 <= 6.4e0 OR dd.x2 >= {WIDTH} - 6.4e0) AS edge, sc_a, sc_b, sc_min FROM dd JOIN scale USING (video_id)),
  lh AS (SELECT *, t_us - lag(t_us) OVER w AS dt_us, lag(foot_x) OVER w AS px, lag(foot_y) OVER w AS py, lag(size) OVER w AS ps, lag(edge) OVER w AS pe FROM lg WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
  li AS (SELECT *, sqrt((foot_x - px) * (foot_x - px) + (foot_y - py) * (foot_y - py)) / {SCALE.format(y='foot_y')} AS disp, greatest(size / ps, ps / size) AS ratio FROM lh),
  pieces AS (SELECT video_id, track_id * 16777216 + piece AS track_id, track_id AS src_id, piece, frame, t, t_us, cls, conf, x1, y1, x2, y2 FROM (SELECT *, CAST(sum(CASE WHEN dt_us IS NULL OR dt_us > 1000000
    OR (NOT edge AND NOT pe AND ((disp / greatest(dt_us / 1e6, 1e-3) > 20e0 AND disp > 1e0) OR ratio > 1.8e0)) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS BIGINT) AS piece FROM li))"""
FILLED = f"""{PIECES}, {majority("mj", "pieces")},
  pc AS (SELECT p.* EXCLUDE (cls), mj.cls FROM pieces p JOIN mj USING (video_id, track_id)),
  pn AS (SELECT *, lead(frame) OVER w AS nf, lead(t_us) OVER w AS nt, lead(x1) OVER w AS n1, lead(y1) OVER w AS n2, lead(x2) OVER w AS n3, lead(y2) OVER w AS n4 FROM pc WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
  ga AS (SELECT *, unnest(range(frame + 1, nf)) AS f FROM pn WHERE nf - frame > 1 AND nt - t_us <= 1000000),
  gb AS (SELECT *, (f * {FRAME_US} - t_us) / CAST(nt - t_us AS DOUBLE) AS a FROM ga),
  filled AS (SELECT video_id, track_id, src_id, piece, frame, t, t_us, cls, conf, x1, y1, x2, y2, false AS interp FROM pc
    UNION ALL SELECT video_id, track_id, src_id, piece, f, f * 0.08e0, f * {FRAME_US}, cls, 0e0, x1 * (1 - a) + n1 * a, y1 * (1 - a) + n2 * a, x2 * (1 - a) + n3 * a, y2 * (1 - a) + n4 * a, true FROM gb),
  rows0 AS (SELECT *, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, {SIZE} AS size, {EDGE} AS edge FROM filled)"""
VALUED = f"""{FILLED},
  val AS (SELECT video_id, track_id, max(t_us) - min(t_us) AS span_us, coalesce(avg(conf) FILTER (WHERE NOT interp), 0e0) AS track_conf, count(*) AS n_rows, count(*) FILTER (WHERE NOT edge) AS n_ok, quantile_cont(size, 0.5) AS track_size
    FROM rows0 GROUP BY 1, 2 HAVING max(t_us) - min(t_us) >= 1000000),
  rows1 AS (SELECT r.*, track_conf, track_size, n_rows, n_ok, track_conf >= 0.4e0 AND track_size >= 0.025e0 * {HEIGHT} AS reliable FROM rows0 r JOIN val USING (video_id, track_id)),
  pw AS (SELECT p.video_id, p.track_id, p.frame, bool_or(((p.x1 + p.x2) / 2 BETWEEN w.x1 AND w.x2 AND p.y1 + 0.75e0 * (p.y2 - p.y1) BETWEEN w.y1 - 0.2e0 * (w.y2 - w.y1) AND w.y2)
      OR (greatest(least(p.x2, w.x2) - greatest(p.x1, w.x1), 0) * greatest(least(p.y2, w.y2) - greatest(p.y1, w.y1), 0)) > 0.1e0 * ((p.x2 - p.x1) * (p.y2 - p.y1) + (w.x2 - w.x1) * (w.y2 - w.y1)
        - greatest(least(p.x2, w.x2) - greatest(p.x1, w.x1), 0) * greatest(least(p.y2, w.y2) - greatest(p.y1, w.y1), 0))) AS hit
    FROM rows1 p LEFT JOIN rows1 w ON w.video_id = p.video_id AND w.frame = p.frame AND w.cls IN (1, 3) WHERE p.cls = 0 GROUP BY 1, 2, 3),
  rid AS (SELECT video_id, track_id FROM pw GROUP BY 1, 2 HAVING avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) >= 0.3e0)"""
TRACKS = f"""{VALUED},
  gr AS (SELECT r.*, sc_a, sc_b, sc_min, r.y1 + quantile_cont(r.y2 - r.y1, 0.5) OVER (PARTITION BY r.video_id, r.track_id ORDER BY r.frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS fy,
    NOT edge OR n_ok < 2 AS seq, row_number() OVER (PARTITION BY r.video_id, r.track_id ORDER BY r.frame) AS ra FROM rows1 r JOIN scale USING (video_id)),
  sq AS (SELECT *, CASE WHEN n_ok < 2 THEN n_rows ELSE n_ok END AS n, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) - 1 AS i, t_us - lag(t_us) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS sdt FROM gr WHERE seq),
  dtm AS (SELECT video_id, track_id, quantile_cont(sdt / 1e6, 0.5) AS dm FROM sq GROUP BY 1, 2),
  wn AS (SELECT sq.*, t_us / 1e6 AS tt, least(greatest(round_even(1e0 / coalesce(dm, 1e0), 0)::INT | 1, 5), CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END) AS win FROM sq JOIN dtm USING (video_id, track_id)),
  wh AS (SELECT *, CASE WHEN win >= 5 THEN (win - 1) // 2 ELSE 0 END AS h FROM wn),
  {savgol("k1", "wh", {"sx": "foot_x", "sy": "fy", "ay": "y1"})},
  k2 AS (SELECT *, {grad("sx")} / {SCALE.format(y="sy")} AS vx, {grad("ay")} / {SCALE.format(y="sy")} AS vy FROM k1 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY i)),
  k3 AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM k2),
  {savgol("k4", "k3", {"sp": "speed"})},
  k5 AS (SELECT *, {grad("sp")} AS accel, degrees(atan2(vy, vx)) AS heading FROM k4 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY i)),
  bn AS (SELECT g.*, k.vx, k.vy, k.speed, k.heading, k.accel, row_number() OVER (PARTITION BY g.video_id, g.track_id, g.frame ORDER BY abs(k.ra - g.ra), k.ra DESC) AS z
    FROM gr g JOIN k5 k ON g.video_id = k.video_id AND g.track_id = k.track_id WHERE NOT g.seq),
  trk AS (SELECT video_id, track_id, src_id, frame, t, t_us, cls, conf, x1, y1, x2, y2, foot_x, foot_y, size, edge, interp, track_conf, track_size, reliable, sx, sy, vx, vy, speed, heading, accel, sc_a, sc_b, sc_min FROM k5
    UNION ALL SELECT video_id, track_id, src_id, frame, t, t_us, cls, conf, x1, y1, x2, y2, foot_x, foot_y, size, edge, interp, track_conf, track_size, reliable, foot_x, fy, vx, vy, speed, heading, accel, sc_a, sc_b, sc_min FROM bn WHERE z = 1),
  tracks AS MATERIALIZED (SELECT t.*, rid.track_id IS NOT NULL AS rider, {WIDTH} AS width, {HEIGHT} AS height FROM trk t LEFT JOIN rid USING (video_id, track_id))"""
LAST_FRAME = N_FRAMES - 1

"""Pitch geometry."""

from pyspark.sql import functions as F

from touchline.operators import pitch as pt
from touchline.plans.registry import query
from touchline.plans.scalar_queries import H9

LAYOUT = "layout AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x:.1f}::DOUBLE, {y:.1f}::DOUBLE)" for i, (x, y) in pt.KEYPOINTS.items()) + ") l(idx, wx, wy))"
USED = LAYOUT + """, placed AS (SELECT k.*, wx, wy, k.idx NOT IN (0, 6) AND conf >= CASE WHEN k.idx IN (1, 5, 7, 11) THEN 35e-2 ELSE 5e-1 END AS used FROM fx_keypoints k JOIN layout l ON l.idx = k.idx),
per AS (SELECT match_id, frame_idx, CAST(count(*) FILTER (used) AS INT) AS n_used, max(wx) FILTER (used) - min(wx) FILTER (used) AS span FROM placed GROUP BY ALL),
elig AS (SELECT match_id, frame_idx, n_used, n_used >= 4 AND span >= 12 AS eligible, CASE WHEN n_used >= 4 AND span < 12 THEN printf('x_span=%.1fm<%.0fm', span, 12e0) ELSE '' END AS skip_reason FROM per),
log AS (SELECT e.match_id, e.frame_idx, n_used, eligible AND cond <= 1e7 AND inliers >= 4 AS solved, CASE WHEN NOT eligible THEN skip_reason WHEN cond > 1e7 THEN 'singular'
 WHEN inliers < 4 THEN concat('only ', inliers, ' inliers') ELSE '' END AS skip_reason, """ + ", ".join(H9) + """ FROM elig e JOIN fx_solves s ON s.match_id = e.match_id AND s.frame_idx = e.frame_idx)"""


def solves(fx):
    return fx.solves.select("match_id", "frame_idx", "cond", "inliers", F.array(*H9).alias("h"))


def log(fx):
    return pt.acceptance(pt.eligibility(fx.keypoints), solves(fx))


@query("b15_usable_keypoints", "WITH " + USED + " SELECT match_id, frame_idx, idx, conf FROM placed WHERE used")
def b15(fx):
    """Keypoints good enough for a homography."""
    return pt.usable(fx.keypoints).select("match_id", "frame_idx", "idx", "conf")


@query("c12_world_positions", "WITH " + USED + " SELECT match_id, frame_idx, idx, wx, wy FROM placed")
def c12(fx):
    """World position of every keypoint."""
    return pt.with_world(fx.keypoints).select("match_id", "frame_idx", "idx", "wx", "wy")


@query("b16_solve_eligibility", "WITH " + USED + " SELECT * FROM elig")
def b16(fx):
    """Frames with enough keypoints, spread wide enough."""
    return pt.eligibility(fx.keypoints)


@query("b17_solve_acceptance", "WITH " + USED + " SELECT match_id, frame_idx, n_used, solved, skip_reason FROM log")
def b17(fx):
    """Kept matrices and skip reasons."""
    return log(fx).drop("h")


NEAR = USED + """, near AS (SELECT *, max(CASE WHEN solved THEN frame_idx END) OVER (PARTITION BY match_id ORDER BY frame_idx) AS p, min(CASE WHEN solved THEN frame_idx END) OVER (PARTITION BY match_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM log),
fill AS (SELECT a.match_id, a.frame_idx, a.solved, a.p, a.n, CASE WHEN a.solved THEN 'direct' WHEN a.p IS NULL AND a.n IS NULL THEN NULL WHEN a.p IS NULL THEN 'after' WHEN a.n IS NULL THEN 'before' ELSE 'blend' END AS source,
 NOT a.solved AND coalesce(a.n - a.p > 3 * 2, false) AS long_gap, (a.frame_idx - a.p) / CAST(a.n - a.p AS DOUBLE) AS w, """ + ", ".join(f"b.{h} AS p{h}, c.{h} AS n{h}" for h in H9) + """
 FROM near a LEFT JOIN log b ON b.match_id = a.match_id AND b.frame_idx = a.p LEFT JOIN log c ON c.match_id = a.match_id AND c.frame_idx = a.n)"""


def filled(fx):
    return pt.fill_homographies(log(fx), 2.0)


@query("c11_nearest_solved", "WITH " + NEAR + " SELECT match_id, frame_idx, p AS prev_frame, n AS next_frame FROM fill")
def c11(fx):
    """C11: nearest solved frames before and after."""
    return filled(fx).select("match_id", "frame_idx", "prev_frame", "next_frame")


def filled_entry(h):
    mixed = "((1e0 - w) * p{0} + w * n{0})"
    return f"round(CASE source WHEN 'direct' THEN p{h} WHEN 'before' THEN p{h} WHEN 'after' THEN n{h} WHEN 'blend' THEN {mixed.format(h)} / {mixed.format('h33')} END, 9) AS {h}"


@query("e5_filled_homographies", "WITH " + NEAR + " SELECT match_id, frame_idx, source, long_gap, " + ", ".join(filled_entry(h) for h in H9) + " FROM fill")
def e5(fx):
    """E5: a matrix for every frame."""
    return filled(fx).select("match_id", "frame_idx", "source", "long_gap", *[F.round(F.col("h")[i], 9).alias(h) for i, h in enumerate(H9)])


@query("d14_solve_summary", "WITH " + NEAR + " SELECT match_id, count(*) AS frames, count(*) FILTER (solved) AS direct, count(*) FILTER (NOT solved AND source IS NOT NULL) AS interpolated, count(*) FILTER (long_gap) AS long_gaps FROM fill GROUP BY match_id")
def d14(fx):
    """Direct and filled matrices per match."""
    return pt.solve_summary(filled(fx))


@query("d14_skip_reasons", "WITH " + USED + " SELECT match_id, skip_reason, count(*) AS n, CAST(row_number() OVER (PARTITION BY match_id ORDER BY count(*) DESC, skip_reason) AS INT) AS rank FROM log WHERE skip_reason <> '' GROUP BY match_id, skip_reason")
def d14_reasons(fx):
    """Skip reasons, most frequent first."""
    return pt.skip_counts(log(fx))


@query("d15_used_histogram", "WITH " + USED + " SELECT match_id, n_used, count(*) AS frames, count(*) FILTER (solved) AS solved FROM log GROUP BY match_id, n_used")
def d15(fx):
    """Frames and solved frames by keypoints used."""
    return pt.used_histogram(log(fx))


@query("f4_best_frames", "WITH " + USED + " SELECT match_id, frame_idx, n_used, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY n_used DESC, frame_idx) AS INT) AS rank FROM log WHERE solved) r WHERE rank <= 10")
def f4(fx):
    """ten solved frames with most keypoints (a top-k report)."""
    return pt.best_frames(log(fx)).select("match_id", "frame_idx", "n_used", "rank")


INV = """inv AS (SELECT *, h11 * (h22 * h33 - h23 * h32) - h12 * (h21 * h33 - h23 * h31) + h13 * (h21 * h32 - h22 * h31) AS det FROM log WHERE solved),
back AS (SELECT p.match_id, p.frame_idx, p.idx, px, py, ((h22 * h33 - h23 * h32) / det) * wx + ((h13 * h32 - h12 * h33) / det) * wy + (h12 * h23 - h13 * h22) / det AS u,
 ((h23 * h31 - h21 * h33) / det) * wx + ((h11 * h33 - h13 * h31) / det) * wy + (h13 * h21 - h11 * h23) / det AS v,
 ((h21 * h32 - h22 * h31) / det) * wx + ((h12 * h31 - h11 * h32) / det) * wy + (h11 * h22 - h12 * h21) / det AS w FROM placed p JOIN inv i ON i.match_id = p.match_id AND i.frame_idx = p.frame_idx WHERE used)"""


@query("c15_reprojection", "WITH " + USED + ", " + INV + " SELECT match_id, frame_idx, idx, round(u / w, 4) AS reproj_x, round(v / w, 4) AS reproj_y, round(sqrt(pow(px - u / w, 2) + pow(py - v / w, 2)), 4) AS error_px FROM back")
def c15(fx):
    """Reprojection error of every used keypoint."""
    r = pt.reprojection(fx.keypoints, log(fx))
    return r.select("match_id", "frame_idx", "idx", *[F.round(c, 4).alias(c) for c in ("reproj_x", "reproj_y", "error_px")])


def corner(i, x, y):
    w = f"(h31 * {x}e0 + h32 * {y}e0 + h33)"
    return (f"least(40e0, greatest(0e0, (h11 * {x}e0 + h12 * {y}e0 + h13) / {w})) AS x{i}, least(20e0, greatest(0e0, (h21 * {x}e0 + h22 * {y}e0 + h23) / {w})) AS y{i}")


def cut(i, j):
    return f"CASE WHEN (y{i} <= cy) <> (y{j} <= cy) THEN x{i} + (cy - y{i}) * (x{j} - x{i}) / (y{j} - y{i}) END"


CELLS = USED + ", quads AS (SELECT match_id, frame_idx, " + ", ".join(corner(i, x, y) for i, (x, y) in enumerate([(0, 0), (1280, 0), (1280, 720), (0, 720)])) + """ FROM log WHERE solved),
grid AS (SELECT r.i AS row, c.i AS col, r.i + 5e-1 AS cy, c.i + 5e-1 AS cx FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS i) r CROSS JOIN (SELECT CAST(unnest(range(0, 40)) AS INT) AS i) c),
hits AS (SELECT match_id, row, col, cx, least(""" + ", ".join(cut(i, (i + 1) % 4) for i in range(4)) + ") AS a, greatest(" + ", ".join(cut(i, (i + 1) % 4) for i in range(4)) + """) AS b FROM quads CROSS JOIN grid),
cells AS (SELECT match_id, row, col, count(*) AS frames FROM hits WHERE cx >= a AND cx <= b GROUP BY ALL)"""


@query("d26_coverage_cells", "WITH " + CELLS + " SELECT * FROM cells")
def d26(fx):
    """Frames that see each pitch cell."""
    return pt.coverage_cells(log(fx), 1280.0, 720.0)


@query("d26_coverage_share", "WITH " + CELLS + " SELECT match_id, count(*) * 125e-3 AS covered_pct FROM cells GROUP BY match_id")
def d26_share(fx):
    """Share of the pitch seen."""
    return pt.coverage(pt.coverage_cells(log(fx), 1280.0, 720.0))

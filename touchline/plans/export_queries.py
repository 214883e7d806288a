"""Match export."""

from touchline.functions import counters as cnt
from touchline.operators import export as ex
from touchline.plans.registry import query
from touchline.sources import writers

C = cnt.COUNTERS
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in C)
CAST = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in C)
NAMES = "names AS (SELECT match_id, coalesce(nullif(team_a_name, ''), 'Team 0') AS team_a_name, coalesce(nullif(team_b_name, ''), 'Team 1') AS team_b_name FROM fx_matches)"
PERIODS = f"""src AS (SELECT *, CAST(clip_duration_seconds AS DOUBLE) AS s, row_number() OVER (PARTITION BY match_id, half ORDER BY minute) AS rn FROM fx_minute_stats),
walk AS (SELECT match_id, half, minute, rn, s, 1 AS block, 0e0 AS start_s, s AS filled FROM src WHERE rn = 1
 UNION ALL SELECT r.match_id, r.half, r.minute, r.rn, r.s, CASE WHEN w.filled >= 280 THEN w.block + 1 ELSE w.block END, CASE WHEN w.filled >= 280 THEN w.start_s + w.filled ELSE w.start_s END,
 CASE WHEN w.filled >= 280 THEN r.s ELSE w.filled + r.s END FROM walk w JOIN src r ON r.match_id = w.match_id AND r.half = w.half AND r.rn = w.rn + 1),
minutes AS (SELECT 'minute' AS row_type, match_id, half, printf('H%d_M%02d', half, minute) AS period_label, sum(s) OVER w - s AS period_start_sec, sum(s) OVER w AS period_end_sec,
 s AS actual_duration_sec, CAST(1 AS BIGINT) AS clip_count, {CAST}, half AS sort_half, 0 AS sort_rank, minute AS seq FROM src WINDOW w AS (PARTITION BY match_id, half ORDER BY minute)),
blocks AS (SELECT 'block_5min' AS row_type, m.match_id, m.half, printf('H%d_B%02d', m.half, block) AS period_label, start_s AS period_start_sec, start_s + sum(m.s) AS period_end_sec,
 sum(m.s) AS actual_duration_sec, count(*) AS clip_count, {SUMS}, m.half AS sort_half, 1 AS sort_rank, block AS seq
 FROM src m JOIN walk w ON w.match_id = m.match_id AND w.half = m.half AND w.minute = m.minute GROUP BY m.match_id, m.half, block, start_s),
total AS (SELECT 'match_total' AS row_type, match_id, CAST(NULL AS INT) AS half, 'MATCH_TOTAL' AS period_label, 0e0 AS period_start_sec, sum(s) AS period_end_sec, sum(s) AS actual_duration_sec,
 count(*) AS clip_count, {SUMS}, 1073741824 AS sort_half, 2 AS sort_rank, 0 AS seq FROM src GROUP BY match_id),
allrows AS (SELECT * FROM minutes UNION ALL SELECT * FROM blocks UNION ALL SELECT * FROM total), {NAMES}"""
COLS = ["row_type", "match_id", "half", "period_label", "period_start_sec", "period_end_sec", "actual_duration_sec", "clip_count", *C]


@query("c6_team_names", "WITH " + NAMES + " SELECT * FROM names")
def c6(fx):
    """Names for display."""
    return ex.team_names(fx.matches)


@query("e6_running_seconds", f"WITH {PERIODS} SELECT {', '.join(COLS)} FROM minutes")
def e6(fx):
    """Minute rows with running seconds in their half."""
    return ex.minute_periods(fx.minute_stats).select(*COLS)


@query("d6_five_minute_blocks", f"WITH {PERIODS} SELECT {', '.join(COLS)} FROM blocks")
def d6(fx):
    """Blocks of about five minutes."""
    return ex.block_periods(fx.minute_stats).select(*COLS)


@query("d5_match_totals", f"WITH {PERIODS} SELECT {', '.join(COLS)} FROM total")
def d5(fx):
    """One total per match."""
    return ex.match_totals(fx.minute_stats).select(*COLS)


@query("g1_export_rows", f"WITH {PERIODS} SELECT team_a_name, team_b_name, {', '.join('a.' + c for c in COLS)} FROM allrows a JOIN names USING (match_id)")
def g1(fx):
    """G1: minutes, blocks and totals together."""
    return ex.export_rows(fx.minute_stats, fx.matches).select("team_a_name", "team_b_name", *COLS)


@query("f6_export_order", f"WITH {PERIODS} SELECT match_id, period_label, CAST(row_number() OVER (PARTITION BY match_id ORDER BY sort_half, sort_rank, seq) AS BIGINT) AS position FROM allrows")
def f6(fx):
    """place of every row in the file of its match."""
    return ex.with_position(ex.export_rows(fx.minute_stats, fx.matches)).select("match_id", "period_label", "position")


@query("a11_csv_export", f"WITH {PERIODS} SELECT a.match_id, a.match_id AS file, period_label, coalesce(CAST(half AS VARCHAR), '') AS half, period_end_sec, clip_count, frames_oof FROM allrows a")
def a11(fx):
    """CSV per match, read back."""
    path = writers.scratch(fx.spark, "export")
    ex.write_export(ex.export_rows(fx.minute_stats, fx.matches), path)
    types = {"half": "string", "clip_count": "bigint", "period_start_sec": "double", "period_end_sec": "double", "actual_duration_sec": "double"}
    ddl = ", ".join(f"{f} {types.get(f, 'bigint' if f in C else 'string')}" for f in writers.EXPORT_FIELDS) + ", file string"
    rows = writers.read_csv(fx.spark, path, ddl)
    return rows.selectExpr("match_id", "file", "period_label", "coalesce(half, '') AS half", "period_end_sec", "clip_count", "frames_oof")

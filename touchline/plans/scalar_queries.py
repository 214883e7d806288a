"""Column functions."""

from pyspark.sql import functions as F

from touchline.functions import colours as col, counters as cnt, geometry as geo
from touchline.operators import rulesets as rs
from touchline.plans.registry import query

NORMAL = "nullif(lower(trim(ltrim(trim({c}), '#'))), '')"


@query("h1_normalise_colour", f"SELECT event_id, colour, {NORMAL.format(c='colour')} AS normal FROM fx_colours")
def h1(fx):
    """H1: colour form used for change detection."""
    return fx.colours.select("event_id", "colour", col.normalise_colour(F.col("colour")).alias("normal"))


NAMES = "(VALUES " + ", ".join(f"('{n}', '{v}')" for n, v in col.NAMED_COLOURS.items()) + ") c(name, value)"


def rgb_sql(source, colour, keep):
    """Tables ``rgb`` and ``hsv`` for the checking engine."""
    return f"""
hexa AS (SELECT {keep}, lower(ltrim(coalesce(c.value, lower(trim({colour}))), '#')) AS s FROM {source} LEFT JOIN {NAMES} ON c.name = lower(trim({colour}))),
six AS (SELECT * EXCLUDE (s), CASE WHEN length(s) = 3 THEN concat(s[1], s[1], s[2], s[2], s[3], s[3]) ELSE s END AS s FROM hexa),
rgb AS (SELECT * EXCLUDE (s), CASE WHEN ok THEN CAST(concat('0x', s[1:2]) AS INT) END AS r, CASE WHEN ok THEN CAST(concat('0x', s[3:4]) AS INT) END AS g,
  CASE WHEN ok THEN CAST(concat('0x', s[5:6]) AS INT) END AS b FROM (SELECT *, regexp_full_match(s, '[0-9a-f]{{6}}') AS ok FROM six) x),
spread AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
units AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE round_even(1044480e0 / v, 0) END AS su, CASE WHEN d = 0 THEN 0 ELSE round_even(737280e0 / (6 * d), 0) END AS hu,
  CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS sector FROM spread),
hsv AS (SELECT * EXCLUDE (v, d, su, hu, sector), CAST(CASE WHEN floor((sector * hu + 2048) / 4096) < 0 THEN floor((sector * hu + 2048) / 4096) + 180
  ELSE floor((sector * hu + 2048) / 4096) END AS INT) AS h, CAST(floor((d * su + 2048) / 4096) AS INT) AS s, v FROM units)"""


@query("h2_parse_colour", "WITH " + rgb_sql("fx_colours", "colour", "event_id, colour") + " SELECT event_id, colour, r, g, b FROM rgb")
def h2(fx):
    """H2: colour name or hex text to red, green, blue."""
    rgb = col.parse_colour(F.col("colour"))
    return fx.colours.select("event_id", "colour", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"))


PIXEL_RGB = "(SELECT match_id, frame_idx, px, py, hue AS r, sat AS g, val AS b FROM fx_pixels)"


@query("h3_rgb_to_hsv", "WITH " + rgb_sql("fx_colours", "colour", "event_id").split("spread AS")[0].rsplit(",", 1)[0] + """,
points AS (SELECT match_id, frame_idx, px, py, CAST(hue AS INT) AS r, CAST(sat AS INT) AS g, CAST(val AS INT) AS b FROM fx_pixels),
spread AS""" + rgb_sql("fx_colours", "colour", "event_id").split("spread AS")[1].replace("FROM rgb)", "FROM points)") +
       " SELECT match_id, frame_idx, px, py, h, s, v FROM hsv")
def h3(fx):
    """H3: 8-bit RGB to HSV over every pixel."""
    hsv = col.rgb_to_hsv(F.col("hue"), F.col("sat"), F.col("val"))
    return fx.pixels.select("match_id", "frame_idx", "px", "py", hsv["h"].alias("h"), hsv["s"].alias("s"), hsv["v"].alias("v"))


@query("h4_colour_vector", """WITH vec AS (SELECT match_id, frame_idx, px, py, sat * cos(hue * (pi() / 90)) AS a, sat * sin(hue * (pi() / 90)) AS b, val + 0e0 AS v FROM fx_pixels)
SELECT match_id, frame_idx, px, py, round(a, 6) + 0e0 AS a, round(b, 6) + 0e0 AS b, v, round(sqrt(a * a + (b - 255) * (b - 255) + (v - 200) * (v - 200)), 6) AS dist FROM vec""")
def h4(fx):
    """H4: cylindrical colour vector and Euclidean distance."""
    vec = col.colour_vector(F.col("hue"), F.col("sat"), F.col("val"))
    ref = F.struct(F.lit(0.0).alias("a"), F.lit(255.0).alias("b"), F.lit(200.0).alias("v"))
    rows = fx.pixels.select("match_id", "frame_idx", "px", "py", vec.alias("vec"))
    return rows.select("match_id", "frame_idx", "px", "py", (F.round("vec.a", 6) + 0.0).alias("a"), (F.round("vec.b", 6) + 0.0).alias("b"),
                       F.col("vec.v").alias("v"), F.round(col.colour_distance(F.col("vec"), ref), 6).alias("dist"))


IOU = """CASE WHEN u > 0 THEN i / u ELSE 0 END"""


@query("h5_iou", """WITH moved AS (SELECT *, x1 + track_id * 5 AS u1, y1 + frame_idx % 50 AS v1, x2 + track_id * 5 - 3 AS u2, y2 AS v2 FROM fx_players),
parts AS (SELECT match_id, frame_idx, track_id, CAST(greatest(0, x2 - x1) * greatest(0, y2 - y1) AS DOUBLE) AS area,
  greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) + 0e0 AS i,
  greatest(0, u2 - u1) * greatest(0, v2 - v1) AS area2 FROM moved)
SELECT match_id, frame_idx, track_id, area, CASE WHEN area + area2 - i > 0 THEN i / (area + area2 - i) ELSE 0 END AS iou FROM parts""")
def h5(fx):
    """H5: box area and intersection over union."""
    a = geo.box()
    b = [F.col("x1") + F.col("track_id") * 5, F.col("y1") + F.col("frame_idx") % 50, F.col("x2") + F.col("track_id") * 5 - 3, F.col("y2")]
    return fx.players.select("match_id", "frame_idx", "track_id", geo.box_area(*a).alias("area"), geo.iou(a, b).alias("iou"))


@query("h6_cosine", """SELECT vec_id, round(list_sum(list_transform(list_zip(e, f), lambda p: p[1] * p[2])) /
 (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(f, lambda x: x * x))) + 1e-8), 6) AS cos_reverse
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_reverse(CAST(embedding AS DOUBLE[])) AS f FROM fx_vectors) v""")
def h6(fx):
    """H6: cosine similarity of two arrays."""
    return fx.vectors.select("vec_id", F.round(geo.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cos_reverse"))


H9 = ["h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32", "h33"]
IMG_TO_WORLD = """(h11 * {x} + h12 * {y} + h13) / (h31 * {x} + h32 * {y} + h33) AS {p}x, (h21 * {x} + h22 * {y} + h23) / (h31 * {x} + h32 * {y} + h33) AS {p}y"""
# inverse by cofactors for the checking engine
INVERSE = """SELECT *, (h22 * h33 - h23 * h32) / det AS i11, (h13 * h32 - h12 * h33) / det AS i12, (h12 * h23 - h13 * h22) / det AS i13,
  (h23 * h31 - h21 * h33) / det AS i21, (h11 * h33 - h13 * h31) / det AS i22, (h13 * h21 - h11 * h23) / det AS i23,
  (h21 * h32 - h22 * h31) / det AS i31, (h12 * h31 - h11 * h32) / det AS i32, (h11 * h22 - h12 * h21) / det AS i33
  FROM (SELECT *, h11 * (h22 * h33 - h23 * h32) - h12 * (h21 * h33 - h23 * h31) + h13 * (h21 * h32 - h22 * h31) AS det FROM fx_solves) d"""


@query("h7_homography_points", f"""WITH inv AS ({INVERSE})
SELECT match_id, frame_idx, round(wx, 6) AS wx, round(wy, 6) AS wy, round(ix, 4) AS ix, round(iy, 4) AS iy FROM (
SELECT match_id, frame_idx, {IMG_TO_WORLD.format(x='640e0', y='360e0', p='w')},
 (i11 * 20e0 + i12 * 10e0 + i13) / (i31 * 20e0 + i32 * 10e0 + i33) AS ix, (i21 * 20e0 + i22 * 10e0 + i23) / (i31 * 20e0 + i32 * 10e0 + i33) AS iy FROM inv) p""")
def h7(fx):
    """H7: image to pitch and pitch to image."""
    rows = fx.solves.select("match_id", "frame_idx", F.array(*H9).alias("h"))
    w = geo.img_to_world(F.col("h"), F.lit(640.0), F.lit(360.0))
    i = geo.world_to_img(F.col("h"), F.lit(20.0), F.lit(10.0))
    return rows.select("match_id", "frame_idx", F.round(w["x"], 6).alias("wx"), F.round(w["y"], 6).alias("wy"),
                       F.round(i["x"], 4).alias("ix"), F.round(i["y"], 4).alias("iy"))


@query("h8_crop_boxes", """WITH b AS (SELECT *, x1 - 20 AS lx, y1 - 30 AS ty FROM fx_players),
c AS (SELECT *, greatest(0, lx) AS cl, least(1200, x2) AS cr, greatest(0, ty) AS ct FROM b),
e AS (SELECT *, least(600, ct + CAST(trunc((y2 - ct) * 55e-2) AS BIGINT)) AS cb, x2 - lx AS w, y2 - ty AS h FROM c),
g AS (SELECT *, CAST(trunc(h * 25e-2) AS BIGINT) AS by1, CAST(trunc(h * 65e-2) AS BIGINT) AS by2, CAST(trunc(w * 15e-2) AS BIGINT) AS bx1, w - CAST(trunc(w * 15e-2) AS BIGINT) AS bx2,
  cr - cl >= 4 AND cb - ct >= 4 AS fits FROM e)
SELECT match_id, frame_idx, track_id, ty + CAST(trunc((y2 - ty) * 65e-2) AS BIGINT) AS torso_y2,
 CASE WHEN fits THEN cl END AS cx1, CASE WHEN fits THEN ct END AS cy1, CASE WHEN fits THEN cr END AS cx2, CASE WHEN fits THEN cb END AS cy2,
 CASE WHEN by2 > by1 AND bx2 > bx1 THEN bx1 ELSE 0 END AS bx1, CASE WHEN by2 > by1 AND bx2 > bx1 THEN by1 ELSE 0 END AS by1,
 CASE WHEN by2 > by1 AND bx2 > bx1 THEN bx2 ELSE w END AS bx2, CASE WHEN by2 > by1 AND bx2 > bx1 THEN by2 ELSE h END AS by2,
 CAST(trunc(w * 5e-1 / 2) AS BIGINT) AS margin_x, CAST(trunc(h * 5e-1 / 2) AS BIGINT) AS margin_y FROM g""")
def h8(fx):
    """H8: jersey crops: by ratio, kept inside the image, middle band, centre."""
    b = fx.players.withColumns({"lx": F.col("x1") - 20, "ty": F.col("y1") - 30})
    lx, ty, x2, y2 = (F.col(c) for c in ("lx", "ty", "x2", "y2"))
    b = b.withColumns({"c": geo.torso_clamped(lx, ty, x2, y2, 1200, 600), "d": geo.torso_band(x2 - lx, y2 - ty)})
    return b.select("match_id", "frame_idx", "track_id", geo.torso_bottom(ty, y2, 0.65).alias("torso_y2"),
                    *[F.col(f"c.{k}").alias(f"c{k}") for k in ("x1", "y1", "x2", "y2")],
                    *[F.col(f"d.{k}").alias(f"b{k}") for k in ("x1", "y1", "x2", "y2")],
                    geo.centre_margin(x2 - lx, 0.5).alias("margin_x"), geo.centre_margin(y2 - ty, 0.5).alias("margin_y"))


@query("h9_split_adjustment", """SELECT event_id, least(k, event_id % 20) AS prior, k - least(k, event_id % 20) AS current, event_id % 20 - least(k, event_id % 20) AS rest FROM fx_ev""")
def h9(fx):
    """H9: share of an adjustment owed to the minute before."""
    s = cnt.split_adjustment(F.col("k"), F.col("event_id") % 20)
    return fx.ev.select("event_id", s["prior"].alias("prior"), s["current"].alias("current"), s["rest"].alias("rest"))


@query("h10_adjust_counters", """WITH c AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN 'drop' WHEN k % 3 = 1 THEN 'flip_to' ELSE 'other' END AS kind, event_id % 2 AS team,
 k % 12 - 2 AS n, k % 9 AS a, event_id % 7 AS b, k % 5 AS oof FROM fx_ev)
SELECT event_id, CAST(CASE WHEN kind = 'flip_to' AND n > 0 THEN CASE WHEN team = 0 THEN a + least(n, b) ELSE a - least(n, a) END
  WHEN kind = 'drop' AND n > 0 AND team = 0 THEN a - least(n, a) ELSE a END AS BIGINT) AS a,
 CAST(CASE WHEN kind = 'flip_to' AND n > 0 THEN CASE WHEN team = 0 THEN b - least(n, b) ELSE b + least(n, a) END
  WHEN kind = 'drop' AND n > 0 AND team = 1 THEN b - least(n, b) ELSE b END AS BIGINT) AS b,
 CAST(CASE WHEN kind = 'drop' AND n > 0 THEN oof + CASE WHEN team = 0 THEN least(n, a) ELSE least(n, b) END ELSE oof END AS BIGINT) AS oof FROM c""")
def h10(fx):
    """Counters after a clamped adjustment."""
    kind = F.when(F.col("k") % 3 == 0, "drop").when(F.col("k") % 3 == 1, "flip_to").otherwise("other")
    new = cnt.adjust(kind, F.col("event_id") % 2, F.col("k") % 12 - 2, F.col("k") % 9, F.col("event_id") % 7, F.col("k") % 5)
    return fx.ev.select("event_id", new["a"].alias("a"), new["b"].alias("b"), new["oof"].alias("oof"))


@query("h11_event_kinds", """SELECT event_id, CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'interception' ELSE 'ball_lost' END AS kind,
 CASE WHEN k % 4 IN (0, 1) THEN 1 - k % 4 WHEN k % 4 = 2 THEN 2 END AS team FROM fx_ev""")
def h11(fx):
    """Stored event names and flipped team ids."""
    kind = F.element_at(F.array(F.lit("completed"), F.lit("interception"), F.lit("ball_lost")), F.col("k") % 3 + 1)
    team = F.when(F.col("k") % 4 < 3, F.col("k") % 4)
    return fx.ev.select("event_id", cnt.event_kind(kind).alias("kind"), cnt.flip_team(team).alias("team"))


@query("h12_labels", """SELECT match_id, half, minute, printf('H%d_M%02d', half, minute) AS minute_label, printf('H%d_B%02d', half, 1 + minute // 5) AS block_label FROM fx_minute_stats""")
def h12(fx):
    """Period labels."""
    block = 1 + F.floor(F.col("minute") / 5).cast("int")
    return fx.minute_stats.select("match_id", "half", "minute", cnt.minute_label(F.col("half"), F.col("minute")).alias("minute_label"),
                                  cnt.block_label(F.col("half"), block).alias("block_label"))


@query("h13_safe_filename", """SELECT event_id, regexp_replace(concat(match_id, '/', event_type, ' é#', k, '-x_1.csv'), '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM fx_ev""")
def h13(fx):
    """File name of a match."""
    raw = F.concat("match_id", F.lit("/"), "event_type", F.lit(" é#"), F.col("k").cast("string"), F.lit("-x_1.csv"))
    return fx.ev.select("event_id", cnt.safe_filename(raw).alias("name"))


@query("h14_frame_rates", """SELECT event_id, CAST(greatest(1, round_even(n * (fps / 15e0), 0)) AS INT) AS scaled, CAST(trunc(fps / 30e0 * n) AS INT) AS buffer,
 CAST(round_even(s * fps, 0) AS INT) AS frames FROM (SELECT event_id, k % 46 AS n, 10e0 + k % 50 + 5e-1 AS fps, event_id % 200 + 0e0 AS s FROM fx_ev) e""")
def h14(fx):
    """Frame counts at another rate."""
    fps, n = 10.0 + F.col("k") % 50 + 0.5, F.col("k") % 46
    return fx.ev.select("event_id", rs.scale_frames(n, fps, F.lit(15.0)).alias("scaled"), rs.buffer_frames(n, fps).alias("buffer"),
                        rs.seconds_to_frames(F.col("event_id") % 200 + F.lit(0.0), fps).alias("frames"))

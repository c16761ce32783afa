"""Registered queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geoweave.functions import areal as A
from geoweave.functions import geodesy, hulls, kernels, predicates
from geoweave.functions import linear as N
from geoweave.functions import vectors as V
from geoweave.operators import centrality, layers, ordered, spatial_join
from geoweave.operators import graph_algorithms as GA
from geoweave.operators.graph import Graph, edge_text
from geoweave.operators.storage import cut
from geoweave.plans import jobs
from geoweave.plans import layers_from_tables as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from geoweave.plans import catalog_arrangements  # noqa: F401  registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k15_polygon_graph_degree(spark, sf_dir)


def r6(c, places: int = 6):
    """Rounded, without negative zero."""
    return F.round(c, places) + F.lit(0.0)


def big(c):
    return c.cast("long")


# --- vectors and angles ------------------------------------------------------------------------


@query(f"""WITH {T.VECTORS} SELECT id, round(ax+bx,6)+0.0 AS add_x, round(ay+by_,6)+0.0 AS add_y, round(ax-bx,6)+0.0 AS sub_x, round(-ay,6)+0.0 AS neg_y,
  round(ax*3,6)+0.0 AS mul_x, round(ax/4,6)+0.0 AS div_x, round(ax,6)+0.0 AS div0_x, round(ax*bx+ay*by_,6)+0.0 AS dot, round(ax*by_-ay*bx,6)+0.0 AS cross_z,
  round(sqrt(ax*ax+ay*ay),6)+0.0 AS len, round(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)),6)+0.0 AS dist, round(ay,6)+0.0 AS ortho_x, round(-ax,6)+0.0 AS ortho_y,
  round(ax/sqrt(ax*ax+ay*ay),6)+0.0 AS norm_x, printf('(%f,%f)', round(ax,3)+0.0, round(ay,3)+0.0) AS txt FROM vecs""")
def v1_v8_vector_arithmetic(spark, sf):
    a, b = F.col("a"), F.col("b")
    rounded = V.raw(r6(a["x"], 3), r6(a["y"], 3))
    return T.vectors(spark, sf).select(
        "id", r6(V.add(a, b)["x"]).alias("add_x"), r6(V.add(a, b)["y"]).alias("add_y"), r6(V.subtract(a, b)["x"]).alias("sub_x"), r6(V.negate(a)["y"]).alias("neg_y"),
        r6(V.scale(a, 3)["x"]).alias("mul_x"), r6(V.divide(a, 4)["x"]).alias("div_x"), r6(V.divide(a, 0)["x"]).alias("div0_x"), r6(V.dot(a, b)).alias("dot"),
        r6(V.cross(a, b)).alias("cross_z"), r6(V.length(a)).alias("len"), r6(V.distance(a, b)).alias("dist"), r6(V.orthogonal(a)["x"]).alias("ortho_x"),
        r6(V.orthogonal(a)["y"]).alias("ortho_y"), r6(V.normalize(a)["x"]).alias("norm_x"), V.text(rounded).alias("txt"),
    )


@query(f"""WITH {T.VECTORS}, w AS (SELECT id, atan2(ay-by_, ax-bx) AS t, ax*10 AS v FROM vecs)
  SELECT id, round(t+0.5 - 2*pi()*floor((t+0.5)/(2*pi())),6)+0.0 AS angle, round(degrees(t - 2*pi()*floor(t/(2*pi()))),5)+0.0 AS deg,
  round(sin(t),6)+0.0 AS sin_t, round(cos(t),6)+0.0 AS cos_t, round(v-3*floor(v/3),6)+0.0 AS range_v,
  round((v-pi()) - 2*pi()*floor((v-pi())/(2*pi())) - pi(),6)+0.0 AS range_lb, round((t+2) - 2*pi()*floor((t+2)/(2*pi())),6)+0.0 AS plus, round((t-2) - 2*pi()*floor((t-2)/(2*pi())),6)+0.0 AS minus FROM w""")
def v6_v15_angles(spark, sf):
    pi = 3.141592653589793
    rows = T.vectors(spark, sf).withColumn("t", V.angle_to(F.col("a"), F.col("b"))).withColumn("v", F.col("a.x") * 10)
    t = F.col("t")
    return rows.select(
        "id", r6(V.angle_to(F.col("a"), F.col("b"), 0.5)).alias("angle"), r6(V.to_degrees(t), 5).alias("deg"), r6(F.sin(t)).alias("sin_t"), r6(F.cos(t)).alias("cos_t"),
        r6(V.normalize_range(F.col("v"), 3)).alias("range_v"), r6(V.normalize_range(F.col("v"), pi, -pi)).alias("range_lb"),
        r6(V.angle_add(t, 2.0)).alias("plus"), r6(V.angle_subtract(t, 2.0)).alias("minus"),
    )


@query(f"""WITH {T.SITES} SELECT id, x*2-y*1=0 AS parallel, x*1+y*2=0 AS orthogonal, x=100 AND y=100 AS equal, CASE WHEN x=250 THEN y<250 ELSE x<250 END AS before_xy,
  CASE WHEN y=250 THEN x<250 ELSE y<250 END AS before_yx, cast(((x+y)*(x+y+1))//2+y AS bigint) AS cantor FROM sites""")
def v3_v16_relations(spark, sf):
    p = V.point(F.col("x"), F.col("y"))
    q = V.point(250.0, 250.0)
    return T.sites(spark, sf).select(
        "id", V.is_parallel(p, V.point(1.0, 2.0)).alias("parallel"), V.is_orthogonal(p, V.point(1.0, 2.0)).alias("orthogonal"), V.equals(p, V.point(100.0, 100.0)).alias("equal"),
        V.before_xy(p, q).alias("before_xy"), V.before_yx(p, q).alias("before_yx"), V.cantor_pair(F.col("x"), F.col("y")).alias("cantor"),
    )


# --- lines, rays, segments ---------------------------------------------------------------------


#: Twice the area of the triangle of three points, in SQL.
_TURN = "(({b}x-{a}x)*({c}y-{a}y)-({b}y-{a}y)*({c}x-{a}x))"


@query(f"""WITH {T.PARCELS}, q AS (SELECT id, xmin AS px, ymin AS py, xmax AS qx, ymax AS qy, xmin+w*(id%3) AS tx, ymax AS ty, (xmin+xmax)/2+id%2 AS mx, (ymin+ymax)/2 AS my, xmin+w*(id%2) AS cx, ymax AS cy,
    xmin+w*(id%3-1) AS rx, ymin+h*(id%3-1) AS ry FROM parcels)
  SELECT id, round((qy-py)/(qx-px),6)+0.0 AS slope, round(py-(qy-py)/(qx-px)*px,6)+0.0 AS intercept, tx = px AS vertical, CASE WHEN tx = px THEN 1.7976931348623157e308 ELSE round((ty-py)/(tx-px),6)+0.0 END AS v_slope,
  {_TURN.format(a='p', b='q', c='m')} = 0 AS has_middle, {_TURN.format(a='p', b='q', c='c')} = 0 AS has_corner, (qx-px)*(py+1-py)-(qy-py)*(px-px)>0 AS is_left,
  {_TURN.format(a='p', b='q', c='r')} = 0 AND (rx-px)*(qx-px)+(ry-py)*(qy-py) >= 0 AS ray_has_end, {_TURN.format(a='p', b='q', c='r')} = 0 AND (rx-px)*(qx-px)+(ry-py)*(qy-py) <= 0 AS ray_has_back,
  {_TURN.format(a='p', b='q', c='m')} = 0 AS same_line FROM q""")
def n1_n8_lines_and_rays(spark, sf):
    """Lines through the corners of parcels, and others that are moved off them for some ids."""
    b, i = F.col("box"), F.col("id")
    p, q = V.point(b["xmin"], b["ymin"]), V.point(b["xmax"], b["ymax"])
    ln, mid = N.line(p, q), V.point((b["xmin"] + b["xmax"]) / 2 + i % 2, (b["ymin"] + b["ymax"]) / 2)
    tilted = N.line(p, V.point(b["xmin"] + F.col("w") * (i % 3), b["ymax"]))
    r, at = N.ray(p, V.subtract(q, p)), V.point(b["xmin"] + F.col("w") * (i % 3 - 1), b["ymin"] + F.col("h") * (i % 3 - 1))
    return T.parcels(spark, sf).select(
        "id", r6(N.slope(ln)).alias("slope"), r6(N.y_intercept(ln)).alias("intercept"), N.is_vertical(tilted).alias("vertical"),
        F.when(N.is_vertical(tilted), N.slope(tilted)).otherwise(r6(N.slope(tilted))).alias("v_slope"),
        N.line_contains(ln, mid).alias("has_middle"), N.line_contains(ln, V.point(b["xmin"] + F.col("w") * (i % 2), b["ymax"])).alias("has_corner"), N.is_left(ln, V.point(b["xmin"], b["ymin"] + 1)).alias("is_left"),
        N.ray_contains(r, at).alias("ray_has_end"), N.ray_contains(N.ray_opposite(r), at).alias("ray_has_back"), N.lines_equal(ln, N.line(q, mid)).alias("same_line"),
    )


@query(f"""WITH {T.PARCELS} SELECT id, round(sqrt(w*w+h*h),6)+0.0 AS len, xmax AS upper_x, xmin AS left_x, w*(h/2+id%2)-h*(w/2) = 0 AS has_middle, xmax+id%2 = xmax AS flipped_equal,
  {_TURN.format(a='p', b='q', c='t')} = 0 AND tx BETWEEN px AND qx AS touches_side,
  round(abs(w*h)/sqrt(w*w+h*h),6)+0.0 AS corner_dist, round(sqrt(9+16),6)+0.0 AS beyond, round(least(w,h)/2,6)+0.0 AS cross_dist, w*(h+id%2)-h*w = 0 AS overlay
  FROM (SELECT *, xmin AS px, ymin AS py, xmax AS qx, ymax AS qy, xmax+3*(id%2) AS tx, ymax AS ty FROM parcels)""")
def n9_n15_segments(spark, sf):
    b = F.col("box")
    p, q = V.point(b["xmin"], b["ymin"]), V.point(b["xmax"], b["ymax"])
    s, odd = N.segment(p, q), F.col("id") % 2
    mx, my = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    flat, steep = N.segment(V.point(b["xmin"], my), V.point(b["xmax"], my)), N.segment(V.point(mx, b["ymin"]), V.point(mx, b["ymax"]))
    return T.parcels(spark, sf).select(
        "id", r6(N.segment_length(s)).alias("len"), N.endpoint(s, "upper")["x"].alias("upper_x"), N.endpoint(s, "left")["x"].alias("left_x"), N.contains(s, V.point(mx, my + odd)).alias("has_middle"),
        N.segments_equal(s, N.flip(N.segment(p, V.point(b["xmax"] + odd, b["ymax"])))).alias("flipped_equal"), N.touches(s, N.segment(V.point(b["xmax"] + 3 * odd, b["ymax"]), V.point(b["xmax"] + 9, b["ymax"] + 1))).alias("touches_side"), r6(N.point_distance(s, V.point(b["xmin"], b["ymax"]))).alias("corner_dist"),
        r6(N.point_distance(flat, V.point(b["xmax"] + 3, my + 4))).alias("beyond"), r6(N.segment_distance(flat, steep)).alias("cross_dist"), N.has_overlay(s, N.segment(V.point(mx, my), V.point(b["xmax"], b["ymax"] + odd))).alias("overlay"),
    )


@query(f"""WITH {T.PARCELS} SELECT id, round((xmin+xmax)/2,6)+0.0 AS ix, round((ymin+ymax)/2,6)+0.0 AS iy, CASE WHEN uy = ty THEN NULL ELSE round(tx-(ty-low)*(ux-tx)/(uy-ty),6)+0.0 END AS par_x,
  {_TURN.format(a='a', b='c', c='t')} * {_TURN.format(a='a', b='c', c='e')} <= 0 AS crossing, (ty-low)*(uy-low) <= 0 AS apart,
  round(xmin+w/2,6)+0.0 AS ray_x, round(h/2,6)+0.0 AS close_d
  FROM (SELECT *, xmin AS ax, ymin AS ay, xmax AS cx, ymax AS cy, xmin AS tx, ymax AS ty, xmin+w*(1-0.75*(id%2)) AS ex, ymax-h*(1-0.75*(id%2)) AS ey, xmax AS ux, ymax-(id%3)*(h+1)/2 AS uy, ymin AS low FROM parcels)""")
def n16_n19_intersections(spark, sf):
    b = F.col("box")
    mx = (b["xmin"] + b["xmax"]) / 2
    d1, d2 = N.segment(V.point(b["xmin"], b["ymin"]), V.point(b["xmax"], b["ymax"])), N.segment(V.point(b["xmin"], b["ymax"]), V.point(b["xmax"], b["ymin"]))
    bottom, top = N.segment(V.point(b["xmin"], b["ymin"]), V.point(b["xmax"], b["ymin"])), N.segment(V.point(b["xmin"], b["ymax"]), V.point(b["xmax"], b["ymax"]))
    centre = V.point(mx, (b["ymin"] + b["ymax"]) / 2)
    share = 1 - 0.75 * (F.col("id") % 2)  # of the second diagonal, which ends before the first one for odd ids
    part = N.segment(V.point(b["xmin"], b["ymax"]), V.point(b["xmin"] + F.col("w") * share, b["ymax"] - F.col("h") * share))
    falling = N.segment(V.point(b["xmin"], b["ymax"]), V.point(b["xmax"], b["ymax"] - (F.col("id") % 3) * (F.col("h") + 1) / 2))
    return T.parcels(spark, sf).select(
        "id", r6(N.segment_intersection(d1, d2)["x"]).alias("ix"), r6(N.segment_intersection(d1, d2)["y"]).alias("iy"), r6(N.line_intersection(bottom, falling)["x"]).alias("par_x"),
        N.intersects(d1, part).alias("crossing"), N.intersects(bottom, falling).alias("apart"), r6(N.ray_segment_intersection(N.ray_towards(centre, "up"), top)["x"]).alias("ray_x"),
        r6(N.closest_points(N.segment(centre, centre), top)["d"]).alias("close_d"),
    )


# --- areal geometry ----------------------------------------------------------------------------

_SHOELACE = "0.5*abs(list_sum(list_transform(range(1,len({r})+1), lambda i: {r}[i].x*{r}[i%len({r})+1].y-{r}[i%len({r})+1].x*{r}[i].y)))"
_MEAN = "list_sum(list_transform({r}, lambda p: p.{c}))/len({r})"


_BENT = "CASE WHEN id%8 >= 4 AND len(ring) = 4 THEN [ring[1],ring[3],ring[2],ring[4]] ELSE ring END"
_SIDE = "((bent[{b}].x-bent[{a}].x)*(bent[{c}].y-bent[{a}].y)-(bent[{b}].y-bent[{a}].y)*(bent[{c}].x-bent[{a}].x))"
_PAIR = lambda a, b, c, d: f"({_SIDE.format(a=a, b=b, c=c)}*{_SIDE.format(a=a, b=b, c=d)} < 0 AND {_SIDE.format(a=c, b=d, c=a)}*{_SIDE.format(a=c, b=d, c=b)} < 0)"
_UNCROSSED = f"(len(bent) < 4 OR NOT ({_PAIR(1, 2, 3, 4)} OR {_PAIR(2, 3, 4, 1)}))"


@query(f"""WITH {T.LOTS}, m AS (SELECT *, {_BENT} AS bent, {_SHOELACE.format(r='ring')} AS ra, coalesce({_SHOELACE.format(r='hole')},0) AS ha, {_MEAN.format(r='ring', c='x')} AS cx, {_MEAN.format(r='ring', c='y')} AS cy,
    coalesce({_MEAN.format(r='hole', c='x')},0) AS hx, list_min(list_transform(ring, lambda p: p.x)) AS xmin, list_max(list_transform(ring, lambda p: p.x)) AS xmax,
    list_min(list_transform(ring, lambda p: p.y)) AS ymin, list_max(list_transform(ring, lambda p: p.y)) AS ymax FROM lots)
  SELECT id, round(ra,6)+0.0 AS ring_area, round(ra-ha,6)+0.0 AS area, round(cx,6)+0.0 AS ring_cx, round((cx*ra-hx*ha)/(ra-ha),6)+0.0 AS cx, xmin, ymin, xmax, ymax,
  round(xmin-(xmax-xmin)*0.5,6)+0.0 AS scaled_xmin, round(ymax+(ymax-ymin)*0.5,6)+0.0 AS scaled_ymax, xmin AS kept_xmin, round(2*(ra-ha),6)+0.0 AS multi_area,
  round((cx*ra-hx*ha)/(ra-ha)+50,6)+0.0 AS multi_cx, hole IS NULL AS simple, {_UNCROSSED} AS valid, cast(len(ring) AS bigint) AS n_segments FROM m""")
def a1_a12_measures(spark, sf):
    g = F.col("geom")
    b = A.ring_box(g["boundary"])
    moved = F.transform(g["boundary"], lambda p: V.point(p["x"] + 100, p["y"]))
    moved_holes = F.transform(g["holes"], lambda r: F.transform(r, lambda p: V.point(p["x"] + 100, p["y"])))
    both = F.array(g, F.struct(moved.alias("boundary"), moved_holes.alias("holes")))
    corner = lambda i: F.get(g["boundary"], F.lit(i))
    bent = F.when(F.col("bend") & (F.size(g["boundary"]) == 4), F.array(*[corner(i) for i in (0, 2, 1, 3)])).otherwise(g["boundary"])
    measures = lambda kinds: T.shaped(kinds).select(
        *T.FRAME, "bend", r6(A.ring_area(g["boundary"])).alias("ring_area"), r6(A.polygon_area(g)).alias("area"), r6(A.ring_centroid(g["boundary"])["x"]).alias("ring_cx"),
        r6(A.polygon_centroid(g)["x"]).alias("cx"), b["xmin"].alias("xmin"), b["ymin"].alias("ymin"), b["xmax"].alias("xmax"), b["ymax"].alias("ymax"),
        r6(A.scale_rectangle(b, 1.5)["xmin"]).alias("scaled_xmin"), r6(A.scale_rectangle(b, 1.5)["ymax"]).alias("scaled_ymax"), A.scale_rectangle(b, -1)["xmin"].alias("kept_xmin"),
        r6(A.multi_area(both)).alias("multi_area"), r6(A.multi_centroid(both)["x"]).alias("multi_cx"), A.is_simple(g).alias("simple"), A.is_valid_ring(bent).alias("valid"),
        big(F.size(A.segments(g["boundary"]))).alias("n_segments"),
    )
    frames = T.lot_frames(spark, sf).withColumn("bend", F.col("id") % 8 >= 4)
    return T.told_by_kind(frames, [*T.FRAME, "bend"], measures).drop(*T.FRAME, "bend")


@query(f"""WITH {T.LOTS} SELECT id, CASE WHEN kind=3 THEN 'OUTSIDE' WHEN kind=1 THEN 'BOUNDARY' ELSE 'INSIDE' END AS centre, CASE WHEN kind=2 THEN 'OUTSIDE' ELSE 'BOUNDARY' END AS corner,
  'OUTSIDE' AS far, CASE WHEN kind=3 THEN 'INSIDE' WHEN kind=1 THEN 'INSIDE' ELSE 'INSIDE' END AS hole_edge, kind<>3 AS multi_has_centre, true AS multi_far_out,
  cast(CASE kind WHEN 3 THEN 4 ELSE 2 END AS bigint) AS n_cuts FROM lots""")
def a13_a18_point_location(spark, sf):
    g, x, y, s = F.col("geom"), F.col("x"), F.col("y"), F.col("s")
    at = lambda dx, dy: V.point(x + dx * s, y + dy * s)
    cut = N.segment(V.point(x - 1, y + s * 0.375), V.point(x + s + 1, y + s * 0.375))
    places = lambda kinds: T.shaped(kinds).select(
        *T.FRAME, A.polygon_location(g, at(0.5, 0.5)).alias("centre"), A.polygon_location(g, at(0, 0)).alias("corner"), A.polygon_location(g, at(3, 3)).alias("far"),
        A.polygon_location(g, at(0.25, 0.375)).alias("hole_edge"), A.multi_contains_point(F.array(g), at(0.5, 0.5)).alias("multi_has_centre"),
        A.multi_outside(F.array(g), at(3, 3)).alias("multi_far_out"), big(F.size(A.polygon_intersections(g, cut))).alias("n_cuts"),
    )
    return T.told_by_kind(T.lot_frames(spark, sf), T.FRAME, places).drop(*T.FRAME)


@query(f"""WITH {T.LOTS} SELECT id, list_sort(moved) = list_sort(ring) AS turned_equal, list_sort(list_reverse(moved)) = list_sort(ring) AS reversed_equal, list_sort(moved) = list_sort(ring) AS same_id, cast(len(ring) AS bigint) AS n_clean,
  '[' || array_to_string(list_transform(ring, lambda p: printf('(%f,%f)', p.x, p.y)), ',') || ']' AS txt, cast(len([ring, moved]) AS bigint) AS parts,
  cast(len(list_filter([ring, moved], lambda r: list_sort(r) <> list_sort(ring))) AS bigint) AS left_parts
  FROM (SELECT *, list_concat([{{'x':ring[1].x+(id//4)%2,'y':ring[1].y}}], ring[2:]) AS moved FROM lots)""")
def a2_a37_canonical_forms(spark, sf):
    r = F.col("geom.boundary")
    moved = F.transform(r, lambda p, i: F.when(i == 0, V.point(p["x"] + F.floor(F.col("id") / 4) % 2, p["y"])).otherwise(p))  # another ring for some ids
    turned = F.concat(F.slice(moved, 2, 10), F.slice(moved, 1, 1))
    closed = F.concat(r, F.slice(r, 1, 1), F.slice(r, 1, 1))
    multi = A.add_part(A.promote(A.polygon(r)), A.polygon(moved), F.lit(True))
    return T.lots(spark, sf).select(
        "id", (A.canonical_ring(turned) == A.canonical_ring(r)).alias("turned_equal"), (A.canonical_ring(F.reverse(moved)) == A.canonical_ring(r)).alias("reversed_equal"),
        (A.geometry_id(A.canonical_ring(turned)) == A.geometry_id(A.canonical_ring(r))).alias("same_id"), big(F.size(A.ring_from_points(closed))).alias("n_clean"), A.ring_text(r).alias("txt"),
        big(F.size(multi)).alias("parts"), big(F.size(A.remove_part(multi, A.polygon(r)))).alias("left_parts"),
    )


_BOX_PAIRS = """pairs AS (SELECT a.id AS a, b.id AS b, a.xmin AS ax0, a.ymin AS ay0, a.xmax AS ax1, a.ymax AS ay1, b.xmin AS bx0, b.ymin AS by0, b.xmax AS bx1, b.ymax AS by1
  FROM parcels a JOIN parcels b ON a.id < b.id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax)"""


@query(f"""WITH {T.PARCELS}, {_BOX_PAIRS}, k AS (SELECT *, ax0<=bx0 AND bx1<=ax1 AND ay0<=by0 AND by1<=ay1 AS a_has_b, bx0<=ax0 AND ax1<=bx1 AND by0<=ay0 AND ay1<=by1 AS b_has_a,
    least(ax1,bx1)>greatest(ax0,bx0) AND least(ay1,by1)>greatest(ay0,by0) AS inner_ FROM pairs)
  SELECT a, b, a_has_b AS a_contains_b, inner_ AND NOT a_has_b AND NOT b_has_a AS crosses, NOT inner_ AS touches, CASE WHEN a_has_b THEN -1.0 WHEN NOT inner_ THEN 0.0 ELSE -1.0 END AS distance FROM k""")
def a22_a27_polygon_predicates(spark, sf):
    """Exact predicates on the pairs of boxes that meet, told once for equal boxes."""
    rows, members = spatial_join.kind_pairs(T.parcels(spark, sf).select("id", "box"))
    box = lambda c: A.polygon(A.box_ring(c["xmin"], c["ymin"], c["xmax"], c["ymax"]))
    p, q = box(F.col("a_box")), box(F.col("b_box"))
    from pyspark.sql.types import DoubleType

    two = lambda k, t=None: kernels.pair_udf(k, "polygon", "polygon", t)(p, q)
    told = rows.select(
        "a", "b", two(kernels.polygon_contains).alias("a_contains_b"), two(kernels.polygon_crosses).alias("crosses"), two(kernels.polygon_touches).alias("touches"), (two(kernels.polygon_distance, DoubleType()) + 0.0).alias("distance")
    )
    return spatial_join.joined_kinds(cut(told, "told"), members)


@query(f"""WITH {T.PARCELS} SELECT a.id AS a, b.id AS b, round(sqrt(power(greatest(0,a.xmin-b.xmax,b.xmin-a.xmax),2)+power(greatest(0,a.ymin-b.ymax,b.ymin-a.ymax),2)),6)+0.0 AS d
  FROM parcels a JOIN parcels b ON b.id = a.id + 1 WHERE greatest(a.xmin-b.xmax,b.xmin-a.xmax,a.ymin-b.ymax,b.ymin-a.ymax) > 0""")
def a28_a31_shape_distance(spark, sf):
    rows = T.parcels(spark, sf).select("id", "box", A.polygon(A.box_ring(F.col("box.xmin"), F.col("box.ymin"), F.col("box.xmax"), F.col("box.ymax"))).alias("geom"))
    pairs = rows.select(F.col("id").alias("a"), F.col("box").alias("a_box"), F.col("geom").alias("a_geom")).join(rows.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("box").alias("b_box"), F.col("geom").alias("b_geom")), "a")
    apart = pairs.where(~A.overlap(F.col("a_box"), F.col("b_box")))
    return apart.select("a", "b", r6(kernels.closest_udf()(F.col("a_geom"), F.col("b_geom"))["d"]).alias("d"))


@query(f"""WITH {T.LOTS} SELECT id, cast(CASE kind WHEN 1 THEN 3 ELSE 4 END AS bigint) AS hull_points, round(CASE kind WHEN 1 THEN s*s/2 WHEN 2 THEN s*s/2 ELSE s*s END,6)+0.0 AS hull_area,
  hole IS NULL OR (id//4)%2*s + list_max(list_transform(hole, lambda p: p.x)) <= list_max(list_transform(ring, lambda p: p.x)) AS valid,
  list_max(list_transform(ring, lambda p: p.x)) < list_min(list_transform(ring, lambda p: p.x)) + 2*s*((id//4)%2) AS multi_valid, kind IN (0,3) AS has_top, kind IN (0,3) AS box_like FROM lots""")
def a17_a38_validity_and_hull(spark, sf):
    import numpy as np

    g = F.col("geom")
    hull = kernels.points_udf(lambda p: kernels.convex_hull(np.concatenate(p)), "polygon")(g)
    top = kernels.unary_udf(lambda p: kernels.ring_contains_segment(p[0], np.array([[p[0][:, 0].min(), p[0][:, 1].max()], p[0].max(axis=0)])), "polygon")
    by = lambda r, k: F.transform(r, lambda p: V.point(p["x"] + k * F.col("s") * (F.floor(F.col("id") / 4) % 2), p["y"]))
    loose = F.struct(g["boundary"].alias("boundary"), F.transform(g["holes"], lambda h: by(h, 1)).alias("holes"))  # holes outside for some ids
    beside = F.struct(by(g["boundary"], 2).alias("boundary"), F.transform(g["holes"], lambda h: by(h, 2)).alias("holes"))  # or the same again
    rows = T.lots(spark, sf).withColumn("hull", hull).withColumn("valid", kernels.unary_udf(kernels.polygon_valid, "polygon")(loose))
    rows = rows.withColumn("multi_valid", kernels.unary_udf(kernels.multi_valid, "multi")(F.array(g, beside))).withColumn("has_top", top(g))
    return rows.select("id", big(F.size("hull")).alias("hull_points"), r6(A.ring_area(F.col("hull"))).alias("hull_area"), "valid", "multi_valid", "has_top", (F.col("kind") % 3 == 0).alias("box_like"))


@query(f"""WITH {T.LOTS}, a AS (SELECT id, kind, round(CASE WHEN kind IN (1,2) THEN s*s/2 ELSE s*s END,6)+0.0 AS area FROM lots)
  SELECT id, area AS hull_area, CASE WHEN kind <> 3 THEN area END AS outline_area FROM a""")
def a39_concave_outlines(spark, sf):
    """Concave outlines of the lots. Where all corners are on the border, every ratio gives the hull; lots with a hole have no closed form."""
    lots = T.lots(spark, sf).withColumn("parts", F.array("geom"))
    area = lambda shape: r6(A.polygon_area(shape))
    rows = lots.select("id", "kind", hulls.outline_udf(1.0)(F.col("parts")).alias("hull"), hulls.outline_udf()(F.col("parts")).alias("outline"))
    return rows.select("id", area(F.col("hull")).alias("hull_area"), F.when(F.col("kind") != 3, area(F.col("outline"))).alias("outline_area"))


# --- spatial joins -----------------------------------------------------------------------------

_SCALED = """scaled AS (SELECT id, xmin-w AS xmin, ymin-h AS ymin, xmax+w AS xmax, ymax+h AS ymax, xmin AS px0, ymin AS py0, xmax AS px1, ymax AS py1, area FROM parcels)"""
_NEAR = """near AS (SELECT a, b, d, rk FROM (SELECT a.id AS a, b.id AS b, sqrt(power(greatest(0,a.px0-b.px1,b.px0-a.px1),2)+power(greatest(0,a.py0-b.py1,b.py0-a.py1),2)) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY sqrt(power(greatest(0,a.px0-b.px1,b.px0-a.px1),2)+power(greatest(0,a.py0-b.py1,b.py0-a.py1),2)), b.id) AS rk
  FROM scaled a JOIN scaled b ON a.id <> b.id AND (a.ymin > b.ymin OR (a.ymin = b.ymin AND a.id < b.id)) AND a.ymin < b.ymax AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND b.ymin <= a.ymax) WHERE rk <= 5)"""


def polygon_graph(spark, sf) -> Graph:
    p = T.parcels(spark, sf)
    near = cut(spatial_join.neighbours_by_box(p, 2.0, 5).select(F.col("a").alias("src"), F.col("b").alias("dst")), "near")  # nodes and edges read it
    return Graph.of_edges(near, nodes=p.select("id", "area", F.col("x0").alias("x"), F.col("y0").alias("y")))


@query(f"WITH {T.PARCELS}, {_SCALED}, {_NEAR} SELECT a, b, round(d,6)+0.0 AS distance, cast(rk AS bigint) AS rank FROM near")
def j3_j6_polygon_neighbours(spark, sf):
    return spatial_join.neighbours_by_box(T.parcels(spark, sf), 2.0, 5).select("a", "b", r6(F.col("distance")).alias("distance"), big(F.col("rank")).alias("rank"))


@query(f"""WITH {T.PARCELS}, {_SCALED}, {_NEAR}, ends AS (SELECT a AS id FROM near UNION ALL SELECT b FROM near)
  SELECT p.id, count(e.id) AS degree FROM parcels p LEFT JOIN ends e ON p.id = e.id GROUP BY p.id""")
def k15_polygon_graph_degree(spark, sf):
    """Degree of each parcel in the graph of scaled boxes."""
    return polygon_graph(spark, sf).degrees()


@query(f"""WITH {T.PARCELS}, big_ AS (SELECT * FROM parcels WHERE area >= 4) SELECT id, area FROM big_ p WHERE NOT EXISTS (SELECT 1 FROM big_ q WHERE q.id <> p.id
   AND (q.ymax > p.ymax OR (q.ymax = p.ymax AND q.area > p.area) OR (q.ymax = p.ymax AND q.area = p.area AND q.id < p.id)) AND q.ymin <= p.ymax AND q.xmin <= p.xmin AND p.xmax <= q.xmax AND q.ymin <= p.ymin AND p.ymax <= q.ymax)""")
def j2_mutual_filter(spark, sf):
    box = lambda g: A.ring_box(g["boundary"])
    layer = T.parcels(spark, sf).select("id", "area", A.polygon(A.box_ring(F.col("box.xmin"), F.col("box.ymin"), F.col("box.xmax"), F.col("box.ymax"))).alias("geom"))
    return spatial_join.mutual_filter(layer, lambda g: A.polygon_area(g) >= 4, lambda p, q: ~A.rectangle_contains(box(q), box(p))).select("id", "area")


@query(f"""WITH {T.SITES}, pts AS (SELECT min(id) AS id, x, y FROM sites GROUP BY x, y), r AS (SELECT a.id, b.id AS neighbour, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.id) AS rk FROM pts a JOIN pts b ON a.id <> b.id)
  SELECT id, neighbour, round(d,6)+0.0 AS distance, cast(rk AS bigint) AS rank FROM r WHERE rk <= 3""")
def j7_j9_all_nearest_points(spark, sf):
    pts = T.sites(spark, sf).select("id", V.point(F.col("x"), F.col("y")).alias("p"))
    return spatial_join.all_nearest(pts, 3).select("id", "neighbour", r6(F.col("distance")).alias("distance"), big(F.col("rank")).alias("rank"))


@query(f"""WITH {T.SITES}, q AS (SELECT n_nationkey AS qid, cast(n_nationkey*20 AS double) AS qx, cast(n_nationkey*20 AS double) AS qy FROM nation), r AS (SELECT qid, id,
  sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)), id) AS rk FROM q, sites WHERE NOT (qx=x AND qy=y))
  SELECT cast(qid AS bigint) AS qid, id, round(d,6)+0.0 AS distance FROM r WHERE rk <= 2""")
def j8_nearest_of_queries(spark, sf):
    q = T.read(spark, sf, "nation").selectExpr("n_nationkey AS qid", "cast(n_nationkey*20 AS double) AS qx", "cast(n_nationkey*20 AS double) AS qy")
    return spatial_join.nearest_of(q, T.sites(spark, sf), 2).select(big(F.col("qid")).alias("qid"), "id", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {T.PARCELS}, prim AS (SELECT min(xmin) x0, min(ymin) y0, max(xmax) x1, max(ymax) y1 FROM parcels WHERE x0 < 300 AND y0 < 300)
  SELECT id FROM parcels, prim WHERE prim.x0-20 <= xmax AND xmin <= prim.x1+20 AND prim.y0-20 <= ymax AND ymin <= prim.y1+20""")
def j10_restrict_to_range(spark, sf):
    p = T.parcels(spark, sf)
    return spatial_join.restrict_to_range(p, "box", p.where("x0 < 300 AND y0 < 300"), "box", 20.0).select("id")


def _tiles(spark, sf):
    return T.read(spark, sf, "nation").selectExpr("concat('tile_', n_nationkey % 5, '_', -(n_nationkey div 5), '.shp') AS file")


_TILE_SQL = "t AS (SELECT concat('tile_', n_nationkey % 5, '_', -(n_nationkey // 5), '.shp') AS file, n_nationkey % 5 AS x, -(n_nationkey // 5) AS y FROM nation)"


@query(f"""WITH {_TILE_SQL} SELECT 'TILES' AS rule, a.file AS a, b.file AS b FROM t a JOIN t b ON a.file <> b.file AND sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) <= 1.5
  UNION ALL SELECT 'WSF', a.file, b.file FROM t a JOIN t b ON a.file <> b.file AND abs(a.x-b.x) <= 2 AND abs(a.y-b.y) <= 2
  UNION ALL SELECT 'CHEBYSHEV', a.file, b.file FROM t a JOIN t b ON greatest(abs(a.x-b.x),abs(a.y-b.y)) = 1""")
def j11_j12_adjacent_tiles(spark, sf):
    parts = [spatial_join.adjacent_tiles(_tiles(spark, sf), r).select(F.lit(r).alias("rule"), "a", "b") for r in ("TILES", "WSF", "CHEBYSHEV")]
    return parts[0].union(parts[1]).union(parts[2])


# --- graphs ------------------------------------------------------------------------------------


def supply_graph(spark, sf) -> Graph:
    return Graph.of_edges(T.supply(spark, sf))


_COMPONENTS = f"""WITH RECURSIVE {T.SUPPLY}, both_ AS (SELECT src, dst FROM supply UNION SELECT dst, src FROM supply), ids AS (SELECT DISTINCT src AS id FROM both_),
  reach AS (SELECT id, id AS seen FROM ids UNION SELECT r.id, b.dst FROM reach r JOIN both_ b ON r.seen = b.src), comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""


@query(f"{_COMPONENTS} SELECT id, component FROM comp")
def r23_connected_components(spark, sf):
    return GA.connected_components(Graph.of_edges(T.supply_lines(spark, sf), keep_multi=True))


@query(f"""{_COMPONENTS} SELECT component AS id, cast(sum(abs(id)) AS bigint) AS id_sum, count(*) AS parts, string_agg(cast(id AS varchar), ',' ORDER BY id) AS members FROM comp GROUP BY component""")
def r25_contraction_nodes(spark, sf):
    """One node for each component, with the sum of its ids and a fold of them in order."""
    g = Graph.of_edges(T.supply_lines(spark, sf), keep_multi=True)  # repeated edges tie no more
    labels = cut(GA.connected_components(g), "components")  # of all nodes, so what follows need not look for them among the edges again
    g = Graph(labels.select("id", F.abs("id").alias("n"), F.col("id").cast("string").alias("s")), g.edges)
    out = GA.contract(g, None, [GA.id_sum("n").alias("id_sum"), F.count("*").alias("parts")], labels)
    named = g.nodes.join(labels, "id").select("component", "id", "s")
    members = ordered.fold_in_order(named, "component", "id", "s", lambda a, b: F.concat(a, F.lit(","), b))
    return out.nodes.join(members.select(F.col("component").alias("id"), F.col("s").alias("members")), "id").select("id", "id_sum", "parts", "members")


@query(f"""WITH {T.PARCELS}, {_SCALED}, {_NEAR}, e AS (SELECT DISTINCT least(a,b) AS src, greatest(a,b) AS dst FROM near), lab AS (SELECT id, id//4 AS c FROM parcels)
  SELECT DISTINCT least(x.c,y.c) AS src, greatest(x.c,y.c) AS dst FROM e JOIN lab x ON x.id = src JOIN lab y ON y.id = dst WHERE x.c <> y.c""")
def r25_contraction_edges(spark, sf):
    g = polygon_graph(spark, sf)
    labels = g.nodes.select("id", F.expr("id div 4").alias("component"))
    return GA.contract(g, None, [F.count("*").alias("n")], labels).edges.select("src", "dst")


@query(f"""WITH {T.PARCELS}, {_SCALED}, {_NEAR}, both_ AS (SELECT a AS s, b AS t, d FROM near UNION ALL SELECT b, a, d FROM near)
  SELECT p.id, count(t) AS degree, round(coalesce(avg(CASE WHEN d=0 THEN 'inf'::double ELSE p.area*q.area/(d*d) END),0),4)+0.0 AS mls, round(coalesce(avg(CASE WHEN p.area>q.area THEN 1.0 ELSE 0.0 END),0),6)+0.0 AS smaller
  FROM parcels p LEFT JOIN both_ ON p.id = s LEFT JOIN parcels q ON q.id = t GROUP BY p.id""")
def g1_g4_centralities(spark, sf):
    p = T.parcels(spark, sf)
    near = spatial_join.neighbours_by_box(p, 2.0, 5).select(F.col("a").alias("src"), F.col("b").alias("dst"), "distance")
    g = Graph.of_edges(near, nodes=p.select("id", "area"))
    m = centrality.apply_measures(g, ["DegreeCentralityMeasure", "MeanLocalSignificance", "SmallerNeighboursRatio"])
    return m.select("id", F.col("DegreeCent").alias("degree"), r6(F.col("MeanLocSig"), 4).alias("mls"), r6(F.col("SmallNeigh")).alias("smaller"))


@query(f"""WITH {T.SUPPLY}, e AS (SELECT src, dst FROM supply WHERE dst % 2 = 0 AND src <> -1 UNION SELECT -2, 3), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM (SELECT src AS id FROM supply UNION SELECT dst FROM supply) WHERE id <> -1 UNION SELECT 3)
  SELECT id, (SELECT count(*) FROM e WHERE dst = ids.id) AS in_degree, (SELECT count(*) FROM e WHERE src = ids.id) AS out_degree, id NOT IN (SELECT dst FROM e) AS is_root FROM ids""")
def r1_r16_graph_edits(spark, sf):
    """Directed graph: drop odd edges, drop node -1, add an edge; then degrees and roots."""
    g = Graph.of_edges(T.supply(spark, sf), directed=True)
    g = g.remove_edges(g.edges.where("dst % 2 <> 0")).remove_nodes(spark.createDataFrame([(-1,)], "id long"))
    g = g.add_edges(spark.createDataFrame([(-2, 3), (-2, 3)], "src long, dst long"))
    roots = g.roots().select("id", F.lit(True).alias("is_root"))
    out = g.in_degrees().join(g.out_degrees(), "id").join(roots, "id", "left")
    return out.select("id", "in_degree", "out_degree", F.coalesce("is_root", F.lit(False)).alias("is_root"))


@query(f"""WITH {T.SUPPLY}, e AS (SELECT DISTINCT least(src,dst) AS src, greatest(src,dst) AS dst FROM supply) SELECT src, dst, cast(CASE WHEN dst % 6 = 0 THEN 100 ELSE dst - src END AS double) AS weight,
  '(' || src || ')-(' || dst || ')' AS txt, dst % 6 = 0 AS listed FROM e""")
def r12_r14_weighted_edges(spark, sf):
    g = supply_graph(spark, sf)
    given = g.edges.where("dst % 6 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(100.0).alias("weight"))
    w = g.weighted((F.col("dst") - F.col("src")).cast("double"), given)
    listed = g.contains_edges(g.edges.select("src", "dst")).select("src", "dst").join(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("listed")), ["src", "dst"], "left")
    return w.edges.join(listed, ["src", "dst"]).select("src", "dst", "weight", edge_text(F.col("src"), F.col("dst"), False).alias("txt"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey*3+1)%25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey+5)%25 FROM nation),
  b AS (SELECT src, dst FROM e WHERE src<>dst), walk AS (SELECT 0 AS id, 0 AS hops, [0] AS path UNION ALL SELECT b.dst, hops+1, list_append(path, b.dst) FROM walk JOIN b ON walk.id = b.src WHERE hops < 8 AND NOT list_contains(path, b.dst))
  SELECT cast(id AS bigint) AS id, cast(min(hops) AS bigint) AS hops, array_to_string(min_by(path, [hops::int] || path), '>') AS path, cast(min(hops) AS bigint) AS n_edges FROM walk GROUP BY id""")
def r18_r22_shortest_paths(spark, sf):
    n = T.read(spark, sf, "nation")
    e = n.selectExpr("cast(n_nationkey AS bigint) AS src", "cast((n_nationkey*3+1)%25 AS bigint) AS dst").union(n.selectExpr("cast(n_nationkey AS bigint)", "cast((n_nationkey+5)%25 AS bigint)"))
    paths = GA.path_edges(GA.shortest_paths(Graph.of_edges(e, directed=True), 0))
    return paths.select("id", big(F.col("hops")).alias("hops"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), big(F.size("edges")).alias("n_edges"))


@query(f"""{_COMPONENTS}, f AS (SELECT id, component, 'f' || (abs(id)%3) AS file FROM comp WHERE id > 0), per AS (SELECT component, count(DISTINCT file) AS nf, count(DISTINCT id) AS nodes, min(file) AS file FROM f GROUP BY component),
  single AS (SELECT *, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file ORDER BY component)-1 AS k FROM per WHERE nf = 1), pl AS (SELECT *, ceil(n/4.0) AS parts FROM single)
  SELECT file || '#' || cast(least(floor(k/floor(n/parts)), parts-1) AS int) AS workload, count(*) AS components, cast(sum(nodes) AS bigint) AS nodes FROM pl GROUP BY 1
  UNION ALL SELECT 'component#' || component, 1, nodes FROM per WHERE nf > 1""")
def g13_pack_workloads(spark, sf):
    c = GA.connected_components(supply_graph(spark, sf)).where("id > 0").withColumn("file", F.concat(F.lit("f"), (F.abs("id") % 3).cast("string")))
    return GA.pack_workloads(c.select("component", "file", "id"), 4).select("workload", big(F.size("components")).alias("components"), "nodes")


# --- layers ------------------------------------------------------------------------------------


@query(f"""WITH {T.PARCELS}, c AS (SELECT *, x0+w/2 AS cx, y0+h/2 AS cy FROM parcels), b AS (SELECT min(cx) x0, min(cy) y0, max(cx) x1, max(cy) y1 FROM c)
  SELECT cast(least(3, floor((cx-b.x0)/(b.x1-b.x0)*4)) AS bigint) AS tx, cast(least(3, floor((cy-b.y0)/(b.y1-b.y0)*4)) AS bigint) AS ty, count(*) AS n, cast(sum(id) AS bigint) AS ids FROM c, b GROUP BY 1, 2""")
def l11_k1_split_tiles(spark, sf):
    p = T.parcels(spark, sf).withColumn("cx", F.col("x0") + F.col("w") / 2).withColumn("cy", F.col("y0") + F.col("h") / 2)
    box = p.agg(F.min("cx").alias("xmin"), F.min("cy").alias("ymin"), F.max("cx").alias("xmax"), F.max("cy").alias("ymax"))
    return layers.split(p, 3, F.col("cx"), F.col("cy"), box).groupBy(big(F.col("tx")).alias("tx"), big(F.col("ty")).alias("ty")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {T.PARCELS} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n FROM parcels""")
def l12_g8_common_box(spark, sf):
    return layers.common_box(T.parcels(spark, sf))


@query(f"""WITH {T.LOTS}, a AS (SELECT * FROM lots WHERE id % 2 = 0), b AS (SELECT * FROM lots WHERE id % 3 = 0)
  SELECT 'shared' AS part, count(*) AS n, cast(sum(id) AS bigint) AS ids, cast(NULL AS bigint) AS marks FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.ring = a.ring AND b.hole IS NOT DISTINCT FROM a.hole)
  UNION ALL SELECT 'rest', count(*), cast(sum(id) AS bigint), cast(NULL AS bigint) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ring = a.ring AND b.hole IS NOT DISTINCT FROM a.hole)
  UNION ALL SELECT 'merged', (SELECT count(*) FROM a) + (SELECT count(*) FROM b), cast((SELECT sum(id) FROM a) + (SELECT sum(id) FROM b) AS bigint), cast((SELECT count(*) FROM b) * 7 AS bigint)""")
def l1_l10_layer_edits(spark, sf):
    lots = T.lots(spark, sf).select("id", "geom")
    a, b, key = lots.where("id % 2 = 0"), lots.where("id % 3 = 0"), A.canonical_polygon(F.col("geom"))
    marked = layers.add_attribute(layers.add_field(b, "mark", "integer"), "mark", F.lit(7))
    merged = layers.merge(a, marked)
    sums = lambda df, name, mark=F.lit(None): df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(mark).cast("long").alias("marks"))
    out = sums(layers.contains_geometry(a, b, key), "shared").union(sums(layers.remove_geometry(a, b, key), "rest"))
    return out.union(sums(merged, "merged", F.col("mark")))


@query(f"""WITH {T.PARCELS}, o AS (SELECT id, area, row_number() OVER (ORDER BY area, id) AS rn, count(*) OVER () AS n FROM parcels),
  b AS (SELECT max(CASE WHEN rn = floor(n*0.5) THEN area END) b1, max(CASE WHEN rn = floor(n*0.75) THEN area END) b2, max(CASE WHEN rn = floor(n*0.9375) THEN area END) b3, max(CASE WHEN rn = floor(n*0.99609375) THEN area END) b4, max(CASE WHEN rn = n THEN area END) b5 FROM o)
  SELECT CASE WHEN area < b1 THEN 0 WHEN area < b2 THEN 1 WHEN area < b3 THEN 2 WHEN area < b4 THEN 3 WHEN area < b5 THEN 4 END::bigint AS class, count(*) AS n FROM parcels, b WHERE area < b5 GROUP BY 1""")
def g14_area_classes(spark, sf):
    """Areas by the bounds at 1/2, 3/4, 15/16, 255/256 and all of their order; the greatest area has no class."""
    p = T.parcels(spark, sf).select("id", "area")
    b = ordered.order_statistics(p, "area", [0.5, 0.75, 0.9375, 0.99609375, 1.0])
    label = F.coalesce(*[F.when(F.col("area") < F.col(f"b{i}"), i) for i in range(5)])
    return p.join(F.broadcast(b)).withColumn("class", big(label)).where("class is not null").groupBy("class").agg(F.count("*").alias("n"))


# --- geodesy and domain filters ----------------------------------------------------------------

_GEO = f"{T.SITES}, geo AS (SELECT id, x/503*20-10 AS lon, y/509*20+40 AS lat FROM sites)"
_DIST = """d AS (SELECT id, lon, lat, power(sin(radians(g)),2)*power(cos(radians(l)),2)+power(cos(radians(f)),2)*power(sin(radians(l)),2) AS s,
  power(cos(radians(g)),2)*power(cos(radians(l)),2)+power(sin(radians(f)),2)*power(sin(radians(l)),2) AS c, f, g FROM (SELECT id, lon, lat, (lat+52)/2 AS f, (lat-52)/2 AS g, (lon-13.4)/2 AS l FROM geo)),
  e AS (SELECT *, atan(sqrt(s/c)) AS w FROM d), h AS (SELECT *, sqrt(s*c)/w AS t FROM e)"""


@query(f"""WITH {_GEO}, {_DIST} SELECT id, round(2*w*6378137,3)+0.0 AS plain, round(2*w*6378137*(1+(1/298.257223563)*((3*t-1)/(2*c))*power(sin(radians(f)),2)*power(cos(radians(g)),2)
  -(1/298.257223563)*((3*t+1)/(2*s))*power(cos(radians(f)),2)*power(sin(radians(g)),2)),3)+0.0 AS exact FROM h""")
def p1_geodesic_distance(spark, sf):
    p = V.point(F.col("x") / 503 * 20 - 10, F.col("y") / 509 * 20 + 40)
    q = V.point(13.4, 52.0)
    return T.sites(spark, sf).select("id", r6(geodesy.wgs84_distance(p, q, False), 3).alias("plain"), r6(geodesy.wgs84_distance(p, q), 3).alias("exact"))


@query(f"""WITH {T.PARCELS} SELECT id, w*h >= 20 AND h < 5 AS both_, w*h >= 20 OR h < 2 AS either, w*h >= 12 AS none_and, h < 3 AS none_or, w*h >= 12 AS large FROM parcels""")
def p8_p12_composed_filters(spark, sf):
    large, flat = lambda r: F.col("w") * F.col("h") >= r, lambda r: F.col("h") < r
    x = F.lit(0)
    return T.parcels(spark, sf).select(
        "id", predicates.all_of(lambda _: large(20), lambda _: flat(5))(x).alias("both_"), predicates.any_of(lambda _: large(20), lambda _: flat(2))(x).alias("either"),
        predicates.all_of(predicates.all_of(), lambda _: large(12))(x).alias("none_and"), predicates.any_of(predicates.any_of(), lambda _: flat(3))(x).alias("none_or"), large(12).alias("large"),
    )


def _geographic():
    lon, lat = lambda p: 10 + p["x"] / 10000, lambda p: 48 + p["y"] / 10000
    turn = lambda r: F.transform(r, lambda p: V.point(lon(p), lat(p)))
    return F.struct(turn(F.col("geom.boundary")).alias("boundary"), F.transform(F.col("geom.holes"), turn).alias("holes"))


def geographic_lots(spark, sf) -> DataFrame:
    """Lots as polygons of some hundred metres around 10 degrees east, 48 north."""
    return T.lots(spark, sf).select("id", _geographic().alias("geom"))


@query(f"""WITH {T.LOTS}, geo AS (SELECT id, list_transform(ring, lambda p: {{'x':10+p.x/10000,'y':48+p.y/10000}}) AS ring, list_transform(hole, lambda p: {{'x':10+p.x/10000,'y':48+p.y/10000}}) AS hole FROM lots),
  d AS (SELECT id, {_SHOELACE.format(r='ring')} - coalesce({_SHOELACE.format(r='hole')},0) AS degrees, sqrt(power(ring[1].x-ring[2].x,2)+power(ring[1].y-ring[2].y,2)) AS len,
    radians((ring[1].y+ring[2].y)/2) AS f, radians((ring[1].y-ring[2].y)/2) AS g, radians((ring[1].x-ring[2].x)/2) AS l FROM geo),
  e AS (SELECT *, power(sin(g),2)*power(cos(l),2)+power(cos(f),2)*power(sin(l),2) AS s, power(cos(g),2)*power(cos(l),2)+power(sin(f),2)*power(sin(l),2) AS c FROM d),
  h AS (SELECT *, atan(sqrt(s/c)) AS w, sqrt(s*c)/atan(sqrt(s/c)) AS t FROM e),
  metres AS (SELECT id, degrees*power(2*w*6378137*(1+(1/298.257223563)*((3*t-1)/(2*c))*power(sin(f),2)*power(cos(g),2)-(1/298.257223563)*((3*t+1)/(2*s))*power(cos(f),2)*power(sin(g),2))/len,2) AS approx FROM h),
  rings AS (SELECT id, 1 AS sign, ring AS r FROM geo UNION ALL SELECT id, -1, hole FROM geo WHERE hole IS NOT NULL),
  angles AS (SELECT id, sign, list_transform(r, lambda p: {{'lam':radians(p.x-list_avg(list_transform(r, lambda q: q.x))),
    'theta':list_reduce(list_prepend(radians(p.y)/2, list_transform(range(30), lambda z: 0.0::double)), lambda t, z: t-(t+sin(t)*cos(t)+2*sin(t)-(2+pi()/2)*sin(radians(p.y)))/(2*cos(t)*(1+cos(t))))}}) AS a FROM rings),
  flat AS (SELECT id, sign, list_transform(a, lambda v: {{'x':6378137*2/sqrt(pi()*(4+pi()))*v.lam*(1+cos(v.theta)),'y':6378137*2*sqrt(pi()/(4+pi()))*sin(v.theta)}}) AS r FROM angles),
  projected AS (SELECT id, sum(sign*{_SHOELACE.format(r='r')}) AS projected FROM flat GROUP BY id)
  SELECT id, round(approx,1)+0.0 AS approx, round(projected,1)+0.0 AS projected, approx >= 5000 AS large FROM metres JOIN projected USING (id)""")
def p2_p6_metric_areas(spark, sf):
    """Approximate and projected square metres of geographic polygons."""
    from pyspark.sql.types import DoubleType

    g = F.col("geom")

    def areas(kinds):
        rows = T.shaped(kinds).select(*T.FRAME, _geographic().alias("geom")).withColumn("projected", kernels.unary_udf(geodesy.projected_area, "polygon", DoubleType())(g))
        return rows.select(*T.FRAME, r6(predicates.approx_area(g), 1).alias("approx"), r6(F.col("projected"), 1).alias("projected"), predicates.approx_area_filter(5000.0)(g).alias("large"))

    return T.told_by_kind(T.lot_frames(spark, sf), T.FRAME, areas).drop(*T.FRAME)


# --- attribute rules ---------------------------------------------------------------------------


@query(f"""WITH {T.PARCELS}, v AS (SELECT id, id%7 AS grp, area, CASE WHEN id%3=0 THEN NULL ELSE (id%100)/100.0 END AS imp, CASE WHEN id%5=0 THEN NULL ELSE cast(id%50 AS double) END AS pop FROM parcels)
  SELECT cast(grp AS bigint) AS grp, round(sum(area),6)+0.0 AS area, round(sum(imp*area)/sum(area),6)+0.0 AS imp, round(sum(pop),6)+0.0 AS pop,
  round(sum(CASE WHEN imp IS NULL THEN area ELSE area*imp END + CASE WHEN pop IS NULL THEN 0 ELSE area*pop/10 END),4)+0.0 AS value FROM v GROUP BY grp""")
def y2_y7_merge_attributes(spark, sf):
    v = T.parcels(spark, sf).selectExpr("id", "id%7 AS grp", "area", "CASE WHEN id%3=0 THEN NULL ELSE cast((id%100)/100.0 AS double) END AS imp", "CASE WHEN id%5=0 THEN NULL ELSE cast(id%50 AS double) END AS pop")
    merged = centrality.merge_attributes(v, "grp")
    value = v.groupBy("grp").agg(F.sum(centrality.settlement_value(F.col("area"), F.col("imp"), F.col("pop"), 10.0)).alias("value"))
    return merged.join(value, "grp").select(big(F.col("grp")).alias("grp"), r6(F.col("area")).alias("area"), r6(F.col("imp")).alias("imp"), r6(F.col("pop")).alias("pop"), r6(F.col("value"), 4).alias("value"))


@query(f"""WITH {T.PARCELS}, {_SCALED}, {_NEAR}, both_ AS (SELECT a AS s, b AS t, d FROM near WHERE d > 0 UNION ALL SELECT b, a, d FROM near WHERE d > 0), r AS (SELECT s, t, q.area/d AS rel, row_number() OVER (PARTITION BY s ORDER BY q.area/d DESC, t) AS rk FROM both_ JOIN parcels q ON q.id = t)
  SELECT s AS src, t AS dst, round(rel,6)+0.0 AS relevance FROM r WHERE rk <= 3""")
def y3_relevant_neighbours(spark, sf):
    """At most three neighbours of each node, by their value over the distance."""
    p = T.parcels(spark, sf)
    near = spatial_join.neighbours_by_box(p, 2.0, 5).select(F.col("a").alias("src"), F.col("b").alias("dst"), "distance").where("distance > 0")
    both = Graph.of_edges(near, nodes=p.select("id")).both().join(p.select(F.col("id").alias("dst"), F.col("area").alias("value")), "dst")
    ranked = spatial_join.top_k(both.withColumn("relevance", F.col("value") / F.col("distance")), ["src"], [F.desc("relevance"), F.col("dst")], 3)
    return ranked.select("src", "dst", r6(F.col("relevance")).alias("relevance"))


# --- text, files, windows ----------------------------------------------------------------------


@query(f"""WITH {_TILE_SQL} SELECT file, cast(x AS bigint) AS x, cast(y AS bigint) AS y, 'SHP' AS type, 'tile_' || x AS stem, cast(abs(y) AS varchar) || '.shp' AS tail FROM t""")
def f1_f4_file_names(spark, sf):
    from geoweave.sources.files import file_type

    f = F.col("file")
    c = spatial_join.tile_coordinates(f)
    return _tiles(spark, sf).select("file", big(c["x"]).alias("x"), big(c["y"]).alias("y"), file_type(f).alias("type"), F.substring_index(f, "_", 2).alias("stem"), F.regexp_replace(F.substring_index(f, "_", -1), "^-", "").alias("tail"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4)+0.0 AS total FROM events GROUP BY 1, 2")
def t1_windowed_events(spark, sf):
    from geoweave.streaming.tiles import windowed_counts

    return windowed_counts(T.read(spark, sf, "events")).select("start", "event_type", "n", r6(F.col("total"), 4).alias("total"))


# --- sources and workflows ---------------------------------------------------------------------


@query("""WITH RECURSIVE cells AS MATERIALIZED (SELECT p_partkey//40 AS r, p_partkey%40 AS c, p_size%3 AS val, (p_partkey//40)*2147483648 + p_partkey%40 AS id FROM part WHERE p_size%3 <> 0),
  n8 AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, abs(a.r-b.r) + abs(a.c-b.c) AS steps FROM cells a JOIN cells b ON a.val = b.val AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.id <> b.id),
  reach8 AS (SELECT id, id AS seen FROM cells UNION SELECT x.id, n.dst FROM reach8 x JOIN n8 n ON x.seen = n.src), region8 AS MATERIALIZED (SELECT id, min(seen) AS region FROM reach8 GROUP BY id),
  reach4 AS (SELECT id, id AS seen FROM cells UNION SELECT x.id, n.dst FROM reach4 x JOIN n8 n ON x.seen = n.src AND n.steps = 1), piece AS MATERIALIZED (SELECT id, min(seen) AS p FROM reach4 GROUP BY id),
  m AS MATERIALIZED (SELECT c.*, region FROM cells c JOIN region8 USING (id)),
  pieces AS (SELECT region, count(DISTINCT p) AS pieces, count(*) AS n FROM region8 JOIN piece USING (id) GROUP BY region),
  sides AS (SELECT region, count(*) AS n FROM m JOIN n8 ON n8.src = m.id AND n8.steps = 1 AND n8.src < n8.dst GROUP BY region),
  blocks AS (SELECT a.region, count(*) AS n FROM m a JOIN m b ON b.region = a.region AND b.r = a.r AND b.c = a.c+1 JOIN m d ON d.region = a.region AND d.r = a.r+1 AND d.c = a.c JOIN m e ON e.region = a.region AND e.r = a.r+1 AND e.c = a.c+1 GROUP BY a.region)
  SELECT cast(val AS integer) AS pixel_val, region, 2*pieces - (p.n - coalesce(s.n,0) + coalesce(b.n,0)) AS n_rings, cast(p.n AS double) AS area
  FROM pieces p LEFT JOIN sides s USING (region) LEFT JOIN blocks b USING (region) JOIN (SELECT DISTINCT region, val FROM m) USING (region)""")
def s7_raster_regions(spark, sf):
    """A raster from the parts, polygonised: how many rings each region of equal value has, and their area. (SQL: pieces less holes are cells less shared sides plus full blocks.)"""
    from geoweave.sources.raster import polygonise

    cells = T.read(spark, sf, "part").selectExpr("cast(p_partkey div 40 AS int) AS row", "cast(p_partkey % 40 AS int) AS col", "cast(p_size % 3 AS int) AS val")
    area = F.aggregate("rings", F.lit(0.0), lambda a, r: a + A.signed_area(r))
    return polygonise(cells).select("pixel_val", "region", big(F.size("rings")).alias("n_rings"), r6(area).alias("area"))


@query(f"""WITH {T.LOTS} SELECT id, round(CASE kind WHEN 0 THEN s*s WHEN 3 THEN s*s*0.75 ELSE s*s/2 END,6)+0.0 AS area FROM lots""")
def s15_wkb_round_trip(spark, sf):
    from geoweave.sources import wkb

    back = wkb.polygon_from_wkb(wkb.polygon_to_wkb(F.col("geom")))
    areas = lambda kinds: T.shaped(kinds).withColumn("back", back).select(*T.FRAME, r6(A.polygon_area(F.col("back"))).alias("area"))
    return T.told_by_kind(T.lot_frames(spark, sf), T.FRAME, areas).drop(*T.FRAME)


@query()
def k2_k7_settlement_workflow(spark, sf):
    """All stages on geographic polygons: filter, neighbours, components, contraction, analysis."""
    from geoweave.plans import workflow
    from geoweave.plans.config import WorkflowConfig

    near = lambda d: {"name": "DistanceBiPredicate", "maxDistanceMeters": d}
    config = WorkflowConfig(
        unary_filters=[{"name": "ApproxAreaFilter", "requiredArea": 2000.0}], binary_filters=[{"name": "InsidePolygonFilter"}], max_distance_meters=200.0, max_neighbours=3,
        neighbouring_predicates=[near(200.0)], contraction_predicates=[near(60.0)], centrality_measures=["DegreeCentralityMeasure", "MeanLocalSignificance", "SmallerNeighboursRatio"],
    )
    out = workflow.run([geographic_lots(spark, sf).select("geom")], config)
    return out.analysed.select("id", "FEATURE_ID", "parts", F.round("area", 9).alias("area"), "DegreeCent", F.round("MeanLocSig", 6).alias("MeanLocSig"), F.round("SmallNeigh", 6).alias("SmallNeigh"))


# --- orders, jobs, searches, classes -------------------------------------------------------------


@query(f"""WITH {T.SITES}, {T.PARCELS} SELECT * FROM (SELECT 'lexicographic' AS rule, id FROM sites ORDER BY x, y, id LIMIT 25) UNION ALL SELECT * FROM (SELECT 'by_y', id FROM sites ORDER BY y, x, id LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 'vertical', id FROM parcels ORDER BY ymax DESC, id LIMIT 25) UNION ALL SELECT * FROM (SELECT 'horizontal', id FROM parcels ORDER BY xmin, xmax, id LIMIT 25)""")
def w3_w6_first_in_order(spark, sf):
    points, boxes = T.sites(spark, sf), T.parcels(spark, sf).select("id", "box.*")
    parts = [spatial_join.in_order(points if r in ("lexicographic", "by_y") else boxes, r, 25).select(F.lit(r).alias("rule"), "id") for r in spatial_join.ORDERS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH jobs AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNABLE' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'FAILED' END END AS state FROM orders),
  again AS (SELECT job, CASE WHEN state IN ('RUNNING', 'FAILED') THEN 'RUNNABLE' ELSE state END AS state FROM jobs)
  SELECT 'before' AS what, state, count(*) AS n FROM jobs GROUP BY state UNION ALL SELECT 'resumed', state, count(*) FROM again GROUP BY state UNION ALL SELECT 'next', NULL, coalesce(max(job), 0) + 1 FROM jobs""")
def g9_g10_job_states(spark, sf):
    state = "CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNABLE' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'FAILED' END END AS state"
    j = T.read(spark, sf, "orders").selectExpr("o_orderkey AS job", state)
    parts = [jobs.count_by_state(d).select(F.lit(w).alias("what"), "state", "n") for w, d in (("before", j), ("resumed", jobs.resume(j)))]
    return parts[0].union(parts[1]).union(jobs.next_id(j).select(F.lit("next"), F.lit(None).cast("string"), "job"))


@query("SELECT DISTINCT l_suppkey AS component, 'f' || (p_size % 20) AS file FROM lineitem JOIN part ON l_partkey = p_partkey")
def j14_files_of_components(spark, sf):
    part_of = T.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("component"))
    stored = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), (F.col("p_size") % 20).cast("string")).alias("file"))
    return GA.files_of_components(part_of, stored)


@query(f"""WITH {T.SITES}, c AS (SELECT *, id % 4 AS class FROM sites), p AS (SELECT a.id, b.id AS neighbour, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM c a JOIN c b ON b.class = a.class + 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS k FROM p) SELECT id, neighbour, round(d,6)+0.0 AS distance FROM r WHERE k = 1""")
def k14_nearest_in_next_class(spark, sf):
    near = spatial_join.nearest_in_next_class(T.sites(spark, sf).withColumn("class", F.col("id") % 4))
    return near.select("id", "neighbour", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {T.PARCELS}, src AS (SELECT id AS source, x0+0.25 AS sx0, y0+0.25 AS sy0, x0+0.25+w/4 AS sx1, y0+0.25+h/4 AS sy1, w*h/16 AS a, id % 100 AS imp, id % 7 AS pop FROM parcels),
  met AS (SELECT source, min(id) AS id, any_value(a) AS a, any_value(imp) AS imp, any_value(pop) AS pop FROM src JOIN parcels ON xmin <= sx0 AND sx1 <= xmax AND ymin <= sy0 AND sy1 <= ymax GROUP BY source),
  sums AS (SELECT id, sum(imp*a)/sum(a) AS imp, sum(pop) AS pop FROM met GROUP BY id)
  SELECT parcels.id, round(imp,6)+0.0 AS imp, cast(pop AS double) AS pop FROM parcels LEFT JOIN sums USING (id)""")
def y1_attach_by_containment(spark, sf):
    p = T.parcels(spark, sf)
    shape = lambda x0, y0, x1, y1: A.polygon(F.array(V.point(x0, y1), V.point(x1, y1), V.point(x1, y0), V.point(x0, y0)))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    polygons = p.select("id", shape(x, y, x + w, y + h).alias("geom"))
    sources = p.select(F.col("id").alias("source"), shape(x + 0.25, y + 0.25, x + 0.25 + w / 4, y + 0.25 + h / 4).alias("geom"), (w * h / 16).alias("area"), (F.col("id") % 100).cast("double").alias("imp"), (F.col("id") % 7).cast("double").alias("pop"))
    return spatial_join.attach_by_containment(polygons, sources).select("id", r6(F.col("imp")).alias("imp"), "pop")


@query(f"""WITH {T.LOTS}, seg AS (SELECT id, kind, x, y, s, x+0.1*s AS ax, y+0.1*s AS ay, x+(0.2+id%2*0.7)*s AS bx, y+0.1*s AS by_, y+0.9*s AS cy FROM lots WHERE kind IN (0, 3))
  SELECT id, ax >= x AND bx <= x+s AND ay >= y AND ay <= y+s AS low, NOT (kind = 3 AND bx > x+0.25*s AND bx < x+0.75*s) AND bx <= x+s AND cy <= y+s AND NOT (kind = 3 AND ax < x+0.75*s AND (bx-ax)/(cy-ay) * 0.15*s + ax < x+0.75*s AND (bx-ax)/(cy-ay) * 0.65*s + ax > x+0.25*s) AS high FROM seg""")
def a21_polygon_contains_segment(spark, sf):
    """Segments along the lower side of a box, and up through it; the second one may cross the hole."""
    p = T.lots(spark, sf).where("kind IN (0, 3)")
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    end = x + (F.lit(0.2) + F.col("id") % 2 * 0.7) * s
    inside = kernels.pair_udf(kernels.polygon_contains_segment, "polygon", "segment")
    a = V.point(x + 0.1 * s, y + 0.1 * s)
    low, high = N.segment(a, V.point(end, y + 0.1 * s)), N.segment(a, V.point(end, y + 0.9 * s))
    return p.select("id", inside(F.col("geom"), low).alias("low"), inside(F.col("geom"), high).alias("high"))


@query()
def a29_a30_swept_closest_points(spark, sf):
    """Distances of rings of many vertices by the sweep and by brute force; SQL has no shape for this, tests compare the two."""
    n = T.read(spark, sf, "nation").selectExpr("n_nationkey AS id")
    def ring(c):
        turn = lambda k: k * 0.02617993877991494
        r = lambda k: 2 + F.sin(turn(k) * (3 + F.col("id") % 5))
        return F.transform(F.sequence(F.lit(0), F.lit(239)), lambda k: F.struct((c * 7 + r(k) * F.cos(turn(k))).alias("x"), (c % 5 * 6 + r(k) * F.sin(turn(k))).alias("y")))

    pairs = n.select("id", A.polygon(ring(F.col("id"))).alias("p"), A.polygon(ring(F.col("id") + 1)).alias("q"))
    brute = kernels.pair_udf(lambda a, b: kernels.closest_points_of_all(a[0], b[0])[0], "polygon", "polygon", DoubleType())
    swept = kernels.pair_udf(lambda a, b: kernels.closest_points_swept(a[0], b[0])[0], "polygon", "polygon", DoubleType())
    return pairs.select("id", r6(swept(F.col("p"), F.col("q")), 9).alias("swept"), r6(brute(F.col("p"), F.col("q")), 9).alias("of_all"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey*3+1)%25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey+5)%25 FROM nation),
  walk AS (SELECT 0 AS id, 0 AS hops UNION SELECT e.dst, hops+1 FROM walk JOIN e ON walk.id = e.src WHERE hops < 25), best AS (SELECT id, min(hops) AS h FROM walk GROUP BY id)
  SELECT cast(n_nationkey AS bigint) AS id, CASE WHEN h < 3 THEN 'closed' WHEN h = 3 THEN 'open' ELSE 'unknown' END AS status, cast(CASE WHEN h <= 3 THEN h END AS bigint) AS hops FROM nation LEFT JOIN best ON id = n_nationkey""")
def r19_r20_search_states(spark, sf):
    """A search that is stopped when it opens nodes three hops away."""
    n = T.read(spark, sf, "nation")
    e = n.selectExpr("cast(n_nationkey AS bigint) AS src", "cast((n_nationkey*3+1)%25 AS bigint) AS dst").union(n.selectExpr("cast(n_nationkey AS bigint)", "cast((n_nationkey+5)%25 AS bigint)"))
    found = GA.Search(stop=lambda new: not new.where("hops >= 3").isEmpty()).run(Graph.of_edges(e, directed=True), 0)
    return found.select("id", "status", big(F.col("hops")).alias("hops"))


@query("""WITH o AS (SELECT l_orderkey AS id, list(cast(l_quantity AS bigint)) AS q, range(0, count(*)) AS n FROM lineitem GROUP BY l_orderkey)
  SELECT id, cast(len(q) AS bigint) AS size, len(q) = 0 AS empty, cast(list_sum(list_transform(q, lambda x: 2*x)) AS bigint) AS doubled, cast(len(list_filter(q, lambda x: x > 25)) AS bigint) AS large,
  len(list_filter(q, lambda x: x > 49)) > 0 AS any_large, len(list_filter(q, lambda x: x > 5)) = len(q) AS all_five, cast(len(flatten([q, cast(n AS bigint[])])) AS bigint) AS joined,
  cast(len(list_distinct(q)) AS bigint) AS inverse_keys, cast(list_max(n) AS bigint) AS last FROM o""")
def f7_f9_collections(spark, sf):
    """Ranges and maps of the lines of an order: place -> quantity, and turned around (of equal quantities the last place)."""
    o = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(big(F.col("l_quantity")))).alias("q"))
    o = o.select("id", F.transform("q", lambda x, i: F.struct(big(i).alias("n"), x.alias("q"))).alias("l"))
    m = F.map_from_entries("l")
    q = F.transform("l", lambda x: x["q"])
    turned = F.map_from_entries(F.map_values(F.aggregate("l", F.create_map().cast("map<bigint,struct<k:bigint,v:bigint>>"), lambda a, x: F.map_zip_with(a, F.create_map(x["q"], F.struct(x["q"].alias("k"), x["n"].alias("v"))), lambda k, old, new: F.coalesce(new, old)))))
    return o.select(
        "id", big(F.size(m)).alias("size"), (F.size("l") == 0).alias("empty"), F.aggregate(F.transform(q, lambda x: 2 * x), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"), big(F.size(F.filter(q, lambda x: x > 25))).alias("large"),
        F.exists(q, lambda x: x > 49).alias("any_large"), F.forall(q, lambda x: x > 5).alias("all_five"), big(F.size(F.flatten(F.array(q, F.map_keys(m))))).alias("joined"),
        big(F.size(turned)).alias("inverse_keys"), F.array_max(F.map_keys(m)).alias("last"),
    )

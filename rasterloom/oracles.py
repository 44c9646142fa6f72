"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

EMB = "emb as (select vec_id as y, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v from embeddings)"
R16 = EMB + ", r16 as (select y, pos % 16 as x, pos // 16 + 1 as band, v from emb)"
C64 = EMB + ", c64 as (select a.y, a.pos as x, round(a.v, 1) + 0.0 as b0, round(b.v, 1) + 0.0 as b1 from emb a join emb b on a.y = b.y and b.pos = 63 - a.pos)"
#: The raster 64 wide, padded to cells of 8, in its patches of 16.
PATCHES = (
    C64
    + """, n as (select ceil((max(y) + 1) / 8.0)::bigint as n1, 8 as n2, max(y) + 1 as h from c64),
pad as (select yy.y, xx.x, coalesce(b0, 0.0::double) as b0, coalesce(b1, 0.0::double) as b1 from (select unnest(range(0, n1 * 8)) as y from n) yy cross join (select unnest(range(0, 64)) as x) xx left join c64 on c64.y = yy.y and c64.x = xx.x),
pp as (select y // 8 - di as i, x // 8 - dj as j, y, x, y - (y // 8 - di) * 8 as py, x - (x // 8 - dj) * 8 as px, b0, b1, n1, n2, h
  from pad, n, (select unnest([0, 1]) as di) a, (select unnest([0, 1]) as dj) b
  where y // 8 - di between 0 and n1 - 2 and x // 8 - dj between 0 and n2 - 2)"""
)
HANN = "(0.5::double - 0.5::double * cos(2.0::double * pi() * {k} / 16.0::double))"


def _side(kind: str, k: str) -> str:
    w = HANN.format(k=k)
    return {"lo": f"(case when {k} < 8 then 1.0::double else {w} end)", "hi": f"(case when {k} < 8 then {w} else 1.0::double end)", "mid": w}[kind]


#: The nine cases one after the other, first match wins.
WEIGHT = "case " + " ".join(
    f"when {cond} then {_side(fy, 'py')} * {_side(fx, 'px')}"
    for cond, fy, fx in (
        ("j >= n2 - 2 and i = 0", "lo", "hi"),
        ("j >= n2 - 2 and i > 0 and i < n1 - 2", "mid", "hi"),
        ("j >= n2 - 2 and i >= n1 - 2", "hi", "hi"),
        ("i >= n1 - 2 and j > 0 and j < n2 - 2", "hi", "mid"),
        ("i >= n1 - 2 and j = 0", "hi", "lo"),
        ("i = 0 and j = 0", "lo", "lo"),
        ("j = 0 and i > 0 and i < n1", "mid", "lo"),
        ("j > 0 and j < n2 - 2 and i = 0", "lo", "mid"),
    )
) + f" else {_side('mid', 'py')} * {_side('mid', 'px')} end"
MEANS = ", m as (select *, avg(b0) over (partition by i, j) as m0, avg(b1) over (partition by i, j) as m1 from pp)"
PROBS = (
    MEANS
    + """, z as (select *, 1.0::double * (b0 - m0) + -0.5::double * (b1 - m1) + 0.1::double as z0, -0.7::double * (b0 - m0) + 0.9::double * (b1 - m1) as z1, 0.2::double * (b0 - m0) + 0.3::double * (b1 - m1) - 0.1::double as z2 from m),
e as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1, exp(z2 - greatest(z0, z1, z2)) as e2 from z),
pr as (select *, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2, """
    + WEIGHT
    + """ as w from e),
bl as (select y, x, sum(p0 * w) as s0, sum(p1 * w) as s1, sum(p2 * w) as s2, sum(w) as sw from pr group by y, x)"""
)
SEGMENT = (
    PATCHES
    + PROBS
    + """, q as (select c64.y, c64.x, b0 <> 0 and b1 <> 0 as ok, coalesce(sw, 0.0) as sw, case when sw <> 0 then s0 / sw else 0.0 end as p0, case when sw <> 0 then s1 / sw else 0.0 end as p1, case when sw <> 0 then s2 / sw else 0.0 end as p2 from c64 left join bl using (y, x)),
c as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end::bigint as cls from q)"""
)
_B4 = range(4)
_W4 = ((1.0, -0.5, 0.4, 0.3), (-0.7, 0.9, -0.2, 0.6), (0.2, 0.3, 0.8, -0.4))
#: The raster 16 wide with all its four bands, two cells wide.
NARROW = (
    R16
    + ", c16 as (select y, x, " + ", ".join(f"max(v) filter (where band = {k + 1}) as b{k}" for k in _B4) + " from r16 group by y, x)"
    + """, n as (select ceil((max(y) + 1) / 8.0)::bigint as n1, 2 as n2 from c16),
pad as (select yy.y, xx.x, """ + ", ".join(f"coalesce(b{k}, 0.0::double) as b{k}" for k in _B4) + """ from (select unnest(range(0, n1 * 8)) as y from n) yy cross join (select unnest(range(0, 16)) as x) xx left join c16 on c16.y = yy.y and c16.x = xx.x),
pp as (select y // 8 - di as i, 0 as j, y, x, y - (y // 8 - di) * 8 as py, x as px, b0, b1, b2, b3, n1, n2 from pad, n, (select unnest([0, 1]) as di) a where y // 8 - di between 0 and n1 - 2),
m as (select *, """ + ", ".join(f"b{k} - avg(b{k}) over (partition by i, j) as d{k}" for k in _B4) + """ from pp),
z as (select *, """ + ", ".join(" + ".join(f"({w})::double * d{k}" for k, w in enumerate(ws)) + f" + ({b})::double as z{c}" for c, (ws, b) in enumerate(zip(_W4, (0.1, 0.0, -0.1), strict=True))) + """ from m),
e as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1, exp(z2 - greatest(z0, z1, z2)) as e2 from z),
pr as (select *, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2, """
    + WEIGHT
    + """ as w from e),
bl as (select y, x, sum(p0 * w) as s0, sum(p1 * w) as s1, sum(p2 * w) as s2, sum(w) as sw from pr group by y, x),
q as (select c16.y, c16.x, coalesce(sw, 0.0) as sw, case when sw <> 0 then s0 / sw else 0.0 end as p0, case when sw <> 0 then s1 / sw else 0.0 end as p1, case when sw <> 0 then s2 / sw else 0.0 end as p2 from c16 left join bl using (y, x)),
c as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end::bigint as cls from q)"""
)
LI = "li as (select l_suppkey as y, l_partkey % 64 as x, (sum(l_linenumber) % 5)::bigint as cls from lineitem group by 1, 2)"
RUNS = LI + ", g as (select *, x - row_number() over (partition by y, cls order by x) as grp from li where cls > 0), runs as (select y * 4294967296 + min(x) as run_id, y, cls, min(x) as x0, max(x) as x1 from g group by y, cls, grp)"
COMPONENTS = (
    "recursive "
    + RUNS
    + """, adj as (select a.run_id as a, b.run_id as b from runs a join runs b on a.cls = b.cls and b.y = a.y + 1 and a.x0 <= b.x1 and b.x0 <= a.x1),
links as (select a, b from adj union all select b, a from adj),
reach as (select run_id as node, run_id as label from runs union select links.b as node, reach.label from reach join links on links.a = reach.node where reach.label < links.b),
comp as (select node as run_id, min(label) as component from reach group by node)"""
)
STATS = COMPONENTS + ", st as (select component, min(cls) as cls, sum(x1 - x0 + 1)::bigint as pixels, min(x0) as minx, min(y) as miny, max(x1) + 1 as maxx, max(y) + 1 as maxy from runs join comp using (run_id) group by component)"
RECT = "r as (select o_orderkey as fid, o_orderstatus as status, o_totalprice as price, (o_orderkey % 1100 - 50)::double as x0, (o_custkey % 900 - 40)::double as y0, (o_orderkey % 1100 - 50 + o_orderkey % 37 + 10)::double as x1, (o_custkey % 900 - 40 + o_custkey % 23 + 5)::double as y1 from orders)"
CATS = RECT + ", cats as (select status as name, row_number() over (order by min(fid)) as cid from r group by status)"
RATIO = "(greatest(least(x1, 1000.0) - greatest(x0, 0.0), 0.0) * greatest(least(y1, 800.0) - greatest(y0, 0.0), 0.0) / ((x1 - x0) * (y1 - y0)))"
INT = "{0}::bigint::varchar"
#: Boxes of longitude and latitude from orders, and the UTM series for zone 16 north.
LONLAT = "ll as (select o_orderkey as fid, -90.0::double + (o_orderkey % 500) / 100.0::double as lon0, 20.0::double + (o_custkey % 400) / 10.0::double as lat0, -90.0::double + (o_orderkey % 500) / 100.0::double + 0.5 as lon1, 20.0::double + (o_custkey % 400) / 10.0::double + 0.25 as lat1 from orders)"
_THIRD = 0.0016792203863836474  # third flattening of WGS 84
RECTIFYING = f"({6378137.0 / (1 + _THIRD) * (1 + _THIRD**2 / 4 + _THIRD**4 / 64)!r}::double)"
_SERIES = (_THIRD / 2 - 2 / 3 * _THIRD**2 + 5 / 16 * _THIRD**3, 13 / 48 * _THIRD**2 - 3 / 5 * _THIRD**3, 61 / 240 * _THIRD**3)
UTM = (
    f"s0 as (select fid, radians(lat0) as phi, radians(lon0) - radians(-87.0::double) as lam, {2 * _THIRD**0.5 / (1 + _THIRD)!r}::double as ecc from ll), "
    "s1 as (select fid, lam, (exp(g) - exp(-g)) / 2 as t from (select *, atanh(sin(phi)) - ecc * atanh(ecc * sin(phi)) as g from s0)), "
    "sx as (select fid, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from s1), s2 as (select fid, eta"
    + "".join(f" + {a!r}::double * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_SERIES, 1))
    + " as east, xi"
    + "".join(f" + {a!r}::double * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_SERIES, 1))
    + " as north from sx)"
)


def _join(*names: str) -> str:
    return " || ',' || ".join(INT.format(n) for n in names)


def _tta(variants: str) -> str:
    places = "case t when 0 then py when 1 then 15 - mx when 2 then 15 - py else mx end as ty, case t when 0 then mx when 1 then py when 2 then 15 - mx else 15 - py end as tx"
    return f"with {PATCHES}, v as (select unnest({variants}) as v), a as (select i, j, py, px, b0, v // 10 as m, v % 10 as t, case when v >= 10 then 15 - px else px end as mx from pp, v), b as (select *, {places} from a) select i as patch_row, j as patch_col, py, px, round(avg(b0 * (ty * 16 + tx + 1)), 6) + 0.0 as p from b group by i, j, py, px"


NAMES4 = "['red', 'green', 'blue', 'nir']"
ASSETS = f"a as (select n_name as item, k, {NAMES4}[(n_nationkey + k) % 4 + 1] as common_name, 's' || k || '/' || n_name || '.tif' as href from nation, (select unnest(range(0, 4)) as k) where (n_nationkey + k) % 7 <> 0)"

ORACLE_SQL: dict[str, str] = {
    "segment_mask": f"with {SEGMENT} select y, x, case when ok then cls else 255::bigint end as cls, round(sw, 6) as sw, round(p0, 6) as p0, round(p1, 6) as p1, round(p2, 6) as p2 from c",
    "segment_tiles": f"with {SEGMENT} select y, x, case when ok then cls else 255::bigint end as cls from c",
    "segment_narrow": f"with {NARROW} select x, cls, count(*) as n, round(sum(sw), 6) as sw from c group by x, cls",
    "segment_binary": f"""with {PATCHES}{MEANS}, pr as (select y, x, 1 / (1 + exp(-(1.0::double * (b0 - m0) + -0.5::double * (b1 - m1) + 0.1::double))) as p, {WEIGHT} as w from m), bl as (select y, x, case when sum(w) <> 0 then sum(p * w) / sum(w) else 0.0 end as p from pr group by y, x)
        select y, (p > 0.5)::bigint as cls, count(*) as n, round(sum(p), 6) as p from bl join c64 using (y, x) group by y, (p > 0.5)::bigint""",
    "scan_tiles": f"with {R16} select band, y // 8 as cell_row, x // 8 as cell_col, count(*) as n, round(sum(v), 6) + 0.0 as total, round(min(v), 6) + 0.0 as low, round(max(v), 6) + 0.0 as high from r16 group by 1, 2, 3",
    "band_reorder": f"with {R16} select a.y, a.x, round(a.v, 6) + 0.0 as b1, round(b.v, 6) + 0.0 as b2, round(a.v, 6) + 0.0 as b3 from r16 a join r16 b on a.y = b.y and a.x = b.x and a.band = 3 and b.band = 1",
    "band_reorder_long": f"with {R16} select y, x, o.band::bigint as band, round(v, 6) + 0.0 as v from r16 join (select unnest([1, 2, 3]) as band, unnest([3, 1, 3]) as src) o on o.src = r16.band",
    "band_stack": f"with {R16} select y, band // 2 as band, count(*) as n, round(sum(v), 6) + 0.0 as total from r16 where band in (2, 4) group by 1, 2",
    "nodata_resolve": "select s_suppkey, s_suppkey % 3 <> 0 and s_suppkey % 2 = 0 as is_nan, case when s_suppkey % 3 = 0 then round(s_acctbal, 6) when s_suppkey % 2 <> 0 then 0.0 end as value from supplier",
    "valid_mask": f"with {R16} select y, x, bool_and(round(v, 1) <> 0) as valid from r16 group by y, x",
    "mask_nodata": f"with {LI} select y, x, case when cls <> 3 then cls else 255 end as cls from li",
    "bbox_crop": f"with {C64} select y - 10 as y, x - 19 as x, b0, b1, 733610.7::double as c, 3725133.9::double as f from c64 where x >= 19 and x < 19 + 33 and y >= 10 and y < 10 + 67",
    "pad_grid": f"with {C64} select yy.y, 72::bigint as n, round(coalesce(sum(b0), 0.0), 6) + 0.0 as total, 71::bigint as last from (select unnest(range(0, (select ceil((max(y) + 1) / 12.0)::bigint * 12 from c64))) as y) yy left join c64 on c64.y = yy.y group by yy.y",
    "tile_grid": f"with {C64} select y // 8 as cell_row, x // 8 as cell_col, count(*) as n, round(sum(b0), 6) + 0.0 as total, sum(y % 8 * 100 + x % 8)::bigint as places from c64 group by 1, 2",
    "overlap_patches": f"with {PATCHES} select i as patch_row, j as patch_col, count(*) as n, round(sum(b0), 6) + 0.0 as total, sum(py * 16 + px)::bigint as places from pp group by i, j",
    "patch_skip_nodata": f"""with {LI}, n as (select ceil((max(y) + 1) / 4.0)::bigint as n1, 16 as n2 from li), thin as (select y, x, case when (y // 16 + x // 16) % 3 = 0 then cls else 0 end as v from li),
        p as (select unnest(range(0, n1 - 1)) as i, n2 from n), q as (select i, unnest(range(0, n2 - 1)) as j from p)
        select i as patch_row, j as patch_col, coalesce(bool_or(v <> 0), false) as has_data from q left join thin on y >= i * 4 and y < i * 4 + 8 and x >= j * 4 and x < j * 4 + 8 group by i, j""",
    "patch_predict": f"with {PATCHES}{PROBS} select i as patch_row, j as patch_col, round(sum(p0), 6) as p0, round(sum(p1), 6) as p1, round(sum(p2), 6) as p2 from pr group by i, j",
    "normalize_bands": f"with {R16} select y, x, " + ", ".join(f"round((max(v) filter (where band = {k + 1}) / 255.0::double - {m}::double) / {s}::double, 6) + 0.0 as b{k}" for k, (m, s) in enumerate(((0.405, 0.164), (0.432, 0.173), (0.397, 0.153)))) + " from r16 group by y, x",
    "softmax": f"with {R16}, e as (select *, exp(v) as e, sum(exp(v)) over (partition by y, x) as t from r16) select y, x, " + ", ".join(f"round(max(e / t) filter (where band = {k + 1}), 6) as p{k}" for k in range(4)) + " from e group by y, x",
    "sigmoid": f"with {R16} select y, x, band, round(1 / (1 + exp(-v)), 6) as p from r16",
    "device_select": "select coalesce('cuda:' || min(s_suppkey) filter (where 100 * abs(s_acctbal) / 10000.0 < 70 and (s_suppkey * 37 + 90) % 100 < 70), 'gpu') as device from supplier",
    "gpu_stats": "select s_suppkey as gpu, round(10000.0::double - abs(s_acctbal), 6) as memory_used, 10000.0::double as memory_total from supplier",
    "tta_d4": _tta("[0, 1, 2, 3, 10, 11, 12, 13]"),
    "tta_rotate": _tta("[0, 1]"),
    "tta_flip": _tta("[0, 10, 2, 12]"),
    "hann_weights": f"with g as (select n_nationkey // 5 + 1 as n1, n_nationkey % 5 + 1 as n2 from nation), p as (select n1, n2, unnest(range(0, n1 - 1)) as i from g where n1 > 1 and n2 > 1), q as (select n1, n2, i, unnest(range(0, n2 - 1)) as j from p), a as (select q.*, k // 16 as py, k % 16 as px from q, (select unnest(range(0, 256)) as k)) select n1::bigint as n1, n2::bigint as n2, i, j, py, px, round({WEIGHT}, 6) + 0.0 as w from a",
    "overlap_blend": f"with {PATCHES}{PROBS} select y, x, round(s0, 6) + 0.0 as s0, round(s1, 6) + 0.0 as s1, round(s2, 6) + 0.0 as s2, round(sw, 6) + 0.0 as sw from bl",
    "blend_normalize": "select p_partkey, round(case when p_size % 7 <> 0 then p_retailprice / (p_size % 7) else 0.0 end, 6) as p0, round(case when p_size % 7 <> 0 then p_size / (p_size % 7)::double else 0.0 end, 6) as p1 from part",
    "argmax_class": "select p_partkey, case when p_size % 3 >= p_size % 4 and p_size % 3 >= p_size % 5 then 0 when p_size % 4 >= p_size % 5 then 1 else 2 end::bigint as cls from part",
    "threshold_class": "select l_linenumber::bigint as l_linenumber, (l_discount * 5 > 0.3::double)::bigint as cls, count(*) as n from lineitem group by 1, 2",
    "mask_runs": f"with {RUNS} select run_id, y, cls, x0, x1 from runs",
    "mask_components": f"with {COMPONENTS} select run_id, component from comp",
    "mask_components_strips": f"with {COMPONENTS} select run_id, component from comp",
    "component_area_filter": f"with {STATS} select component, cls, pixels, minx, miny, maxx, maxy from st where pixels * 0.25 >= 1.5",
    "mask_polygons": f"with {STATS} select component, cls::double as value, pixels::double as area, minx::double as minx, miny::double as miny, maxx::double as maxx, maxy::double as maxy from st",
    "polygon_ids": f"with {COMPONENTS} select component, row_number() over (order by component) as feature_id from (select distinct component from comp)",
    "affine_forward": f"with {RECT} select fid as feature_id, round(2 * x0 + 0.5 * y1 + 100, 6) as x, round(-0.25 * x0 + 3 * y1 + 7, 6) as y from r",
    "affine_inverse": f"with {RECT} select fid as feature_id, round((3 * (x0 - 100) - 0.5 * (y1 - 7)) / 6.125, 6) + 0.0 as x, round((2 * (y1 - 7) + 0.25 * (x0 - 100)) / 6.125, 6) + 0.0 as y from r",
    "affine_precision": f"with {RECT} select fid as feature_id, round_even(0.5 * x0 + 10, 0) + 0.0 as ax, round_even(-0.5 * y0 + 20, 0) + 0.0 as ay, round_even(0.5 * x1 + 10, 0) + 0.0 as cx, round_even(-0.5 * y1 + 20, 0) + 0.0 as cy from r",
    "geo_to_px": f"with {RECT} select fid as feature_id, 'scene.tif' as image_fname, x0 as minx, y0 as miny, x1 as maxx, y1 as maxy from r where x0 <= 1000 and x1 >= 0 and y0 <= 800 and y1 >= 0",
    "wkt_parse": "select o_orderkey, o_orderkey % 5 <> 0 and o_orderkey % 7 = 0 as bad, case when o_orderkey % 5 = 0 then 1 when o_orderkey % 7 = 0 then 0 else 4 end::bigint as vertices, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 0.0::double else 20.0::double end as area from orders",
    "web_mercator_bounds": f"with {LONLAT} select fid as feature_id, round(6378137.0::double * radians(lon0), 3) + 0.0 as minx, round(6378137.0::double * ln(tan(pi() / 4 + radians(lat0) / 2)), 3) + 0.0 as miny, round(6378137.0::double * radians(lon1), 3) + 0.0 as maxx, round(6378137.0::double * ln(tan(pi() / 4 + radians(lat1) / 2)), 3) + 0.0 as maxy from ll",
    "utm_forward": f"with {LONLAT}, {UTM} select fid as feature_id, round(500000 + 0.9996::double * {RECTIFYING} * east, 3) + 0.0 as x, round(0.9996::double * {RECTIFYING} * north, 3) + 0.0 as y from s2",
    "utm_round_trip": f"with {LONLAT} select fid as feature_id, round(lon0, 8) + 0.0 as lon, round(lat0, 8) + 0.0 as lat from ll",
    "polygon_area": f"with {RECT} select fid as feature_id, round((x1 - x0) * (y1 - y0) * 0.75, 6) as area from r",
    "polygon_bounds": f"with {RECT} select fid as feature_id, x0 as minx, y0 as miny, x1 as maxx, y1 as maxy from r",
    "overlap_ratio": f"with {RECT} select fid as feature_id, round({RATIO}, 6) + 0.0 as ratio from r",
    "bbox_to_coco": f"with {RECT} select fid as feature_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h from r",
    "polygon_to_coco": f"with {RECT} select fid as feature_id, {_join('x0', 'y0', 'x1', 'y0', 'x0', 'y1', 'x0', 'y0')} as segmentation from r",
    "bbox_overlap_join": f"with {RECT} select fid as feature_id, n_nationkey::bigint as image from r join nation on x0 <= n_nationkey % 5 * 200 + 200 and x1 >= n_nationkey % 5 * 200 and y0 <= n_nationkey // 5 * 160 + 160 and y1 >= n_nationkey // 5 * 160",
    "yolo_labels": f"with {RECT} select (fid % 5)::double as value, count(*) as n, round(sum((x0 + x1) / 2 / 1000), 4) as x, round(sum((y0 + y1) / 2 / 800), 4) as y, round(sum((x1 - x0) / 1000), 4) as w, round(sum((y1 - y0) / 800), 4) as h from r where {RATIO} >= 0.66 group by 1",
    "yolo_boxes": f"with {STATS} select cls as value, round((minx + maxx) / 2.0::double / 64, 6) as x, round((miny + maxy) / 2.0::double / 100, 6) as y, round((maxx - minx) / 64.0::double, 6) as w, round((maxy - miny) / 100.0::double, 6) as h from st",
    "category_ids": f"with {CATS} select name, cid as category_id from cats",
    "category_map_join": f"with {CATS} select name as category_name, cid as category_id, count(*) as n from r join cats on name = status group by 1, 2",
    "preset_include": f"with {RECT} select case when status in ('F', 'P') then status else 'other' end as category_name, case status when 'F' then 3 when 'P' then 7 else 8 end::bigint as category_id, count(*) as n from r group by 1, 2",
    "preset_exclude": f"with {RECT} select status as category_name, case status when 'F' then 3 else 7 end::bigint as category_id, count(*) as n from r where status in ('F', 'P') group by 1, 2",
    "preset_other_id": "select max(n_nationkey)::bigint + 1 as other_id from nation",
    "coco_default_other": "select 'other' as category_name, 1::bigint as category_id, count(*) as n from orders",
    "coco_categories": f"with {CATS} select cid as id, name from cats",
    "annotation_ids": f"with {RECT} select row_number() over (order by fid) + 99 as id, (x1 - x0) * (y1 - y0) as area from r",
    "coco_annotations": f"with {CATS} select row_number() over (order by fid) as id, 1::bigint as image_id, cid as category_id, {_join('x0', 'y0', 'x1', 'y0', 'x1', 'y1', 'x0', 'y1', 'x0', 'y0')} as segmentation, (x1 - x0) * (y1 - y0) as area, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h, 0::bigint as iscrowd from r join cats on name = status",
    "coco_scores": f"with {CATS} select row_number() over (order by fid) as id, cid as category_id, round(price, 6) as score from r join cats on name = status",
    "coco_images": "select n_nationkey::bigint as id, n_name || '.tif' as file_name, n_nationkey::bigint * 10 + 100 as width, n_regionkey::bigint + 50 as height, 1::bigint as license from nation",
    "coco_licenses": "select r_name as name, 'http://licenses.example/' || r_regionkey as url, row_number() over (order by r_regionkey) as id from region",
    "coco_document": f"with {CATS} select count(*) as n_annotations, round(sum((x1 - x0) * (y1 - y0)), 6) as area, (select string_agg(name, ',' order by cid) from cats) as names, (select count(*) from nation) as n_images from r",
    "label_union": f"with {RECT}, u as (select status, null as price from r union all select null, price from r) select status, price is null as no_price, count(*) as n from u group by 1, 2",
    "geojson_feature": f"""with {RECT}, p as (select fid, unnest([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]) as p, unnest(range(0, 5)) as k from r)
        select '{{"type":"Feature","properties":{{"value":' || (fid % 5)::double || '}},"geometry":{{"type":"Polygon","coordinates":[[' || string_agg('[' || p[1] || ',' || p[2] || ']', ',' order by k) || ']]}}}}' as feature from p group by fid""",
    "geojson_scan": f"with {RECT} select fid::double as value, (x1 - x0) * (y1 - y0) as area, x0 as minx, y1 as maxy from r",
    "zarr_transform_parse": "select p_partkey, 0.5::double as a, 0.0::double as b, p_partkey::double as c, 0.0::double as d, -0.25::double as e, p_size::double as f from part",
    "stac_assets": f"with {ASSETS} select item, common_name, href from a qualify k = max(k) over (partition by item, common_name)",
    "stac_band_select": f"with {ASSETS} select item, case common_name when 'blue' then 1 else 2 end::bigint as band, common_name, href from a where common_name in ('blue', 'red') qualify k = max(k) over (partition by item, common_name)",
    "manifest_sorted": "select '/data/img' || p_partkey || '.tif' as tif, case when p_size % 2 <> 0 then '/data/' || p_name end as gpkg, p_type as split, null::varchar as aoi_id, row_number() over (order by p_type, p_partkey) as place from part",
    "is_tiff_path": "select p_partkey, replace(p_name, ' ', '/') || ['.tif', '.TIFF', '.tiff.png', 'tif', '.Tif'][p_partkey % 5 + 1] as path, p_partkey % 5 in (0, 1, 4) as is_tiff from part",
    "is_tiff_url": "select page_id, page_id % 5 in (0, 1, 4) as made, regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '(?i)\\.(tiff|tif)$') as own from pages",
    "output_names": "select p_partkey, replace(p_name, ' ', '_') || case p_partkey % 3 when 2 then '.json' else '' end || '_mask_0a1b2c.tif' as mask, replace(p_name, ' ', '_') || case p_partkey % 3 when 2 then '.json' else '' end || '_yolo_0a1b2c.csv' as yolo from part",
    "mask_profile": "select s_suppkey, 'GTiff' as driver, 1::bigint as count, 'uint8' as dtype, s_suppkey + 10 as width, s_suppkey + 20 as height, 'YES' as bigtiff, 'lzw' as compress from supplier",
}

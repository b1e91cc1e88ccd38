"""DuckDB SQL for the registered queries, written from the rules of each operator: nested conditions, no grid, no edge tricks."""

from __future__ import annotations

from functools import cache

SCENE = """
lines as (
  with h as (select o_orderkey::bigint k, (o_orderkey::bigint * 7919 + o_custkey::bigint * 104729 + 12345) % 1000003 h from orders)
  select k // 30 as page_id, (k % 30)::int as line_idx,
    cast((h % 7) * 100 + (h // 7) % (case when k % 5 = 0 then 25 else 7 end) as double) as x1,
    cast((h // 49) % 7 * 100 + (h // 847) % 7 as double) as y1,
    cast((h % 7) * 100 + (h // 5929) % 7 + case when k % 2 = 0 then 100 * (1 + (h // 41503) % 4) else 0 end as double) as x2,
    cast((h // 49) % 7 * 100 + (h // 290521) % 3 + case when k % 2 = 0 then 0 else 100 * (1 + (h // 41503) % 4) end as double) as y2,
    cast(h % 1000 as double) / 1000 as score from h),
boxes as (
  with h as (select c_custkey::bigint k, (c_custkey::bigint * 15485863 + c_nationkey::bigint * 32452843 + 777) % 1000003 h from customer)
  select k // 3 as page_id, case when k % 9 = 8 then (case when h % 2 = 0 then 'ground' else 'power' end) else 'device' end as kind, (k % 3)::int as box_idx,
    cast(10 + (k % 3) * 250 as double) as x1, cast(30 + (h % 8) * 60 as double) as y1, cast(110 + (k % 3) * 250 as double) as x2, cast(180 + (h % 8) * 60 as double) as y2 from h),
signals as (
  with h as (select p_partkey::bigint k, (p_partkey::bigint * 49979687 + p_size::bigint * 8191 + 99) % 1000003 h, p_name || '-' || p_partkey as raw_text from part)
  select h.k // 4 as page_id, (h.k % 4)::int as sig_idx, raw_text,
    case h % 6 when 0 then b.x1 + 2 when 5 then b.x2 + 45 else b.x1 + 38 end as x1,
    case h % 6 when 0 then b.y1 + 5 when 1 then b.y1 - 30 when 2 then b.y1 + 20 when 3 then b.y1 + 80 when 4 then b.y2 + 20 else b.y1 + 70 end as y1,
    case h % 6 when 0 then b.x1 + 26 when 5 then b.x2 + 105 else b.x1 + 62 end as x2,
    case h % 6 when 0 then b.y1 + 17 when 1 then b.y1 - 18 when 2 then b.y1 + 32 when 3 then b.y1 + 92 when 4 then b.y2 + 32 else b.y1 + 82 end as y2
  from h join boxes b on b.page_id = h.k // 4 and b.box_idx = case when h.h % 6 = 5 then (h.h // 6) % 2 else (h.h // 6) % 3 end)"""

SPLIT = """
split as (
  with h as (select c_custkey::bigint k, (c_custkey::bigint * 15485863 + c_nationkey::bigint * 32452843 + 777) % 1000003 h from customer)
  select k // 6 as page_id, (k % 6)::int as box_idx, cast((k % 2) * 400 + h % 20 as double) as x1, cast((h // 20) % 7 * 2600 as double) as y1,
    cast((k % 2) * 400 + h % 20 + 100 + (h // 140) % 70 as double) as x2, cast((h // 20) % 7 * 2600 + 90 + (h // 9800) % 50 as double) as y2 from h)"""

PINS = """
signals as (
  with e as (select page_id, line_idx * 2 as sig_idx, x1 as x, y1 as y from lines union all select page_id, line_idx * 2 + 1, x2, y2 from lines)
  select page_id, sig_idx::int as sig_idx, 'P' || ((page_id * 7 + sig_idx * 3) % 6) as raw_text, x - 12 as x1, y - 6 as y1, x + 14 as x2, y + 8 as y2 from e)"""

IMAGES = "pics as (select c_custkey::bigint as page_id, (60 + c_custkey * 37 % 4000)::int as width, (60 + c_custkey * 53 % 3000)::int as height from customer)"

DETECTED = """
det as (
  with h as (select p_partkey::bigint k, (p_partkey::bigint * 49979687 + p_size::bigint * 8191 + 99) % 1000003 h, p_name from part),
  d as (select k // 10 as page_id, (k % 10)::int as det_idx, (h % 6)::int as class_id, cast(h % 1000 as double) / 1000 as confidence,
    h % 900 - 50 + 0.75 as x_min, (h // 7) % 700 - 40 + 0.5 as y_min, h % 900 - 50 + (h // 11) % 90 + 0.25 as x_max, (h // 7) % 700 - 40 + (h // 13) % 60 + 0.9 as y_max, '  ' || p_name || ' ' as text from h)
  select page_id, det_idx, class_id, case class_id when 0 then 'signalName' when 1 then 'device' when 2 then 'power' when 3 then 'ground' when 4 then 'deviceName' end as class_name, confidence,
    trunc(x_min)::int as x_min, trunc(y_min)::int as y_min, trunc(x_max)::int as x_max, trunc(y_max)::int as y_max, text from d where class_id < 4 and confidence >= 0.05),
roi as (
  with c as (select det.* exclude (x_min, y_min, x_max, y_max), case when class_id = 0 then greatest(0, least(width, x_min)) else x_min end as x_min, case when class_id = 0 then greatest(0, least(height, y_min)) else y_min end as y_min,
      case when class_id = 0 then greatest(0, least(width, x_max)) else x_max end as x_max, case when class_id = 0 then greatest(0, least(height, y_max)) else y_max end as y_max from det join pics using (page_id))
  select * from c where class_id <> 0 or (x_max > x_min and y_max > y_min)),
objs as (
  select page_id, (row_number() over (partition by page_id order by (class_id <> 0), det_idx) - 1)::int as obj_idx, class_name as label, x_min, y_min, x_max, y_max, case when class_id = 0 then text else '' end as text from roi)"""


def tiles(overlap: float) -> str:
    stride = 1024 - overlap
    return f"""tile as (
  with n as (select *, ceil((width - {overlap}) / {stride})::int as cols, ceil((height - {overlap}) / {stride})::int as rows_ from pics),
  r as (select *, unnest(range(rows_)) as row from n where rows_ > 0 and cols > 0), c as (select *, unnest(range(cols)) as col from r)
  select page_id, row::int as row, col::int as col, trunc(col * {stride})::int as x1, trunc(row * {stride})::int as y1,
    least(trunc(col * {stride})::int + 1024, width) as x2, least(trunc(row * {stride})::int + 1024, height) as y2 from c)"""


def dist(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt((({a}) - ({c})) * (({a}) - ({c})) + (({b}) - ({d})) * (({b}) - ({d})))"


def ends(lines: str, pre: str) -> str:
    """Endpoints, their clusters by reachability, junctions and edges, as CTEs whose names begin with ``pre``."""
    return f"""
{pre}pts as (select page_id, line_idx * 2 as pi, x1 as x, y1 as y from {lines} union all select page_id, line_idx * 2 + 1, x2, y2 from {lines}),
{pre}near as (select a.page_id, a.pi as a, b.pi as b from {pre}pts a join {pre}pts b on a.page_id = b.page_id and a.pi < b.pi and {dist('a.x', 'a.y', 'b.x', 'b.y')} < 13),
{pre}link as (select page_id, a, b from {pre}near union select page_id, b, a from {pre}near),
{pre}reach as (select page_id, pi as a, pi as b from {pre}pts union select r.page_id, r.a, l.b from {pre}reach r join {pre}link l on l.page_id = r.page_id and l.a = r.b),
{pre}root as (select page_id, a as pi, min(b) as root from {pre}reach group by page_id, a),
{pre}cl as (select p.page_id, p.pi, p.x, p.y, (dense_rank() over (partition by p.page_id order by root) - 1)::int as jid from {pre}pts p join {pre}root r on r.page_id = p.page_id and r.pi = p.pi),
{pre}junc as (select page_id, jid, avg(x) as x, avg(y) as y from {pre}cl group by page_id, jid),
{pre}edge as (select distinct a.page_id, least(a.jid, b.jid) as a, greatest(a.jid, b.jid) as b from {pre}cl a join {pre}cl b on a.page_id = b.page_id and a.pi % 2 = 0 and b.pi = a.pi + 1 where a.jid <> b.jid)"""


def entries(lines: str, boxes: str, pre: str) -> str:
    sides = [("bx1", "by1", "bx2", "by1"), ("bx2", "by1", "bx2", "by2"), ("bx2", "by2", "bx1", "by2"), ("bx1", "by2", "bx1", "by1")]
    parts = []
    for i, (x3, y3, x4, y4) in enumerate(sides):
        den = f"((x1 - x2) * ({y3} - {y4}) - (y1 - y2) * ({x3} - {x4}))"
        parts.append(
            f"select page_id, kind, box_idx, line_idx, {i} as edge_idx, x1, y1, x2, y2, case when abs({den}) < 1e-10 then null else ((x1 - {x3}) * ({y3} - {y4}) - (y1 - {y3}) * ({x3} - {x4})) / {den} end as t, "
            f"case when abs({den}) < 1e-10 then null else -((x1 - x2) * (y1 - {y3}) - (y1 - y2) * (x1 - {x3})) / {den} end as u from {pre}lb"
        )
    return f"""
{pre}wide as (select page_id, kind, box_idx, greatest(0, x1 - 25) as bx1, greatest(0, y1 - 25) as by1, x2 + 25 as bx2, y2 + 25 as by2 from {boxes}),
{pre}lb as (select l.page_id, l.line_idx, l.x1, l.y1, l.x2, l.y2, kind, box_idx, bx1, by1, bx2, by2 from {lines} l join {pre}wide w on w.page_id = l.page_id),
{pre}met as ({' union all '.join(parts)}),
{pre}cnt as (select page_id, count(*) as n from {pre}junc group by page_id),
{pre}ent as (select m.page_id, kind, box_idx, line_idx, edge_idx,
  (n + row_number() over (partition by m.page_id order by case kind when 'device' then 0 when 'ground' then 1 else 2 end, box_idx, line_idx, edge_idx) - 1)::int as jid,
  x1 + t * (x2 - x1) as x, y1 + t * (y2 - y1) as y from {pre}met m join {pre}cnt c on c.page_id = m.page_id where t >= 0 and t <= 1 and u >= 0 and u <= 1)"""


def merge_steps(boxes: str, pre: str) -> str:
    """Three attempts to merge devices that a drawing splits, one after another; boxes has page_id, box_idx, corners."""
    out = [
        f"{pre}s0 as (select *, row_number() over (partition by page_id order by (x2 - x1) * (y2 - y1) desc, box_idx) as rk, count(*) over (partition by page_id) as n from {boxes})",
        f"{pre}g0 as (select page_id, box_idx as ref, box_idx as i, 0 as o from {pre}s0 where false)",
    ]
    for k in (1, 2, 3):
        s, g0 = f"{pre}s{k - 1}", f"{pre}g{k - 1}"
        wide = "(r.x2 - r.x1) <> 0 and (b.x2 - b.x1) <> 0 and abs((r.x2 - r.x1) - (b.x2 - b.x1)) / greatest(r.x2 - r.x1, b.x2 - b.x1) <= 0.3 and abs((b.x1 + b.x2) / 2 - (r.x1 + r.x2) / 2) <= (r.x2 - r.x1) * 0.15"
        gap = lambda top, bottom, most: f"((b.y2 < {top} and {top} - b.y2 <= {most}) or (b.y1 > {bottom} and b.y1 - {bottom} <= {most}))"
        cand = lambda test, r=k, s=s: f"select r.page_id, r.box_idx as ref, b.box_idx as i, b.box_idx + 1 as o from {pre}r{r} r join {s} b on b.page_id = r.page_id and b.box_idx <> r.box_idx and {wide} and {test}"
        out += [
            f"{pre}r{k} as (select * from {s} where rk = {k} and n > 1 and page_id not in (select page_id from {g0}))",
            f"{pre}n{k} as ({cand(gap('r.y1', 'r.y2', 4000))})",
            f"{pre}f{k} as (select * from ({cand(gap('(r.y1 - 4000)', '(r.y2 + 4000)', 8000))}) where page_id not in (select page_id from {pre}n{k}))",
            f"{pre}g{k} as (select * from {g0} union all select * from {pre}n{k} union all select * from {pre}f{k} union all select distinct page_id, ref, ref, 0 from (select * from {pre}n{k} union all select * from {pre}f{k}))",
            f"{pre}s{k} as (select s.page_id, s.box_idx, s.x1, case when r.box_idx is not null then s.y1 - 350 else s.y1 end as y1, s.x2, case when r.box_idx is not null then s.y2 + 300 else s.y2 end as y2, s.rk, s.n "
            f"from {s} s left join {pre}r{k} r on r.page_id = s.page_id and r.box_idx = s.box_idx and s.page_id not in (select page_id from {pre}g{k}))",
        ]
    out += [
        f"{pre}one as (select s.page_id, min(x1) as x1, min(y1) - 350 as y1, max(x2) as x2, max(y2) + 300 as y2, string_agg(s.box_idx::varchar, '-' order by g.o) as merged_from from {pre}s3 s join {pre}g3 g on g.page_id = s.page_id and g.i = s.box_idx group by s.page_id)",
        f"{pre}every as (select page_id, -1 as o, x1, y1, x2, y2, merged_from from {pre}one union all select page_id, box_idx, x1, y1, x2, y2, null from {pre}s3 s where not exists (select 1 from {pre}g3 g where g.page_id = s.page_id and g.i = s.box_idx))",
        f"{pre}merged as (select page_id, (row_number() over (partition by page_id order by o) - 1)::int as box_idx, x1, y1, x2, y2, merged_from from {pre}every)",
    ]
    return ",\n".join(out)


def names(devices: str, pre: str) -> str:
    """Names of devices (page_id, box_idx, corners) from signals."""
    return f"""
{pre}ds as (select d.page_id, d.box_idx, d.x1, d.y1, d.x2, d.y2, s.sig_idx, s.raw_text, s.x1 as sx1, s.y1 as sy1, s.x2 as sx2, s.y2 as sy2, (s.x1 + s.x2) / 2 as cx, (s.y1 + s.y2) / 2 as cy,
  coalesce(s.x1 >= d.x1 and s.x2 <= d.x2 and s.y1 >= d.y1 and s.y2 <= d.y2, false) as held from {devices} d left join signals s on s.page_id = d.page_id),
{pre}dr as (select *, held and sx2 - x1 < 30 and abs(cy - y1) < 45 as lft, held and x2 - sx1 < 30 and abs(cy - y1) < 45 as rgt from {pre}ds),
{pre}rule as (select *, case when lft then {dist('cx', 'cy', 'x1', 'y1')} when rgt then {dist('cx', 'cy', 'x2', 'y1')} else abs(cy - y1) end as away,
  case when lft or rgt then 1 when sy2 < y1 and cx between x1 - 20 and x2 + 20 and cy between y1 - 50 and y1 then 2 when sy1 > y1 and cx between x1 - 20 and x2 + 20 and cy between y1 and y1 + 50 then 3
    when held and abs(cx - (x1 + x2) / 2) <= 20 then 4 end as rule from {pre}dr),
{pre}top as (select page_id, box_idx, rule, raw_text from {pre}rule where rule is not null qualify row_number() over (partition by page_id, box_idx order by rule, away, sig_idx) = 1),
{pre}low as (select page_id, box_idx, 5 as rule, raw_text from {pre}rule r where sy1 > y2 and cx between x1 - 30 and x2 + 30 and cy > y2 and cy <= y2 + 80
  and not exists (select 1 from {pre}top t where t.page_id = r.page_id and t.box_idx = r.box_idx) and not exists (select 1 from {pre}ds q where q.page_id = r.page_id and q.box_idx = r.box_idx and q.held)
  qualify row_number() over (partition by page_id, box_idx order by abs(cy - y2), sig_idx) = 1),
{pre}named as (select d.page_id, d.box_idx, coalesce(t.rule, l.rule, 0)::int as rule, coalesce(t.raw_text, l.raw_text, 'Unknown') as raw_text from {devices} d
  left join {pre}top t on t.page_id = d.page_id and t.box_idx = d.box_idx left join {pre}low l on l.page_id = d.page_id and l.box_idx = d.box_idx)"""


def aux(boxes: str, pre: str) -> str:
    return f"""
{pre}two as (select s.page_id, s.sig_idx from signals s join {boxes} b on b.page_id = s.page_id and b.kind = 'device' and not (s.x2 + 50 < b.x1 or s.x1 - 50 > b.x2 or s.y2 + 50 < b.y1 or s.y1 - 50 > b.y2) group by s.page_id, s.sig_idx having count(*) = 2),
{pre}aux as (select s.page_id, (coalesce((select max(line_idx) + 1 from lines l where l.page_id = s.page_id), 0) + row_number() over (partition by s.page_id order by s.sig_idx) - 1)::int as line_idx,
  case when x2 - x1 >= y2 - y1 then x1 - 50 else (x1 + x2) / 2 end as x1, case when x2 - x1 >= y2 - y1 then (y1 + y2) / 2 else y1 - 50 end as y1,
  case when x2 - x1 >= y2 - y1 then x2 + 50 else (x1 + x2) / 2 end as x2, case when x2 - x1 >= y2 - y1 then (y1 + y2) / 2 else y2 + 50 end as y2, 1::double as score, true as is_auxiliary
  from signals s join {pre}two t on t.page_id = s.page_id and t.sig_idx = s.sig_idx)"""


def flow() -> list[str]:
    """The graph flow: merged and named boxes, all lines, clusters, entries, spliced and contracted graph, paths, labels."""
    proj = "greatest(0, least(1, ((e.x - c.x1) * ((c.x2 - c.x1) / len) + (e.y - c.y1) * ((c.y2 - c.y1) / len)) / len))"
    steps = [
        "dev as (select page_id, box_idx, x1, y1, x2, y2 from boxes where kind = 'device')",
        merge_steps("dev", "m_"),
        names("m_merged", "m_"),
        "fb as (select d.page_id, 'device' as kind, d.box_idx, n.raw_text, x1, y1, x2, y2 from m_merged d join m_named n on n.page_id = d.page_id and n.box_idx = d.box_idx "
        "union all select page_id, kind, box_idx, case kind when 'power' then 'KL30' else 'GND' end, x1, y1, x2, y2 from boxes where kind <> 'device')",
        aux("fb", "f_"),
        "fl as (select page_id, line_idx, x1, y1, x2, y2, score, false as is_auxiliary from lines where score >= 0.05 union all select page_id, "
        "(line_idx - coalesce((select max(line_idx) + 1 from lines l where l.page_id = a.page_id), 0) + coalesce((select max(line_idx) + 1 from lines l where l.page_id = a.page_id and score >= 0.05), 0))::int, x1, y1, x2, y2, score, is_auxiliary from f_aux a)",
        ends("fl", "f_"),
        entries("fl", "fb", "f_"),
        "nodes as (select page_id, jid, x, y from f_junc union all select page_id, jid, x, y from f_ent)",
        f"cut as (select l.page_id, l.line_idx, x1, y1, x2, y2, {dist('x2', 'y2', 'x1', 'y1')} as len, min(jid) as turn from fl l join f_ent e on e.page_id = l.page_id and e.line_idx = l.line_idx group by all)",
        f"st as (select c.page_id, c.line_idx, n.jid from cut c join nodes n on n.page_id = c.page_id qualify row_number() over (partition by c.page_id, c.line_idx order by {dist('n.x', 'n.y', 'x1', 'y1')}, jid) = 1)",
        f"fin as (select c.page_id, c.line_idx, n.jid from cut c join nodes n on n.page_id = c.page_id where {dist('n.x', 'n.y', 'x2', 'y2')} < 26 qualify row_number() over (partition by c.page_id, c.line_idx order by {dist('n.x', 'n.y', 'x2', 'y2')}, jid) = 1)",
        f"on_ as (select c.page_id, c.line_idx, c.turn, st.jid as ep1, fin.jid as ep2, e.jid, {proj} as t from cut c join st on st.page_id = c.page_id and st.line_idx = c.line_idx "
        "join fin on fin.page_id = c.page_id and fin.line_idx = c.line_idx join f_ent e on e.page_id = c.page_id and e.line_idx = c.line_idx where len >= 1e-6)",
        "ch as (select page_id, line_idx, turn, ep1, ep2, list_concat(list_concat([ep1], list(jid order by t, jid)), [ep2]) as ns from on_ group by page_id, line_idx, turn, ep1, ep2)",
        "adds as (select page_id, turn, ns, unnest(range(1, len(ns))) as i from ch)",
        "log as (select page_id, a, b, -1 as turn, 1 as op from f_edge union all select page_id, least(ep1, ep2), greatest(ep1, ep2), turn, 0 from ch union all select page_id, least(ns[i], ns[i + 1]), greatest(ns[i], ns[i + 1]), turn, 1 from adds)",
        "rebuilt as (select page_id, a, b from log qualify row_number() over (partition by page_id, a, b order by turn desc, op desc) = 1 and op = 1)",
    ]
    steps[-1] = "rebuilt as (select page_id, a, b from (select *, row_number() over (partition by page_id, a, b order by turn desc, op desc) as rn from log) where rn = 1 and op = 1)"
    # Contraction, signal by signal: a page has four at most.
    steps += [
        "two180 as (select s.page_id, s.sig_idx from signals s join fb b on b.page_id = s.page_id and b.kind = 'device' and not (s.x2 + 180 < b.x1 or s.x1 - 180 > b.x2 or s.y2 + 180 < b.y1 or s.y1 - 180 > b.y2) group by s.page_id, s.sig_idx having count(*) = 2)",
        "inbox as (select n.page_id, s.sig_idx, n.jid, n.x, n.y from nodes n join signals s on s.page_id = n.page_id and n.x between s.x1 and s.x2 and n.y between s.y1 and s.y2 where not exists (select 1 from two180 t where t.page_id = s.page_id and t.sig_idx = s.sig_idx))",
        "way as (select n.page_id, n.jid, bool_or(abs(l.x2 - l.x1) > abs(l.y2 - l.y1) * 2) as h, bool_or(abs(l.y2 - l.y1) > abs(l.x2 - l.x1) * 2) as v from (select distinct page_id, jid, x, y from inbox) n join fl l on l.page_id = n.page_id "
        "and ((abs(n.x - l.x1) < 5 and abs(n.y - l.y1) < 5) or (abs(n.x - l.x2) < 5 and abs(n.y - l.y2) < 5)) group by n.page_id, n.jid)",
        "cand as (select i.*, case when h then 'H' else 'V' end as way, case when h then y else x end as val from inbox i join way w on w.page_id = i.page_id and w.jid = i.jid where h <> v)",
        "mg_ as (select page_id, jid, sig_idx, way, 0::hugeint as run, x, y from cand where false)",
    ]
    before = "mg_"
    for k in range(4):
        steps += [
            f"c{k} as (select * from cand c where sig_idx = {k} and not exists (select 1 from {before} m where m.page_id = c.page_id and m.jid = c.jid))",
            f"b{k} as (select *, case when val - lag(val) over (partition by page_id, way order by val, jid) < 10 then 0 else 1 end as brk from c{k})",
            f"u{k} as (select *, sum(brk) over (partition by page_id, way order by val, jid) as run from b{k})",
            f"v{k} as (select *, count(*) over (partition by page_id, way, run) as n from u{k})",
            f"mg{k} as (select * from {before} union all select page_id, jid, sig_idx, way, run, x, y from v{k} where n > 1)",
        ]
        before = f"mg{k}"
    steps += [
        "tops as (select page_id, max(jid) as top from nodes group by page_id)",
        "rel as (select m.page_id, m.jid, (top + dense_rank() over (partition by m.page_id order by sig_idx, way, run))::int as new_jid, avg(x) over w as x, avg(y) over w as y from mg3 m join tops t on t.page_id = m.page_id window w as (partition by m.page_id, sig_idx, way, run))",
        "moved as (select e.page_id, e.a = e.b as own, ra.new_jid is not null as touched, coalesce(ra.new_jid, e.a) as a, coalesce(rb.new_jid, e.b) as b from rebuilt e left join rel ra on ra.page_id = e.page_id and ra.jid = e.a left join rel rb on rb.page_id = e.page_id and rb.jid = e.b)",
        "graph as (select distinct page_id, least(a, b) as a, greatest(a, b) as b from moved where a <> b or (own and not touched))",
        "allnodes as (select page_id, jid, x, y from nodes union all select distinct page_id, new_jid, x, y from rel)",
        "gids as (select *, (row_number() over (partition by page_id order by case kind when 'device' then 0 when 'ground' then 1 else 2 end, box_idx) - 1)::int as gid from fb)",
        "owner as (select e.page_id, e.jid, g.gid from f_ent e join gids g on g.page_id = e.page_id and g.kind = e.kind and g.box_idx = e.box_idx)",
        "step as (select s.page_id, u, v, o.gid from (select page_id, a as u, b as v from graph union select page_id, b, a from graph) s left join owner o on o.page_id = s.page_id and o.jid = v where u <> v)",
        "walk as (select page_id, gid as src, jid as last, [jid] as path, null::int as dst from owner union all select w.page_id, src, v, list_append(path, v), s.gid from walk w join step s on s.page_id = w.page_id and s.u = w.last where w.dst is null and len(path) < 20 and not list_contains(path, v) and (s.gid is null or s.gid > src))",
        "wpaths as (select w.page_id, src as from_gid, dst as to_gid, path from walk w join gids a on a.page_id = w.page_id and a.gid = src join gids b on b.page_id = w.page_id and b.gid = dst where dst is not null "
        "and case when least(a.x2, b.x2) <= greatest(a.x1, b.x1) or least(a.y2, b.y2) <= greatest(a.y1, b.y1) then 0 else (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) "
        "- (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) end <= 0.6)",
        "seg as (select p.page_id, path, i, path[i] as ja, path[i + 1] as jb from (select *, unnest(range(1, len(path))) as i from wpaths) p)",
        "segxy as (select s.page_id, path, i, a.x as x, a.y as y, b.x as ex, b.y as ey from seg s join allnodes a on a.page_id = s.page_id and a.jid = ja join allnodes b on b.page_id = s.page_id and b.jid = jb)",
        f"lab as (select s.page_id, s.path, g.sig_idx, g.raw_text, bool_or({hits('s.x', 's.y', 's.ex', 's.ey', 'g')}) as hit, min({to_segment('(g.x1 + g.x2) / 2', '(g.y1 + g.y2) / 2', 's.x', 's.y', 's.ex', 's.ey')}) as d, bool_or((g.y1 + g.y2) / 2 < (s.y + s.ey) / 2 - 5) as above from segxy s join signals g on g.page_id = s.page_id group by all)",
        "best as (select page_id, path, raw_text from lab where hit or (above and d < 50) qualify row_number() over (partition by page_id, path order by case when hit then 0 else d end, sig_idx) = 1)",
        "conn as (select p.page_id, a.raw_text as from_device, b.raw_text as to_device, a.kind as from_type, b.kind as to_type, case when a.kind = 'device' and b.kind = 'device' then coalesce(t.raw_text, '') end as signal, p.path[1] as from_entry, p.path[-1] as to_entry, p.path "
        "from wpaths p join gids a on a.page_id = p.page_id and a.gid = from_gid join gids b on b.page_id = p.page_id and b.gid = to_gid left join best t on t.page_id = p.page_id and t.path = p.path)",
    ]
    return steps


def turned(a: tuple, b: tuple, c: tuple) -> str:
    return f"(({c[1]} - {a[1]}) * ({b[0]} - {a[0]}) > ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def hits(x: str, y: str, ex: str, ey: str, b: str) -> str:
    """A segment with an end in box b or that crosses one of its sides."""
    inside = lambda px, py: f"({px} between {b}.x1 and {b}.x2 and {py} between {b}.y1 and {b}.y2)"
    corners = [(f"{b}.x1", f"{b}.y1"), (f"{b}.x2", f"{b}.y1"), (f"{b}.x2", f"{b}.y2"), (f"{b}.x1", f"{b}.y2")]
    p, q = (x, y), (ex, ey)
    cross = [f"({turned(p, r, s)} <> {turned(q, r, s)} and {turned(p, q, r)} <> {turned(p, q, s)})" for r, s in zip(corners, corners[1:] + corners[:1], strict=True)]
    return " or ".join([inside(x, y), inside(ex, ey), *cross])


def to_segment(px: str, py: str, x: str, y: str, ex: str, ey: str) -> str:
    dx, dy = f"({ex} - {x})", f"({ey} - {y})"
    t = f"greatest(0, least(1, (({px} - {x}) * {dx} + ({py} - {y}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"case when {dx} = 0 and {dy} = 0 then {dist(px, py, x, y)} else {dist(px, py, f'{x} + {t} * {dx}', f'{y} + {t} * {dy}')} end"


CONFLICT = f"""
ranked as (select *, row_number() over (partition by page_id order by score desc, line_idx) as r, (row_number() over (partition by page_id order by score desc, line_idx))::int as rr from {{lines}}),
conf as (select a.page_id, a.r, list(b.rr) as better from ranked a join ranked b on a.page_id = b.page_id and b.r < a.r and least(({dist('a.x1', 'a.y1', 'b.x1', 'b.y1')} + {dist('a.x2', 'a.y2', 'b.x2', 'b.y2')}) / 2, ({dist('a.x1', 'a.y1', 'b.x2', 'b.y2')} + {dist('a.x2', 'a.y2', 'b.x1', 'b.y1')}) / 2) < 10 group by a.page_id, a.r),
todo as (select k.page_id, k.r, k.rr, coalesce(c.better, []) as better from ranked k left join conf c on c.page_id = k.page_id and c.r = k.r),
keep as (select page_id, r, [rr] as kept from todo where r = 1 union all select t.page_id, t.r, case when list_has_any(k.kept, t.better) then k.kept else list_append(k.kept, t.rr) end from keep k join todo t on t.page_id = k.page_id and t.r = k.r + 1),
final as (select page_id, max_by(kept, r) as kept from keep group by page_id),
kept as (select k.* from ranked k join final f on f.page_id = k.page_id and list_contains(f.kept, k.rr))"""

ENDPOINT = f"""
es as (select e.page_id, pi, sig_idx, raw_text, case when e.x between s.x1 - 8 and s.x2 + 8 and e.y between s.y1 - 8 and s.y2 + 8 then 'in_box' when {dist('e.x', 'e.y', '(s.x1 + s.x2) / 2', '(s.y1 + s.y2) / 2')} < 30 then 'near_box' end as method,
  {dist('e.x', 'e.y', '(s.x1 + s.x2) / 2', '(s.y1 + s.y2) / 2')} as d from {{pts}} e join signals s on s.page_id = e.page_id),
em as (select page_id, pi, sig_idx, raw_text, method from es where method is not null qualify row_number() over (partition by page_id, pi order by method, case when method = 'near_box' then d end, sig_idx) = 1)"""


RECORDED = """
recorded as (
  with h as (select p_partkey::bigint k, (p_partkey::bigint * 49979687 + p_size::bigint * 8191 + 99) % 1000003 h from part)
  select k, h, k // 10 as page_id, (k % 10)::int as det_idx, (h % 6)::int as class_id, cast(h % 1000 as double) / 1000 as confidence,
    (h % 900 - 50 + 0.75)::double as x_min, ((h // 7) % 700 - 40 + 0.5)::double as y_min, (h % 900 - 50 + (h // 11) % 90 + 0.25)::double as x_max, ((h // 7) % 700 - 40 + (h // 13) % 60 + 0.9)::double as y_max from h)"""

#: Greedy suppression, one rank after another: what a kept better one of the class covers by more than a tenth goes.
SUPPRESSED = """
crowd as (select k // 200 as page_id, (k % 200)::int as det_idx, class_id, confidence, x_min, y_min, x_max, y_max from recorded where confidence >= 0.05),
cranked as (select *, (row_number() over (partition by page_id order by confidence desc, det_idx))::int as r from crowd),
cmet as (select a.page_id, a.r, b.r as better, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min) as w, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) as h,
  (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) as areas from cranked a join cranked b on a.page_id = b.page_id and a.class_id = b.class_id and b.r < a.r),
cbetter as (select page_id, r, list(better) as better from cmet where w > 0 and h > 0 and w * h / (areas - w * h) > 0.1 group by page_id, r),
ctodo as (select c.page_id, c.r, coalesce(b.better, []) as better from cranked c left join cbetter b on b.page_id = c.page_id and b.r = c.r),
ckeep as (select page_id, r, [r] as kept from ctodo where r = 1 union all
  select t.page_id, t.r, case when list_has_any(k.kept, t.better) then k.kept else list_append(k.kept, t.r) end from ckeep k join ctodo t on t.page_id = k.page_id and t.r = k.r + 1),
cfinal as (select page_id, max_by(kept, r) as kept from ckeep group by page_id)"""

#: Lines that begin in a tile; a tile one of whose lines fails has none.
TILE_LINES = """
begun as (select t.page_id, t.row, t.col, l.line_idx, l.x1, l.y1, l.x2, l.y2, l.score, round(l.score * 1000)::int % 97 = 0 as fails from tile t join lines l on l.page_id = t.page_id and l.x1 >= t.x1 and l.x1 < t.x2 and l.y1 >= t.y1 and l.y1 < t.y2),
sound as (select * from begun b where not exists (select 1 from begun f where f.fails and f.page_id = b.page_id and f.row = b.row and f.col = b.col))"""

SPLIT_TEXTS = "stext as (select c_custkey::bigint // 6 as page_id, (c_custkey % 6)::int as box_idx, case c_custkey % 4 when 0 then '' when 1 then 'Unknown' when 2 then c_name end as raw_text from customer)"


@cache
def all_sql() -> dict[str, str]:
    scene = lambda ctes: SCENE[: SCENE.index("signals as (")].rstrip().rstrip(",") if PINS in ctes else SCENE
    sql = lambda select, *ctes: "with recursive " + ",\n".join(c.strip() for c in (scene(ctes), *ctes)) + "\n" + select
    raw_ends, raw_entries = ends("lines", ""), entries("lines", "boxes", "")
    f = flow()
    shown = "select c.page_id, from_device, to_device, from_type, to_type, signal, from_entry, to_entry, round(a.x, 6) as from_x, round(a.y, 6) as from_y, round(b.x, 6) as to_x, round(b.y, 6) as to_y, array_to_string(path, '-') as path_jids from conn c join allnodes a on a.page_id = c.page_id and a.jid = from_entry join allnodes b on b.page_id = c.page_id and b.jid = to_entry"
    quoted = lambda c: f"case when regexp_matches({c}, '[\",\\r\\n]') then '\"' || replace({c}, '\"', '\"\"') || '\"' else {c} end"
    px = lambda *cs: ", ".join(f"trunc({c})::int as {n}" for c, n in zip(cs, ("x1", "y1", "x2", "y2"), strict=True))
    draw = f"""
select page_id, 0 as z, 'line' as shape, {px('x1', 'y1', 'x2', 'y2')}, 'purple' as color, '' as text from fl
union all select page_id, 1, 'box', {px('x1', 'y1', 'x2', 'y2')}, 'orange', raw_text from signals
union all select page_id, 2, 'box', {px('x1', 'y1', 'x2', 'y2')}, case kind when 'device' then 'blue' when 'ground' then 'green' else 'red' end, raw_text from fb
union all select page_id, 3, 'dot', {px('x', 'y', 'x', 'y')}, case kind when 'device' then 'cyan' when 'ground' then 'yellow' else 'magenta' end, '' from f_ent
union all select page_id, 4, 'line', {px('x', 'y', 'ex', 'ey')}, 'red', '' from segxy
union all select c.page_id, 5, 'text', {px('n.x', 'n.y', 'n.x', 'n.y')}, 'red', coalesce(nullif(signal, ''), '?') from conn c join allnodes n on n.page_id = c.page_id and n.jid = path[len(path) // 2 + 1]"""
    iou_w, iou_h = "(least(b.x2, s.x2) - greatest(b.x1, s.x1))", "(least(b.y2, s.y2) - greatest(b.y1, s.y1))"
    best_pin = "select page_id, \"from\", \"to\", from_box, to_box, score, method, from_x, from_y, to_x, to_y from pins qualify row_number() over (partition by page_id, least(\"from\", \"to\"), greatest(\"from\", \"to\") order by pins.raw_score desc, line_idx) = 1"
    pins = "pins as (select k.page_id, k.line_idx, a.raw_text as \"from\", b.raw_text as \"to\", a.sig_idx as from_box, b.sig_idx as to_box, k.score as raw_score, round_even(k.score, 3) as score, a.method || '+' || b.method as method, k.x1 as from_x, k.y1 as from_y, k.x2 as to_x, k.y2 as to_y from kept k join em a on a.page_id = k.page_id and a.pi = k.line_idx * 2 join em b on b.page_id = k.page_id and b.pi = k.line_idx * 2 + 1 where a.sig_idx <> b.sig_idx)"
    points = "[{'x': x_min, 'y': y_min}, {'x': x_max, 'y': y_min}, {'x': x_max, 'y': y_max}, {'x': x_min, 'y': y_max}]"
    return {
        "scene_lines": sql("select * from lines"),
        "scene_boxes": sql("select * from boxes"),
        "scene_signals": sql("select * from signals"),
        "box_geometry": sql("select page_id, box_idx, kind, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as width, (x2 - x1) * (y2 - y1) as area, greatest(0, x1 - 25) as ex1, greatest(0, y1 - 25) as ey1, x2 + 25 as ex2, y2 + 25 as ey2 from boxes"),
        "iou_pairs": sql(f"select b.page_id, box_idx, sig_idx, round({iou_w} * {iou_h} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (s.x2 - s.x1) * (s.y2 - s.y1) - {iou_w} * {iou_h}), 6) as iou, abs((b.x2 - b.x1) - (s.x2 - s.x1)) / greatest(b.x2 - b.x1, s.x2 - s.x1) <= 0.3 as similar from boxes b join signals s on s.page_id = b.page_id where {iou_w} > 0 and {iou_h} > 0"),
        "edge_touch_pairs": sql("select b.page_id, box_idx, sig_idx from boxes b join signals s on s.page_id = b.page_id where not (s.x1 >= b.x1 and s.x2 <= b.x2 and s.y1 >= b.y1 and s.y2 <= b.y2) and not (b.x1 >= s.x1 and b.x2 <= s.x2 and b.y1 >= s.y1 and b.y2 <= s.y2) and not (b.x2 < s.x1 - 45 or b.x1 > s.x2 + 45) and not (b.y2 < s.y1 - 45 or b.y1 > s.y2 + 45)"),
        "edge_touch_near": sql("select b.page_id, b.sig_idx as box_idx, s.sig_idx from signals b join signals s on s.page_id = b.page_id where not (s.x1 >= b.x1 and s.x2 <= b.x2 and s.y1 >= b.y1 and s.y2 <= b.y2) and not (b.x1 >= s.x1 and b.x2 <= s.x2 and b.y1 >= s.y1 and b.y2 <= s.y2) and not (b.x2 < s.x1 - 5 or b.x1 > s.x2 + 5) and not (b.y2 < s.y1 - 5 or b.y1 > s.y2 + 5)", PINS),
        "box_pair_counts": sql("select a.page_id, count(*) as pairs, count(*) filter ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) > 0 and (least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0 and (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > 0.6) as skipped from boxes a join boxes b on a.page_id = b.page_id and a.box_idx < b.box_idx group by a.page_id"),
        "pin_preview": sql("select * from (select page_id, row_number() over (partition by page_id order by score, line_idx) as place, line_idx from lines) where place <= 20"),
        "segment_box_hits": sql(f"select l.page_id, line_idx, kind, box_idx from lines l join boxes b on b.page_id = l.page_id where {hits('l.x1', 'l.y1', 'l.x2', 'l.y2', 'b')}"),
        "segment_distances": sql(f"select * from (select l.page_id, line_idx, sig_idx, round({to_segment('(s.x1 + s.x2) / 2', '(s.y1 + s.y2) / 2', 'l.x1', 'l.y1', 'l.x2', 'l.y2')}, 6) as d, case when abs(l.x2 - l.x1) > abs(l.y2 - l.y1) * 2 then 'H' when abs(l.y2 - l.y1) > abs(l.x2 - l.x1) * 2 then 'V' end as way from lines l join signals s on s.page_id = l.page_id) where d < 50"),
        "score_cut": sql("select page_id, flow, count(*) as n_lines from lines, (values ('graph', 0.05::double), ('fuse', 0.25::double), ('cli', 0.3::double)) as c(flow, least) where score >= least group by page_id, flow"),
        "tile_grid_half_px": sql("select * from tile", IMAGES, tiles(0.5)),
        "tile_grid_128": sql("select * from tile", IMAGES, tiles(128)),
        "tile_remap": sql("select l.page_id, 0 as row, (line_idx % 2)::int as col, line_idx, round(l.x1 * (t.x2 - t.x1) / 512 + t.x1, 6) as x1, round(l.y1 * (t.y2 - t.y1) / 512 + t.y1, 6) as y1, round(l.x2 * (t.x2 - t.x1) / 512 + t.x1, 6) as x2, round(l.y2 * (t.y2 - t.y1) / 512 + t.y1, 6) as y2, score from lines l join tile t on t.page_id = l.page_id and t.row = 0 and t.col = l.line_idx % 2", IMAGES, tiles(128)),
        "directory_scan": "select '/in/' || c_name || '-' || c_custkey || e as path, c_name || '-' || c_custkey as name from (select *, ['.png', '.JPG', '.jpeg', '.txt', '.pngx'][c_custkey % 5 + 1] as e from customer) where lower(e) in ('.png', '.jpg', '.jpeg')",
        "page_payload_decode": "select c_custkey::bigint as page_id, 1 as page_number, c_name || '-' || c_custkey as content, null::varchar as error from customer",
        "label_filter": sql("select page_id, det_idx, class_id, class_name, confidence from det", IMAGES, DETECTED),
        "roi_clamp": sql("select page_id, det_idx, class_name, x_min, y_min, x_max, y_max from roi", IMAGES, DETECTED),
        "object_boxes": sql("select page_id, obj_idx, label, trim(text) as raw_text, least(x_min, x_max)::double as x1, least(y_min, y_max)::double as y1, greatest(x_min, x_max)::double as x2, greatest(y_min, y_max)::double as y2 from objs", IMAGES, DETECTED),
        "endpoint_pairs": sql("select page_id, a, b from near", raw_ends),
        "junctions": sql("select page_id, jid, round(x, 6) as x, round(y, 6) as y from junc", raw_ends),
        "graph_edges": sql("select page_id, a, b from edge", raw_ends),
        "graph_stats": sql("select c.page_id, count(*) // 2 as n_lines, count(distinct jid) as n_junctions, (select count(*) from edge e where e.page_id = c.page_id) as n_edges from cl c group by c.page_id", raw_ends),
        "device_names": sql("select page_id, box_idx, rule, raw_text from named", "dev as (select * from boxes where kind = 'device')", names("dev", "")),
        "power_ground_names": sql("select b.page_id, b.kind, b.box_idx, coalesce((select s.raw_text from signals s where s.page_id = b.page_id and least(abs((s.y1 + s.y2) / 2 - b.y1), abs((s.y1 + s.y2) / 2 - b.y2)) <= 40 and (s.x1 + s.x2) / 2 between b.x1 - 20 and b.x2 + 20 order by least(abs((s.y1 + s.y2) / 2 - b.y1), abs((s.y1 + s.y2) / 2 - b.y2)), s.sig_idx limit 1), case b.kind when 'power' then 'Power' else 'GND' end) as raw_text from boxes b where kind <> 'device'"),
        "box_merge": sql("select page_id, box_idx, x1, y1, x2, y2, merged_from from merged", SPLIT, merge_steps("split", "")),
        "aux_lines": sql("select * from aux", aux("boxes", "")),
        "entry_points": sql("select page_id, kind, box_idx, line_idx, edge_idx, jid, round(x, 6) as x, round(y, 6) as y from ent", raw_ends, raw_entries),
        "graph_rebuilt": sql("select page_id, a, b from rebuilt", *f),
        "graph_contracted": sql("select page_id, a, b from graph", *f),
        "contracted_nodes": sql("select page_id, jid, round(x, 6) as x, round(y, 6) as y from allnodes", *f),
        "paths": sql("select page_id, from_gid, to_gid, array_to_string(path, '-') as path from wpaths", *f),
        "connections": sql(shown, *f),
        "connection_summary": sql("select from_type, to_type, count(*) as n_connections, count(distinct page_id) as n_pages, count(*) filter (signal <> '') as n_labelled from conn group by from_type, to_type", *f),
        "connections_csv": sql(f"select page_id, concat_ws(',', {quoted(chr(99) + 'oalesce(signal, ' + chr(39) * 2 + ')')}, {quoted('from_device')}, {quoted('to_device')}) as line from conn", *f),
        "draw_commands": sql(draw, *f),
        "endpoint_match": sql("select page_id, pi, sig_idx, method from em", "pts as (select page_id, line_idx * 2 as pi, x1 as x, y1 as y from lines union all select page_id, line_idx * 2 + 1, x2, y2 from lines)", ENDPOINT.format(pts="pts")),
        "line_dedup": sql("select page_id, line_idx, score from kept", CONFLICT.format(lines="lines")),
        "pin_links": sql(best_pin, PINS, "fair as (select * from lines where score >= 0.25)", CONFLICT.format(lines="fair"), "pts as (select page_id, line_idx * 2 as pi, x1 as x, y1 as y from lines union all select page_id, line_idx * 2 + 1, x2, y2 from lines)", ENDPOINT.format(pts="pts"), pins),
        "suppressed_detections": sql("select c.page_id, det_idx, class_id, confidence from cranked c join cfinal f on f.page_id = c.page_id and list_contains(f.kept, c.r)", RECORDED, SUPPRESSED),
        "model_objects": sql("select r.page_id, det_idx, class_id, confidence, x_min, y_min, x_max, y_max, case class_id when 0 then 'signalName' when 1 then 'device' when 2 then 'power' when 3 then 'ground' when 4 then 'deviceName' end as class_name from recorded r join pics p on p.page_id = r.page_id where confidence >= 0.05", IMAGES, RECORDED),
        "model_lines": sql("select page_id, row, col, line_idx, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2, score from sound where score >= 0.05", IMAGES, tiles(128), TILE_LINES),
        "model_texts": sql("select page_id, obj_idx, label, case when label = 'signalName' and (page_id + det_idx) % 5 = 3 then '' else text end as text from objs", IMAGES, DETECTED.replace("select page_id, (row_number()", "select page_id, det_idx, (row_number()")),
        "merged_texts": sql("select p.page_id, p.new as box_idx, coalesce(arg_min(raw_text, pos) filter (raw_text not in ('', 'Unknown')), arg_min(coalesce(raw_text, 'Unknown'), pos)) as raw_text from (select page_id, box_idx as new, unnest(string_split(merged_from, '-'))::int as box_idx, unnest(range(len(string_split(merged_from, '-')))) as pos from merged where merged_from is not null) p left join stext t on t.page_id = p.page_id and t.box_idx = p.box_idx group by p.page_id, p.new", SPLIT, merge_steps("split", ""), SPLIT_TEXTS),
        "flow_counts": sql("select * from (select 'boxes' as step, count(*) as n from fb union all select 'lines', count(*) from fl union all select 'auxiliary_lines', count(*) from fl where is_auxiliary union all select 'line_ends', count(*) * 2 from fl union all select 'entries', count(*) from f_ent union all select 'rebuilt_edges', count(*) from rebuilt union all select 'nodes', count(*) from allnodes union all select 'contracted_edges', count(*) from graph union all select 'paths', count(*) from wpaths)", *f),
        "page_payload": sql("select page_id, to_json({'page_number': 1, 'objects': list({'label': label, 'points': " + points + ", 'text': text} order by obj_idx)})::varchar as payload from objs group by page_id", IMAGES, DETECTED),
    }

"""SQL that says the same as the library's queries, for another engine to check them with."""

from __future__ import annotations

from annolith.sources.fixtures import LABEL_LINE, gt_sql, pred_sql

GT, PRED_A, PRED_B = gt_sql(), pred_sql(), pred_sql(model="B")


def area(p: str) -> str:
    return f"greatest(0.0::double, {p}.x2 - {p}.x1) * greatest(0.0::double, {p}.y2 - {p}.y1)"


def iou(a: str, b: str) -> str:
    inter = f"greatest(0.0::double, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::double, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    total = f"(({area(a)}) + ({area(b)}) - ({inter}))"
    return f"(case when {total} = 0 then 0.0::double else ({inter}) / {total} end)"


def edges(gt: str, pred: str, least: float, on: str = "and g.c = p.c") -> str:
    return f"select g.img, p.i, g.j, p.s, {iou('g', 'p')} as iou from {gt} g join {pred} p on g.img = p.img {on} where {iou('g', 'p')} >= {least}"


def greedy(name: str, candidates: str, order: str) -> str:
    """CTEs that end in ``name`` (img, i, j): edges in order, each taken if both ends are free."""
    return f"""{name}_e as (select img, i, j, row_number() over (partition by img order by {order}) as k from ({candidates}) q),
{name}_t(img, k, ui, uj) as (
  select distinct img, 0::bigint, []::bigint[], []::bigint[] from {name}_e
  union all
  select t.img, t.k + 1, case when list_contains(t.ui, e.i) or list_contains(t.uj, e.j) then t.ui else list_append(t.ui, e.i) end,
    case when list_contains(t.ui, e.i) or list_contains(t.uj, e.j) then t.uj else list_append(t.uj, e.j) end
  from {name}_t t join {name}_e e on e.img = t.img and e.k = t.k + 1),
{name} as (select img, unnest(ui) as i, unnest(uj) as j from (select img, arg_max(ui, k) as ui, arg_max(uj, k) as uj from {name}_t group by img) z)"""


def matched(model: str, pred: str = "A", where: str = "true") -> str:
    """CTEs {model}p (predictions), {model}m (matches), {model}x (confusions); needs gt."""
    m, p = f"{model}m", f"{model}p"
    free_g, free_p = f"(select * from gt where not exists (select 1 from {m} where {m}.img = gt.img and {m}.j = gt.j))", f"(select * from {p} where not exists (select 1 from {m} where {m}.img = {p}.img and {m}.i = {p}.i))"
    return f"""{p} as (select * from ({PRED_A if pred == 'A' else PRED_B}) q where {where}),
{greedy(m, edges('gt', p, 0.5), 's desc, i, iou desc, j')},
{greedy(f'{model}x', edges(free_g, free_p, 0.5, 'and g.c <> p.c'), 'iou desc, j desc, i desc')}"""


def outcome(model: str) -> str:
    return f"select gt.img, gt.j, gt.c, case when m.i is not null then 'CORRECT' when x.i is not null then 'CLASS_CONFUSION' else 'MISSED' end as outcome, coalesce(m.i, x.i) as i from gt left join {model}m m on m.img = gt.img and m.j = gt.j left join {model}x x on x.img = gt.img and x.j = gt.j"


def assigned(gt: str = "gt", pred: str = "ap") -> str:
    """CTEs that end in hm (img, i, j, iou): of all ways to pair the boxes of an image that overlap the one of the largest total overlap."""
    inter = "(greatest(0.0::double, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0.0::double, least(g.y2, p.y2) - greatest(g.y1, p.y1)))"
    over = f"{inter} / greatest((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {inter}, 1e-9::double)"
    return f"""he as (select g.img, g.j, p.i, {over} as iou from {gt} g join {pred} p on g.img = p.img where {inter} > 0),
hj as (select img, j, row_number() over (partition by img order by j) as k from (select distinct img, j from he) q),
ho as (select img, j, i, iou, iou + 1e-9::double * (i / (i + 1) * (j / (j + 1))) as v from he union all select distinct img, j, null, 0.0, 0.0 from he),
ht(img, k, used, found, total) as (select distinct img, 0::bigint, []::bigint[], []::struct(i bigint, j bigint, iou double)[], 0.0::double from he union all
  select t.img, t.k + 1, case when o.i is null then used else list_append(used, o.i) end, case when o.i is null then found else list_append(found, {{'i': o.i, 'j': o.j, 'iou': o.iou}}) end, total + o.v
  from ht t join hj on hj.img = t.img and hj.k = t.k + 1 join ho o on o.img = hj.img and o.j = hj.j where o.i is null or not list_contains(used, o.i)),
hm as (select img, x.i as i, x.j as j, x.iou as iou from (select img, unnest(arg_max(found, (k, total))) as x from ht group by img) q where x.iou >= 0.5)"""


HEAD = f"with recursive gt as ({GT}), "


def curve(model: str, pred: str) -> str:
    """CTE {model}c: the sweep of a model; needs gt and {model}m."""
    p, m = f"{model}p", f"{model}m"
    return f"""{model}s as (select p.c, p.s, case when m.i is null then 0 else 1 end as tp from {p} p left join {m} m on m.img = p.img and m.i = p.i),
{model}d as (select scope, s as threshold, sum(tp) as t, count(*) as n from (select cast(c as varchar) as scope, s, tp from {model}s union all select 'Overall', s, tp from {model}s) q group by 1, 2),
{model}g as (select scope, count(*) as n from (select cast(c as varchar) as scope from gt union all select 'Overall' from gt) q group by 1),
{model}n as (select count(*) as n from (select img from gt union select img from {p}) q),
{model}r as (select d.scope, threshold, sum(t) over w as tp, sum(d.n) over w - sum(t) over w as fp, g.n - sum(t) over w as fn from {model}d d join {model}g g using (scope) window w as (partition by d.scope order by threshold desc rows unbounded preceding)),
{model}c as (select '{pred}' as model, scope, threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as recall,
  case when 2 * tp + fp + fn = 0 then 0 else (2 * tp)::double / (2 * tp + fp + fn) end as f1, fp::double / n.n as fp_per_image from {model}r, {model}n n)"""


BOTH = f"{HEAD}{matched('qa')}, {curve('qa', 'A')}, {matched('qb', 'B')}, {curve('qb', 'B')}, curves as (select * from qac union all select * from qbc)"
POINTS = BOTH + """, points as (select model, threshold, t.tp as t_tp, t.fp as t_fp, t.fn as t_fn, t.precision as t_precision, t.recall as t_recall, t.fp_per_image as t_fp_per_image, o.tp as o_tp, o.fp as o_fp, o.fn as o_fn, o.precision as o_precision, o.recall as o_recall, o.fp_per_image as o_fp_per_image
 from (select * from curves where scope = '1') t join (select * from curves where scope = 'Overall') o using (model, threshold))"""
HASHES = "hashes as (select vec_id as key, (" + " + ".join(f"case when embedding[{k + 1}] > 0 then {1 << k} else 0 end" for k in range(62)) + ")::bigint as hash from embeddings)"
PAIRS = "pairs as (select a.key as a, b.key as b, bit_count(xor(a.hash, b.hash))::int as distance from hashes a join hashes b on a.key < b.key where bit_count(xor(a.hash, b.hash)) <= 8)"
SIMILARITY = "case when distance <= 4 then 'VERY_SIMILAR' when distance <= 8 then 'POSSIBLY_SIMILAR' end"
DECIDED = "decided as (select o_orderkey as a, o_custkey + 1000000000 as b, case o_orderkey % 5 when 0 then 'KEEP_A_EXCLUDE_B' when 1 then 'KEEP_B_EXCLUDE_A' else 'KEEP_BOTH' end as decision, case o_orderkey % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split_a, case o_custkey % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split_b from orders)"
QUEUE = "queue as (select cast(p_partkey as varchar) as review_id, case p_size % 3 when 0 then 'P0' when 1 then 'P1' else 'P3' end as priority from part where p_partkey % 10 <> 3)"
CHOICES = "choices as (select cast(p_partkey as varchar) as review_id, case p_size % 4 when 0 then 'KEEP_BOTH' when 1 then 'KEEP_A_EXCLUDE_B' when 2 then 'MAYBE' else 'PENDING' end as decision from part where p_partkey % 4 <> 1 union all select cast(p_partkey as varchar), 'KEEP_BOTH' from part where p_partkey % 50 = 0)"
LINES = f"lines as (select l_orderkey as img, l_linenumber as n, {LABEL_LINE} as line from lineitem)"
TIERS = "tiers as (select p_partkey as img, p_size % 4 as tier, (p_size * 7) % 3 as n_hard1, 1 + p_size % 2 as n0, p_size % 3 as n1 from part)"
EVENTS = "ev as (select user_id, event_id, ts, value, event_type, event_id % 5 as raw, event_type = 'error' as cut from events)"
_NUM = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"

ORACLES: dict[str, str] = {
    "parse_validate": f"""with {LINES}, f as (select *, string_split(line, ' ') as f from lines),
 v as (select *, [case when regexp_full_match(lower(t), '[+-]?(nan|inf|infinity)') then 'nan'::double when regexp_matches(t, '{_NUM}') then try_cast(t as double) end for t in f] as v from f),
 k as (select *, case when len(f) <> 5 then 'FIELD_COUNT' when list_contains([x is null for x in v], true) then 'NON_NUMERIC' when list_contains([isnan(x) or isinf(x) for x in v], true) then 'NON_FINITE' when v[1] <> floor(v[1]) then 'CLASS_NOT_INTEGER'
  when v[1] not in (0, 1) then 'INVALID_CLASS_ID' when not (v[2] between 0 and 1 and v[3] between 0 and 1 and v[4] > 0 and v[4] <= 1 and v[5] > 0 and v[5] <= 1) then 'INVALID_COORDINATES' end as fatal from v),
 r as (select *, case when fatal is not null then fatal else concat_ws('|', case when v[2] - v[4] / 2 < -1e-6 or v[3] - v[5] / 2 < -1e-6 or v[2] + v[4] / 2 > 1 + 1e-6 or v[3] + v[5] / 2 > 1 + 1e-6 then 'OUT_OF_BOUNDS' end, case when least(v[4], v[5]) < 1e-4 then 'NEAR_ZERO' end) end as issues,
  case when fatal is null then v[4] * v[5] end as area from k)
 select img, n, line, case when fatal is null then v[1]::int end as class_id, area, case when area < 0.001 then 'tiny' when area < 0.01 then 'small' when area < 0.1 then 'medium' when area is not null then 'large' end as size_category, issues from r""",
    "duplicate_lines": f"with {LINES}, f as (select *, string_split(line, ' ') as f from lines), v as (select *, [case when regexp_matches(t, '{_NUM}') then try_cast(t as double) end for t in f] as v from f), k as (select *, row_number() over (partition by img, coalesce(v::varchar, ''), case when len(f) <> 5 or list_contains([x is null for x in v], true) or v[1] not in (0, 1) or v[3] > 1 or v[2] > 1 then line end order by n) as k from v) select img, n, line from k where k > 1",
    "exact_duplicates": "with d as (select sha256(text) as sha256, lpad(doc_id::varchar, 12, '0') as name, source from documents where text is not null), g as (select sha256, min(name) as representative, count(*) as n, string_agg(distinct source, '|' order by source) as splits, count(distinct source) > 1 as cross_split from d group by 1 having count(*) >= 2) select sha256, name, representative, n, splits, cross_split, case when cross_split then 'ERROR' else 'REVIEW' end as severity from d join g using (sha256)",
    "source_groups": "with p as (select regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '^(https?)', 1) as scheme from pages) select host, count(*) as n, string_agg(distinct scheme, '|' order by scheme) as splits, count(distinct scheme) > 1 as cross_split from p where host <> '' group by 1",
    "near_duplicate_pairs": f"with {HASHES}, {PAIRS} select a, b, distance, {SIMILARITY} as similarity from pairs",
    "near_duplicate_components": f"with recursive {HASHES}, {PAIRS}, both_ways as (select a, b from pairs union select b, a from pairs), reach(key, other) as (select key, key from hashes union select r.key, w.b from reach r join both_ways w on w.a = r.other) select key, min(other) as component from reach group by 1",
    "orphans_missing": "select d.doc_id as key, 'ONLY_LEFT' as side from (select distinct doc_id from documents) d where not exists (select 1 from labels l where l.doc_id = d.doc_id) union all select l.doc_id, 'ONLY_RIGHT' from (select distinct doc_id from labels) l where not exists (select 1 from documents d where d.doc_id = l.doc_id)",
    "class_distribution": "with b as (select d.lang, l.doc_id, l.quality from labels l join documents d using (doc_id)), g as (select lang, count(distinct doc_id) as n_images, count(*) as n_objects, count(*) filter (quality = 0) as n_class0, count(*) filter (quality = 1) as n_class1 from b group by rollup (lang)) select *, n_objects::double / nullif(n_images, 0) as objects_per_image, n_class0::double / nullif(n_class1, 0) as ratio from g",
    "bbox_statistics": "with l as (select l_returnflag as grp, unnest(['l_quantity', 'l_extendedprice']) as metric, unnest([l_quantity, l_extendedprice]) as v from lineitem) select grp, metric, count(v) as n, min(v) as minimum, max(v) as maximum, round(avg(v), 6) as mean, median(v) as median from l group by 1, 2",
    "object_counts": "with i as (select o.o_orderkey, o.o_orderstatus as split, nullif(count(l.l_orderkey), 5) as n from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1, 2) select split, count(*) filter (n = 0) as n_zero, count(*) filter (n = 1) as n_one, count(*) filter (n > 1) as n_many, count(*) filter (n is null) as n_unknown from i group by rollup (split)",
    "resolution_histogram": "select concat(p_size, 'x', p_partkey % 7) as resolution, count(*) as n from part group by 1",
    "suspicious_boxes": f"with {LINES}, b as (select img, n, v[4] as w, v[5] as h from (select img, n, [try_cast(t as double) for t in string_split(line, ' ')] as v from lines where line not like '%nan%' and line not like 'x %' and line not like 'only%' and line not like '0.5 %' and line not like '7 %' and line not like '1 0.5 1.5%') q) select img, n, r as reason from (select img, n, unnest([case when w * h < 0.001 then 'TINY_BBOX' end, case when w / h < 0.2 or w / h > 5 then 'EXTREME_ASPECT_RATIO' end, case when least(w, h) < 1e-4 then 'NEAR_ZERO' end]) as r from b) q where r is not null",
    "audit_status": f"with {LINES}, f as (select *, [try_cast(t as double) for t in string_split(line, ' ')] as v from lines), m as (select *, line like 'only%' or line like 'x %' or line like '%nan%' or line like '0.5 %' or line like '7 %' or line like '1 0.5 1.5%' as broken from f), bad as (select * from m where broken), good as (select * from m where not broken), edges as (select * from good where v[2] - v[4] / 2 < -1e-6 or v[2] + v[4] / 2 > 1 + 1e-6 or v[3] - v[5] / 2 < -1e-6 or v[3] + v[5] / 2 > 1 + 1e-6), thin as (select * from good where least(v[4], v[5]) < 1e-4), twice as (select (select sum(c - 1) from (select count(*) as c from good group by img, v) q) + (select sum(c - 1) from (select count(*) as c from bad group by img, line) q) as k), t as (select (select count(*) from bad) as e, (select count(*) from edges) + (select count(*) from thin) + (select k from twice) as r) select e as n_errors, (e + r)::bigint as n_issues, case when e > 0 then 'FAIL' when r > 0 then 'REVIEW_REQUIRED' else 'PASS' end as status from t",
    "review_queue": f"with {HASHES}, {PAIRS}, cases as (select 'P0' as priority, concat(a, '|', b) as subject, 'near duplicate' as why from pairs union all select 'P1', doc_id::varchar, case when quality = 0 then 'low quality' else 'toxic' end from labels where quality = 0 or toxic = 1 union all select 'P3', source, 'source group' from (select distinct source from documents) q), one as (select priority, subject, string_agg(distinct why, '|' order by why) as evidence from cases group by 1, 2) select priority, substr(sha256(concat(priority, ':', subject)), 1, 16) as review_id, subject, evidence from one",
    "decision_validation": f"with {QUEUE}, {CHOICES} select review_id, 'DUPLICATE' as problem from choices group by 1 having count(*) > 1 union all select distinct review_id, 'UNKNOWN_CASE' from choices c where not exists (select 1 from queue q where q.review_id = c.review_id) union all select distinct review_id, 'INVALID_DECISION' from choices where decision not in ('KEEP_BOTH', 'KEEP_A_EXCLUDE_B', 'KEEP_B_EXCLUDE_A', 'PENDING') union all select review_id, 'MISSING' from queue q where not exists (select 1 from choices c where q.review_id = c.review_id)",
    "decision_progress": f"with {QUEUE}, {CHOICES}, one as (select review_id, min(decision) as decision from choices group by 1), m as (select priority, coalesce(decision, 'PENDING') as d from queue left join one using (review_id)) select priority, count(*) as n_cases, count(*) filter (d <> 'PENDING') as n_decided, count(*) filter (d = 'PENDING') as n_pending from m group by 1",
    "action_map": f"with {DECIDED}, v as (select a as image, case when decision = 'KEEP_B_EXCLUDE_A' then 'EXCLUDE' else 'KEEP' end as action from decided union all select b, case when decision = 'KEEP_A_EXCLUDE_B' then 'EXCLUDE' else 'KEEP' end from decided) select image, case when count(distinct action) > 1 then 'CONFLICT' else min(action) end as action, count(*) as n_votes, count(distinct action) > 1 as conflict from v group by 1",
    "policy_sanity": f"with {DECIDED}, w as (select *, case when a_p > b_p then 'KEEP_A_EXCLUDE_B' when b_p > a_p then 'KEEP_B_EXCLUDE_A' else 'KEEP_BOTH' end as wanted from (select *, case split_a when 'test' then 3 when 'valid' then 2 else 1 end as a_p, case split_b when 'test' then 3 when 'valid' then 2 else 1 end as b_p from decided) q) select case when decision = 'KEEP_BOTH' then 'KEPT' when decision = wanted then 'FOLLOWS_RULE' else 'AGAINST_RULE' end as direction, count(*) as n_pairs, count(distinct case decision when 'KEEP_A_EXCLUDE_B' then b when 'KEEP_B_EXCLUDE_A' then a end) as n_excluded from w group by 1",
    "label_counts": "with r as (select concat(l_returnflag, '|', l_linestatus, '|', l_returnflag) as labels from lineitem), x as (select unnest(list_distinct(string_split(labels, '|'))) as label from r) select label, count(*) as n from x group by 1",
    "iou_pairs": f"with gt as ({GT}), p as ({PRED_A}) select g.img, p.i, g.j, {iou('g', 'p')} as iou from gt g join p on g.img = p.img and g.c = p.c where {iou('g', 'p')} >= 0.1",
    "greedy_match": f"{HEAD}{matched('qa')} select img, i, j from qam",
    "confusion_match": f"{HEAD}{matched('qa')} select img, i, j from qax",
    "object_outcomes": f"{HEAD}{matched('qa', where='s >= 0.25')} {outcome('qa')}",
    "failure_events": f"""{HEAD}{matched('qa', where='s >= 0.25')}, cold as (select * from ({PRED_A}) q where s >= 0.001 and s < 0.25), missed as (select * from gt where not exists (select 1 from qam where qam.img = gt.img and qam.j = gt.j)), {greedy('low', edges('missed', 'cold', 0.5), 's desc, i, iou desc, j')}
 select event, count(*) as n from (select 'FALSE_NEGATIVE' as event from missed union all select 'LOW_CONFIDENCE' from low union all select 'LOW_CONFIDENCE' from qam join qap using (img, i) where s < 0.5 union all select 'FALSE_POSITIVE' from qap where not exists (select 1 from qam where qam.img = qap.img and qam.i = qap.i) union all select 'CLASS_CONFUSION' from qax union all select 'MULTIPLE_OBJECT_SCENE' from (select img from gt group by 1 having count(*) > 1) q) q group by 1""",
    "nearest_prediction": f"{HEAD}{matched('qa')}, near as (select g.img, g.j, p.i, p.c as predicted_class, {iou('g', 'p')} as iou, p.s from gt g join qap p on p.img = g.img where not exists (select 1 from qam where qam.img = g.img and qam.j = g.j)) select img, j, i, iou, predicted_class from (select *, row_number() over (partition by img, j order by iou desc, s desc, i) as k from near) q where k = 1",
    "threshold_sweep": f"{HEAD}{matched('qa')}, {curve('qa', 'A')} select scope, threshold, tp, fp, fn, precision, recall, f1, fp_per_image from qac",
    "threshold_grid": f"{HEAD}{matched('qa')}, {curve('qa', 'A')}, grid as (select s.scope, i / 100.0::double as threshold from range(5, 91) r(i), (select distinct scope from qac) s) select g.scope, g.threshold, arg_min(c.tp, c.threshold) as tp, arg_min(c.fp, c.threshold) as fp, arg_min(c.fn, c.threshold) as fn from grid g join qac c on c.scope = g.scope and c.threshold >= g.threshold group by 1, 2",
    "best_f1": f"{BOTH} select model, scope, threshold, tp, fp, fn, f1 from (select *, row_number() over (partition by model, scope order by f1 desc, recall desc, precision desc, threshold desc) as k from curves) q where k = 1",
    "precision_floor": f"{BOTH} select model, scope, threshold, tp, fp, fn, recall from (select *, row_number() over (partition by model, scope order by recall desc, precision desc, threshold desc) as k from curves where tp + fp > 0 and precision >= 0.8) q where k = 1",
    "policy_select": f"{POINTS} select model, threshold, t_tp, t_fp, o_fp from (select *, row_number() over (partition by model order by t_recall desc, t_precision desc, o_fp, t_fp, threshold desc) as k from points where t_tp + t_fp > 0 and t_precision >= 0.75 and t_fp_per_image <= 0.4 and o_fp_per_image <= 0.9) q where k = 1",
    "fp_budget_frontier": f"{BOTH}, own as (select * from curves where scope = '1'), b as (select distinct fp as budget from own) select budget, model, threshold, fp, recall, budget - fp as slack from (select b.budget, o.*, row_number() over (partition by b.budget, o.model order by o.recall desc, o.precision desc, o.threshold desc) as k from b join own o on o.fp <= b.budget) q where k = 1",
    "closest_cost": f"{BOTH}, own as (select * from curves where scope = '1') select threshold_a, fp_a, threshold_b, fp_b from (select a.threshold as threshold_a, a.fp as fp_a, b.threshold as threshold_b, b.fp as fp_b, row_number() over (partition by a.threshold order by abs(a.fp - b.fp), b.recall desc, b.threshold desc) as k from own a, own b where a.model = 'A' and b.model = 'B') q where k = 1",
    "pareto": "with v as (select p_size, p_retailprice, -(p_partkey % 50) as z, p_partkey from part), u as (select p_size, p_retailprice, z, max(p_partkey) as p_partkey, count(*) as n_equal from v group by 1, 2, 3) select * from u where not exists (select 1 from u o where o.p_size >= u.p_size and o.p_retailprice >= u.p_retailprice and o.z >= u.z and (o.p_size > u.p_size or o.p_retailprice > u.p_retailprice or o.z > u.z))",
    "same_cost_pairs": f"{POINTS}, u as (select model, t_tp, t_fp, t_fn, o_tp, o_fp, o_fn, max(threshold) as threshold, max(t_recall) as r, max(t_precision) as p from points group by all) select case when a.r > b.r and a.p >= b.p then 'A_PREFERRED' when b.r > a.r and b.p >= a.p then 'B_PREFERRED_UNDER_THIS_BUDGET' else 'NO_CLEAR_ADVANTAGE' end as decision, count(*) as n from u a join u b on a.model = 'A' and b.model = 'B' and abs(a.o_fp - b.o_fp) <= 1 and abs(a.t_fp - b.t_fp) <= 1 group by 1",
    "transitions": f"{HEAD}{matched('qa', where='s >= 0.25')}, {matched('qb', 'B', where='s >= 0.25')}, oa as ({outcome('qa')}), ob as ({outcome('qb')}), t as (select oa.c, oa.outcome as a, ob.outcome as b from oa join ob using (img, j)) select c, case when a = 'CORRECT' and b = 'CORRECT' then 'CORRECT_IN_BOTH' when a = 'CORRECT' and b = 'CLASS_CONFUSION' then 'CORRECT_IN_A_WRONG_IN_B' when a = 'CORRECT' then 'CORRECT_IN_A_MISSED_IN_B' when a = 'MISSED' and b = 'CORRECT' then 'RECOVERED_BY_B' when b = 'CORRECT' then 'A_CLASS_CONFUSION_B_CORRECT' when a = 'MISSED' and b = 'CLASS_CONFUSION' then 'A_MISSED_B_CLASS_CONFUSION' else 'STILL_MISSED_BY_B' end as transition, count(*) as n from t group by 1, 2",
    "fp_transitions": f"""{HEAD}{matched('qa')}, {matched('qb', 'B')}, xa as (select * from qap where not exists (select 1 from qam where qam.img = qap.img and qam.i = qap.i)), xb as (select img, i as j, c, x1, y1, x2, y2 from qbp where not exists (select 1 from qbm where qbm.img = qbp.img and qbm.i = qbp.i)),
 {greedy('kept', f"select g.img, g.i, p.j, {iou('g', 'p')} as iou from xa g join xb p on g.img = p.img and g.c = p.c where {iou('g', 'p')} >= 0.5", 'iou desc, i, j')}
 select 'PERSISTENT_FALSE_POSITIVE' as category, count(*) as n from kept union all select 'REMOVED_FALSE_POSITIVE_IN_B', (select count(*) from xa) - count(*) from kept union all select 'NEW_FALSE_POSITIVE_IN_B', (select count(*) from xb) - count(*) from kept""",
    "metric_deltas": f"{BOTH}, best as (select *, row_number() over (partition by model, scope order by f1 desc, recall desc, precision desc, threshold desc) as k from curves), l as (select model, scope, unnest(['precision', 'recall', 'f1']) as metric, unnest([precision, recall, f1]) as v from best where k = 1) select scope, metric, max(v) filter (model = 'A') as a, max(v) filter (model = 'B') as b, max(v) filter (model = 'A') - max(v) filter (model = 'B') as delta from l group by 1, 2",
    "distribution_compare": f"{HEAD}{matched('qa')}, o as ({outcome('qa')}), s as (select gt.*, o.outcome, case when area < 120 then 'small' when area < 180 then 'medium' else 'large' end as bucket from (select *, (x2 - x1) * (y2 - y1) as area from gt) gt join o using (img, j)), g as (select bucket as value, count(*) as n_all, count(*) filter (outcome = 'MISSED') as n_subset from s group by 1) select value, n_all, n_subset, n_all::double / sum(n_all) over () as share_all, n_subset::double / sum(n_subset) over () as share_subset from g",
    "tier_quota_sample": f"with {TIERS} select img, tier, place::int as place from (select *, row_number() over (partition by tier order by (n_hard1 > 0) desc, n_hard1 desc, img) as place from tiers where tier > 0) q where place <= case tier when 3 then 30 when 2 then 15 else 8 end",
    "round_robin_sample": "with recursive r as (select (select list(p_partkey order by p_size desc, p_partkey) from (from part order by p_size desc, p_partkey limit 40)) as a, (select list(p_partkey order by p_retailprice, p_partkey) from (from part order by p_retailprice, p_partkey limit 40)) as b, (select list(p_partkey order by p_partkey) from (from part where p_partkey % 3 = 0 order by p_partkey limit 40)) as c), t(step, chosen, pick) as (select -1, []::bigint[], null::bigint union all select step + 1, case when p is null then chosen else list_append(chosen, p) end, p from (select step, chosen, list_filter(case (step + 1) % 3 when 0 then a when 1 then b else c end, lambda x: not list_contains(chosen, x))[1] as p from t, r where len(chosen) < 40 and step < 200) q) select pick as key, case step % 3 when 0 then 'largest' when 1 then 'cheapest' else 'third' end as criterion, (step // 3 + 1)::int as turn from t where pick is not null",
    "class_flips": "select user_id, count(*) filter (b <> event_type) as n_changes from (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) q group by 1",
    "scene_generation": f"with {EVENTS} select event_id, sum(cut::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as generation from ev",
    "display_ids": f"with {EVENTS}, g as (select *, sum(cut::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as generation from ev), f as (select user_id, generation, raw, min((ts, event_id)) as first from g group by 1, 2, 3), n as (select *, row_number() over (partition by user_id order by first, generation, raw)::int as display_id from f) select g.event_id, n.display_id from g join n using (user_id, generation, raw)",
    "ema_vote": """with recursive e as (select user_id, event_id, (event_id % 2)::int as c, (event_id * 7 % 10)::double / 10.0::double as p, row_number() over (partition by user_id order by ts, event_id) as k from events),
 t(user_id, k, v0, v1, shown, event_id) as (
  select user_id, 0::bigint, 0.0::double, 0.0::double, c, -1::bigint from e where k = 1
  union all select user_id, k, v0, v1, case when best <> shown and (case best when 1 then v1 else v0 end) > (case shown when 1 then v1 else v0 end) + 0.05::double then best else shown end, event_id
  from (select q.*, case when v1 > v0 then 1 else 0 end as best from (select t.user_id, e.k, 0.7::double * t.v0 + (1.0::double - 0.7::double) * (case when e.c = 0 then e.p else 0.0::double end) as v0, 0.7::double * t.v1 + (1.0::double - 0.7::double) * (case when e.c = 1 then e.p else 0.0::double end) as v1, t.shown, e.event_id from t join e on e.user_id = t.user_id and e.k = t.k + 1) q) z)
 select event_id, shown from t where k > 0""",
    "sampling_weights": f"with {TIERS}, t as (select count(*) as n, sum(tier) as s from tiers) select img, tier, 1.0::double + tier * (case when s > 0 then least(0.1::double * n / s, 1.0::double / 3) else 0.0::double end) as weight from tiers, t",
    "sampling_stats": f"with {TIERS}, t as (select count(*) as n, sum(tier) as s from tiers), w as (select 1.0::double + tier * (case when s > 0 then least(0.1::double * n / s, 1.0::double / 3) else 0.0::double end) as weight, n from tiers, t), p as (select weight / (select sum(weight) from w) as p, n from w) select max(n) as n, round(max(p * n), 9) as max_draws, round(sum(1 - pow(1 - p, n)), 4) as expected_unique, round(1 / sum(p * p), 4) as effective_size, 'PASS' as risk from p",
    "class_exposure": f"with {TIERS}, t as (select count(*) as n, sum(tier) as s from tiers), w as (select *, 1.0::double + tier * (case when s > 0 then least(0.1::double * n / s, 1.0::double / 3) else 0.0::double end) as weight from tiers, t), e as (select *, weight / (select sum(weight) from w) * n as e from w) select 'n0' as class, sum(n0) as baseline, round(sum(n0 * e), 6) as expected from e union all select 'n1', sum(n1), round(sum(n1 * e), 6) from e",
    "weighted_sample": f"with {TIERS}, c as (select img, sum(1 + tier) over (order by img) as upto, 1 + tier as w from tiers), u as (select o_orderkey as draw, (o_orderkey * 7919 + o_custkey * 31) % (select sum(1 + tier) from tiers) as u from orders) select draw, img as key from u join c on u.u < c.upto and u.u >= c.upto - c.w",
    "fingerprint": "select doc_id as key, sha256(coalesce(length(text) || ':' || text, 'N;') || coalesce(length(lang) || ':' || lang, 'N;')) as sha256 from documents",
    "verify_snapshot": "with a as (select doc_id as key, sha256(text) as h from documents where doc_id % 7 <> 0), b as (select doc_id as key, sha256(case when doc_id % 11 = 0 then concat(text, '!') else text end) as h from documents where doc_id % 5 <> 0) select coalesce(a.key, b.key) as key, case when a.key is null then 'ADDED' when b.key is null then 'REMOVED' else 'CHANGED' end as change from a full join b on a.key = b.key where a.h is distinct from b.h",
    "argument_drift": "with a as (select n_name as key, (n_regionkey % 3)::varchar as v from nation where n_nationkey % 5 <> 1), b as (select n_name as key, (n_regionkey % 2)::varchar as v from nation where n_nationkey % 7 <> 2) select coalesce(a.key, b.key) as key, a.v as actual, b.v as baseline, case when coalesce(a.key, b.key) in (select n_name from nation where n_nationkey in (3, 8)) and a.v is distinct from b.v then 'EXPECTED_DIFFERENCE' when a.v = b.v then 'MATCH' else 'DRIFT' end as status from a full join b on a.key = b.key",
    "curve_summary": "with m as (select o_orderpriority as run, row_number() over (partition by o_orderpriority order by date_trunc('month', o_orderdate)) as epoch, sum(round(o_totalprice * 100)::bigint) as v from orders group by o_orderpriority, date_trunc('month', o_orderdate)), r as (select *, row_number() over (partition by run order by epoch desc) as d from m) select run, first(epoch order by v desc, epoch) as best, avg(v) filter (epoch <= 5) as first_mean, avg(v) filter (d <= 5) as last_mean, min(v) as minimum, max(v) as maximum, true as contiguous from r group by 1",
    "early_stopping": "with m as (select o_orderpriority as run, row_number() over (partition by o_orderpriority order by date_trunc('month', o_orderdate)) as epoch, sum(round(o_totalprice * 100)::bigint)::double as v from orders group by o_orderpriority, date_trunc('month', o_orderdate)) select run, max(v) as best_fitness, first(epoch order by v desc, epoch) as best_epoch, count(*) - first(epoch order by v desc, epoch) >= 10 as stop from m group by 1",
    "frame_offsets": "select l_orderkey as video, k as segment, (coalesce(sum(l_quantity::bigint) over (partition by l_orderkey order by k rows between unbounded preceding and 1 preceding), 0))::bigint as start from (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as k from lineitem) q",
    "stream_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minute",
    "stream_votes": None,
}
ORACLES["stream_display_ids"] = f"with {EVENTS}, g as (select *, sum(cut::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as generation from ev), f as (select user_id, generation, raw, min((ts, event_id)) as first from g group by 1, 2, 3), n as (select *, row_number() over (partition by user_id order by first, generation, raw)::bigint as display_id from f) select user_id as source, g.event_id, generation, n.display_id from g join n using (user_id, generation, raw)"
ORACLES["train_inventory"] = f"with {LINES}, g as (select img, count(*) filter (line like '0 %') as k0, count(*) filter (line like '1 %') as k1 from lines where regexp_matches(line, '^[01] 0.[0-9]+ 0.[0-9]+ 0.[0-9]+ 0.[0-9]+$') group by 1) select o_orderkey as img, coalesce(k0, 0) as n0, coalesce(k1, 0) as n1 from orders left join g on img = o_orderkey"
ORACLES["projected_truth"] = """with p as (select *, 200 + o_custkey % 300 as iw, 150 + o_orderkey % 200 as ih from orders), q as (select *, least(640.0::double / iw, 480.0::double / ih) as s from p), r as (select *, greatest(1, round_even(iw * s, 0)::int) as pw, greatest(1, round_even(ih * s, 0)::int) as ph from q),
 b as (select o_orderkey, o_orderkey % 2 as c, (640 - pw) // 2 as l, (480 - ph) // 2 as t, pw, ph, (o_custkey % 100) / 100.0::double as x, (o_orderkey % 90) / 90.0::double as y, (1 + o_custkey % 37) / 80.0::double as w, (1 + o_orderkey % 29) / 400.0::double as h from r), f as (select b.*, i, 1.0::double + 0.5::double * (i / 2.0::double) as z from b, range(3) g(i)),
 k as (select *, case when z <= 1 then 640 else round_even(640 / z, 0)::int end as cw, case when z <= 1 then 480 else round_even(480 / z, 0)::int end as ch from f), m as (select *, (640 - cw) // 2 as cl, (480 - ch) // 2 as ct from k),
 e as (select o_orderkey * 3 + i as img, c, greatest(0, (l + (x - w / 2) * pw - cl) * (640.0::double / cw)) as x1, greatest(0, (t + (y - h / 2) * ph - ct) * (480.0::double / ch)) as y1, least(640, (l + (x + w / 2) * pw - cl) * (640.0::double / cw)) as x2, least(480, (t + (y + h / 2) * ph - ct) * (480.0::double / ch)) as y2 from m)
 select img, c, floor(x1 * 1000.0::double + 0.3::double)::bigint as x1, floor(y1 * 1000.0::double + 0.3::double)::bigint as y1, floor(x2 * 1000.0::double + 0.3::double)::bigint as x2, floor(y2 * 1000.0::double + 0.3::double)::bigint as y2 from e where x2 - x1 >= 1 and y2 - y1 >= 1"""
ORACLES["stream_votes"] = ORACLES["ema_vote"].replace("select event_id, shown from t", "select user_id as track, event_id, shown from t")
_DIFFICULTY = f"""{HEAD}{matched('qa')}, used as (select img, i, j from qam union all select img, i, j from qax),
 freeg as (select * from gt where not exists (select 1 from used u where u.img = gt.img and u.j = gt.j)), freep as (select * from qap where not exists (select 1 from used u where u.img = qap.img and u.i = qap.i)),
 cand as (select img, i, s, list({{'j': j, 'iou': iou}} order by iou desc, j) as c from ({edges('freeg', 'freep', 0.0)}) q group by 1, 2, 3), seq as (select *, row_number() over (partition by img order by s desc, i) as k from cand),
 loc(img, k, ui, uj) as (select distinct img, 0::bigint, []::bigint[], []::bigint[] from seq union all
  select img, k, case when fits then list_append(ui, i) else ui end, case when fits then list_append(uj, b.j) else uj end from (select *, b is not null and b.iou >= 0.1 and b.iou < 0.5 as fits from (select l.img, l.k + 1 as k, l.ui, l.uj, q.i, list_filter(q.c, lambda x: not list_contains(l.uj, x.j))[1] as b from loc l join seq q on q.img = l.img and q.k = l.k + 1) z) y),
 near as (select img, unnest(ui) as i, unnest(uj) as j from (select img, arg_max(ui, k) as ui, arg_max(uj, k) as uj from loc group by 1) z),
 assigned as (select m.img, m.j, case when p.s >= 0.25 then 'EASY_CORRECT' else 'LOW_CONFIDENCE_CORRECT' end as category from qam m join qap p on p.img = m.img and p.i = m.i union all select img, j, 'CLASS_CONFUSION' from qax union all select img, j, 'LOCALIZATION_FAILURE' from near),
 spare as (select * from qap where s >= 0.25 and not exists (select 1 from used u where u.img = qap.img and u.i = qap.i) and not exists (select 1 from near u where u.img = qap.img and u.i = qap.i)), owned as (select * from gt where exists (select 1 from qam m where m.img = gt.img and m.j = gt.j)),
 owners as (select * from (select *, row_number() over (partition by img, i order by iou desc, j) as k from ({edges('owned', 'spare', 0.0)}) q) z where k = 1 and iou >= 0.5), again as (select img, j, count(*) as n from owners group by 1, 2), top as (select img, j, max(iou) as best from ({edges('gt', 'qap', 0.0)}) q group by 1, 2),
 hardness as (select gt.img, gt.j, gt.c, coalesce(a.category, case when t.best >= 0.1 then 'MATCH_COMPETITION' else 'MISSED_NO_CORRECT_CLASS_PROPOSAL' end) as category, coalesce(d.n, 0) as duplicates from gt left join assigned a on a.img = gt.img and a.j = gt.j left join again d on d.img = gt.img and d.j = gt.j left join top t on t.img = gt.img and t.j = gt.j),
 graded as (select *, category <> 'EASY_CORRECT' or duplicates > 0 as hard from hardness)"""
ORACLES["object_difficulty"] = f"{_DIFFICULTY} select img, j, c, category, duplicates, hard from graded"
ORACLES["difficulty_tiers"] = f"""{_DIFFICULTY} select img, count(*) as n_objects, count(*) filter (hard) as n_hard, count(*) filter (hard and c = 1) as n_hard1, count(*) >= 3 as crowded, count(distinct c) > 1 as multi_class,
 max(case when category = 'MISSED_NO_CORRECT_CLASS_PROPOSAL' then 3 when category in ('CLASS_CONFUSION', 'MATCH_COMPETITION') then 2 when hard then 1 else 0 end) as tier from graded group by 1"""
_RUN = """select '{0}' as run, * from (select count(*) as gt_boxes, count(distinct (img // 100, j)) as gt_objects, count(*) filter (c = 1) as targets from gt) a, (select count(*) as outputs, count(track) > 0 as tracked from {0}) b,
 (select count(*) as matched, count(*) filter (t0 <> track) as id_switches, count(*) filter (track is not null and o0 <> o) as id_transfers, count(*) filter (track is not null and o0 <> o and o0.scene <> o.scene) as scene_id_transfers, count(*) filter (c0 <> oc) as class_flips, count(*) filter (gc = oc) as right_, count(*) filter (gc = 1 and oc = 1) as shown
  from (select *, last_value(track ignore nulls) over (partition by o order by img, j rows between unbounded preceding and 1 preceding) as t0, lag(oc) over (partition by o order by img, j) as c0, lag(o) over (partition by track order by img, j) as o0 from {0}_m) q) c,
 (select avg(k) as mean_ids_per_object from (select count(distinct track) as k from {0}_m where track is not null group by o) q) d, (select count(*) filter (k > 1) as ids_spanning_objects from (select count(distinct o) as k from {0}_m where track is not null group by track) q) e"""
_TRACK = "{0} as (select *, {1} as track from ap), {0}_m as (select hm.img, hm.j, {{'scene': hm.img // 100, 'number': hm.j}} as o, g.c as gc, p.c as oc, p.track from hm join gt g on g.img = hm.img and g.j = hm.j join {0} p on p.img = hm.img and p.i = hm.i)"
ORACLES["hungarian_match"] = f"{HEAD} ap as ({PRED_A}), {assigned()} select * from hm"
ORACLES["tracking_metrics"] = f"""{HEAD} ap as ({PRED_A}), {assigned()}, {_TRACK.format('tracked', 'case when (img + i) % 11 > 0 then i * 2 + img % 2 end')}, {_TRACK.format('plain', 'null::bigint')}, r as ({_RUN.format('tracked')} union all {_RUN.format('plain')})
 select run, tracked, gt_boxes, gt_objects, outputs, matched, outputs - matched as false_positives, case when tracked then id_switches end as id_switches, case when tracked then id_transfers end as id_transfers, case when tracked then scene_id_transfers end as scene_id_transfers, case when tracked then ids_spanning_objects end as ids_spanning_objects,
  case when tracked then mean_ids_per_object end as mean_ids_per_object, class_flips, matched / gt_boxes as recall, matched / outputs as "precision", right_ / matched as class_accuracy, shown / targets as target_recall, 1 - (gt_boxes - matched + outputs - matched + case when tracked then id_switches else 0 end) / gt_boxes as mota from r"""
ORACLES["frame_violations"] = "with o as (select o_orderkey as img, o_orderdate < date '1998-01-01' as truth, o_custkey % 7 <> 0 as output from orders) select distinct img, case when truth then 'ONLY_TRUTH' else 'ONLY_OUTPUT' end as problem from o where truth <> output"

"""DuckDB SQL for the queries of ``queries``, from common parts; seeded parameters are inlined as values."""

from __future__ import annotations

from dataclasses import replace

from .plans.config import FdeConfig, Projection, ams_columns, count_sketch, gray_decode, hyperplanes, lsh_planes
from .queries import BASE, DIMENSION, DOC, NPROBE, QUERIES_N, TOP, WIDE, fixed_centers, fixed_lists
from .sources.store import LATENCY


def values(rows: list[tuple]) -> str:
    show = lambda x: f"[{','.join(map(repr, x))}]::double[]" if isinstance(x, list) else repr(x)
    return "values " + ",".join(f"({','.join(map(show, r))})" for r in rows)


def r6(x: str) -> str:
    return f"round(({x})::double, 6) + 0.0"


TOK = f"""tok as (select (vec_id // 5)::bigint doc_id, (vec_id % 5)::bigint tok, embedding::double[] x, label from embeddings),
qt as (select doc_id qid, tok qtok, x from tok where doc_id < {QUERIES_N}),
dt as (select doc_id, tok, x from tok where doc_id >= {QUERIES_N})"""


def parts(cfg: FdeConfig, prefix: str = "", forced: tuple[int, int] | None = None) -> str:
    """{prefix}p: every token with its raw bits and its partition in each repetition; a partition's number is built by
    appending bits one by one."""
    h = values([(r, b, hv.tolist()) for r, planes in enumerate(hyperplanes(cfg)) for b, hv in enumerate(planes)])
    bit = f"(case b when {forced[0]} then {forced[1]} else bit end)" if forced else "bit"
    return f"""{prefix}h(rep, b, hv) as ({h}),
{prefix}bits as (select doc_id, tok, rep, b, (list_dot_product(x, hv) > 0)::int bit from tok, {prefix}h),
{prefix}codes as (select doc_id, tok, rep, sum(bit << ({cfg.bits} - 1 - b))::bigint raw,
    list_reduce(list_prepend(0, list({bit} order by b)), lambda a, z: (a << 1) + xor(a & 1, z))::bigint part
  from {prefix}bits group by all),
{prefix}p as (select t.doc_id, t.tok, t.x, c.rep, c.raw, c.part from tok t join {prefix}codes c using (doc_id, tok))"""


def cells(name: str, how: str, source: str, where: str, width: int = DIMENSION) -> str:
    """name(doc_id, rep, part, dim, val)"""
    return f"""{name} as (select doc_id, rep, part, dim, {how}(v) val from
  (select doc_id, rep, part, unnest(x) v, unnest(range({width})) dim from {source} where {where}) group by all)"""


IS_Q, IS_D = f"doc_id < {QUERIES_N}", f"doc_id >= {QUERIES_N}"
Q_CELLS, D_CELLS = cells("qc", "sum", "p", IS_Q), cells("dc", "avg", "p", IS_D)
SCORES = """sc as (select q.doc_id qid, d.doc_id, sum(q.val * d.val) score from qc q join dc d using (rep, part, dim) group by all)"""
RANK = "row_number() over (partition by qid order by score desc, doc_id)"
FDE = f"{TOK}, {parts(BASE)}, {Q_CELLS}, {D_CELLS}, {SCORES}, ra as (select *, {RANK} rank from sc)"


def cand(k: int) -> str:
    return f"ca as (select * from ra where rank <= {k})"


def chamfer(tokens: str = "dt") -> str:
    return f"""pr as (select q.qid, q.qtok, d.doc_id, max(list_dot_product(q.x, d.x)) m from qt q, {tokens} d group by all),
ch as (select qid, doc_id, sum(m) score from pr group by all)"""


NORMS = """nm as (select doc_id, tok, x, sqrt(list_dot_product(x, x)) row_norm from dt),
st as (select *, row_number() over (partition by doc_id order by row_norm desc, tok) place from nm)"""
LABELS = f"""lb as (select doc_id, label from (select doc_id, label, count(*) n from tok group by all)
  qualify row_number() over (partition by doc_id order by n desc, label) = 1),
qr as (select q.doc_id qid, d.doc_id, 1 rel from lb q join lb d using (label) where q.{IS_Q} and d.{IS_D})"""
RERANKED = """rr as (select c.qid, c.doc_id, c.rank came, case when c.rank <= {n} then h.score else c.score end score,
  case when c.rank <= {n} then 'rerank' else 'tail' end stage
  from ca c left join ch h using (qid, doc_id) where {keep})"""
RERANK_OUT = f"""select qid, doc_id, {r6("score")} score, rank, stage from (select *,
  row_number() over (partition by qid order by stage, case stage when 'rerank' then -score end, came) rank from rr)"""


def rerank(n: int, keep: str = "true", tokens: str = "dt", extra: str = "", k: int = 20, top: int | None = None) -> str:
    last = f" where rank <= {top}" if top else ""
    return f"with {FDE}, {cand(k)}{extra}, {chamfer(tokens)}, {RERANKED.format(n=n, keep=keep)} {RERANK_OUT}{last}"


def per_query(k: int, ranked: str = "ra", rel: str = "qr", more: str = "") -> str:
    """pq: qid, hit, recall, ndcg (and ``more``, a column of both sides that keys them further)."""
    m = f"{more}, " if more else ""
    on = f"using ({m}qid, doc_id)"
    return f"""gd as (select *, row_number() over (partition by {m}qid order by rel desc, doc_id) place from {rel} where rel > 0),
mt as (select {m}qid, doc_id, g.rel, place, rank from gd g left join (select * from {ranked} where rank <= {k}) r {on}),
pq as (select {m}qid, max((rank is not null)::int)::double hit, avg((rank is not null)::int)::double recall,
  coalesce(sum((2 ^ rel - 1) / log2(rank + 1)) filter (rank is not null), 0)
    / sum((2 ^ rel - 1) / log2(place + 1)) filter (place <= {k}) ndcg from mt group by all)"""


def evaluated(base: str, ks: tuple[int, ...], rel: str = "qr") -> str:
    one = lambda k: f"""select {k}::bigint k, count(*)::bigint queries, {r6("coalesce(avg(hit), 0)")} hit_at_k, {r6("coalesce(avg(recall), 0)")} recall_at_k,
  {r6("coalesce(avg(ndcg), 0)")} ndcg_at_k from (with {per_query(k, "ca", rel)} select * from pq)"""  # noqa: E731
    return f"with {base} " + " union all ".join(map(one, ks))


def truth_pq(k: int, driver: str = "") -> str:
    return f"""tm as (select t.qid, t.doc_id, greatest(t.score, 0) gain, t.rank place, s.rank from tr t
  left join (select * from sy where rank <= {k}) s using (qid, doc_id) where t.rank <= {k} {driver}),
tq as (select qid, avg((rank is not null)::int)::double recall, max((rank is not null)::int)::double hit,
  case when sum(gain / log2(place + 1)) > 0 then coalesce(sum(gain / log2(rank + 1)) filter (rank is not null), 0) / sum(gain / log2(place + 1)) else 0 end ndcg from tm group by qid)"""


TRUTH = f"{FDE}, {cand(20)}, {chamfer()}, tr as (select *, {RANK} rank from ch)"
LONG = f"select doc_id, rep::bigint rep, part::bigint part, dim::bigint dim, {r6('val')} val from "
SCAFFOLD = f"""ev as (select doc_id, rep, part from (select distinct doc_id, rep from p where {IS_D}), (select unnest(range(8)) part))"""
COUNTS = f"""{TOK}, {parts(BASE)}, {SCAFFOLD},
cn as (select e.doc_id, e.rep, e.part, count(p.tok)::bigint cnt from ev e left join p using (doc_id, rep, part) group by all)"""


def filled(rule: str, target: str) -> str:
    """fi(doc_id, rep, part, dim, val): means of partitions, and of empty ones what ``rule`` takes from the nearest."""
    bits = [(p, gray_decode(p) if target == "reference" else p ^ (p >> 1)) for p in range(8)]
    near = f"""tg(part, target) as ({values(bits)}), {SCAFFOLD},
em as (select e.* from ev e anti join p using (doc_id, rep, part)),
ds as (select e.doc_id, e.rep, e.part, p.tok, p.x, bit_count(xor(p.raw, g.target)) dist
  from em e join p on p.doc_id = e.doc_id and p.rep = e.rep join tg g on g.part = e.part)"""
    if rule == "nearest":
        pick = "pk as (select * from ds qualify row_number() over (partition by doc_id, rep, part order by dist, tok) = 1)"
        how = "any_value"
    else:
        pick = "pk as (select * from ds qualify dist = min(dist) over (partition by doc_id, rep, part))"
        how = {"tie_max": "max", "tie_mean": "avg"}[rule]
    return f"{near}, {pick}, {cells('fx', how, 'pk', 'true')}, fi as (from dc union all from fx)"


UTIL = f"""{COUNTS}, ut as (select rep::bigint rep, part::bigint part, count(*) filter (cnt > 0) utilized_docs, count(*) total_docs,
  count(*) filter (cnt > 0) / count(*) * 100 utilization_rate, coalesce(sum(cnt) filter (cnt > 0), 0)::bigint count_sum,
  coalesce(avg(cnt) filter (cnt > 0), 0)::double count_mean, coalesce(median(cnt) filter (cnt > 0), 0)::double count_median,
  coalesce(stddev_pop(cnt) filter (cnt > 0), 0)::double count_std, coalesce(min(cnt) filter (cnt > 0), 0)::double count_min,
  coalesce(max(cnt) filter (cnt > 0), 0)::double count_max from cn group by rep, part)"""
MASKS = f"""{COUNTS}, mk as (select rep::bigint rep, doc_id, string_agg((cnt > 0)::int::varchar, '' order by part) partition_mask,
  sum((cnt > 0)::int)::bigint active_partition_count from cn group by rep, doc_id)"""
REPS = f"""{UTIL}, rs as (select rep, avg(utilization_rate) avg_rate, stddev_samp(utilization_rate) std_rate, min(utilization_rate) min_rate,
  max(utilization_rate) max_rate, sum(count_sum)::bigint total_count, avg(count_mean) avg_count, avg(utilized_docs) avg_docs, count(*)::bigint n_partitions from ut group by rep)"""


def first_by(order: str) -> str:
    return f"(select rep from rs order by {order}, rep limit 1)"


def _columns(names: list[str]) -> str:
    one = lambda c: f"""select '{c}' column_name, {r6(f"avg({c})")} mean, {r6(f"median({c})")} median, {r6(f"stddev_samp({c})")} std,
  {r6(f"min({c})")} min, {r6(f"max({c})")} max, {", ".join(f'{r6(f"quantile_cont({c}, {q})")} {n}' for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))},
  {r6(f"count({c})")} count, {r6(f"sum({c})")} sum from (select {c}::double {c} from events)"""  # noqa: E731
    return " union all ".join(map(one, names))


def ams() -> str:
    cfg = replace(DOC, projection=Projection.AMS, projection_dimension=16)
    columns, signs = ams_columns(cfg)
    m = values([(r, i, int(columns[r][i]), float(signs[r][i])) for r in range(cfg.reps) for i in range(cfg.dimension)])
    return f"""with {TOK}, {parts(BASE)}, am(rep, i, dim, sign) as ({m}),
ex as (select doc_id, tok, rep, part, unnest(x) v, unnest(range({DIMENSION})) i from p where {IS_D}),
pj as (select doc_id, tok, rep, part, dim, sum(v * sign) v from ex join am using (rep, i) group by all),
al as (select * from (select distinct doc_id, tok, rep, part from ex) cross join (select unnest(range(16)) dim)),
pz as (select doc_id, tok, rep, part, dim, coalesce(v, 0) v from al left join pj using (doc_id, tok, rep, part, dim))
select doc_id, rep::bigint rep, part, dim::bigint dim, {r6("avg(v)")} val from pz group by all"""


def sketch() -> str:
    bucket, sign = count_sketch(BASE.length, 32, BASE.seed)
    m = values([(i, int(b), float(s)) for i, (b, s) in enumerate(zip(bucket, sign, strict=True))])
    return f"""with {TOK}, {parts(BASE)}, {D_CELLS}, cs(flat, bucket, sign) as ({m})
select doc_id, bucket::bigint bucket, {r6("sum(sign * val)")} val from dc join cs on flat = (rep * 8 + part) * {DIMENSION} + dim group by all"""


VARIANCE = f"""{TOK}, {parts(BASE)}, {Q_CELLS}, {D_CELLS}, nd as (select count(distinct doc_id) n from dt),
de as (select e.doc_id, e.rep, e.part, e.dim, coalesce(d.val, 0) val from (select doc_id, rep, part, dim from
  (select distinct doc_id from dt), (select unnest(range(2)) rep), (select unnest(range(8)) part), (select unnest(range({DIMENSION})) dim)) e left join dc d using (doc_id, rep, part, dim)),
va as (select rep::bigint rep, (part * {DIMENSION} + dim)::bigint local_idx, var_pop(val) variance from de group by all),
bs as (select *, rep * {8 * DIMENSION} + local_idx global_idx from va
  qualify row_number() over (partition by rep order by variance desc, local_idx desc) <= {8 * DIMENSION // 4})"""


def centers(fill: bool) -> str:
    c = values([(r, p, v.tolist()) for r, ps in enumerate(fixed_centers()) for p, v in enumerate(ps)])
    base = f"""with {TOK}, ce(rep, part, c) as ({c}),
di as (select doc_id, tok, x, rep, part, list_distance(x, c) dist from dt, ce),
p as (select * from di qualify row_number() over (partition by doc_id, tok, rep order by dist, part) = 1), {cells("dc", "avg", "p", "true")}"""
    if not fill:
        return f"{base} {LONG} dc"
    return f"""{base}, pk as (select * from di anti join (select distinct doc_id, rep, part from p) using (doc_id, rep, part)
  qualify row_number() over (partition by doc_id, rep, part order by dist, tok) = 1), {cells("fx", "any_value", "pk", "true")}
{LONG} (from dc union all from fx)"""


def lists(nprobe: int) -> str:
    return f"""ls(list_id, rep, part, c) as ({values(fixed_lists())}),
lc as (select list_id::bigint list_id, rep, part, unnest(c) c, unnest(range({DIMENSION})) dim from ls),
la as (select doc_id, list_id from (select doc_id, list_id, sum(val * c) s from dc join lc using (rep, part, dim) group by all)
  qualify row_number() over (partition by doc_id order by s desc, list_id) = 1),
lp as (select doc_id qid, list_id from (select doc_id, list_id, sum(val * c) s from qc join lc using (rep, part, dim) group by all)
  qualify row_number() over (partition by doc_id order by s desc, list_id) <= {nprobe})"""


def hashes(bits: int, tables_: int) -> str:
    m = values([(t, b, v.tolist()) for t, planes in enumerate(lsh_planes(DIMENSION, bits, tables_)) for b, v in enumerate(planes)])
    return f"""lh(table_id, b, hv) as ({m}),
ha as (select table_id::bigint table_id, sum((list_dot_product(x, hv) >= 0)::bigint << ({bits} - 1 - b))::bigint hash, doc_id, tok from tok, lh group by all)"""


def ablation() -> str:
    runs = [(-1, None), *((2 * b + v, (b, v)) for b in range(3) for v in (0, 1))]
    ctes, unions = [], []
    for run, forced in runs:
        n = f"r{run}_".replace("-", "m")
        ctes.append(f"{parts(BASE, n, forced)}, {cells(n + 'd', 'avg', n + 'p', IS_D)}")
        unions.append(f"select {run} run, q.doc_id qid, d.doc_id, sum(q.val * d.val) score from qc q join {n}d d using (rep, part, dim) group by all")
    return f"""with {TOK}, {parts(BASE)}, {Q_CELLS}, {LABELS}, {", ".join(ctes)}, al as ({" union all ".join(unions)}),
rk as (select *, row_number() over (partition by run, qid order by score desc, doc_id) rank from al),
ql as (select run, qr.* from qr, (select distinct run from rk)), {per_query(10, "rk", "ql", "run")},
me as (select run, avg(recall) recall, avg(ndcg) ndcg from pq group by run),
dr as (select (m.run // 2)::bigint bit, (m.run % 2)::bigint forced, m.recall, m.ndcg, f.recall - m.recall recall_drop, f.ndcg - m.ndcg ndcg_drop
  from me m, me f where m.run >= 0 and f.run = -1)"""


def by_repetition(by: str = "recall") -> str:
    return f"""with {TOK}, {parts(WIDE)}, {Q_CELLS}, {D_CELLS}, {LABELS},
rsc as (select rep, q.doc_id qid, d.doc_id, sum(q.val * d.val) score from qc q join dc d using (rep, part, dim) group by all),
rk as (select *, row_number() over (partition by rep, qid order by score desc, doc_id) rank from rsc),
ql as (select rep, qr.* from qr, (select distinct rep from rk)),
me as (select rep::bigint rep, avg(recall) recall, avg(ndcg) ndcg from (with {per_query(10, "rk", "ql", "rep")} select * from pq) group by rep),
tp as (select pc::bigint percent, rep from (select *, row_number() over (order by {by} desc, rep) place from me),
  (select unnest([20, 40, 60, 80]) pc) where place <= greatest(1, {WIDE.reps} * pc // 100))"""


def combined(by: str) -> str:
    return f"""{by_repetition(by)}, cr as (select percent, qid, doc_id, sum(score) score from rsc join tp using (rep) group by all),
rc as (select *, row_number() over (partition by percent, qid order by score desc, doc_id) rank from cr), qc2 as (select percent, qr.* from qr, (select distinct percent from tp)),
{per_query(10, "rc", "qc2", "percent")} select percent, {r6('avg(recall)')} recall, {r6('avg(ndcg)')} ndcg from pq group by percent"""


def grid() -> str:
    out = []
    for name, cfg in (("r1", replace(BASE, reps=1)), ("r2", BASE)):
        base = f"{TOK}, {parts(cfg)}, {Q_CELLS}, {D_CELLS}, {SCORES}, ra as (select *, {RANK} rank from sc), {LABELS}, {per_query(10)}"
        out.append(f"select '{name}' setting, {r6('avg(recall)')} recall, {r6('avg(ndcg)')} ndcg from (with {base} select * from pq)")
    return " union all ".join(out)


def latency() -> str:
    minus = ", ".join(f"-1.0::double {c}" for c in ("rerank_compute_ms", "rerank_io_ms", "wait_ms", "dup_ratio", "read_bytes", "minflt", "majflt", "docloads", "uniqdocs", "mean_pos_delta", "p95_pos_delta"))
    return f"select event_id qid, {r6('coalesce(abs(value) / 10, -1)')} ann_ms, {r6('coalesce(case when user_id % 2 = 0 then value * 2 end, -1)')} rerank_ms, {minus} from events"


def sample() -> str:
    import random

    draw = random.Random(42)
    rows = values([(i, draw.randrange(20)) for i in range(30)])
    return f"""with b as (select item_id, row_number() over (order by item_id) - 1 place from benchmark qualify place < 20), d(i, pick) as ({rows})
select item_id::varchar || '__rep' || i qid, item_id * 2 doc_id, 1::bigint rel from d join b on place = pick"""


TOP_OUT = f"select qid, doc_id, {r6('score')} score, rank from"
CHAMFER_TOP = f"with {TOK}, {chamfer()} {TOP_OUT} (select *, {RANK} rank from ch) where rank <= {TOP}"
FDE_TOP = f"with {FDE} {TOP_OUT} ra where rank <= {TOP}"

ORACLES: dict[str, str] = {
    "fde_topk": FDE_TOP,
    "fde_scan_topk": FDE_TOP,
    "stored_index": FDE_TOP,
    "fde_full_ranking": f"""with {FDE}, ev as (select qid, doc_id, coalesce(score, 0) score from (select distinct qid from qt) cross join (select distinct doc_id from dt) left join sc using (qid, doc_id))
{TOP_OUT} (select *, {RANK} rank from ev)""",
    "chamfer_bruteforce": CHAMFER_TOP,
    "append_truth": CHAMFER_TOP,
    "chamfer_candidates": f"with {FDE}, {cand(20)}, {chamfer()} select qid, doc_id, {r6('h.score')} score from ca join ch h using (qid, doc_id)",
    "rerank_with_tail": rerank(8),
    "rerank_without_tail": rerank(8, "c.rank <= 8"),
    "rerank_sketch": rerank(8, tokens="sk", extra=f", {NORMS}, sk as (select * from st where place <= 2)"),
    "rerank_half": rerank(20, tokens="hf", extra=", hf as (select * from dt where tok < 2)"),
    "streaming_search": rerank(8, k=8, top=TOP),
    "fde_average_long": f"with {TOK}, {parts(BASE)}, {D_CELLS} {LONG} dc",
    "fde_sum_long": f"with {TOK}, {parts(BASE)}, {Q_CELLS} {LONG.replace('doc_id', 'doc_id qid')} qc",
    "fill_nearest": f"with {TOK}, {parts(BASE)}, {D_CELLS}, {filled('nearest', 'reference')} {LONG} fi",
    "fill_nearest_canonical": f"with {TOK}, {parts(BASE)}, {D_CELLS}, {filled('nearest', 'canonical')} {LONG} fi",
    "fill_tie_max": f"with {TOK}, {parts(BASE)}, {D_CELLS}, {filled('tie_max', 'reference')} {LONG} fi",
    "fill_tie_mean": f"with {TOK}, {parts(BASE)}, {D_CELLS}, {filled('tie_mean', 'reference')} {LONG} fi",
    "fde_filled_topk": f"""with {TOK}, {parts(BASE)}, {Q_CELLS}, {D_CELLS}, {filled('nearest', 'reference')},
{SCORES.replace('join dc', 'join fi')} {TOP_OUT} (select *, {RANK} rank from sc) where rank <= {TOP}""",
    "partition_indices": f"with {TOK}, {parts(BASE)} select doc_id, tok, rep::bigint rep, raw, part from p where {IS_D}",
    "bit_forced": f"with {TOK}, {parts(BASE, forced=(1, 1))}, {D_CELLS} {LONG} dc",
    "partition_counts": f"with {COUNTS} select doc_id, rep::bigint rep, part::bigint part, cnt from cn",
    "ams_projection": ams(),
    "count_sketch": sketch(),
    "bit_selection": f"with {VARIANCE} select rep, local_idx, global_idx, {r6('variance')} variance from bs",
    "bit_selection_scores": f"""with {VARIANCE}, {SCORES.replace('group by all', f"semi join bs b on b.rep = q.rep and b.local_idx = q.part * {DIMENSION} + q.dim group by all")}
{TOP_OUT} (select *, {RANK} rank from sc) where rank <= {TOP}""",
    "center_partitions": centers(False),
    "center_fill": centers(True),
    "hash_encoder": """select doc_id, count(*)::bigint n_tokens, 8::bigint dimension from
(select doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) w from documents) where w <> '' group by doc_id""",
    "ivf_assign": f"with {FDE}, {lists(2)} select * from la",
    "ivf_probe": f"with {FDE}, {lists(2)}, pb as (select s.* from sc s join la using (doc_id) join lp using (qid, list_id)) {TOP_OUT} (select *, {RANK} rank from pb) where rank <= {TOP}",
    "ivf_stored": f"with {FDE}, {lists(NPROBE)}, pb as (select s.* from sc s join la using (doc_id) join lp using (qid, list_id)) {TOP_OUT} (select *, {RANK} rank from pb) where rank <= {TOP}",
    "ivf_recall": f"with {FDE}, {lists(6)} " + " union all ".join(f"select {n}::bigint nprobe, (select {r6('avg((list_id is not null)::int)')} from (with {lists(n)} select l.list_id from ra join la using (doc_id) left join lp l on l.qid = ra.qid and l.list_id = la.list_id where rank <= {TOP})) recall" for n in range(1, 7)),
    "lsh_stored": f"with {TOK}, {hashes(6, 3)} select q.doc_id qid, d.doc_id, count(*)::bigint hits from ha q join ha d using (table_id, hash) where q.{IS_Q} and d.{IS_D} group by all",
    "lsh_buckets": f"with {TOK}, {hashes(12, 3)} select * from ha where {IS_D}",
    "lsh_probe": f"with {TOK}, {hashes(6, 3)} select q.doc_id qid, d.doc_id, count(*)::bigint hits from ha q join ha d using (table_id, hash) where q.{IS_Q} and d.{IS_D} group by all",
    "doc_sketch_topl": f"with {TOK}, {NORMS} select doc_id, tok, {r6('row_norm')} row_norm from st where place <= 2",
    "half_front": f"with {TOK} select doc_id, tok from dt where tok < 2",
    "half_back": f"with {TOK} select doc_id, tok from dt where tok >= 3",
    "half_stride2": f"with {TOK} select doc_id, tok from dt where tok < 1 or tok >= 4",
    "block_max_norm": f"with {TOK}, {NORMS} select doc_id, tok // 2 block, count(*)::bigint n_rows, {r6('max(row_norm)')} max_norm from nm group by all",
    "row_spans": f"""with {TOK}, {NORMS}, i as (select doc_id, tok, tok - row_number() over (partition by doc_id order by tok) island from st where place <= 3)
select doc_id, min(tok) start, count(*)::bigint length from i group by doc_id, island""",
    "pack_rows": f"with {TOK} select doc_id, tok, tok // 2 block, row_number() over (order by doc_id, tok) - 1 row from dt",
    "retrieval_metrics": evaluated(f"{FDE}, {cand(20)}, {LABELS}", (1, 5, 10)),
    "graded_metrics": evaluated(f"{FDE}, {cand(20)}, {LABELS}, gr as (select qid, doc_id, doc_id % 3 rel from qr)", (5, 10), "gr"),
    "per_query_metrics": f"with {FDE}, {LABELS}, {per_query(10)} select qid, {r6('hit')} hit, {r6('recall')} recall, {r6('ndcg')} ndcg from pq",
    "metric_summary": f"with {FDE}, {LABELS}, {per_query(10)} " + " union all ".join(f"select '{c}' metric, {r6(f'min({c})')} min, {r6(f'avg({c})')} avg, {r6(f'max({c})')} max from pq" for c in ("recall", "ndcg")),
    "truth_metrics": f"with {TRUTH}, sy as (from ca) " + " union all ".join(f"select {k}::bigint k, count(*)::bigint queries, {r6('avg(recall)')} recall_at_k, {r6('avg(hit)')} hit_at_k, {r6('avg(ndcg)')} ndcg_at_k from (with {truth_pq(k)} select * from tq)" for k in (1, 5, 10)),
    "truth_metrics_system": f"with {TRUTH}, sy as (from ca), {truth_pq(10, 'and t.qid in (select qid from sy)')} select qid, {r6('recall')} recall, {r6('hit')} hit, {r6('ndcg')} ndcg from tq",
    "qrels_overlap": f"with {FDE}, {cand(20)}, {LABELS}, d as (select distinct doc_id, doc_id in (select doc_id from ca) ok from qr) select count(*)::bigint relevant, count(*) filter (ok)::bigint indexed, {r6('count(*) filter (ok) / greatest(count(*), 1)')} overlap from d",
    "partition_mask": f"with {MASKS} select * from mk",
    "masking_summary": f"with {MASKS} select rep, count(*)::bigint n_docs, {r6('avg(active_partition_count)')} mean, {r6('median(active_partition_count)')} median, min(active_partition_count) min, max(active_partition_count) max, {r6('stddev_samp(active_partition_count)')} std from mk group by rep",
    "partition_utilization": f"with {UTIL} select rep, part, utilized_docs, total_docs, count_sum, {', '.join(f'{r6(c)} {c}' for c in ('utilization_rate', 'count_mean', 'count_median', 'count_std', 'count_min', 'count_max'))} from ut",
    "utilization_summary": f"with {UTIL} select rep, {r6('avg(utilization_rate)')} mean_rate, arg_min(part, (-utilization_rate, part)) most_used, arg_min(part, (utilization_rate, part)) least_used, sum(count_sum)::bigint total_count from ut group by rep",
    "repetition_stats": f"with {REPS} select rep, total_count, n_partitions, {', '.join(f'{r6(c)} {c}' for c in ('avg_rate', 'std_rate', 'min_rate', 'max_rate', 'avg_count', 'avg_docs'))} from rs",
    "repetition_extremes": f"with {REPS} select {first_by('avg_rate desc')} best_rate, {first_by('avg_rate')} worst_rate, {first_by('total_count desc')} most_tokens, {first_by('total_count')} fewest_tokens",
    "column_stats": _columns(["value", "user_id"]),
    "duplicate_ratio": f"""with {FDE}, b as (select qid, (row_number() over (order by qid) - 1) // 4 batch_id from (select distinct qid from ra))
select batch_id, count(*)::bigint total_docs, count(distinct doc_id)::bigint unique_docs, {r6('1 - count(distinct doc_id) / count(*)')} dup_ratio from ra join b using (qid) where rank <= 8 group by batch_id""",
    "access_locality": f"""with {FDE}, dl as (select qid, doc_id, abs(doc_id - lag(doc_id) over (partition by qid order by rank)) delta from ra where rank <= 10)
select qid, count(*)::bigint docloads, count(distinct doc_id)::bigint uniqdocs, {r6('avg(delta)')} mean_pos_delta,
  {r6('list_sort(list(delta) filter (delta is not null))[(floor(0.95 * (count(delta) - 1)) + 1)::int]')} p95_pos_delta from dl group by qid""",
    "latency_log": latency(),
    "latency_means": f"with l as ({latency()}) " + " union all ".join(f"select '{c}' metric, count(*) filter ({c} >= 0)::bigint n, {r6(f'avg({c}) filter ({c} >= 0)')} mean from l" for c in LATENCY[1:]),
    "cumulative_timing": f"""with b as (select event_id // 500 batch, event_type phase, sum(abs(value)) s from events group by all)
select batch, phase, {r6('s')} as seconds, {r6('sum(s) over (partition by phase order by batch)')} as total from b""",
    "stream_waits": f"""with t as (select event_id qid, ts, abs(value) v, date_trunc('minute', ts) + interval 1 minute b from events),
p as (select b, count(*)::bigint n, sum(v) / count(*) s from t group by b)
select qid, strftime(b, '%Y-%m-%d %H:%M:%S') batch_start, {r6('(epoch_us(b) - epoch_us(ts)) / 1e6')} wait_s, n batch_size, {r6('s')} shared_s from t join p using (b)""",
    "query_cache": f"with {TOK}, {parts(BASE)}, {Q_CELLS} select doc_id qid, ((rep * 8 + part) * {DIMENSION} + dim)::bigint flat, {r6('val')} val from qc where val <> 0",
    "retriever_report": " union all ".join(f"select '{name}' retriever, * from ({sql})" for name, sql in (
        ("fde", evaluated(f"{FDE}, {cand(20)}, {LABELS}", (10,))),
        ("fde+rerank", evaluated(f"{FDE}, {cand(20).replace('ca as', 'c0 as')}, {chamfer()}, rr as (select c.qid, c.doc_id, c.rank came, case when c.rank <= 8 then -h.score end s from c0 c left join ch h using (qid, doc_id)), ca as (select qid, doc_id, row_number() over (partition by qid order by s is null, s, came) rank from rr), {LABELS}", (10,))),
        ("chamfer", evaluated(f"{TOK}, {chamfer()}, ca as (select * from (select *, {RANK} rank from ch) where rank <= 20), {LABELS}", (10,))))),
    "event_windows": f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, event_type kind, count(*)::bigint n, {r6('avg(value)')} mean_value from events group by all",
    "bit_ablation": f"{ablation()} select bit, forced, {', '.join(f'{r6(c)} {c}' for c in ('recall', 'ndcg', 'recall_drop', 'ndcg_drop'))} from dr",
    "ablation_summary": f"{ablation()}, ev2 as (from dr union all select bit, -1, recall, ndcg, recall_drop, ndcg_drop from dr) select forced, {r6('avg(recall_drop)')} mean_recall_drop, {r6('avg(ndcg_drop)')} mean_ndcg_drop, {r6('stddev_pop(recall_drop)')} std_recall_drop, arg_min(bit, (-recall_drop, bit)) worst_bit from ev2 group by forced",
    "repetition_ablation": f"{by_repetition()} select rep, {r6('recall')} recall, {r6('ndcg')} ndcg from me",
    "top_repetitions": f"{by_repetition()} select * from tp",
    "top_repetitions_ndcg": f"{by_repetition('ndcg')} select * from tp",
    "combined_repetitions": combined("recall"),
    "combined_repetitions_ndcg": combined("ndcg"),
    "parameter_grid": grid(),
    "qrels_filter": "select doc_id::varchar qid, (doc_id + 1)::varchar doc_id, 1::bigint rel from labels where quality > 0",
    "query_keys": "select item_id qid, sha1(item_id || '||' || text) query_key from benchmark",
    "missing_documents": "select doc_id, lang from documents anti join labels using (doc_id)",
    "resolve_sources": "select doc_id, case when doc_id % 3 = 0 then 'external' when doc_id % 2 = 0 then 'internal' else 'encoded' end source from documents",
    "query_sample": sample(),
}

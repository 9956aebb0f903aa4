"""DuckDB SQL of the registered queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Word lists of a table's texts, A-Z lower-cased.
_WORDS = r"""select {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w from {table}"""

#: Distinct 5-word shingles; a shorter text's whole sequence is its one shingle.
_SHINGLES = """select {key}, unnest(case when len(w) >= 5 then list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from ({words})"""


def _shingles(table: str, key: str) -> str:
    return _SHINGLES.format(key=key, words=_WORDS.format(key=key, table=table, upper=_UPPER, lower=_LOWER))


_OP2 = f"""
with recursive s as materialized ({_shingles("documents", "doc_id")}),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as materialized (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
u as materialized (select a, b from e union all select b, a from e),
r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, u.b from r join u on u.a = r.reached)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select doc_id, min(reached) as component_id from r group by doc_id) c using (doc_id)
"""

_OP3 = f"""
with d as ({_shingles("documents", "doc_id")}), b as ({_shingles("benchmark", "item_id")}),
n as (select item_id, count(*) as n from b group by item_id)
select d.doc_id, b.item_id, n.n::bigint as n_item, count(*)::bigint as n_shared
from d join b using (g) join n using (item_id) group by all having 100 * count(*) >= 75 * n.n
"""

_OP10 = r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
q as (select *, regexp_replace(host, ':\d*$', '') as bare from p),
k as (select *, case when regexp_matches(bare, '^[0-9.]+$') then bare when two in ('ac.uk','co.jp','co.uk','com.au','com.br','gov.uk','org.uk')
        then array_to_string(string_split(bare, '.')[-3:], '.') else two end as domain,
    case when regexp_matches(bare, '^[0-9.]+$') then '' when two in ('ac.uk','co.jp','co.uk','com.au','com.br','gov.uk','org.uk') then two else string_split(bare, '.')[-1] end as suffix
    from (select *, array_to_string(string_split(bare, '.')[-2:], '.') as two from q)),
o as (select k.page_id, host, domain, suffix, (quality = 0 or toxic = 1)::bigint as bad from k
    join labels l on l.doc_id = try_cast(regexp_extract(path, '/(\d{1,18})(?:\D|$)', 1) as bigint) where quality is not null and toxic is not null),
h as (select host, domain, suffix, count(*) as n, sum(bad) as bad from o group by all),
dm as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
sx as (select suffix, sum(n) as n, sum(bad) as bad from dm group by all),
w as (select coalesce(sum(bad), 0) + 1.0 as a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1.0 as b from sx),
base as (select a / (a + b) as mean from w),
ms as (select 1 / least(greatest(coalesce((sum(n * pow(bad / n - mean, 2) / (mean * (1 - mean))) - count(*)) / nullif(sum(n - 1), 0), 1e-4), 1e-4), 0.5) - 1 as m from sx, base),
ps as (select suffix, bad + m * mean as a, n - bad + m * (1 - mean) as b from sx, ms, base),
d1 as (select dm.*, a / (a + b) as mean from dm join ps using (suffix)),
md as (select 1 / least(greatest(coalesce((sum(n * pow(bad / n - mean, 2) / (mean * (1 - mean))) - count(*)) / nullif(sum(n - 1), 0), 1e-4), 1e-4), 0.5) - 1 as m from d1),
pd as (select domain, bad + m * mean as a, n - bad + m * (1 - mean) as b from d1, md),
h1 as (select h.*, a / (a + b) as mean from h join pd using (domain)),
mh as (select 1 / least(greatest(coalesce((sum(n * pow(bad / n - mean, 2) / (mean * (1 - mean))) - count(*)) / nullif(sum(n - 1), 0), 1e-4), 1e-4), 0.5) - 1 as m from h1),
ph as (select host, bad + m * mean as a, n - bad + m * (1 - mean) as b from h1, mh),
j as (select k.*, coalesce(ph.a, pd.a, ps.a, w.a) as a, coalesce(ph.b, pd.b, ps.b, w.b) as b
    from k left join ph using (host) left join pd using (domain) left join ps using (suffix), w),
v as (select *, a / (a + b) as mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from j),
f as (select *, case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from v)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when bound > 0.5 then 'block' else 'allow' end as verdict,
    round(mean, 6) as bad_mean, round(bound, 6) as bad_bound from f
"""

_OP11 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by all),
m as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int as step, 1 << (ascii(filter_order[step]) - 65) as own, coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)]), 0)::int as earlier from o, range(1, 6) r(step)),
r as (select part, filter_order, step, own, sum(n) filter (mask & (earlier | own) = 0) as kept, sum(n) filter (mask & earlier = 0 and mask & own > 0) as removed, sum(n) filter (mask & earlier > 0 and mask & own > 0) as redundant,
    sum(n) filter (mask = own) as unique_fails, sum(good) filter (mask & earlier = 0 and mask & own > 0) as good_lost, sum(toxic) filter (mask & earlier = 0 and mask & own > 0) as toxic_lost from m, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, own))::bigint as shapley from r
"""

#: The exact ranking; the query's factor lets it miss neighbours (none on the given small tables).
_OP12 = """
with v as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(strlen({text})::varchar || ':' || {text}, '-'))"
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split(doc_id::varchar, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"

#: Levels of all trees by recursion; ``up`` are siblings on either side of a row's ancestor, level by level.
_OP13 = f"""
with recursive d as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from (select doc_id, lang, {_LEAF.format(text="text")} as leaf,
    case when {_CRC} % 3 = 0 then {_LEAF.format(text="translate(text, '" + _UPPER + "', '" + _LOWER + "')")} end as other from documents)),
t(lang, depth, pos, n, h) as (select lang, 0, pos, n, leaf from d union all select lang, depth + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lang, depth, pos // 8, n),
l as materialized (select lang, depth as top, h as subroot, row_number() over (order by lang is not null, lang::blob) - 1 as pos, count(*) over () as n from t where n = 1),
u(depth, pos, n, h) as (select 0, pos, n, subroot from l union all select depth + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by depth, pos // 8, n),
nodes as materialized (select lang, depth, pos, h from t where n > 1 union all select l.lang, top + depth, u.pos, h from u, l),
place as (select d.lang, d.pos, depth, case when depth < top then d.pos // (8 ** depth)::bigint else l.pos // (8 ** (depth - top))::bigint end as at from d join l on d.lang is not distinct from l.lang, range(0, 60) r(depth)
    where depth < top + (select max(depth) from u)),
up as materialized (select p.lang, p.pos, p.depth, string_agg(h, '' order by n.pos) filter (n.pos < p.at) as lefts, string_agg(h, '' order by n.pos) filter (n.pos > p.at) as rights
    from place p left join nodes n on n.lang is not distinct from p.lang and n.depth = p.depth and n.pos // 8 = p.at // 8 and n.pos <> p.at group by all),
f(lang, pos, depth, h) as (select lang, pos, 0, coalesce(other, leaf) from d union all select f.lang, f.pos, f.depth + 1, sha256(coalesce(lefts, '') || f.h || coalesce(rights, '')) from f join up on up.lang is not distinct from f.lang and up.pos = f.pos and up.depth = f.depth)
select d.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root as verified from d join l on d.lang is not distinct from l.lang, (select h as root from u where n = 1)
left join (select lang, pos, sha256(string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' order by depth)) as proof from up group by all) p on p.lang is not distinct from d.lang and p.pos = d.pos
join (select lang, pos, arg_max(h, depth) as folded_root from f group by all) e on e.lang is not distinct from d.lang and e.pos = d.pos
"""

SQL = {
    "op2_near_duplicates": _OP2,
    "op3_contained_items": _OP3,
    "op10_url_filter": _OP10,
    "op11_filter_audit": _OP11,
    "op12_neighbours": _OP12,
    "op13_manifest": _OP13,
}

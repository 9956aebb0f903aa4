"""DuckDB SQL of the registered queries, over the same tables; written apart from the Spark plans."""

QUESTION = "The reading of thtion and the erin, in thand house; que de la ver und"
DIRECTION = "the thtion of erin LA que"
TERM = "ThTion"

#: Warnings that the display rules are tried on.
WARNINGS = ("Xfyun Spark embedding failed: x", "Local bge-m3 embedding request failed (y)", "OPENAI_API_KEY missing; mock vectors used", "DEEPSEEK_API_KEY missing; mock chat used", "other", "mock chat only", "mock embeddings in use")

_NOTE = "本地 bge-m3 暂不可用。请启动 Ollama 并运行 `ollama pull bge-m3`，以启用本地语义检索。"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _tokens(x: str) -> str:
    cjk = rf"array_to_string(regexp_extract_all({_fold(x)}, '[\x{{3400}}-\x{{9fff}}]'), '')"
    return f"list_distinct(list_concat(regexp_extract_all({_fold(x)}, '[a-z0-9_]{{2,}}'), [substring({cjk}, i, 2) for i in range(1, length({cjk}))]))"


CHUNKS = r"""norm as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents),
cut as (select doc_id, t, unnest(range(0, (length(t) + 899) // 900)) as i from norm where t <> ''),
chunks as (select doc_id || '-' || (i + 1) as chunk_id, doc_id::varchar as doc_id, (i + 1)::bigint as page, substring(t, i * 900 + 1, 900) as text from cut)"""

PAPERS = """papers as (select d.doc_id::varchar as doc_id, d.source || '-' || d.doc_id || '.pdf' as title,
    timestamp '2024-01-01' + to_minutes(d.doc_id) as created_at, coalesce(l.quality = 1, false) as is_favorite, [d.lang, d.source] as tags
    from documents d left join labels l using (doc_id))"""
_PAPER = "doc_id, title, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, is_favorite, array_to_string(tags, ',') as tags"

GAPS = """gaps as (select c_custkey::varchar as gap_id, c_name as title, case when c_acctbal >= 5000 then 'high' else 'mid' end as value_level,
    c_mktsegment as description, [c_mktsegment, 'nation-' || c_nationkey] as evidence, c_custkey as seq from customer)"""

EXPERIMENTS = """lines as (select distinct l_orderkey, l_partkey from lineitem),
lists as (select l_orderkey, list_sort(list(distinct p_name)) as datasets, list_sort(list(distinct p_brand)) as metrics, list_sort(list(distinct p_type)) as baselines,
    list_transform(list_sort(list(distinct p_partkey)), lambda x: x::varchar) as keys from lines join part on l_partkey = p_partkey group by l_orderkey),
experiments as (select o_orderkey::varchar as experiment_id, o_custkey::varchar as gap_id, o_orderpriority || ' ' || printf('%.2f', o_totalprice) as objective,
    coalesce(datasets, []) as datasets, coalesce(metrics, []) as metrics, coalesce(baselines, []) as baselines, coalesce(keys, [])[:5] as support, o_orderkey as seq
    from orders left join lists on l_orderkey = o_orderkey where o_orderstatus = 'F')"""
_EXPERIMENT = "experiment_id, gap_id, objective, array_to_string(datasets, '; ') as datasets, array_to_string(metrics, '; ') as metrics, array_to_string(baselines, '; ') as baselines, array_to_string(support, '; ') as support_papers"

NOTES = "notes as (select conv_id || '-' || turn as note_id, role || ' ' || conv_id as title, text as content from conversations where role = 'user')"

VECTORS = """vectors as (select vec_id::varchar as chunk_id, vec_id as seq, (vec_id % 50)::varchar as doc_id, ['t' || label, case when vec_id % 2 = 1 then 'odd' else 'even' end] as tags,
    case when vec_id % 2 = 1 then 'import' else 'upload' end as module_source, embedding::double[] as e from embeddings),
q as (select embedding::double[] as q from embeddings order by vec_id limit 1)"""
_COSINE = "list_cosine_similarity(e, q)"
_L2 = "1 / (1 + pow(list_distance(e, q), 2))"


def _ranked(select: str, order: str, limit: int) -> str:
    return f"select *, row_number() over (order by {order}) as rank from ({select}) order by {order} limit {limit}"


EVENTS = "entries as (select user_id::varchar as chunk_id, 'v2:mock:' || event_type || ':16' as profile_key, ['ready', 'pending', 'failed'][event_id % 3 + 1] as status, ts, event_id from events)"
MIGRATIONS = "migrations as (select user_id || '-' || event_type as migration_id, 'v2:mock:' || event_type || ':16' as profile_key, ['complete', 'running', 'failed'][event_id % 3 + 1] as status, ts, event_id from events)"

WORKS = """counted as (select l_partkey, count(distinct l_orderkey) as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1),
works as (select p_partkey as k, p_name as title, 1990 + p_size % 36 as year, coalesce(n, 0) as n, coalesce(r, 0) as r from part left join counted on p_partkey = l_partkey),
scored as (select *, greatest(1.0::double, (n + 8 * r)::double + 0.5::double * (year - 2000)) as score from works)"""
CITATIONS = """dl as (select distinct l_orderkey, l_partkey from lineitem),
cites as (select m.s as source, l_partkey as target from dl join (select l_orderkey, min(l_partkey) as s from dl group by 1) m using (l_orderkey) where l_partkey <> m.s)"""


def _nodes(n: int) -> str:
    return f"kept as (select k, 'openalex-' || k as id, title, year, score, row_number() over (order by score desc, k) as rank from scored qualify rank <= {n})"


LABELLED = """labelled as (select p_partkey as part_id, 'The method uses ' || p_name || '. ' ||
    case when p_partkey % 5 <> 0 then 'Dataset: ' || p_name || ', ' || p_brand || ' and ' || p_type || '. ' else '' end ||
    case when p_partkey % 7 <> 0 then 'Metrics : size ' || p_size || '; kept. ' else '' end ||
    case when p_partkey % 3 <> 0 then 'baseline: ' || p_brand || chr(10) else '' end || 'Training loss is low! End.' as text from part)"""


def _label(names: list[str]) -> str:
    out = "'unknown'"
    for name in reversed(names):
        pattern = rf"(?i)\b{name}s?\s*:\s*([^.\n;]+)"
        if not name.isascii():
            pattern = rf"(?i)(?:^|[^\pL\pN_]){name}s?\s*:\s*([^.\n;]+)"
        values = f"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '{pattern}', 1), ',| and '), lambda x: trim(x)), lambda x: x <> ''), '|')"
        out = f"case when regexp_matches(text, '{pattern}') then {values} else {out} end"
    return out


_DATASETS, _METRICS, _BASELINES = _label(["Dataset", "Datasets", "Data", "数据集"]), _label(["Metric", "Metrics", "Evaluation", "指标"]), _label(["Baseline", "Baselines", "基线"])
_DOC_TEXTS = "joined as (select doc_id, string_agg(text, ' ' order by page, chunk_id) as text, array_to_string(list('page ' || page || ', chunk ' || chunk_id order by page, chunk_id)[:5], '{sep}') as evidence from chunks group by doc_id)"

_RISKS = {
    "d": "unknown: 论文上下文未提供明确数据集，复现数据准备风险高。",
    "m": "unknown: 论文上下文未提供明确指标定义，评估可比性风险高。",
    "b": "unknown: 论文上下文未提供明确基线，难以判断对照实验。",
    "": "page/chunk evidence: 已提取数据集、指标和基线；仍需人工核对超参数、实现细节和随机种子。",
}


def _shown(case: str, vectors: str, chat: str) -> str:
    return f"""case when contains({case}, 'Xfyun Spark embedding failed') then '' when contains({case}, 'Local bge-m3 embedding request failed') then '{_NOTE}'
    when contains({case}, 'OPENAI_API_KEY missing') or contains({case}, 'mock embeddings') or contains({case}, 'mock vectors') then '{vectors}'
    when contains({case}, 'DEEPSEEK_API_KEY missing') or contains({case}, 'mock chat') then '{chat}' else {case} end"""


SECTIONS = f"""{PAPERS}, {CHUNKS}, {NOTES}, {GAPS}, {EXPERIMENTS}, found as (
select 'papers' as section, doc_id as id, title from papers where contains(lower(title), 'er') or contains(doc_id, 'er') or len(list_filter(tags, lambda t: contains(lower(t), 'er'))) > 0
    or (select count(*) from papers where contains(lower(title), 'er') or len(list_filter(tags, lambda t: contains(lower(t), 'er'))) > 0) = 0
union all select 'notes', note_id, title from notes where contains(lower(title), 'er') or contains(lower(content), 'er')
union all select 'chunks', chunk_id, 'page ' || page from chunks where contains(lower(text), 'er')
union all select 'gaps', gap_id, title from gaps where contains(lower(title), 'er') or contains(value_level, 'er') or contains(lower(description), 'er') or len(list_filter(evidence, lambda t: contains(lower(t), 'er'))) > 0
union all select 'experiments', experiment_id, gap_id from experiments where contains(lower(objective), 'er') or len(list_filter(list_concat(datasets, metrics, baselines, support), lambda t: contains(lower(t), 'er'))) > 0)"""

_MATCHED = " + ".join(f"contains(lower(text), '{t}')::bigint" for t in sorted({t.lower() for t in DIRECTION.split()}))
TOPDIR = f"{CHUNKS}, top as ({_ranked(f'select chunk_id, doc_id, page, text, {_MATCHED} as matched from chunks', 'matched desc, doc_id, page, chunk_id', 8)})"

_SCORE = "case when shared > 0 then shared / sqrt(greatest(nq, 1) * greatest(nt, 1)) else 0 end"
_SETS = "tk2 as (select *, len(list_intersect(t, qt)) as shared, len(qt) as nq, len(t) as nt from tk)"
TOKENED = f"{CHUNKS}, tk as (select chunk_id, doc_id, page, text, {_tokens('text')} as t, {_tokens(_q(QUESTION))} as qt from chunks), {_SETS}, sc as (select *, {_SCORE} as score from tk2)"
_LEX = "score desc, page, chunk_id desc"

IDS = "src as (select doc_id::varchar as chunk_id from documents), idx as (select (vec_id * 3)::varchar as chunk_id from embeddings)"

_PROFILE = "v2:mock:mock-embedding:16"
MIGRATION = f"""{CHUNKS}, c as (select *, doc_id::bigint as n, sha256(doc_id || chr(10) || page || chr(10) || text) as h from chunks),
legacy as (select case when n % 7 = 0 then 'gone-' || chunk_id else chunk_id end as chunk_id, case when n % 6 = 0 then 'stale' else text end as text, case when n % 5 = 0 then 8 else 16 end as dim from c where n % 2 = 0),
target as (select chunk_id, case when n % 9 = 0 then 'old' else h end as h from c where n % 3 = 0),
acted as (select c.chunk_id, case when t.h = c.h then 'skip' when l.text = c.text and l.dim = 16 then 'reuse' else 'reembed' end as action
    from c left join target t using (chunk_id) left join legacy l on l.chunk_id = c.chunk_id)"""

_DIGEST = "[('0x' || substring(sha256('0:' || text), 2 * i + 1, 2))::int / 255.0::double for i in range(0, 16)]"

MODEL = """shape as (select p_partkey as part_id, p_partkey % 4 as s, case when p_partkey % 10 = 9 then '' else p_name end as title, case p_partkey % 3 when 0 then 'high' else 'mid' end as level,
    p_type, p_brand, p_name, p_partkey % 6 as m from part)"""

SQL = {
    "normalize_chunks": f"with {CHUNKS} select chunk_id, doc_id, page, text from chunks",
    "lexical_topk": f"with {TOKENED} select rank, chunk_id, page, round(score, 6) as score from ({_ranked('select chunk_id, page, score from sc', _LEX, 10)})",
    "lexical_topk_many": f"""with {CHUNKS}, tk as (select chunk_id, page, {_tokens("text")} as t from chunks),
        qs as (select item_id, {_tokens("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} as qt from benchmark),
        tx as (select chunk_id, page, len(t) as nt, unnest(t) as w from tk), qx as (select item_id, len(qt) as nq, unnest(qt) as w from qs),
        m as (select item_id, chunk_id, nq, nt, count(*) as shared from tx join qx using (w) group by all),
        al as (select item_id, k.chunk_id, k.page, coalesce({_SCORE}, 0) as score from qs cross join tk k left join m using (item_id, chunk_id)),
        r as (select *, row_number() over (partition by item_id order by score desc, page, chunk_id desc) as rank from al qualify rank <= 5)
        select item_id, rank, chunk_id, round(score, 6) as score from r""",
    "token_stats": f"with {TOKENED} select chunk_id, len(t)::bigint as n_tokens, len(list_intersect(t, qt))::bigint as shared from sc",
    "direction_rank_top8": f"with {TOPDIR} select rank, chunk_id, matched from top",
    "snippet_summary": f"with {TOPDIR} select string_agg(left(replace(trim(text), chr(10), ' '), 180), ' ' order by rank) as summary from top where rank <= 3",
    "hash_vector16": f"with {CHUNKS}, h as (select chunk_id, {_DIGEST} as v from chunks), u as (select chunk_id, unnest(v) as x, unnest(range(0, 16)) as pos, sqrt(list_sum([y * y for y in v])) as n from h) select chunk_id, pos::bigint as pos, round(x / n, 6) as value from u",
    "content_hash": f"with {CHUNKS} select chunk_id, sha256(doc_id || chr(10) || page || chr(10) || text) as content_hash from chunks",
    "migration_id": f"with {EVENTS} select distinct profile_key, left(sha256(profile_key || '|paper_chunks|target'), 20) as migration_id from entries",
    "collection_names": "select distinct p_brand, p_type, 'v2:' || p_brand || ':' || p_type || ':16' as profile_key, 'paper_chunks_v2_' || regexp_replace(regexp_replace(lower(p_brand || '_' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_16' as collection from part",
    "cosine_topk": f"with {VECTORS} select rank, chunk_id, round(score, 6) as score from ({_ranked(f'select chunk_id, seq, {_COSINE} as score from vectors, q', 'score desc, seq', 10)})",
    "l2_similarity_topk": f"with {VECTORS} select rank, chunk_id, round(score, 6) as score from ({_ranked(f'select chunk_id, seq, {_L2} as score from vectors, q', 'score desc, seq', 10)})",
    "filtered_cosine_topk": f"""with {VECTORS} select rank, chunk_id, round(score, 6) as score from ({_ranked(f"select chunk_id, seq, {_COSINE} as score from vectors, q where doc_id::int % 2 = 0 and list_contains(tags, 'even') and module_source = 'upload'", 'score desc, seq', 5)})""",
    "overfetch_topk": f"""with {VECTORS}, near as (select chunk_id, seq, tags, {_L2} as score from vectors, q order by score desc, seq limit 25) select rank, chunk_id, round(score, 6) as score from ({_ranked("select chunk_id, seq, score from near where list_contains(tags, 'odd')", 'score desc, seq', 5)})""",
    "indexed_topk": """with v as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as item_id, b.vec_id, pow(list_distance(a.e, b.e), 2) as d from v a join v b on a.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by item_id order by d, vec_id) as rank from s qualify rank <= 5) select item_id, rank, vec_id::varchar as chunk_id, round(1 / (1 + d), 6) as score from r""",
    "list_papers": f"with {PAPERS} select {_PAPER} from papers",
    "get_paper": f"with {PAPERS} select {_PAPER} from papers where doc_id = '7'",
    "list_chunks": f"with {CHUNKS} select chunk_id, doc_id, page, text from chunks where doc_id in ('3', '5', '8')",
    "chunk_counts": f"with {CHUNKS} select count(*) as n_chunks, count(distinct doc_id) as n_docs from chunks",
    "papers_by_tag_favorite": f"with {PAPERS} select {_PAPER} from papers where list_contains(tags, 'en') and is_favorite",
    "paper_update": f"with {PAPERS}, u as (select * replace (case when doc_id = '7' then ['new', 'tag'] else tags end as tags, is_favorite or doc_id = '7' as is_favorite) from papers) select {_PAPER} from u",
    "merge_papers": f"with {PAPERS}, u as (select * replace (case when is_favorite then upper(title) else title end as title) from papers) select {_PAPER} from u",
    "tag_vocabulary": f"with {PAPERS} select distinct unnest(tags) as tag from papers",
    "gaps_history": f"with {GAPS} select gap_id, title, value_level, description, array_to_string(evidence, '; ') as evidence from gaps",
    "experiments_history": f"with {EXPERIMENTS} select {_EXPERIMENT} from experiments where gap_id in ('1', '4')",
    "knowledge_papers": f"with {PAPERS}, m as (select * from papers where contains(lower(title), 'src1') or contains(lower(doc_id), 'src1') or len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0) select {_PAPER} from (select * from m union all select * from papers where (select count(*) from m) = 0) where list_contains(tags, 'en')",
    "knowledge_papers_fallback": f"with {PAPERS} select {_PAPER} from papers where list_contains(tags, 'fr') and is_favorite",
    "knowledge_chunks": f"with {CHUNKS} select chunk_id, doc_id, page from chunks where contains(lower(text), lower({_q(TERM)}))",
    "knowledge_chunks_fallback": f"with {CHUNKS} select chunk_id, doc_id, page from chunks order by doc_id, page limit 5",
    "knowledge_notes": f"with {NOTES} select note_id, title from notes where translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%th_n%ing%' or translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%th_n%ing%'",
    "knowledge_gaps": f"with {GAPS} select gap_id, value_level, array_to_string(evidence, '; ') as evidence from gaps where contains(lower(title), 'nation-1') or contains(lower(description), 'nation-1') or len(list_filter(evidence, lambda t: contains(lower(t), 'nation-1'))) > 0",
    "knowledge_experiments": f"with {EXPERIMENTS} select {_EXPERIMENT} from experiments where len(list_filter(list_concat([experiment_id, gap_id, objective], datasets, metrics, baselines, support), lambda t: contains(lower(t), 'urgent 1'))) > 0",
    "knowledge_group_counts": f"with {SECTIONS} select section, count(*) as n from found group by section",
    "top3_per_group": f"with {SECTIONS} select section, row_number() over (partition by section order by id) as place, id, title from found qualify place <= 3",
    "missing_papers": "select (vec_id * 3)::varchar as doc_id from embeddings where vec_id * 3 not in (select doc_id from documents)",
    "experiment_topics": "select o_orderkey as request_id, o_custkey::varchar as gap_id, case when o_orderkey % 2 = 0 then o_orderpriority else c_name || '. ' || c_mktsegment end as topic from orders left join customer on o_custkey = c_custkey",
    "top3_gaps": f"with {GAPS} select rank, gap_id, value_level from ({_ranked('select gap_id, value_level, seq from gaps', '''(value_level <> 'high')::int, seq''', 3)})",
    "routes": f"with {GAPS}, {EXPERIMENTS} select g.gap_id, value_level, coalesce(string_agg(experiment_id, ',' order by x.seq), '') as experiments from gaps g left join experiments x using (gap_id) group by all",
    "plan_cards": f"""with {GAPS}, {EXPERIMENTS}, f as (select * from experiments qualify row_number() over (partition by gap_id order by seq) = 1)
        select g.gap_id, {_q(DIRECTION.strip() + '：')} || title as title, description as research_gap, '从“' || title || '”入手，先复现实有证据，再补齐 ' || value_level || ' 价值缺口。' as entry_point,
        case when f.seq is null then '先定义公开数据集、基础指标和可复现实验脚本。' else objective || ' 数据集：' || array_to_string(datasets, ', ') || '；指标：' || array_to_string(metrics, ', ') || '。' end as experiment_suggestion,
        array_to_string(evidence, '; ') as recommended_papers, '整理 selected papers 的方法和实验设置，形成第一个 baseline。' as next_action from gaps g left join f using (gap_id)""",
    "recommended_papers": f"""with {GAPS}, {EXPERIMENTS}, f as (select * from experiments qualify row_number() over (partition by gap_id order by seq) = 1),
        u as (select g.gap_id, unnest(list_concat(evidence, coalesce(support, []))) as p, unnest(range(0, len(list_concat(evidence, coalesce(support, []))))) as i from gaps g left join f using (gap_id)),
        o as (select gap_id, p, min(i) as i from u group by all), r as (select *, row_number() over (partition by gap_id order by i) as n from o)
        select gap_id, string_agg(p, '; ' order by i) as papers from r where n <= 5 group by gap_id""",
    "support_padding": f"""with {EXPERIMENTS}, s as (select experiment_id, support[:(seq % 6)::int] as x from experiments)
        select experiment_id, array_to_string(case when len(x) >= 3 then x else list_concat(x, ['fallback-support-paper-' || i for i in range(len(x) + 1, 4)]) end, '; ') as support from s""",
    "upsert_latest": f"with {EVENTS} select chunk_id, profile_key, status, event_id from entries qualify row_number() over (partition by chunk_id, profile_key order by ts desc, event_id desc) = 1",
    "upsert_union": "select p_partkey as k, p_name as v from part where p_partkey not in (select p_partkey * 2 from part where p_partkey % 3 = 0) union all select p_partkey * 2, upper(p_name) from part where p_partkey % 3 = 0",
    "migration_upsert": f"""with {MIGRATIONS}, g as (select migration_id, min(ts) as a, max(ts) as b, count(*) as writes, arg_min(profile_key, (ts, event_id)) as profile_key, arg_max(status, (ts, event_id)) as status from migrations group by 1)
        select migration_id, profile_key, status, strftime(a, '%Y-%m-%dT%H:%M:%S') as started_at, case when status in ('complete', 'failed') then strftime(b, '%Y-%m-%dT%H:%M:%S') end as completed_at, writes from g""",
    "entry_status_counts": f"with {EVENTS} select profile_key, status, count(*) as n from entries group by all",
    "latest_migration": f"with {MIGRATIONS} select profile_key, migration_id, status, event_id from migrations qualify row_number() over (partition by profile_key order by ts desc, migration_id desc) = 1",
    "index_missing": f"with {IDS} select chunk_id from src where chunk_id not in (select chunk_id from idx)",
    "index_orphans": f"with {IDS} select chunk_id from idx where chunk_id not in (select chunk_id from src)",
    "index_status": f"""with {IDS}, n as (select (select count(*) from src) as source_count, (select count(*) from src where chunk_id in (select chunk_id from idx)) as indexed_count,
        (select count(*) from src where chunk_id not in (select chunk_id from idx)) as missing_count, (select count(*) from idx where chunk_id not in (select chunk_id from src)) as orphan_count)
        select *, 0::bigint as failed_count, case when missing_count > 0 then 'migration_required' else 'ready' end as state,
        concat_ws('; ', case when missing_count > 0 then missing_count || ' stored chunks have no vector in the index.' end, case when orphan_count > 0 then orphan_count || ' vectors belong to no stored chunk.' end) as warnings from n""",
    "vector_dimension": f"with {VECTORS} select len(e) as dimension from vectors order by seq limit 1",
    "vector_entry": f"with {VECTORS} select chunk_id, doc_id, array_to_string(tags, '; ') as tags, module_source, len(e) as n from vectors where chunk_id = '17'",
    "active_collections": f"""with {EVENTS}, p as (select distinct profile_key, length(profile_key) as n from entries)
        select profile_key, case when n % 3 = 1 then 'set_' || profile_key when n % 2 = 0 then 'paper_chunks' else 'own_' || profile_key end as collection from p""",
    "migration_plan": f"with {MIGRATION} select (select count(*) from acted) as chunk_count, (select count(*) from acted where action = 'skip') as already_current_count, (select count(*) from acted where action <> 'skip') as pending_count, (select count(distinct chunk_id) from legacy) as legacy_vector_count, (select count(distinct chunk_id) from legacy where chunk_id not in (select chunk_id from c)) as legacy_orphan_count",
    "migration_classify": f"with {MIGRATION} select chunk_id, action from acted",
    "citation_nodes": f"with {WORKS}, {_nodes(25)} select rank, id, title, year::bigint as year, round(score / max(score) over (), 3) as importance_score, rank <= 3 as is_key from kept",
    "citation_links": f"with {WORKS}, {_nodes(50)}, {CITATIONS} select 'openalex-' || source as source, 'openalex-' || target as target, 'cites' as relation from cites where source in (select k from kept) and target in (select k from kept)",
    "graph_counts": f"""with {WORKS}, {_nodes(50)}, {CITATIONS}, n as (select count(*) as n_nodes, count(*) filter (rank <= 3) as n_key from kept), l as (select count(*) as c from cites where source in (select k from kept) and target in (select k from kept))
        select n_nodes, n_key, case when c = 0 then n_nodes - 1 else c end as n_links from n, l""",
    "citation_star": f"with {WORKS}, {_nodes(10)} select (select id from kept where rank = 1) as source, id as target, 'cites' as relation from kept where rank > 1",
    "graph_enrichment": f"""with {WORKS}, {CITATIONS}, e as (select distinct source::varchar as s, target::varchar as t from cites),
        r as (select s, list_sort(list(t))[:2] as refs from e group by s), ru as (select s, unnest(refs) as ref, unnest(range(0, len(refs))) as i from r),
        rr as (select s, string_agg(ref, ',' order by i) as references_ from ru where ref in (select s from r) group by s),
        cc as (select t, s, n, row_number() over (partition by t order by n desc, s) as p from e join works on k::varchar = s), ct as (select t, string_agg(s, ',' order by p) as citations from cc where p <= 2 group by t)
        select r.s as paper_id, coalesce(references_, '') as "references", coalesce(citations, '') as citations from r left join rr using (s) left join ct on ct.t = r.s""",
    "label_extract": f"with {LABELLED} select part_id, {_DATASETS} as datasets, {_METRICS} as metrics, {_BASELINES} as baselines from labelled",
    "sentence_filter": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '' and (contains(lower(x), 'the') or contains(lower(x), 'einen'))) as m from documents where text is not null)
        select doc_id, case when len(m) > 0 then array_to_string(m[:5], '|') else 'unknown' end as sentences from s""",
    "risk_rules": f"with {LABELLED}, x as (select part_id, {_DATASETS} = 'unknown' as d, {_METRICS} = 'unknown' as m, {_BASELINES} = 'unknown' as b from labelled) select part_id, case when d or m or b then concat_ws('|', case when d then '{_RISKS['d']}' end, case when m then '{_RISKS['m']}' end, case when b then '{_RISKS['b']}' end) else '{_RISKS['']}' end as risks from x",
    "json_repair_gaps": f"""with {MODEL} select part_id, 0::bigint as pos, title, level as value_level, p_type as description, case when s = 2 then 'local uploaded paper context' else p_brand || '; x' end as evidence from shape where s <> 3 and title <> ''
        union all select part_id, 2, 'second', 'high', 'd ' || p_brand, 'local uploaded paper context' from shape where s <> 3
        union all select part_id, 0, 'topic 的证据覆盖仍不完整', 'mid', 'fallback', 'local uploaded paper context' from shape where s = 3""",
    "json_repair_experiments": f"with {MODEL} select part_id, 0::bigint as pos, p_name as objective, p_brand as datasets, 'F1' as metrics, p_type as baselines, 'plan; run' as steps, 'drift' as risks from shape where s <> 3 and m <> 5",
    "atom_parse": "select 'arxiv-' || p_partkey as paper_id, p_name || ' paper' as title, case when p_partkey % 4 <> 0 then 'about ' || p_type else 'No abstract available.' end as abstract, (1990 + p_size)::bigint as year from part",
    "openalex_decode": f"with {WORKS} select 'W' || k as paper_id, title, case when k % 4 <> 0 then year end::bigint as year, n as citation_count, 'W' || k as refs from works",
    "qa_sources": f"""with {CHUNKS}, tk as (select chunk_id, page, doc_id::bigint as d, {_tokens("text")} as t from chunks),
        qs as (select item_id, {_tokens("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} as qt from benchmark),
        al as (select item_id, chunk_id, page, len(list_intersect(t, qt)) as shared, len(qt) as nq, len(t) as nt from qs join tk on d % 3 = item_id % 3),
        r as (select *, {_SCORE} as score, row_number() over (partition by item_id order by {_SCORE} desc, page, chunk_id desc) as rank from al qualify rank <= 5)
        select item_id, rank, chunk_id, page, round(coalesce(score, 0), 6) as score from r""",
    "qa_context": f"with {TOKENED} select string_agg('[' || rank || '] page ' || page || ', chunk ' || chunk_id || ': ' || text, chr(10) || chr(10) order by rank) as context from ({_ranked('select chunk_id, page, text, score from sc', _LEX, 3)})",
    "evidence_labels": f"with {CHUNKS}, {_DOC_TEXTS.format(sep='; ')} select doc_id, evidence, length(text) as n_chars from joined",
    "reproduction_reports": f"with {PAPERS}, {CHUNKS}, {_DOC_TEXTS.format(sep='|')} select doc_id, coalesce({_DATASETS}, 'unknown') as datasets, coalesce({_METRICS}, 'unknown') as metrics, coalesce({_BASELINES}, 'unknown') as baselines, coalesce(evidence, '') as evidence from papers left join joined using (doc_id)",
    "citation_markers": r"with a as (select p_partkey, 'As [' || (p_partkey % 9) || '] and [2][x] or [' || p_size || '] say' as answer from part) select p_partkey, array_to_string(list_filter(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int between 1 and 5), ',') as numbers from a",
    "warning_classes": f"with w as (select p_partkey, [{', '.join(_q(x) for x in WARNINGS)}][p_partkey % {len(WARNINGS)} + 1] as w from part) select p_partkey, {_shown('w', '当前使用本地测试向量。配置 OPENAI_API_KEY 后可启用生产级语义检索。', '当前使用本地测试回答。配置 DEEPSEEK_API_KEY 后可启用真实模型输出。')} as shown, {_shown('w', '当前使用本地测试向量，检索效果仅供开发验证。', '当前使用本地测试回答，配置 DeepSeek 后可启用真实模型输出。')} as answer_shown from w",
    "tag_parse": "select p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || p_brand || ',, ' || p_type || ' , ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') as tags from part",
    "short_titles": "select p_partkey, case when length(t) > 34 then left(t, 31) || '...' else t end as title from (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand as t from part)",
    "history_items": """select p_brand, pos, id, title from (select p_brand, p_partkey, (row_number() over (partition by p_brand order by p_partkey) - 1)::bigint as pos, p_partkey::varchar as id, p_name as title from part)
        where p_partkey % 4 <> 0 qualify row_number() over (partition by p_brand order by pos) <= 8""",
    "text_cleanup": r"""with r as (select p_partkey, p_name || ' ﬁne ſo Straße' || chr(9) || 'data: A,' || chr(10) || ' B ' || chr(9) || ' and C.' as c from part),
        f as (select *, replace(replace(replace(lower(c), 'ﬁ', 'fi'), 'ſ', 's'), 'ß', 'ss') as fc from r)
        select p_partkey, left(replace(c, chr(10), ' '), 180) as snippet, c as clean, chr(9) || chr(10) || ' ' || fc || chr(10) || ' ' || chr(12288) as folded,
        array_to_string(list_sort(list_distinct(regexp_extract_all(fc, '[a-z0-9_]{2,}'))), '|') as tokens, 'A' as values, replace(c, ',' || chr(10) || ' ', '|') as tags from f""",
}

SQL["postings_topk"] = SQL["lexical_topk_many"]
_QA = SQL["qa_sources"]
_WHOLE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SQL["asked_questions"] = f"""with {CHUNKS}, c as (select *, doc_id::bigint as n from chunks),
    q as (select item_id, t as question, length(t) % 4 = 0 as blind, case item_id % 4 when 0 then null when 1 then [(item_id * 3 % 90 + 1)::varchar, (item_id * 5 % 70 + 1)::varchar] when 2 then ['7', '14'] else ['missing'] end as ids from (select item_id, {_WHOLE} as t from benchmark)),
    qv as (select item_id, ids, {_DIGEST.replace("text", "question")} as v from q where not blind), cv as (select chunk_id, doc_id, page, n, {_DIGEST} as v from c where n % 7 <> 0),
    vs as (select item_id, chunk_id, row_number() over (partition by item_id order by list_distance([x / sqrt(list_sum([y * y for y in qv.v])) for x in qv.v], [x / sqrt(list_sum([y * y for y in cv.v])) for x in cv.v]), n * 1000 + page) as rank
        from qv join cv on ids is null or list_contains(ids, doc_id) qualify rank <= 5),
    lq as (select item_id, ids, {_tokens("question")} as qt from q where item_id not in (select item_id from vs)), lc as (select chunk_id, doc_id, page, {_tokens("text")} as t from chunks),
    ls as (select item_id, chunk_id, page, len(list_intersect(t, qt)) as shared, len(qt) as nq, len(t) as nt from lq join lc on ids is null or list_contains(ids, doc_id)),
    lr as (select item_id, chunk_id, row_number() over (partition by item_id order by {_SCORE} desc, page, chunk_id desc) as rank from ls qualify rank <= 5),
    f as (select *, 'vector' as rung from vs union all select *, 'lexical' from lr), g as (select item_id, any_value(rung) as rung, string_agg(chunk_id, '; ' order by rank) as chunks from f group by item_id)
    select item_id, coalesce(rung, 'none') as rung, case when rung is null then '证据不足：未在已上传论文中检索到可用于回答该问题的片段。' else '根据已检索片段，论文给出了相关方法与结果 [1]。' end as answer, case when rung is null then '' else '1' end as citations, coalesce(chunks, '') as chunks,
        case when blind then 'Embedding failed: refused|No vector of the question could be made; its words were searched instead.' when rung = 'lexical' then 'The vector index held no chunk of these papers; words were searched instead.' else '' end as warnings
    from q left join g using (item_id)"""
_STEPS = "['extract_reproduction_info', 'generate_code_skeleton', 'generate_simulation_template', 'assess_risks', 'generate_report']"
SQL |= {
    "qa_answers": f"""with f as ({_QA}), g as (select item_id, count(*) as n, string_agg(chunk_id, '; ' order by rank) as chunks from f where item_id % 5 <> 0 group by item_id)
        select item_id, case when n is null then '证据不足：未在已上传论文中检索到可用于回答该问题的片段。' else '根据已检索片段，论文给出了相关方法与结果 [1]。' end as answer, coalesce(n, 0) as n_sources, case when n is null then '' else '1' end as citations, coalesce(chunks, '') as chunks from benchmark left join g using (item_id)""",
    "suggested_experiments": f"""with {MODEL} select part_id, case when s <> 3 and m <> 5 then p_name else '评估 ' || part_id || ' 的实验证据充分性。' end as objective, case when s <> 3 and m <> 5 then 'plan; run' else '准备评估划分; 运行基线系统; 比较核心指标; 分析失败案例' end as steps, 1::bigint as n, 'p1; fallback-support-paper-2; fallback-support-paper-3' as support,
        case when s = 3 then 'The model gave no JSON of experiments; the default plan stands.' when m = 5 then 'An experiment with empty fields was left out.|No experiment was left; the default plan stands.' else '' end as warnings from shape""",
    "analysed_gaps": f"""with {MODEL}, a as (select *, title <> '' as has from shape)
        select part_id, case when s = 3 then 'topic 的证据覆盖仍不完整' when has then title || '; second' else 'second' end as titles, case when s = 3 then 'mid' when has then level || '; high' else 'high' end as levels,
        case when s = 3 or not has then 'p1: one' when s = 2 then 'p1: one; p1: one' else p_brand || '; x; p1: one' end as evidence,
        case when s = 3 then 1 when not has then 3 else 2 + (s = 2)::int + (part_id % 3 = 2)::int end::bigint as n_warnings from a""",
    "reproduction_goals": f"""with {PAPERS}, {CHUNKS}, n as (select distinct doc_id from chunks)
        select papers.doc_id, case when n.doc_id is null then '为《' || title || '》生成辅助复现实验报告。' else '根据论文《' || title || '》和用户需求“quick”，整理可辅助复现的目标、数据、指标和基线。' end as goal, 'focused' as mode, 3::bigint as n_plan, n.doc_id is not null as has_code, false as has_simulation from papers left join n using (doc_id)""",
    "reproduction_trace": f"""with {PAPERS}, {CHUNKS}, n as (select doc_id, count(*) as n from chunks where doc_id::bigint % 7 <> 0 group by doc_id),
        t as (select papers.doc_id, coalesce(n, 0) as n, ['retrieve_paper_context'] || case when n is null then ['generate_report'] else {_STEPS} end as tools from papers left join n using (doc_id)),
        u as (select *, unnest(range(1, len(tools) + 1)) as step_index from t)
        select doc_id, step_index, tools[step_index] as tool_name, case when step_index = 1 then 'paper_id=' || doc_id else 'mode=template; chunks=' || n || '; requirement=quick' end as input_summary, coalesce(tools[step_index + 1], 'complete') as next_decision from u""",
    "model_options": """select * from (values ('embedding', 'mock', 'mock-embedding', true, null), ('embedding', 'openai', 'text-embedding-3-small', false, 'OPENAI_API_KEY is not configured.'), ('embedding', 'local-bge-m3', 'bge-m3', true, null), ('embedding', 'xfyun-spark', 'query', false, 'XFYUN_API_KEY is not configured.'),
        ('chat', 'mock', 'mock-chat', true, null), ('chat', 'deepseek', 'deepseek-chat', false, 'DEEPSEEK_API_KEY is not configured.'), ('chat', 'openai', 'gpt-4o-mini', false, 'OPENAI_API_KEY is not configured.')) v(kind, provider, model, available, warning)""",
}

_RUNS = f"""{CHUNKS}, req as (select c_custkey as request_id, {_q(DIRECTION)} || ' ' || c_mktsegment as direction, c_custkey % 3 = 0 as has_result, case when c_custkey % 10 = 0 then ['missing'] else [(c_custkey % 90 + 1)::varchar, (c_custkey % 70 + 2)::varchar] end as ids from customer),
    ctx as (select request_id, page, doc_id, chunk_id, text, len(list_filter(list_distinct(string_split(lower(direction), ' ')), lambda w: contains(lower(text), w))) as matched from req join chunks on list_contains(ids, doc_id)),
    pl as (select *, row_number() over (partition by request_id order by matched desc, doc_id, page, chunk_id) as place from ctx qualify place <= 8),
    run as (select req.*, coalesce(n, 0) as n, s from req left join (select request_id, count(*) as n, string_agg(left(replace(trim(text), chr(10), ' '), 180), ' ' order by place) filter (place <= 3) as s from pl group by all) using (request_id))"""
_TOOLS = "['understand_goal', 'plan_steps', 'knowledge_search_tool', 'paper_summary_tool', 'gap_analysis_tool', 'select_top_3_gaps', 'experiment_suggestion_tool', 'paper_recommendation_tool', 'research_report_tool']"
SQL |= {
    "plan_trace": f"""with {_RUNS}, t as (select *, case when n > 0 then {_TOOLS} else {_TOOLS}[:2] || [{_TOOLS}[3] for i in range(8)] end as tools from run), u as (select *, unnest(range(1, len(tools) + 1)) as step_index from t)
        select request_id, step_index, tools[step_index] as tool_name, coalesce(tools[step_index + 1], 'complete') as next_decision, case tools[step_index] when 'understand_goal' then 'Goal: ' || direction || case when has_result then '; results at hand.' else '; no results yet.' end
        when 'plan_steps' then '9 steps are planned, 10 at most.' when 'knowledge_search_tool' then n || ' passages found in ' || len(ids) || ' papers.' when 'paper_summary_tool' then 'Summary of ' || least(n, 3) || ' passages.' when 'gap_analysis_tool' then '1 gaps.'
        when 'select_top_3_gaps' then '1 gaps kept, those of high value first.' when 'experiment_suggestion_tool' then '1 experiments.' when 'paper_recommendation_tool' then '5 papers named.' else '1 cards.' end as observation from u""",
    "plan_run_cards": f"""with {_RUNS} select request_id, direction || '：评估覆盖不足' as title, '已有研究主要围绕 ' || direction || ' 展开。证据片段：' || s as background, '缺少跨领域评估。' as research_gap, '从“评估覆盖不足”入手，先复现实有证据，再补齐 high 价值缺口。' as entry_point,
        '验证检索质量 数据集：公开基准；指标：NDCG。' as experiment_suggestion, array_to_string(['arxiv-' || i || ': arXiv study on ' || direction || ' 评估覆盖不足 #' || i for i in range(1, 6)], '; ') as recommended_papers, '标签噪声' as risks, '准备数据' as next_action from run where n > 0""",
    "plan_warnings": f"with {_RUNS} select request_id, case when n > 0 then 'Evidence of gap ' || chr(39) || '评估覆盖不足' || chr(39) || ' filled in.' else 'The steps were used up before any passage was found; there are no cards.' end as warnings from run",
}

SQL["indexed_notes"] = SQL["knowledge_notes"]
SQL["indexed_knowledge"] = f"""with {PAPERS}, {CHUNKS}, {GAPS}, {EXPERIMENTS} select 'papers' as section, doc_id as id from papers where contains(lower(title), 'src1') or contains(doc_id, 'src1') or len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0
    union all select 'chunks', chunk_id from chunks where contains(lower(text), lower({_q(TERM)})) union all select 'gaps', gap_id from gaps where contains(lower(title), 'nation-1') or contains(lower(description), 'nation-1') or len(list_filter(evidence, lambda t: contains(lower(t), 'nation-1'))) > 0
    union all select 'experiments', experiment_id from experiments where len(list_filter(list_concat([experiment_id, gap_id, objective], datasets, metrics, baselines, support), lambda t: contains(lower(t), 'urgent 1'))) > 0"""

SQL |= {
    "store_upserts": f"""with {GAPS}, again as (select *, case when seq % 2 = 0 then gap_id else 'new-' || gap_id end as g from gaps where seq % 3 = 0)
        select gap_id, title, value_level, array_to_string(evidence, '; ') as evidence from gaps where gap_id not in (select g from again) union all select g, title, 'changed', array_to_string(evidence, '; ') from again""",
    "migration_run": f"""with {CHUNKS}, c as (select *, doc_id::bigint as n from chunks), a as (select *, n % 2 = 0 and n % 7 <> 0 and n % 6 <> 0 and n % 5 <> 0 as reused from c), k as (select count(*) filter (reused or length(text) % 4 <> 0) as ok, count(*) filter (not reused and length(text) % 4 = 0) as bad from a)
        select 'v2:local-hash:sha:16' as profile_key, case when bad = 0 then 'complete' else 'failed' end as status, ok as processed_count, 0::bigint as skipped_count, bad as failed_count, case when bad > 0 then bad || ' chunks have no current vector.' end as error from k""",
    "index_differences": f"with {IDS} select 'missing' as kind, chunk_id from src where chunk_id not in (select chunk_id from idx) union all select 'orphan', chunk_id from idx where chunk_id not in (select chunk_id from src)",
    "indexed_ids": f"with {EVENTS} select distinct chunk_id from entries where profile_key = 'v2:mock:click:16'",
    "recorded_states": f"with {EVENTS} select profile_key, 'c' || event_id as active_collection, status || '-' || event_id as state from entries qualify row_number() over (partition by profile_key order by ts desc, status || '-' || event_id desc) = 1",
    "legacy_counts": f"with {MIGRATION} select (select count(distinct chunk_id) from legacy) as legacy_vector_count, (select count(distinct chunk_id) from legacy where chunk_id not in (select chunk_id from c)) as legacy_orphan_count",
    "empty_dimension": f"with {VECTORS} (select 'held' as collection, len(e)::bigint as dimension from vectors order by seq limit 1) union all select 'empty', 16",
    "graph_expanded": """with w as (select p_partkey as k, p_name from part where p_partkey % 3 = 0)
        select 'node' as kind, k::varchar as a, p_name as b from w union all select 'node', (k + 1)::varchar, 'ref ' || k from w union all select 'node', (k + 2)::varchar, 'cit ' || k from w union all select 'node', (k + 3)::varchar, 'later ' || k from w where k + 3 not in (select k from w)
        union all select 'edge', k::varchar, (k + 1)::varchar from w union all select 'edge', k::varchar, (k + 3)::varchar from w union all select 'edge', (k + 2)::varchar, k::varchar from w""",
    "key_nodes": f"with {WORKS}, {_nodes(25)}, s as (select rank, id, title, round(score / max(score) over (), 3) as i from kept) select rank, id, round(7 + 9 * i, 6) as radius, printf('%.2f', i) as shown, left(title, 8) as short from s where rank <= 3",
    "newest_notes": f"""with {NOTES}, n as (select note_id, title, split_part(note_id, '-', 1)::bigint * 1000 + split_part(note_id, '-', 2)::bigint as seq from notes where contains(translate(title || chr(10) || content, 'E', 'e'), 'e')),
        r as (select *, row_number() over (order by seq desc, note_id desc) as place from n) select place, note_id, title from r where place <= 100""",
}

"""The same queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

from vellumq.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(c: str) -> str:
    return rf"[t for t in regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+(?:\.[0-9]+)?') if t not in ({_STOP})]"


B = "b as (select * exclude (rn) from (select *, row_number() over (partition by block_id order by loaded_at desc) rn from blocks where block_id is not null) where rn = 1)"
C = "c as (select * exclude (rn) from (select *, row_number() over (partition by chunk_ord order by loaded_at desc) rn from chunks where chunk_ord is not null) where rn = 1)"
Q = "q as (select id as qid, * exclude (id) from questions)"
H = "h as (select config, qid, chunk_ord, min(rank) as rank from hits where rank is not null and qid is not null and chunk_ord is not null group by all)"
CONF = """conf as (select r.config, r.qid, coalesce(case when isnan(r.confidence) then null else r.confidence end, 0.0) as confidence, q.answerable, not q.answerable as positive
    from (select config, qid, arg_max(confidence, searched_at) as confidence from retrieval_results group by all) r join q using (qid))"""
NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
EXACT = f"""rel as (select distinct q.qid, c.chunk_ord from q join c on q.source_file = c.source_file
    where q.answerable and len([e for e in q.evidence if contains({NORM.format('c.text')}, {NORM.format('e')})]) > 0)"""
# Partial ratio >= 90 by its definition: the longest common subsequence of the shorter string with every stretch of the
# longer one, bit-parallel in two numbers of 120 bits. Pairs that lack too many runs of three characters can't reach it
# and are left out; moved by one character, a stretch's subsequence changes by one at most, so every eighth is tried first.
_STEP = """list_reduce(masks[greatest(1, o + 1):o + m], lambda v, k: [(((v[1] + (v[1] & k[1])) & ones) | (v[1] - (v[1] & k[1]))),
    (((v[2] + (v[2] & k[2]) + ((v[1] + (v[1] & k[1])) >> 120)) & ones) | (v[2] - (v[2] & k[2])))], [ones, ones])"""
REL = f"""ev as (select distinct qid, source_file, {NORM.format('e')} as s from (select qid, source_file, unnest(evidence) as e from q where answerable)),
    cn as (select chunk_ord, source_file, {NORM.format("coalesce(text, '')")} as t from c),
    both_ as (select qid, chunk_ord, s, t from ev join cn using (source_file) where s <> '' and t <> ''),
    sided as (select qid, chunk_ord, s, t, length(s) as m from both_ where length(s) <= length(t) union all select qid, chunk_ord, t, s, length(t) from both_ where length(s) >= length(t)),
    sure as (select distinct qid, chunk_ord from sided where contains(t, s)),
    near as (select * from sided where not contains(t, s) and (qid, chunk_ord) not in (select (qid, chunk_ord) from sure)
        and len(list_intersect(list_distinct([s[i:i + 2] for i in range(1, m - 1)]), [t[i:i + 2] for i in range(1, length(t) - 1)])) >= len(list_distinct([s[i:i + 2] for i in range(1, m - 1)])) - 3 * floor(0.2 * m)),
    lettered as (select *, (1::hugeint << 120) - 1 as ones, list_distinct(string_split(t, '')) as chars from near),
    spots as (select *, [[list_sum([case when i <= 120 and s[i] = x then 1::hugeint << (i - 1) else 0::hugeint end for i in range(1, m + 1)])::hugeint,
        list_sum([case when i > 120 and s[i] = x then 1::hugeint << (i - 121) else 0::hugeint end for i in range(1, m + 1)])::hugeint] for x in chars] as spots from lettered),
    masked as (select * exclude (spots, chars), [spots[list_position(chars, t[j])] for j in range(1, length(t) + 1)] as masks from spots),
    coarse as (select *, unnest(range(1 - m, length(t), 8)) as o from masked),
    rough as (select * exclude (v, w) from (select *, least(o + m, length(t)) - greatest(o, 0) as w, {_STEP} as v from coarse) where 200.0 * (248 - bit_count(v[1]) - bit_count(v[2])) / greatest(1, m + w - 8) >= 90),
    fine as (select * replace (o + step as o) from rough cross join (select unnest(range(0, 8)) as step) where o + step < length(t)),
    ended as (select qid, chunk_ord, m, least(o + m, length(t)) - greatest(o, 0) as w, {_STEP} as v from fine),
    rel as materialized (select qid, chunk_ord from sure union select qid, chunk_ord from ended where 200.0 * (240 - bit_count(v[1]) - bit_count(v[2])) / (m + w) >= 90)"""
RANKS = """ranks as (select cf.config, q.qid, (select min(h.rank) from h join rel on h.qid = rel.qid and h.chunk_ord = rel.chunk_ord where h.qid = q.qid and h.config = cf.config) as rank
    from q cross join (select distinct config from h) cf where q.answerable)"""
CURVE = """lv as (select config, confidence as boundary, sum(positive::int) as pos, sum((not positive)::int) as neg from conf group by all),
    pts as (select config, boundary, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by config) as p, sum(neg) over (partition by config) as n from lv
        window w as (partition by config order by boundary rows unbounded preceding)
        union all select config, null, 0, 0, sum(pos), sum(neg) from lv group by config),
    curve as (select config, boundary, pr as precision, rc as recall, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f1, answered_rate from (
        select config, boundary, case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as pr, case when p > 0 then tp / p else 0.0 end as rc, case when n > 0 then (n - fp) / n else 0.0 end as answered_rate from pts))"""
BEST = """best as (select * exclude (rn) from (select *, row_number() over (partition by config order by round(f1, 12) desc, coalesce(boundary, '-inf'::double)) rn from curve) where rn = 1)"""
AUC = """auc as (select config, case when sum(pos) * sum(neg) > 0 then sum(neg * (2 * below + pos)) / (2 * sum(pos) * sum(neg)) else 'nan'::double end as auc
    from (select *, coalesce(sum(pos) over (partition by config order by boundary rows between unbounded preceding and 1 preceding), 0) as below from lv) group by config)"""

RANGES = (
    B
    + r""",
    w as (select doc_id, n, sum(n) over (partition by doc_id order by block_ord rows unbounded preceding) as p, row_number() over (partition by doc_id order by block_ord) as i
        from (select doc_id, block_ord, len(regexp_extract_all(text, '\S+')) as n from b where doc_id is not null and text is not null) where n > 0),
    fold as (select doc_id, 0::bigint as i, 0::bigint as s, 0::bigint as f, 0::bigint as p, 0::bigint as last, false as cut from (select distinct doc_id from w)
        union all select w.doc_id, w.i, case when w.p - fold.s >= 120 then greatest(fold.s, w.p - 30) else fold.s end::bigint, fold.s, w.p::bigint, case when w.p - fold.s >= 120 then w.p else fold.last end::bigint, w.p - fold.s >= 120
        from fold join w on w.doc_id = fold.doc_id and w.i = fold.i + 1),
    cuts as (select doc_id, f as word_from, p as word_to from fold where cut
        union all select doc_id, s, p from (select *, row_number() over (partition by doc_id order by i desc) as rn from fold) where rn = 1 and p > last),
    ranges as (select doc_id, (row_number() over (partition by doc_id order by word_to) - 1)::int as chunk_no, word_from, word_to from cuts),
    br as (select *, b_to - n as b_from from (select doc_id, block_ord, source_file, page, bbox, len(regexp_extract_all(text, '\S+')) as n, regexp_extract_all(text, '\S+') as ws,
        sum(len(regexp_extract_all(text, '\S+'))) over (partition by doc_id order by block_ord rows unbounded preceding) as b_to from b where doc_id is not null and text is not null) where n > 0),
    mem as (select * from ranges join br using (doc_id) where b_from < word_to and b_to > word_from)"""
)
# all chunks scored for all questions; fine for the small tables of the comparison
BM25 = f"""{C}, {Q},
    tk as (select chunk_ord, {_tokens('text')} as ts from c), st as (select count(*) as n_chunks, avg(len(ts)) as avgdl from tk),
    po as (select chunk_ord, term, count(*) as tf, any_value(dl) as dl from (select chunk_ord, len(ts) as dl, unnest(ts) as term from tk) group by all),
    i0 as (select term, count(*) as n, ln(any_value(n_chunks) - count(*) + 0.5) - ln(count(*) + 0.5) as idf0 from po cross join st group by term),
    idf as (select term, n, case when idf0 < 0 then 0.25 * (select avg(idf0) from i0) else idf0 end as idf from i0),
    qt as (select qid, unnest({_tokens('question')}) as term from q),
    sc as (select qt.qid, po.chunk_ord, sum(idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) as score from qt join idf using (term) join po using (term) cross join st group by all),
    bm as (select q.qid, c.chunk_ord, coalesce(sc.score, 0.0) as score, row_number() over (partition by q.qid order by round(coalesce(sc.score, 0.0), 9) desc, c.chunk_ord)::int as rank
        from q cross join c left join sc on sc.qid = q.qid and sc.chunk_ord = c.chunk_ord)"""


def _letters(c: str) -> str:
    return f"[(length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), x, '')))::double for x in string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')]"


DENSE = f"""lq as (select qid, {_letters('question')} as v from q), lc as (select chunk_ord, {_letters('text')} as v from c),
    uq as (select qid, case when list_dot_product(v, v) > 0 then [x / sqrt(list_dot_product(v, v)) for x in v] else v end as v from lq),
    uc as (select chunk_ord, case when list_dot_product(v, v) > 0 then [x / sqrt(list_dot_product(v, v)) for x in v] else v end as v from lc),
    de as (select qid, chunk_ord, score, row_number() over (partition by qid order by round(score, 9) desc, chunk_ord)::int as rank from (select qid, chunk_ord, list_dot_product(uq.v, uc.v) as score from uq cross join uc))"""

FIRST = "fh as (select config, qid, chunk_ord, place::int as rank from (select *, row_number() over (partition by config, qid order by rank, chunk_ord) as place from h) where place <= 4)"
CTX = """ctx as (select config, qid, string_agg('[Source: ' || coalesce(source_file, '') || ', p.' || page_start || '-' || page_end || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank, chunk_ord) as context
    from fh join c using (chunk_ord) group by all)"""
GATE = "gate as (select *, case when threshold is not null and confidence < threshold then 'abstain' else 'answer' end as decision from (select config, qid, confidence, case config when 'hybrid-bge-small' then 0.702 when 'dense-bge-small' then 0.702 when 'baseline-minilm' then 0.629 end::double as threshold from conf))"
PAIRED = "pd as (select r.config, r.qid, coalesce(1.0 / r.rank, 0.0) - coalesce(1.0 / s.rank, 0.0) as diff from ranks r join ranks s on s.config = 'baseline-minilm' and s.qid = r.qid)"
CV = """cvin as (select *, ((row_number() over (partition by config, positive order by md5('0:' || qid), qid) - 1) % 5)::int as fold from conf),
    cl as (select config, t.test, confidence as boundary, sum(positive::int) as pos, sum((not positive)::int) as neg from cvin cross join (select unnest([0, 1, 2, 3, 4]) as test) t where fold <> t.test group by all),
    cp as (select config, test, boundary, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by config, test) as p from cl window w as (partition by config, test order by boundary rows unbounded preceding)
        union all select config, test, null, 0, 0, sum(pos) from cl group by config, test),
    cc as (select config, test, boundary, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f1 from (select *, case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as pr, case when p > 0 then tp / p else 0.0 end as rc from cp)),
    cb as (select config, test as fold, boundary from (select *, row_number() over (partition by config, test order by round(f1, 12) desc, coalesce(boundary, '-inf'::double)) as rn from cc) where rn = 1),
    said as (select cvin.config, positive, coalesce(confidence <= boundary, false) as said from cvin join cb using (config, fold)),
    sums as (select config, sum((said and positive)::int) as tp, sum(said::int) as n, sum(positive::int) as p from said group by config),
    cvf as (select config, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as cv_f1 from (select config, case when n > 0 then tp / n else 1.0 end as pr, case when p > 0 then tp / p else 0.0 end as rc from sums))"""
AWE = """awe as (select r.config, count(*) as n, avg(((b.boundary is null or k.confidence > b.boundary) and coalesce(r.rank <= 4, false))::int::double) as answered_with_evidence
    from ranks r join conf k on k.config = r.config and k.qid = r.qid join best b on b.config = r.config group by r.config)"""
HM = "select config, count(*) as n, {} from ranks group by config".format(", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in (1, 3, 4, 5, 10)) + ", round(avg(case when rank <= 10 then 1.0 / rank else 0.0 end), 6) as mrr_10")

_JSON_CHUNKS = """one as (select arg_max(payload, loaded_at) as payload from chunk_files where payload is not null group by coalesce(file_name, payload)),
    pg as (select json_extract_string(p, '$.page') as page, json_extract(p, '$.chunks') as cs from (select unnest(json_extract(payload, '$.pages[*]')) as p from one)),
    lists as (select null as page, payload::json as cs from one where json_type(payload) = 'ARRAY' union all select null, json_extract(payload, '$.chunks') from one
        union all select null, unnest(json_extract(payload, '$.document.sections[*].chunks')) from one union all select page, cs from pg),
    ch as (select page, unnest(case json_type(cs) when 'ARRAY' then json_extract(cs, '$[*]') when 'OBJECT' then [cs] else [] end) as x from lists),
    rg as (select json_extract_string(x, '$.chunk_id') as chunk_id, json_extract_string(x, '$.page_start') as page_start, json_extract_string(x, '$.page_end') as page_end, page, case json_type(json_extract(x, '$.regions')) when 'ARRAY' then json_extract(x, '$.regions[*]') when 'OBJECT' then [json_extract(x, '$.regions')] else [] end as rs from ch),
    js as (select chunk_id, unnest(rs) as r, generate_subscripts(rs, 1) - 1 as region_no, page_start, page from rg)"""


_CORNERS = ", ".join(f"try_cast(coalesce(json_extract_string(r, '$.bbox.{a}{i}'), json_extract_string(r, '$.bbox.{'min' if i == 0 else 'max'}.{a}'), json_extract_string(r, '$.bbox[{2 * i + (a == 'y')}]')) as double)" for i in (0, 1) for a in "xy")


def oracle_sql() -> dict[str, str]:
    six = "round(score, 6) as score"
    sql = {
        "blocks_from_lines": r"""select doc_id, (i - 1)::int as block_ord, s as text, (1 + (i - 1) // 10)::int as page, ((i - 1) * 12)::double as y0, ((i - 1) * 12 + 12)::double as y1
            from (select doc_id, i, regexp_replace(t, '^\s+|\s+$', '', 'g') as s from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where doc_id is not null)) where s <> ''""",
        "page_routing": rf"""with {B}, p as (select source_file, page, string_agg(coalesce(text, ''), chr(10) order by block_ord, block_id) as t from b where source_file is not null and page is not null group by all)
            select source_file, page, case when length(regexp_replace(t, '^\s+|\s+$', '', 'g')) >= 20 then 'digital' else 'ocr' end as route from p""",
        "ocr_counts": f"""with {B} select source_file, count(*) as n_blocks, count(*) filter (lower(trim(extraction_method)) = 'ocr') as n_ocr, count(distinct page) filter (lower(trim(extraction_method)) = 'ocr') as ocr_pages
            from b where source_file is not null group by source_file""",
        "ocr_line_grouping": r"""with w as (select doc_id, unnest(regexp_extract_all(text, '\S+')) as t, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 as pos from documents where text is not null)
            select doc_id, (row_number() over (partition by doc_id order by min(pos)) - 1)::int as block_ord, string_agg(t, ' ' order by pos) as text, round(min(pos % 8 * 70) * 0.5, 2)::double as x0, round(min(pos // 8 * 20) * 0.5, 2)::double as y0,
            round(max(pos % 8 * 70 + length(t) * 8) * 0.5, 2)::double as x1, round(max(pos // 8 * 20 + 16) * 0.5, 2)::double as y1 from w group by doc_id, pos // 64, pos // 32, pos // 8""",
        "chunk_bounds": f"with recursive {RANGES} select doc_id, chunk_no, word_from, word_to from ranges",
        "chunk_text": f"""with recursive {RANGES}, dw as (select doc_id, flatten(list(ws order by block_ord)) as ws from br group by doc_id)
            select r.doc_id || '_' || r.chunk_no as chunk_id, any_value(coalesce(m.src, r.doc_id)) as source_file, any_value(m.p0) as page_start, any_value(m.p1) as page_end, any_value(array_to_string(dw.ws[(r.word_from + 1):r.word_to], ' ')) as text
            from ranges r join dw using (doc_id) join (select doc_id, chunk_no, min(page) as p0, max(page) as p1, arg_min(source_file, block_ord) as src from mem group by all) m using (doc_id, chunk_no) group by r.doc_id, r.chunk_no""",
        "chunk_regions": f"""with recursive {RANGES} select doc_id || '_' || chunk_no as chunk_id, (row_number() over (partition by doc_id, chunk_no order by block_ord) - 1)::int as region_no, page, bbox.x0 as x0, bbox.y0 as y0, bbox.x1 as x1, bbox.y1 as y1 from mem""",
        "token_counts": f"with {C} select chunk_ord, len(ts)::int as n_tokens, len(list_distinct(ts))::int as n_terms from (select chunk_ord, {_tokens('text')} as ts from c)",
        "bm25_idf": f"with {BM25} select term, n, round(idf, 6) as idf from idf",
        "bm25_topk": f"with {BM25} select qid, chunk_ord, rank, {six} from bm where rank <= 10",
        "dense_topk": f"""select qid, chunk_ord, rank, {six} from (select a.vec_id as qid, b.vec_id as chunk_ord, list_dot_product(a.embedding::double[], b.embedding::double[]) as score,
            row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id)::int as rank
            from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where rank <= 10""",
        "bow_dense_topk": f"with {C}, {Q}, {DENSE} select qid, chunk_ord, rank, {six} from de where rank <= 10",
        "hybrid_topk": f"""with {BM25}, {DENSE}, f as (select qid, chunk_ord, d.rank as r0, s.rank as r1 from (select * from de where rank <= 50) d full join (select * from bm where rank <= 50) s using (qid, chunk_ord)),
            g as (select *, coalesce(1.0 / (60 + r0), 0.0) + coalesce(1.0 / (60 + r1), 0.0) as score from f)
            select qid, chunk_ord, rank, {six} from (select *, row_number() over (partition by qid order by round(score, 12) desc, coalesce(r0, 1073741824 + r1), chunk_ord)::int as rank from g) where rank <= 10""",
        "rrf_fusion": f"""with {H}, s as (select qid, chunk_ord, sum(1.0 / (60 + rank) order by config) as score, min({{'c': config, 'r': rank}}) as first from h where config is not null group by all)
            select qid, chunk_ord, rank, {six} from (select *, row_number() over (partition by qid order by round(score, 12) desc, first, chunk_ord)::int as rank from s) where rank <= 10""",
        "rerank_topk": f"""with {BM25}, qd as (select qid, list_distinct({_tokens('question')}) as ts from q),
            o as (select bm.qid, bm.chunk_ord, bm.rank as base, case when len(qd.ts) > 0 then len(list_intersect(qd.ts, list_distinct(tk.ts))) / len(qd.ts) else 0.0 end as score from bm join qd using (qid) join tk using (chunk_ord) where bm.rank <= 30)
            select qid, chunk_ord, rank, {six} from (select *, row_number() over (partition by qid order by score desc, base)::int as rank from o) where rank <= 10""",
        "confidence_per_query": f"with {C}, {Q}, {DENSE} select q.qid, round(coalesce(de.score, 0.0), 6) as confidence from q left join de on de.qid = q.qid and de.rank = 1",
        "abstain_gate": f"with {Q}, {CONF}, {GATE} select config, qid, confidence, threshold, decision from gate",
        "relevance_exact": f"with {C}, {Q}, {EXACT} select qid, chunk_ord from rel",
        "relevance_fuzzy": f"with {C}, {Q}, {REL} select qid, chunk_ord from rel",
        "label_errors": f"with {C}, {Q}, {REL} select qid, source_file, question from q where answerable and qid not in (select qid from rel)",
        "first_relevant_rank": f"with {C}, {Q}, {H}, {REL}, {RANKS} select config, qid, rank from ranks",
        "hit_mrr": f"with {C}, {Q}, {H}, {REL}, {RANKS} {HM}",
        "pr_curve": f"with {Q}, {CONF}, {CURVE} select config, round(boundary, 6) as boundary, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(answered_rate, 6) as answered_rate from curve",
        "pick_threshold": f"with {Q}, {CONF}, {CURVE}, {BEST} select config, round(boundary, 6) as boundary, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(answered_rate, 6) as answered_rate from best",
        "roc_auc": f"with {Q}, {CONF}, {CURVE}, {AUC} select config, round(auc, 6) as auc from auc",
        "cv_f1": f"with {Q}, {CONF}, {CV} select config, round(cv_f1, 6) as cv_f1 from cvf",
        "paired_diff": f"with {C}, {Q}, {H}, {REL}, {RANKS}, {PAIRED} select config, count(*) as n, round(avg(diff), 6) as mean_diff from pd group by config",
        "answered_with_evidence": f"with {C}, {Q}, {H}, {REL}, {RANKS}, {CONF}, {CURVE}, {BEST}, {AWE} select config, n, round(answered_with_evidence, 6) as answered_with_evidence from awe",
        "context_assembly": f"with {C}, {H}, {FIRST}, {CTX} select config, qid, context from ctx",
        "citations": f"""with {C}, {H}, {FIRST} select config, qid, rank, coalesce(source_file, '') || ' p.' || page_start || '-' || page_end
            || case when regions[1].bbox.x0 is not null and regions[1].bbox.y0 is not null and regions[1].bbox.x1 is not null and regions[1].bbox.y1 is not null
                then ', bbox=(' || round(regions[1].bbox.x0)::bigint || ',' || round(regions[1].bbox.y0)::bigint || ',' || round(regions[1].bbox.x1)::bigint || ',' || round(regions[1].bbox.y1)::bigint || ')' else '' end
            || ' [rank score=' || printf('%.3f', 1.0 / (60 + rank)) || ']' as citation from fh join c using (chunk_ord)""",
        "search_preview": f"with {C}, {H}, {FIRST} select config, qid, rank, chunk_id, substr(text, 1, 200) as preview from fh join c using (chunk_ord)",
        "answers": f"""with {C}, {Q}, {H}, {FIRST}, {CTX}, {CONF}, {GATE},
            x as (select gate.config, gate.qid, decision, trim(split_part(split_part(split_part(case when strpos(context, ']' || chr(10)) > 0 then substr(context, strpos(context, ']' || chr(10)) + 2) else '' end,
                chr(10) || chr(10) || '---' || chr(10) || chr(10), 1), chr(10) || chr(10) || 'Question:', 1), '. ', 1)) as a from gate left join ctx using (config, qid))
            select config, qid, decision, case when decision = 'answer' and coalesce(a, '') <> '' then a else 'I don''t have enough information' end as answer from x""",
        "labels_review": f"""with {C}, {Q}, {REL}, r as (select qid, chunk_ord, page_start, page_end from rel join c using (chunk_ord)),
            p as (select qid, string_agg(page::varchar, ', ' order by page) as pages from (select distinct qid, unnest(generate_series(page_start, page_end)) as page from r) group by qid), n as (select qid, count(*) as n from r group by qid)
            select qid, answerable, source_file, answer, coalesce(n, 0) as n_chunks, coalesce(pages, '') as pages, why_unanswerable from q left join n using (qid) left join p using (qid)""",
        "config_report": f"""with {C}, {Q}, {H}, {REL}, {RANKS}, {CONF}, {CURVE}, {BEST}, {AUC}, {CV}, {AWE}, {PAIRED}, hm as ({HM}), pm as (select config, avg(diff) as mean_diff from pd group by config)
            select config, hm.n, hit_1, hit_4, hit_10, mrr_10, round(f1, 6) as abstain_f1, round(auc, 6) as auc, round(cv_f1, 6) as cv_f1, round(answered_with_evidence, 6) as answered_with_evidence, round(mean_diff, 6) as mean_diff
            from hm join best using (config) join auc using (config) join cvf using (config) join awe using (config) join pm using (config)""",
        "p3_found": f"""with {C}, {_JSON_CHUNKS}, ty as (select chunk_id, page_start, unnest(regions) as r, generate_subscripts(regions, 1) - 1 as region_no from c)
            select distinct chunk_id, region_no::bigint as region_no, coalesce(r.page, page_start)::bigint as page from ty where r is not null
            union select chunk_id, region_no::bigint, coalesce(try_cast(json_extract_string(r, '$.page') as double), try_cast(page_start as double), try_cast(page as double))::bigint from js where json_type(r) <> 'NULL' and chunk_id is not null""",
        "p3_regions": f"""with {C}, {_JSON_CHUNKS}, ty as (select chunk_id, page_start, unnest(regions) as r, generate_subscripts(regions, 1) - 1 as region_no from c)
            select distinct chunk_id, region_no::bigint as region_no, coalesce(r.page, page_start)::bigint as page, r.bbox.x0 as x0, r.bbox.y0 as y0, r.bbox.x1 as x1, r.bbox.y1 as y1 from ty where r is not null
            union select chunk_id, region_no::bigint, coalesce(try_cast(json_extract_string(r, '$.page') as double), try_cast(page_start as double), try_cast(page as double))::bigint, {_CORNERS} from js where json_type(r) <> 'NULL' and chunk_id is not null""",
        "p3_chunks": f"""with {C}, {_JSON_CHUNKS} select distinct chunk_id, page_start::bigint as page_start, page_end::bigint as page_end from c
            union select chunk_id, coalesce(try_cast(page_start as double), try_cast(page as double))::bigint, try_cast(page_end as double)::bigint from rg where chunk_id is not null""",
    }
    return sql

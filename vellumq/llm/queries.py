"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from vellumq.llm import containers, furniture, language, leaks, neardup, outranking, pieces, quality, scans

MODULES = (outranking, pieces, furniture, containers, leaks, language, quality, neardup, scans)


def queries() -> dict:
    out = {}
    for module in MODULES:
        out |= {k: v for k, v in vars(module).items() if k[0] == "p" and k[1].isdigit()}
    return out


# Every pair of items of a list compared: what the prefix sums avoid.
_FLOW = """h as (select qid as g, config as s, chunk_ord as i, arg_max(case when isnan(score) then null else score end, {'a': score is not null and not isnan(score), 't': searched_at}) as x from hits where qid is not null and config is not null and chunk_ord is not null group by all),
    items as (select distinct g, i from h), n as (select g, count(*) as n from items group by g),
    lists as (select g, s, n - count(*) + count(x) as m, n - count(*) as u from h join n using (g) group by g, s, n),
    named as (select g, s, i, (u + rank() over (partition by g, s order by x) - 1 + count(*) over (partition by g, s, x) / 2) / m as p from h join lists using (g, s) where x is not null),
    rest as (select items.g, lists.s, items.i, u / 2 / m as p from items join lists using (g) where not exists (select 1 from h where h.g = items.g and h.s = lists.s and h.i = items.i)),
    pts as (select * from named union all select * from rest),
    flow as (select a.g, a.i, round(sum((least(1.0, greatest(0.0, (a.p - b.p) / 0.5)) - least(1.0, greatest(0.0, (b.p - a.p) / 0.5))) / m), 9) as flow
        from pts a join pts b on a.g = b.g and a.s = b.s join lists on lists.g = a.g and lists.s = a.s group by all),
    total as (select items.g, items.i, coalesce(flow, 0.0) as flow from items left join flow using (g, i))"""
_CONF = _FLOW.replace("select qid as g, config as s, chunk_ord as i, arg_max(case when isnan(score) then null else score end, {'a': score is not null and not isnan(score), 't': searched_at}) as x from hits where qid is not null and config is not null and chunk_ord is not null group by all", "select 1 as g, config as s, qid as i, arg_max(case when isnan(confidence) then null else confidence end, {'a': confidence is not null and not isnan(confidence), 't': searched_at}) as x from retrieval_results where qid is not null and config is not null group by all")
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_SETS = f"""w as (select chunk_ord, any_value({_W}) as ws from chunks where text is not null and chunk_ord is not null group by chunk_ord),
    s as (select chunk_ord, unnest(list_distinct([ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] for k in generate_series(1, len(ws) - 2)])) as sh from w where len(ws) >= 3),
    n as (select chunk_ord, count(*) as n from s group by chunk_ord),
    i as (select a.chunk_ord as x, b.chunk_ord as y, count(*) as i from s a join s b on a.sh = b.sh and a.chunk_ord < b.chunk_ord group by all),
    near as (select x, y, i.i / (nx.n + ny.n - i.i) as j from i join n nx on nx.chunk_ord = x join n ny on ny.chunk_ord = y where i.i / (nx.n + ny.n - i.i) >= 0.6)"""
# One edit in 13 words leaves 6 words on end as they are: texts without such a piece of an item are left out.
_NEAR = f"""dall as (select doc_id, {_W} as ws from documents where text is not null), t as (select item_id, {_W} as ws from heldout_items where text is not null),
    six as (select distinct unnest([array_to_string(ws[k:(k + 5)], ' ') for k in generate_series(1, len(ws) - 5)]) as g from t),
    sharing as (select distinct doc_id from (select doc_id, unnest([array_to_string(ws[k:(k + 5)], ' ') for k in generate_series(1, len(ws) - 5)]) as g from dall where len(ws) >= 6) join six using (g)),
    d as (select * from dall where doc_id in (select doc_id from sharing)),
    p as (select item_id, k - 1 as no, ws[k:(k + 12)] as g from (select item_id, ws, unnest(generate_series(1, len(ws) - 12)) as k from t where len(ws) >= 13)),
    dk as (select doc_id, unnest([ws[k:(k + 13)] for k in generate_series(1, len(ws) - 11)]) as g from d where len(ws) >= 12), j as (select unnest(generate_series(1, 14)) as j),
    same as (select distinct doc_id, array_to_string(g[1:13], ' ') as g from dk where len(g) >= 13),
    text_ as (select distinct doc_id, 'sub' || j || ' ' || array_to_string(list_concat(g[1:(j - 1)], g[(j + 1):13]), ' ') as g from dk cross join j where j <= 13 and len(g) >= 13
        union select distinct doc_id, 'del ' || array_to_string(g[1:12], ' ') from dk
        union select distinct doc_id, 'ins ' || array_to_string(list_concat(g[1:(j - 1)], g[(j + 1):14]), ' ') from dk cross join j where j between 2 and 13 and len(g) = 14),
    item as (select item_id, no, 'sub' || j || ' ' || array_to_string(list_concat(g[1:(j - 1)], g[(j + 1):13]), ' ') as g from p cross join j where j <= 13
        union all select item_id, no, 'del ' || array_to_string(list_concat(g[1:(j - 1)], g[(j + 1):13]), ' ') from p cross join j where j <= 13
        union all select item_id, no, 'ins ' || array_to_string(g, ' ') from p),
    hit as (select doc_id, item_id, no, 1 as dist from text_ join item using (g) union select doc_id, item_id, no, 0 from same join (select item_id, no, array_to_string(g, ' ') as g from p) using (g))"""
# Every scanned line compared with every head of its source.
_LINES = r"""b as (select * exclude (rn) from (select *, row_number() over (partition by block_id order by loaded_at desc) rn from blocks where block_id is not null) where rn = 1),
    said as (select *, case when lower(trim(extraction_method)) in ('ocr', 'digital') then (lower(trim(extraction_method)) = 'ocr')::int end as said from b),
    read as (select *, coalesce(said, max(said) over (partition by source_file, page), 0) = 1 as scanned from said),
    raw as (select block_id, source_file, page, scanned, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from read where text is not null and source_file is not null and page is not null),
    ln as (select *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') as norm, len(regexp_extract_all(lower(line), '\p{L}+')) as words, len(regexp_extract_all(line, '\S+')) as tokens from raw),
    l as (select * from ln where norm <> '' and words >= case when scanned then 3 else 5 end),
    kind as (select source_file, norm, scanned, count(distinct page) as pages, max(words) as words, max(tokens) as most, min(tokens) as least from l group by all),
    head as (select source_file, norm, sum(pages) as pages, max(most) as most, min(least) as least from kind group by all having sum(pages) >= 2 and max(words) >= 5),
    loose as (select *, greatest(0, least(floor(length(norm) * 0.125), floor(length(norm) / 6) - 1)) as edits from kind where scanned),
    copy as (select k.source_file, k.norm, arg_max(h.norm, {'p': h.pages, 'n': h.norm}) as head from loose k join head h on h.source_file = k.source_file and h.norm <> k.norm and edits > 0 and h.pages > k.pages
        and k.least <= h.most and k.most >= h.least and abs(length(h.norm) - length(k.norm)) <= edits and levenshtein(k.norm, h.norm) <= edits group by all),
    lh as (select l.*, case when scanned then coalesce(copy.head, l.norm) else l.norm end as head from l left join copy on copy.source_file = l.source_file and copy.norm = l.norm),
    pg as (select source_file, head, count(distinct page) as pages from lh group by all),
    found as (select pg.* from pg join head on head.source_file = pg.source_file and head.norm = pg.head where pg.pages >= 6)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_FLOW} select g as qid, i as chunk_ord from (select *, row_number() over (partition by g order by flow desc, i) as rn from total) where rn = 1",
        "p1_ranking": f"with {_FLOW} select g as qid, i as chunk_ord, round(flow, 6) as flow, row_number() over (partition by g order by flow desc, i) as rank from total",
        "p1_confidence": f"with {_CONF} select i as qid, round(flow, 6) as flow, row_number() over (order by flow desc, i) as rank from total",
        "p4_found": r"""select distinct chunk_ord from chunks where text is not null and chunk_ord is not null
            and (len(regexp_extract_all(text, '\S+')) > 240 or length(text) > 1800)""",
        "p4_invariants": "select count(distinct chunk_ord) as chunks, 0::bigint as over_a_limit, 0::bigint as not_rejoined, 0::bigint as other_overlap from chunks where text is not null and chunk_ord is not null",
        "p5_found": f"with {_SETS} select x as chunk_ord_a, y as chunk_ord_b from near",
        "p5_groups": f"""with recursive {_SETS}, rep as (select n.chunk_ord, coalesce(min(x), n.chunk_ord) as rep from n left join near on y = n.chunk_ord and j = 1 group by n.chunk_ord),
            lk as (select distinct a.rep as a, b.rep as b from near join rep a on a.chunk_ord = x join rep b on b.chunk_ord = y where a.rep <> b.rep),
            ed as (select a, b from lk union select b, a from lk), reach as (select distinct rep as a, rep as b from rep union select reach.a, ed.b from reach join ed on ed.a = reach.b),
            g as (select a as rep, min(b) as g from reach group by a), m as (select a as rep, count(distinct b) as links from ed group by a)
            select chunk_ord, rep as class_id, g as group_id, coalesce(links, 0) as links from rep join g using (rep) left join m using (rep)""",
        "p7_found": f"with {_LINES} select distinct block_id, line_no::bigint as line_no from lh join found using (source_file, head)",
        "p7_clean": f"""with {_LINES}, gone as (select distinct block_id, line_no from lh join found using (source_file, head)),
            every as (select block_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from b where text is not null),
            kept as (select block_id, string_agg(line, chr(10) order by line_no) as text from every where (block_id, line_no) not in (select (block_id, line_no) from gone) group by block_id)
            select b.block_id, kept.text from b left join kept using (block_id)""",
        "p8_invariants": "select count(distinct doc_id) as documents, 0::bigint as broken, 0::bigint as overfull from documents where text is not null and doc_id is not null",
        "p9_found": f"""with d as (select doc_id, {_W} as ws from documents where text is not null), t as (select item_id, {_W} as ws from heldout_items where text is not null),
            dg as (select distinct doc_id, unnest([array_to_string(ws[k:(k + 12)], ' ') for k in generate_series(1, len(ws) - 12)]) as g from d where len(ws) >= 13),
            tg as (select distinct item_id, unnest([array_to_string(ws[k:(k + 12)], ' ') for k in generate_series(1, len(ws) - 12)]) as g from t where len(ws) >= 13)
            select distinct doc_id, item_id from dg join tg using (g)""",
        "p9_near": f"with {_NEAR} select doc_id, item_id, count(distinct no) as windows, min(dist) as least, count(distinct case when dist = 0 then no end) as exact from hit group by all",
    }

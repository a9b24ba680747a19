"""ANSI SQL that gives the same rows as the queries of problems.py, where SQL can express them on whole tables."""

_REF_IDS = r"""
  trimmed as (
    select pmid, year, ingested_at, regexp_replace(trim(lower(regexp_replace(refarticleid, '[\s\x{00a0}\x{200b}\x{feff}]+', ' ', 'g'))), '^(pubmed|pmid|id|pm)?( ?id)? ?[:=#]? ?', '') s
    from reference where refarticleid is not null
  ), refs as (
    select 'reference' src, pmid id, year, try_cast(regexp_extract(s, '^\+?0*([0-9]+)(\.0*)?$', 1) as bigint) ref_id, ingested_at from trimmed
    union all
    select 'citation_network', id, year, unnest(citations.refs), ingested_at from citation_network
    union all
    select 'refs_embedding', id, year, unnest(list_transform(refs_embedding, lambda e: e.id)), ingested_at from refs_embedding
  )"""

P2_FOUND = f"""
with {_REF_IDS}, once as (
  select src, id, ref_id, coalesce(min(year), -1) as year, min(ingested_at) seen from refs where ref_id is not null group by src, id, ref_id
), par as (
  select id, min(ingested_at) first_seen, arg_max(gone, ingested_at) gone from (
    select id, ingested_at, deleted_at is not null or coalesce(lower(trim(record_state)) in ('deleted', 'withdrawn'), false) gone from articles
    union all select id, ingested_at, false from core_articles) group by id
), kinds as (
  select o.src, o.id, o.year, o.ref_id, case when p.id is null then 'missing' when p.gone then 'deleted' when p.first_seen > o.seen then 'late' end as kind
  from once o left join par p on o.ref_id = p.id
)
select src, id, year, ref_id, kind from kinds where kind is not null
"""

P2_REPORT = f"select src, year, kind, cast(count(*) as bigint) as n_refs, count(distinct id) as n_records from ({P2_FOUND}) group by src, year, kind"

_CHUNKS = "chunks as (select id, chunk_no, min(year) as year, any_value(citations.cited_by) as cited_by from citation_network group by id, chunk_no)"
_ENTRIES = """recs as (select id, min(year) as year, any_value(cr_year_category) as cat from ref_journals group by id),
  ent as (select year, unnest(list_transform(cat, lambda e: e.journal)) as journal from recs),
  entries as (select * from ent where length(trim(journal)) > 0)"""

P4_ARTICLES = f"""
with {_CHUNKS}, years as (select id as citing, min(year) as y from chunks group by id), cited as (select id, unnest(cited_by) as citing from chunks)
select c.id, count(*) as n_cited_by, count(y.citing) as n_known, min(y.y) as first_year, max(y.y) as last_year, cast(sum(y.y) as bigint) as sum_year
from cited c left join years y on c.citing = y.citing group by c.id
"""

P4_JOURNALS = f"""
with {_ENTRIES}
select e.journal, count(*) as n_entries, count(w.jcr_id) as n_listed, min(w.jcr_id) as jcr_id, cast(sum(e.year) as bigint) as sum_year
from entries e left join wos_jcr w on e.journal = w.title20 group by e.journal
"""

P4_FOUND = f"""
with {_CHUNKS}, {_ENTRIES},
  a as (select id, sum(coalesce(len(cited_by), 0)) as n from chunks group by id),
  j as (select journal, count(*) as n from entries group by journal)
select 'cited_by' as field_name, cast(id as varchar) as key_val from a where n > 0 and n * 50 >= (select sum(n) from a)
union all
select 'journal', journal from j where n * 50 >= (select sum(n) from j)
"""

ORACLES = {"p2_found": P2_FOUND, "p2_report": P2_REPORT, "p4_articles": P4_ARTICLES, "p4_journals": P4_JOURNALS, "p4_found": P4_FOUND}

# another way to the same citations: they are recognised by their form instead of being what is left between separators
_CITATION = r'''"(?:[^"]|"")*"|[A-Za-z][^;|"\r\n\t/]*?\. ?(?:1[5-9]|20)[0-9]{2}(?: [A-Z][a-z]{2}(?: [0-9]{1,2})?)?(?:;[0-9]+(?:\([0-9]+\))?:\w+(?:-\w+)?)?'''

P5_FOUND = f"""
with one as (select row_id, any_value(refcitation) as t from reference where refcitation is not null group by row_id),
  found as (select row_id, list_filter(list_transform(regexp_extract_all(t, '{_CITATION}'), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end),
    lambda x: regexp_matches(x, '^\\S.*\\.\\s*(1[5-9]|20)[0-9]{{2}}')) as l from one)
select row_id, cast(generate_subscripts(l, 1) as int) as pos, unnest(l) as val from found where len(l) >= 2
"""

_P7 = r"""
with tree as (select rec_id, t.key, t.value, t.type, t.fullkey from (select rec_id, payload from result_records where json_valid(payload)) r, json_tree(r.payload) t),
  mesh as (select rec_id, type, value from tree where key = 'Mesh_year_category' and type in ('ARRAY', 'OBJECT')),
  entries as (
    select rec_id, cast(e.key as int) as pos1, e.value as entry from mesh m, json_each(m.value) e where m.type = 'ARRAY' and e.type = 'OBJECT'
    union all select rec_id, 0, value from mesh where type = 'OBJECT'),
  cats as (select rec_id, pos1, json_extract(entry, '$.category') as c, json_type(entry, '$.category') as kind from entries),
  codes as (
    select rec_id, pos1, cast(e.key as int) as pos2, case e.type when 'OBJECT' then json_extract_string(e.value, '$.tree') when 'NULL' then null else json_extract_string(e.value, '$') end as item from cats c, json_each(c.c) e where c.kind = 'ARRAY'
    union all select rec_id, pos1, 0, json_extract_string(c, '$') from cats where kind = 'VARCHAR'),
  outs as (select rec_id, coalesce(try_cast(regexp_extract(fullkey, 'disruptiveness[^\[]*\[([0-9]+)\]', 1) as int), 0) as pos1, try_cast(json_extract_string(value, '$') as double) as x from tree where key = 'DI1' and contains(fullkey, 'disruptiveness') and type <> 'NULL')"""

P7_FOUND = f"""{_P7}
select rec_id, 'category' as branch, pos1, pos2, item from codes where item is not null
union all
select rec_id, 'di1', pos1, 0, cast(cast(round(x * 10000) as bigint) as varchar) from outs where x is not null and not isnan(x)
"""

_FIRST = "arg_min(json_extract_string(value, '$'), id) filter (where key = '{}' and type not in ('OBJECT', 'ARRAY') and not contains(fullkey, '['))"

ORACLES |= {
    "p5_found": P5_FOUND,
    "p7_found": P7_FOUND,
    "p7_records": f"""with tree as (select rec_id, t.* from (select rec_id, payload from result_records where json_valid(payload)) r, json_tree(r.payload) t),
      f as (select rec_id, {_FIRST.format('PMID')} as pmid, {_FIRST.format('year')} as record_year from tree group by rec_id)
      select r.rec_id, case when payload is null or length(trim(payload)) = 0 then 'empty' when json_valid(payload) then 'complete' else 'broken' end as state, f.pmid, f.record_year from result_records r left join f on r.rec_id = f.rec_id""",
    "p7_entries": f"{_P7} select rec_id, pos1 as entry_no, json_extract_string(entry, '$.descUI') as descui, json_extract_string(entry, '$.year') as entry_year from entries",
    "p7_categories": f"{_P7} select rec_id, pos1 as entry_no, pos2 as category_no, item as category from codes where item is not null",
    "p7_di1": f"{_P7} select rec_id, pos1 as output_no, x as di1 from outs where x is not null and not isnan(x)",
}

# every value, also of fields that hold one: what separates nothing is hidden first, as these patterns can't look ahead
_SPAN = '"[^"]*(?:""[^"]*)*"'

P5_VALUES = rf"""
with one as (select row_id, any_value(refcitation) as t from reference where refcitation is not null group by row_id),
  marked as (select row_id, regexp_extract_all(t, '{_SPAN}') as spans, string_split_regex(t, '{_SPAN}') as gaps from one),
  held as (select row_id, spans, list_aggregate(list_transform(range(len(gaps)), lambda i: gaps[i + 1] || case when i < len(gaps) - 1 then chr(57344) || i || chr(57345) else '' end), 'string_agg', '') as s from marked),
  volumes as (select row_id, spans, regexp_replace(regexp_replace(regexp_replace(s, ';(\s*[0-9]+\s*[(:;])', chr(57346) || '\1', 'g'), ';(\s*[0-9]+\s*[(:;])', chr(57346) || '\1', 'g'), ';([0-9])', chr(57346) || '\1', 'g') as s from held),
  numbers as (select row_id, spans, regexp_replace(regexp_replace(s, '(^|[\s;|/])(\[[0-9]+\]|\(?[0-9]+\))(\s)', '\1|\3', 'g'), '(^|[\s;|/])(\[[0-9]+\]|\(?[0-9]+\))(\s)', '\1|\3', 'g') as s from volumes),
  pieces as (select row_id, spans, list_transform(string_split_regex(s, '[|\t\r\n]+|//+|;'), lambda p: regexp_replace(replace(p, chr(57346), ';'), '^[\s\x{{a0}};|]+|[\s\x{{a0}};|]+$', '', 'g')) as ps from numbers),
  restored as (select row_id, list_filter(list_transform(ps, lambda p: case when regexp_full_match(p, chr(57344) || '[0-9]+' || chr(57345)) then trim(replace(spans[cast(p[2:-2] as int) + 1][2:-2], '""', '"'))
      else list_reduce(list_prepend(p, list_transform(range(len(spans)), lambda i: chr(57344) || i || chr(57345) || spans[i + 1])), lambda a, b: replace(a, regexp_extract(b, '^' || chr(57344) || '[0-9]+' || chr(57345)), regexp_replace(b, '^' || chr(57344) || '[0-9]+' || chr(57345), ''))) end), lambda v: length(trim(v)) > 0) as l from pieces)
select row_id, cast(generate_subscripts(l, 1) as int) as pos, unnest(l) as val from restored where len(l) > 0
"""

ORACLES["p5_values"] = P5_VALUES

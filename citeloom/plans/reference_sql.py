"""ANSI SQL that gives the same rows as the queries of reference.py."""

from __future__ import annotations

from citeloom.functions.stats import PERCENTILES as _PS
from citeloom.plans.reference import FOCAL, ORDER_FOCAL, ORDER_WINDOW, SAMPLES, WINDOW, WORD_DIM

_ITEMS = """recs as (select id, min(year) as year, any_value(cr_year_category) as c from ref_journals group by id),
  ent as (select id, year, unnest(c) as e from recs),
  items as (select id as doc_id, year, e.journal as item, e.year as item_year from ent where e.journal <> '' and year is not null)"""
_COUNTS = f"{_ITEMS}, m as (select doc_id, year, item, count(*) as n from items group by all)"
_WEIGHTED = f"""{_COUNTS}, dp as (select a.doc_id, a.year, a.item as i, b.item as j, case when a.item = b.item then a.n * (a.n - 1) // 2 else a.n * b.n end as n
    from m a join m b on a.doc_id = b.doc_id and a.item <= b.item where a.item < b.item or a.n > 1),
  cooc as (select year, i, j, cast(sum(n) as bigint) as w from dp group by all)"""
_UNWEIGHTED = f"""{_COUNTS}, dp as (select a.doc_id, a.year, a.item as i, b.item as j, 1 as n from m a join m b on a.doc_id = b.doc_id and a.item < b.item),
  cooc as (select year, i, j, count(*) as w from dp group by all)"""
_ENOUGH = "enough as (select doc_id from items group by doc_id having count(*) >= 3)"
_LEE = f"""{_WEIGHTED}, ends as (select year, i as item, w from cooc union all select year, j, w from cooc where i <> j),
  margin as (select year, item, sum(w) as n from ends group by all), total as (select year, sum(w) as nt from cooc group by year),
  score as (select c.year, c.i, c.j, c.w, cast(c.w as double) * cast(t.nt as double) / (cast(a.n as double) * cast(b.n as double)) as s from cooc c join total t on c.year = t.year join margin a on c.year = a.year and c.i = a.item
    join margin b on c.year = b.year and c.j = b.item), {_ENOUGH},
  spread as (select d.doc_id, d.year, s.s, unnest(range(d.n)) as k from dp d join score s on d.year = s.year and d.i = s.i and d.j = s.j where d.doc_id in (select doc_id from enough)),
  lee as (select doc_id, year, -ln(quantile_cont(s, 0.1)) as novelty, list_sort(list(round(s, 9))) as scores from spread group by doc_id, year)"""

_WANG = f"""{_UNWEIGHTED},
  fresh as (select i, j from cooc c where year = {FOCAL} and not exists (select 1 from cooc p where p.year < {FOCAL} and p.i = c.i and p.j = c.j)),
  reused as (select i, j, cast(sum(w) as bigint) as w from cooc where year between {FOCAL + 1} and {FOCAL + WINDOW} group by i, j having sum(w) >= 1),
  d as (select i, j, sum(w) as w from cooc where year >= {FOCAL - WINDOW} and year < {FOCAL} group by i, j),
  sym as (select i as a, j as k, w from d union all select j, i, w from d),
  size as (select a, sqrt(cast(sum(w * w) as double)) as size from sym group by a)"""


def _cos(pairs: str) -> str:
    return f"""cos as (select p.i, p.j, cast(sum(x.w * y.w) as double) / (any_value(si.size) * any_value(sj.size)) as cos from {pairs} p join sym x on x.a = p.i join sym y on y.a = p.j and y.k = x.k
    join size si on si.a = p.i join size sj on sj.a = p.j group by p.i, p.j)"""


_DIFFICULTY = f"{_WANG}, wanted as (select f.i, f.j from fresh f join reused r on f.i = r.i and f.j = r.j), {_cos('wanted')}, score as (select w.i, w.j, coalesce(1 - c.cos, 0) as s from wanted w left join cos c on w.i = c.i and w.j = c.j)"
_FREQUENCY = f"freq as (select item, count(*) as n from items where year between {FOCAL - 3} and {FOCAL - 1} group by item), often as (select * from freq where n >= (select quantile_cont(n, 0.5) from freq))"

_UZZI = f"""{_WEIGHTED}, fi as (select * from items where year = {FOCAL}),
  slots as (select doc_id, year, item_year, item, row_number() over (partition by item_year order by doc_id, item) as slot from fi where item_year is not null),
  drawn as (select k, item_year, item, row_number() over (partition by k, item_year order by md5('0:' || k || ':' || slot), slot) as slot from slots, unnest(range(1, {SAMPLES + 1})) as t(k)),
  shuffled as (select d.k, s.doc_id, s.year, s.slot, s.item_year, d.item from drawn d join slots s on d.item_year = s.item_year and d.slot = s.slot),
  sm as (select k, doc_id, item, count(*) as n from shuffled group by all),
  sp as (select a.k, a.doc_id, a.item as i, b.item as j, case when a.item = b.item then a.n * (a.n - 1) // 2 else a.n * b.n end as n from sm a join sm b on a.k = b.k and a.doc_id = b.doc_id and a.item <= b.item where a.item < b.item or a.n > 1),
  sc as (select k, i, j, sum(n) as w from sp group by all),
  moments as (select {FOCAL} as year, i, j, cast(sum(w) as bigint) as sum_w, cast(sum(w * w) as bigint) as sum_w2, cast(sum(w) as double) / {SAMPLES} as mean,
    sqrt(cast({SAMPLES} * sum(w * w) - sum(w) * sum(w) as double)) / {SAMPLES} as sd from sc group by i, j),
  z as (select c.year, c.i, c.j, case when m.sd > 0 then (c.w - m.mean) / m.sd else 'nan'::double end as s from cooc c left join moments m on c.i = m.i and c.j = m.j where c.year = {FOCAL})"""

_NET = """chunks as (select id, chunk_no, min(year) as year, any_value(citations.refs) as refs from citation_network group by id, chunk_no),
  papers as (select id as doc_id, min(year) as year from chunks group by id),
  edges as (select distinct citing, cited from (select id as citing, unnest(refs) as cited from chunks) where citing <> cited)"""
_DISRUPTION = f"""{_NET}, foc as (select doc_id from papers where year = {FOCAL}),
  c as (select e.cited as f, e.citing as c from edges e join foc on e.cited = foc.doc_id),
  hop as (select r.citing as f, e.citing as c, count(*) as shared from edges r join foc on r.citing = foc.doc_id join edges e on e.cited = r.cited where e.citing <> r.citing group by all),
  r as (select h.f, h.c from hop h join papers p on p.doc_id = h.c where p.year >= {FOCAL}),
  deep as (select c.f, c.c from c join edges e on e.citing = c.c join c c2 on c2.f = c.f and c2.c = e.cited group by all),
  ni as (select f, count(*) as n from (select * from c except select * from r) group by f),
  nj as (select f, count(*) as n from (select * from c intersect select * from r) group by f),
  nk as (select f, count(*) as n from (select * from r except select * from c) group by f),
  sh as (select c.f, count(*) filter (where h.shared > 4) as n5, cast(sum(h.shared) as bigint) as n from c join hop h on h.f = c.f and h.c = c.c group by c.f),
  dp as (select f, count(*) as n from deep group by f),
  cnt as (select foc.doc_id, {FOCAL} as year, coalesce(ni.n, 0) as n_i, coalesce(nj.n, 0) as n_j, coalesce(nk.n, 0) as n_k, coalesce(sh.n5, 0) as n_j5, coalesce(sh.n, 0) as shared, coalesce(dp.n, 0) as depth
    from foc left join ni on ni.f = doc_id left join nj on nj.f = doc_id left join nk on nk.f = doc_id left join sh on sh.f = doc_id left join dp on dp.f = doc_id),
  counts as (select *, n_i + n_j - depth as breadth from cnt)"""


def _ratio(a: str, b: str) -> str:
    return f"round(case when {b} = 0 then 0 else cast({a} as double) / ({b}) end, 6)"


_INDICES = f"""{_DISRUPTION}, idx as (select doc_id, year, {_ratio('(n_i - n_j)', '(n_i + n_j + n_k)')} as di1, {_ratio('(n_i - n_j5)', '(n_i + n_j5 + n_k)')} as di5, {_ratio('(n_i - n_j)', '(n_i + n_j)')} as di1nok,
  {_ratio('(n_i - n_j5)', '(n_i + n_j5)')} as di5nok, {_ratio('shared', '(n_i + n_j)')} as dein, {_ratio('breadth', '(n_i + n_j)')} as breadth, {_ratio('depth', '(n_i + n_j)')} as depth from counts)"""


def _stats(d: str = "d") -> str:
    """The columns of a distribution; one NaN makes all but n NaN."""
    nan = lambda x: f"round(case when bool_or(isnan({d})) then 'nan'::double else {x} end, 6)"
    return f"count(*) as n, {nan(f'avg({d})')} as mean, {nan(f'stddev_pop(case when isnan({d}) then null else {d} end)')} as sd, " + ", ".join(f"{nan(f'quantile_cont({d}, {p / 100})')} as p{p}" for p in _PS)


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_inner_product({x}, {y})"
    return f"case when {dot(a, a)} = 0 or {dot(b, b)} = 0 then 'nan'::double else 1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) end"


def _refs(field: str) -> str:
    return f"""recs as (select id, min(year) as year, any_value(refs_embedding) as l from refs_embedding group by id),
    ent as (select id, year, unnest(l) as e, generate_subscripts(l, 1) as pos from recs), v as (select id as doc_id, year, pos, e.{field} as vec from ent where e.{field} is not null and len(e.{field}) > 0)"""


def _distances(entity: str) -> str:
    return f"""select '{entity}' as entity, * from (with {_refs(entity + '_embedding')}, p as (select a.doc_id, a.year, {_cosine('a.vec', 'b.vec')} as d from v a join v b on a.doc_id = b.doc_id and a.pos < b.pos)
      select doc_id, year, {_stats()} from p group by doc_id, year)"""


_METRIC = {
    "cosine": _cosine("a.vec", "b.vec"),
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "sqeuclidean": "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "cityblock": "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))",
    "minkowski": "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "correlation": _cosine("list_transform(a.vec, lambda x: x - list_avg(a.vec))", "list_transform(b.vec, lambda x: x - list_avg(b.vec))"),
    "canberra": "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: case when z[1] = 0 and z[2] = 0 then 0 else abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) end))",
    "braycurtis": "case when list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] + z[2]))) = 0 then 'nan'::double else list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2]))) / list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] + z[2]))) end",
    "hamming": "list_avg(list_transform(list_zip(a.vec, b.vec), lambda z: case when z[1] <> z[2] then 1.0 else 0.0 end))",
    "jaccard": "case when len(list_filter(list_zip(a.vec, b.vec), lambda z: z[1] <> 0 or z[2] <> 0)) = 0 then 0 else len(list_filter(list_zip(a.vec, b.vec), lambda z: z[1] <> z[2])) / cast(len(list_filter(list_zip(a.vec, b.vec), lambda z: z[1] <> 0 or z[2] <> 0)) as double) end",
    "chebyshev": "list_max(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))",
}

_AUTHORS = """papers as (select o_orderkey as doc_id, year(o_orderdate)::int as year, o_custkey, (o_custkey * 7 + o_orderkey) % (select count(*) from customer) as second from orders),
  auth as (select doc_id, year, 0 as pos, o_custkey as author_id from papers union all select doc_id, year, 1, second from papers where second <> o_custkey),
  vec as (select o_orderkey as doc_id, cast(embedding as double[]) as vec from orders join embeddings on vec_id = o_orderkey % (select count(*) from embeddings))"""
_PAST = f"""{_AUTHORS}, past as (select distinct a.author_id, a.doc_id as work, v.vec from auth a join vec v on a.doc_id = v.doc_id where a.year between {ORDER_FOCAL - ORDER_WINDOW} and {ORDER_FOCAL - 1}
    and a.author_id in (select author_id from auth where year = {ORDER_FOCAL})),
  works as (select author_id, count(*) as works from past group by author_id),
  mine0 as (select a.doc_id, a.year, a.pos, a.author_id, w.works from auth a join works w on a.author_id = w.author_id where a.year = {ORDER_FOCAL}),
  mine as (select * from mine0 where doc_id in (select doc_id from mine0 group by doc_id having count(*) > 1 and max(works) > 1))"""

_MESH = """recs as (select id, min(year) as year, any_value(mesh_year_category) as l from mesh_terms group by id),
  ent as (select id as doc_id, year, unnest(l) as t, generate_subscripts(l, 1) as pos from recs)"""
_KW_NOVELTY = f"select doc_id, year, sum(case when t.year = year then 1 else 0 end) / cast(count(*) as double) as novelty_kw from ent where year is not null and t is not null group by doc_id, year"
_KW_DIVERSITY = "select doc_id, year, count(distinct c) / cast(count(*) as double) as diversity_kw from (select doc_id, year, unnest(t.category) as c from ent where year is not null) where c is not null group by doc_id, year"

_TEXTS = "texts as (select id as doc_id, arg_max(coalesce(year, -1), ingested_at) as y, arg_max(coalesce(title, '~'), ingested_at) as title, arg_max(coalesce(abstract, '~'), ingested_at) as abstract from articles group by id)"
_COLLECTIONS = {
    "articles": f"(with {_TEXTS} select nullif(y, -1) as year from texts)",
    "citations": "(select min(year) as year from citation_network group by id)",
    "ref_journals": "(select min(year) as year from ref_journals group by id)",
    "mesh_terms": "(select min(year) as year from mesh_terms group by id)",
}
_WOS = """recs as (select id, any_value(cr_year_category) as l from ref_journals group by id), ent as (select id as doc_id, unnest(l) as e, generate_subscripts(l, 1) - 1 as pos from recs),
  cr as (select doc_id, pos, string_split(concat_ws(', ', case when e.year is not null then 'ANON A' end, cast(e.year as varchar), e.journal), ', ') as p from ent where e.journal is not null),
  parsed as (select doc_id, pos, case when len(p) > 2 then p[3] else p[-1] end as journal, case when len(p) > 2 then p[2] end as ref_year from cr),
  wos as (select p.*, case when p.ref_year is not null then w.web_of_science_categories end as cats, p.ref_year is not null and w.title20 is not null as known from parsed p left join wos_jcr w on p.journal = w.title20)"""
_SCORES = f"""scores as (select * from (select doc_id, year, 'commonness' as indicator, 'journals' as variable, novelty as score from (with {_LEE} select doc_id, year, novelty from lee))
  union all select doc_id, year, 'kw_novelty', 'mesh', novelty_kw from (with {_MESH} {_KW_NOVELTY})
  union all select doc_id, year, 'kw_diversity', 'mesh', diversity_kw from (with {_MESH} {_KW_DIVERSITY})),
  fine as (select *, variable || '_' || indicator as k from scores where not isnan(score) and not isinf(score)),
  twos as (select a.year, a.k as a, b.k as b, a.score as x, b.score as y from fine a join fine b on a.doc_id = b.doc_id and a.year = b.year and a.k < b.k)"""
_R = "case when min(x) < max(x) and min(y) < max(y) then round(corr(x, y), 6) end as r"

ORACLES = {
    "cooc_weighted_selfloop": f"with {_WEIGHTED} select * from cooc",
    "cooc_weighted_noloop": f"with {_WEIGHTED} select * from cooc where i <> j",
    "cooc_unweighted": f"with {_UNWEIGHTED} select * from cooc",
    "cooc_window_sum": f"with {_WEIGHTED} select i, j, cast(sum(w) as bigint) as w from cooc where year >= {FOCAL - WINDOW} and year < {FOCAL} group by i, j",
    "item_index": f"with {_ITEMS} select item, row_number() over (order by item) - 1 as idx from (select distinct item from items)",
    "item_frequency": f"with {_ITEMS}, {_FREQUENCY} select * from freq",
    "restricted_items": f"with {_ITEMS}, {_FREQUENCY} select * from often",
    "lee_pair_score": f"with {_LEE} select year, i, j, w, round(s, 9) as s from score",
    "lee_commonness": f"with {_LEE} select doc_id, year, round(novelty, 6) as novelty from lee",
    "lee_density": f"with {_LEE} select doc_id, year, round(novelty, 6) as novelty, scores from lee",
    "list_ids_filter": f"with {_LEE} select doc_id, year, round(novelty, 6) as novelty from lee where doc_id in (select id from refs_embedding)",
    "wang_new_pairs": f"with {_WANG} select * from fresh",
    "wang_reused_pairs": f"with {_WANG} select * from reused",
    "wang_difficulty_cosine": f"with {_WANG}, mine as (select i, j from cooc where year = {FOCAL}), {_cos('mine')} select i, j, round(cos, 6) as cos from cos",
    "wang_pair_score": f"with {_DIFFICULTY} select i, j, round(s, 6) as s from score",
    "wang_novelty": f"""with {_DIFFICULTY}, {_FREQUENCY}, {_ENOUGH}, hit as (select d.doc_id, s.s from dp d join score s on d.i = s.i and d.j = s.j where d.year = {FOCAL} and d.i in (select item from often) and d.j in (select item from often)),
      docs as (select distinct doc_id from items where year = {FOCAL} and doc_id in (select doc_id from enough))
      select d.doc_id, {FOCAL} as year, round(coalesce(sum(h.s), 0), 6) as novelty from docs d left join hit h on d.doc_id = h.doc_id group by d.doc_id""",
    "uzzi_shuffle": f"with {_UZZI} select * from shuffled",
    "uzzi_sample_moments": f"with {_UZZI} select year, i, j, sum_w, sum_w2, round(mean, 6) as mean, round(sd, 6) as sd from moments",
    "uzzi_zscore": f"with {_UZZI} select year, i, j, round(s, 6) as s from z",
    "uzzi_atypicality": f"""with {_UZZI}, {_ENOUGH}, spread as (select d.doc_id, d.year, z.s, unnest(range(d.n)) as k from dp d join z on d.i = z.i and d.j = z.j where d.year = {FOCAL} and d.doc_id in (select doc_id from enough))
      select doc_id, year, round(case when bool_or(isnan(s)) then 'nan'::double else quantile_cont(s, 0.5) end, 6) as conventionality, round(case when bool_or(isnan(s)) then 'nan'::double else quantile_cont(s, 0.1) end, 6) as novelty from spread group by doc_id, year""",
    "foster_given_partition": f"""with {_WEIGHTED}, {_ENOUGH}, past as (select distinct unnest([i, j]) as item from cooc where year >= {FOCAL - WINDOW} and year < {FOCAL}),
      com as (select item, 'c:' || lower(right(item, 1)) as c from past),
      x as (select d.doc_id, d.year, d.n, coalesce(a.c, 'i:' || d.i) as ci, coalesce(b.c, 'i:' || d.j) as cj from dp d left join com a on d.i = a.item left join com b on d.j = b.item where d.year = {FOCAL} and d.doc_id in (select doc_id from enough))
      select doc_id, year, round(sum(case when ci <> cj then n else 0 end) / cast(sum(n) as double), 6) as novelty from x group by doc_id, year""",
    "citation_reverse_index": f"with {_NET} select cited as doc_id, list_sort(list(citing)) as cited_by from edges group by cited",
    "citation_network": f"""with {_NET}, a as (select citing, list_sort(list(cited)) as refs from edges group by citing), b as (select cited, list_sort(list(citing)) as cited_by from edges group by cited)
      select p.doc_id, p.year, coalesce(a.refs, []) as refs, coalesce(b.cited_by, []) as cited_by from papers p left join a on p.doc_id = a.citing left join b on p.doc_id = b.cited""",
    "disruption_counts": f"with {_DISRUPTION} select doc_id, year, n_i, n_j, n_k, n_j5, shared, depth, breadth from counts",
    "disruption_indices": f"with {_INDICES} select * from idx",
    "breadth_depth": f"with {_INDICES} select doc_id, year, breadth, depth from idx",
    "ref_embedding_join": f"""with {_NET}, all_ as (select id as doc_id, min(year) as year, flatten(list(coalesce(refs, []) order by chunk_no)) as refs from chunks group by id),
      each as (select doc_id, year, unnest(refs) as ref_id, generate_subscripts(refs, 1) - 1 as pos from all_)
      select e.doc_id, e.year, cast(e.pos as int) as pos, e.ref_id, list_transform(v.embedding, lambda x: round(cast(x as double), 6)) as vec from each e join embeddings v on v.vec_id = e.ref_id % (2 * (select count(*) from embeddings))""",
    "pairwise_distance_percentiles": f"{_distances('title')} union all {_distances('abstract')}",
    "pairwise_distance_metrics": " union all ".join(
        f"select '{m}' as metric, * from (with {_refs('title_embedding')} select a.doc_id, count(*) as n, round(avg({x}), 6) as mean from v a join v b on a.doc_id = b.doc_id and a.pos < b.pos group by a.doc_id)" for m, x in _METRIC.items()
    ),
    "author_papers": f"with {_AUTHORS} select author_id, list_sort(list(distinct doc_id)) as doc_list from auth where author_id <> 0 group by author_id",
    "author_year_profile": f"with {_AUTHORS} select a.author_id, a.year, count(*) as n, flatten(list(list_transform(v.vec, lambda x: round(x, 6)) order by a.doc_id)) as numbers from auth a join vec v on a.doc_id = v.doc_id group by a.author_id, a.year",
    "author_intra": f"""with {_PAST}, p as (select x.author_id, {_cosine('x.vec', 'y.vec')} as d from past x join past y on x.author_id = y.author_id and x.work < y.work), s as (select author_id, {_stats()} from p group by author_id)
      select m.doc_id, m.year, s.* from mine m join s on m.author_id = s.author_id""",
    "author_inter": f"""with {_PAST}, pairs as (select a.doc_id, a.year, a.author_id as author_a, b.author_id as author_b from mine a join mine b on a.doc_id = b.doc_id and a.pos < b.pos),
      p as (select q.author_a, q.author_b, {_cosine('x.vec', 'y.vec')} as d from (select distinct author_a, author_b from pairs) q join past x on x.author_id = q.author_a join past y on y.author_id = q.author_b),
      s as (select author_a, author_b, {_stats()} from p group by author_a, author_b)
      select q.doc_id, q.year, s.* from pairs q join s on q.author_a = s.author_a and q.author_b = s.author_b""",
    "author_share_captured": f"with {_PAST} select a.doc_id, a.year, round(count(w.author_id) / cast(count(*) as double), 6) as share from auth a left join works w on a.author_id = w.author_id where a.year = {ORDER_FOCAL} group by a.doc_id, a.year",
    "keyword_novelty": f"with {_MESH} select doc_id, year, round(novelty_kw, 6) as novelty_kw from ({_KW_NOVELTY})",
    "keyword_diversity": f"with {_MESH} select doc_id, year, round(diversity_kw, 6) as diversity_kw from ({_KW_DIVERSITY})",
    "mesh_tree_prefix": f"with {_MESH} select doc_id, cast(pos - 1 as int) as pos, list_sort(list_distinct(list_transform(list_filter(t.category, lambda x: x is not null), lambda x: regexp_extract(x, '^[^.]*(?:[.][^.]*)?')))) as prefixes from ent where t.category is not null",
    "text_centroid": f"""with {_TEXTS}, w as (select doc_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) as word from texts where title <> '~'),
      h as (select doc_id, md5(word) as h from w), v as (select doc_id, case when h[1] = '0' then null else [{', '.join(f"cast(('0x' || h[{1 + 2 * k}:{2 + 2 * k}]) as int) / cast(255 as double)" for k in range(WORD_DIM))}] end as v from h)
      select doc_id, count(*) as n_tokens, [{', '.join(f'round(coalesce(sum(v[{k + 1}]), 0) / count(*), 6)' for k in range(WORD_DIM))}] as vec from v group by doc_id""",
    "reference_parse_pubmed": """select row_id, split_part(refcitation, '.', 1) as journal, case when contains(refcitation, '.') then substr(split_part(refcitation, '.', 2), 2, 4) end as ref_year,
      try_cast(case when regexp_full_match(trim(refarticleid), '[0-9]+') then trim(refarticleid) end as bigint) as ref_id from (select row_id, any_value(refcitation) as refcitation, any_value(refarticleid) as refarticleid from reference group by row_id) where refcitation is not null""",
    "reference_parse_wos": f"with {_WOS} select doc_id, cast(pos as int) as pos, journal, ref_year, coalesce(replace(cats, ' |', '/'), '') as category, known from wos",
    "reference_share_captured": f"with {_WOS} select doc_id, round(sum(known::int) / cast(count(*) as double), 6) as share from wos group by doc_id",
    "journal_list_join": f"with {_ITEMS}, named as (select item, count(*) as n_entries, max(year) as last_year from items group by item) select w.jcr_id, w.journal_title, w.title20, n.n_entries, n.last_year from wos_jcr w left join named n on w.journal_title = n.item",
    "doc_counts": " union all ".join(f"select '{n}' as collection, count(*) as n_docs from {q}" for n, q in _COLLECTIONS.items()),
    "doc_counts_by_year": " union all ".join(f"select '{n}' as collection, year, count(*) as n_docs from {q} where year is not null group by year" for n, q in _COLLECTIONS.items()),
    "papers_per_author": f"with {_AUTHORS}, s as (select count(distinct doc_id) as n_papers from auth where author_id <> 0 group by author_id) select cast(n_papers as int) as n_papers, count(*) as n_authors from s where n_papers < (select quantile_cont(n_papers, 0.99) from s) group by n_papers",
    "refs_per_paper_by_year": f"with {_NET}, r as (select citing, count(*) as n from edges group by citing) select p.year, count(*) as n_docs, round(avg(coalesce(r.n, 0)), 6) as mean, round(var_pop(coalesce(r.n, 0)), 6) as variance from papers p left join r on p.doc_id = r.citing where p.year is not null group by p.year",
    "items_per_paper_by_year": f"with {_MESH} select year, count(*) as n_docs, round(avg(len(l)), 6) as mean, round(var_pop(len(l)), 6) as variance from recs where l is not null and year is not null group by year",
    "field_availability": f"with {_TEXTS} select nullif(y, -1) as year, count(*) as n_docs, count(nullif(title, '~')) as n_title, count(nullif(abstract, '~')) as n_abstract from texts group by y",
    "novelty_trend": f"with {_LEE} select year, count(*) as n, round(avg(novelty), 6) as mean from lee where not isnan(novelty) and not isinf(novelty) group by year",
    "score_distribution": f"with {_SCORES} select indicator, variable, count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd, round(min(score), 6) as least, round(max(score), 6) as most from fine group by indicator, variable",
    "indicator_correlation": f"with {_SCORES} select year, a, b, count(*) as n, {_R} from twos group by year, a, b",
    "indicator_correlation_pooled": f"with {_SCORES} select a, b, count(*) as n, {_R} from twos group by a, b",
    "author_intra_all_years": f"""with {_AUTHORS}, past as (select distinct f.author_id, f.year, a.doc_id as work, v.vec from (select distinct author_id, year from auth) f
        join auth a on a.author_id = f.author_id and a.year between f.year - {ORDER_WINDOW} and f.year - 1 join vec v on v.doc_id = a.doc_id),
      works as (select author_id, year, count(*) as works from past group by all),
      mine as (select a.doc_id, a.year, a.author_id, w.works from auth a join works w on w.author_id = a.author_id and w.year = a.year),
      fit as (select doc_id from mine group by doc_id having count(*) > 1 and max(works) > 1),
      s as (select x.author_id, x.year, count(*) as n, avg({_cosine('x.vec', 'y.vec')}) as mean from past x join past y on x.author_id = y.author_id and x.year = y.year and x.work < y.work group by all)
      select m.year, count(*) as n_rows, cast(sum(s.n) as bigint) as n_distances, round(avg(s.mean), 6) as mean from mine m join s on s.author_id = m.author_id and s.year = m.year where m.doc_id in (select doc_id from fit) group by m.year""",
    "refs_per_paper_density": f"with {_NET}, r as (select p.doc_id, count(e.cited) as size from papers p left join edges e on e.citing = p.doc_id group by p.doc_id) select cast(size as int) as size, count(*) as n_docs from r where size < (select quantile_cont(size, 0.99) from r) group by size",
    "items_per_paper_density": f"with {_MESH}, r as (select len(l) as size from recs where l is not null) select cast(size as int) as size, count(*) as n_docs from r where size < (select quantile_cont(size, 0.99) from r) group by size",
    "embedding_trend": f"with {_refs('title_embedding')}, p as (select a.doc_id, a.year, {_cosine('a.vec', 'b.vec')} as d from v a join v b on a.doc_id = b.doc_id and a.pos < b.pos), q as (select doc_id, year, case when bool_or(isnan(d)) then 'nan'::double else quantile_cont(d, 0.1) end as p10 from p group by doc_id, year) select year, count(*) as n, round(avg(p10), 6) as mean from q where not isnan(p10) group by year",
    "scores_long": f"with {_SCORES} select doc_id, year, indicator, variable, round(score, 6) as score from scores",
}

#: The same over abstracts.
ORACLES |= {
    "text_centroid_abstract": ORACLES["text_centroid"].replace("lower(title)", "lower(abstract)").replace("where title", "where abstract"),
    **{f"{n}_abstract": ORACLES[n].replace("title_embedding", "abstract_embedding") for n in ("pairwise_distance_metrics", "embedding_trend")},
}

_KEYWORDS = f"""{_MESH}, named as (select t.descui as descui, t.year as year, t.category as category from ent where t.descui like 'D%'),
  years as (select descui, min(year) as year from named group by descui),
  codes as (select descui, list_sort(list(distinct regexp_extract(c, '^[^.]*(?:[.][^.]*)?'))) as category from (select descui, unnest(category) as c from named) where c is not null group by descui),
  parsed as (select e.doc_id, cast(e.pos - 1 as int) as pos, e.t.descui as descui, y.year, case when y.descui is not null then coalesce(c.category, []) end as category, y.descui is not null as known
    from ent e left join years y on e.t.descui = y.descui left join codes c on e.t.descui = c.descui where e.t.descui is not null)"""
_INTER = f"""{_PAST}, pairs as (select a.doc_id, a.year, a.author_id as author_a, b.author_id as author_b from mine a join mine b on a.doc_id = b.doc_id and a.pos < b.pos),
  p as (select q.author_a, q.author_b, {_cosine('x.vec', 'y.vec')} as d from (select distinct author_a, author_b from pairs) q join past x on x.author_id = q.author_a join past y on y.author_id = q.author_b)"""

ORACLES |= {
    "collection_years": f"with r as (select id, min(year) as year, any_value(cr_year_category) as c from ref_journals group by id) select id, year, coalesce(len(c), -1) as n_items, list_transform(c, lambda e: e.journal) as journal from r where year >= {FOCAL - WINDOW} and year < {FOCAL}",
    "collection_year_list": "select distinct year from mesh_terms where year is not null",
    "pair_score_store": f"with {_LEE} select year, i, j, w, round(s, 9) as s from score where year = {FOCAL}",
    "journal_csv_union": "select cast(jcr_id as varchar) as jcr_id, journal_title as title, issn, web_of_science_categories as categories from wos_jcr",
    "citation_reverse_chunks": f"with {_NET}, r as (select cited, citing, (row_number() over (partition by cited order by citing) - 1) // 100 as c from edges) select cited as doc_id, cast(c as int) as chunk_no, list_sort(list(citing)) as cited_by from r group by all",
    "keyword_parse": f"with {_KEYWORDS} select * from parsed",
    "keyword_share_captured": f"with {_KEYWORDS} select doc_id, round(sum(known::int) / cast(count(*) as double), 6) as share from parsed group by doc_id",
    "restricted_items_by_year": f"""with {_ITEMS}, ahead as (select item, year + k as year from items, unnest(range(1, 4)) as t(k)), freq as (select year, item, count(*) as n from ahead group by all),
      lim as (select year, quantile_cont(n, 0.5) as p from freq group by year) select f.year, f.item from freq f join lim l on f.year = l.year where f.n >= l.p""",
    "journal_documents": f"with {_ITEMS} select item, list_sort(list(distinct doc_id)) as doc_list from items group by item",
    "journal_statistics": f"with {_ITEMS}, l as (select item, count(distinct doc_id) as n from items group by item) select count(*) as n_entities, cast(sum(n) as bigint) as n_documents, round(avg(n), 6) as mean from l",
    "author_slice": f"with {_AUTHORS} select author_id, list_sort(list(distinct doc_id)) as doc_list from auth where author_id <> 0 group by author_id order by author_id limit 25 offset 10",
    "foster_density": ORACLES["foster_given_partition"].replace("as novelty from x group by", "as novelty, list_sort(flatten(list(list_transform(range(n), lambda k: case when ci <> cj then 1.0::double else 0.0::double end)))) as scores from x group by"),
    "uzzi_density": ORACLES["uzzi_atypicality"].replace("as novelty from spread", "as novelty, list(round(s, 6) order by s) as scores from spread"),
    "author_intra_density": f"""with {_PAST}, p as (select x.author_id, {_cosine('x.vec', 'y.vec')} as d from past x join past y on x.author_id = y.author_id and x.work < y.work),
      s as (select author_id, count(*) as n, list_sort(list(round(d, 6))) as scores from p group by author_id) select m.doc_id, m.year, s.* from mine m join s on m.author_id = s.author_id""",
    "author_inter_density": f"""with {_INTER}, s as (select author_a, author_b, count(*) as n, list_sort(list(round(d, 6))) as scores from p group by author_a, author_b)
      select q.doc_id, q.year, s.* from pairs q join s on q.author_a = s.author_a and q.author_b = s.author_b""",
    "reference_lists_pubmed": """with r as (select row_id, any_value(pmid) as pmid, any_value(refcitation) as c, any_value(refarticleid) as a from reference where pmid is not null group by row_id),
      e as (select pmid, row_id, coalesce(regexp_matches(c, '^[^.]*[.].[0-9]{4}'), false) as known, try_cast(case when regexp_full_match(trim(a), '[0-9]+') then trim(a) end as bigint) as id from r)
      select pmid as doc_id, round(sum(known::int) / cast(count(*) as double), 6) as share, coalesce(list(id order by row_id) filter (where id is not null), []) as refs_pmids from e group by pmid""",
    "article_embeddings": " union all ".join(f"select doc_id, '{f}' as entity, vec from ({ORACLES[q]})" for f, q in (("title", "text_centroid"), ("abstract", "text_centroid_abstract"))),
}

"""The results of the training-data queries in SQL, where whole tables allow it."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
_USABLE = "vector is not null and len(vector) = 64 and len([x for x in vector if x is null or not isfinite(x)]) = 0 and len([x for x in vector if x <> 0]) > 0"
_UNITS = f"units as (select id, [x / n for x in v] as u from (select id, v, sqrt(list_sum([x * x for x in v])) as n from (select id, vector::double[] as v from store_items where {_USABLE})))"
_DOT = "list_sum([z[1] * z[2] for z in list_zip({a}, {b})])"



def _groups(source: str, key: str, text: str, size: int, least: float, least_words: int) -> str:
    """Classes of equal sets of shingles, links between similar ones, and groups by following links."""
    run = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(size))
    return f"""
with recursive w as (select {key} as id, {_WORDS.format(text=text)} as w from {source}),
s as (select distinct id, unnest([{run} for i in range(1, len(w) - {size} + 2)]) as g from w where len(w) >= {max(least_words, size)}),
k as (select id, list_sort(list(g)) as g from s group by id),
c as (select g, min(id) as class_id, count(*) as copies, len(g) as n from k group by g),
t as (select class_id, n, unnest(g) as x from c),
l as (select a, b from (select p.class_id as a, q.class_id as b, any_value(p.n) as n, any_value(q.n) as m, count(*) as shared from t p join t q on p.x = q.x and p.class_id <> q.class_id group by 1, 2) where shared >= {least} * (n + m - shared) - 1e-9),
r as (select class_id as node, class_id as top from c union select l.b as node, r.top from r join l on l.a = r.node)
select k.id, c.class_id, c.copies, coalesce(d.links, 0) as links, f.top as group_id
from k join c on c.g = k.g left join (select a, count(*) as links from l group by a) d on d.a = c.class_id join (select node, min(top) as top from r group by node) f on f.node = c.class_id"""


_COVERED = f"""w as (select doc_id, {_WORDS.format(text="text")} as w from documents),
p as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, unnest([case when i + 5 <= len(w) then list_slice(w, i, i + 5) end for i in range(1, len(w) + 1)]) as run from w where len(w) > 0),
f as (select doc_id, n, i, run is not null and i > min(i) over (partition by doc_id, run) as later from p),
c as (select doc_id, n, later, bool_or(later) over (partition by doc_id order by i rows between 5 preceding and current row) as covered from f),
g as (select doc_id, n, count_if(covered)::bigint as covered, count_if(later)::bigint as runs from c group by doc_id, n)"""

ORACLE = {
    "p1_groups": _groups("store_items", "id", "content.data", 3, 0.6, 20),
    "p1_documents": _groups("documents", "doc_id", "text", 5, 0.8, 5),
    "p2_most_similar": f"""
with {_UNITS}, d as (select a.id as id, b.id as neighbour, {_DOT.format(a="a.u", b="b.u")} as s from units a join units b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by round(s, 12) desc, neighbour) as rank from d)
select id, neighbour, rank::bigint as rank, round(s, 6) + 0.0 as similarity from r where rank <= 5""",
    "p3_kept": "select id, 0::bigint as kinds, coalesce(content.data, '') as text from store_items where content.type in ('code', 'json')",
    "p6_cover": "select id, octet_length(encode(content.data))::bigint as bytes, true as fits, true as whole from store_items where octet_length(encode(content.data)) > 4096",
    "p7_placed": "select doc_id, true as whole, true as once, true as within, true as undivided from documents",
    "p7_filled": "select true as filled",
    "p8_kept": "select lower(trim(t.source)) as source, true as repeats, true as reached from mix_targets t",
    "p9_figures": f"with {_COVERED} select d.doc_id, coalesce(g.n, 0)::bigint as n_words, coalesce(g.covered, 0) as covered_words, round(coalesce(g.covered / g.n, 0), 6) + 0.0 as share, coalesce(g.runs, 0) as repeated_runs from documents d left join g using (doc_id)",
    "p1_found": f"""
with w as (select id, {_WORDS.format(text="content.data")} as w from store_items),
s as (select distinct id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as g from w where len(w) >= 20),
n as (select id, count(*) as n from s group by id),
c as (select a.id as id_a, b.id as id_b, count(*) as shared from s a join s b on a.g = b.g and a.id < b.id group by 1, 2)
select id_a, id_b from c join n x on x.id = id_a join n y on y.id = id_b where shared >= 0.6 * (x.n + y.n - shared) - 1e-9""",
    "p2_found": f"""
with {_UNITS}, d as (select a.id as a, b.id as b, {_DOT.format(a="a.u", b="b.u")} as s from units a join units b on a.id <> b.id),
r as (select *, row_number() over (partition by a order by round(s, 12) desc, b) as rank from d where s >= 0.9)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where rank <= 5 and s >= 0.93""",
    "p4_found": f"""
with {_UNITS}, c as (select distinct code, centroid::double[] as c from centroids where quantizer = 'standard' and version = 3 and centroid is not null),
k as (select code, [x / n for x in c] as u from (select code, c, sqrt(list_sum([x * x for x in c])) as n from c)),
r as (select id, code, {_DOT.format(a="units.u", b="k.u")} as s, row_number() over (partition by id order by {_DOT.format(a="units.u", b="k.u")} desc, code) as rank from units, k)
select id, code::bigint as code from r where rank = 1 and s >= 0.5""",
    "p6_found": r"""
select id, case when list_max([octet_length(encode(x)) for x in regexp_split_to_array(content.data, '[ \t\r\n]+')]) > 4096 then 'forced' else 'natural' end as cut
from store_items where octet_length(encode(content.data)) > 4096""",
    "p9_found": f"""
with w as (select doc_id, {_WORDS.format(text="text")} as w from documents),
p as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, unnest([case when i + 5 <= len(w) then list_slice(w, i, i + 5) end for i in range(1, len(w) + 1)]) as run from w where len(w) >= 30),
f as (select doc_id, n, i, run is not null and i > min(i) over (partition by doc_id, run) as later from p),
c as (select doc_id, n, bool_or(later) over (partition by doc_id order by i rows between 5 preceding and current row) as covered from f)
select doc_id from c group by doc_id, n having count_if(covered) >= 0.3 * n""",
}

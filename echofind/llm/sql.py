"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .repetition import Rules

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as n, sha1(h) as d, max(page_id) over (partition by h) as m from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> m then m end as refers_to from q"""

WINNOWING = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') as w from documents),
b as (select distinct item_id::varchar as item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') as w from benchmark where item_id is not null),
x as (select item, w, least(len(w), 13) as n from b where len(w) > 0),
g as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from x, unnest(range(1, len(w) - n + 2)) t(i)),
s as (select distinct n from g),
v as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from d, s, unnest(range(1, len(w) - n + 2)) t(i)),
h as (select doc_id, v.n, i, item from v join g on v.n = g.n and v.g = g.g),
c as (select doc_id, count(distinct j) as n_hit from h, unnest(range(i, i + n)) t(j) group by doc_id),
k as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join k using (doc_id)"""


def _repetition(rules: Rules) -> str:
    widths = sorted({rules.window, *rules.grams})
    gram = lambda n: " || ' ' || ".join(["x", *(f"lead(x, {k}) over o" for k in range(1, n))])
    covered = lambda n: f"max(coalesce(c{n}, 0)) over (partition by doc_id order by j rows between {n - 1} preceding and current row) > 1 as h{n}"
    parts = [
        "d as (select doc_id, coalesce(text, '') as t from documents)",
        f"w as (select doc_id, t, regexp_extract_all(t, '{_SPACED}') as w from d)",
        "p as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from w)",
        "g as (select *, " + ", ".join(f"{gram(n)} as g{n}" for n in widths) + " from p window o as (partition by doc_id order by j))",
        "c as (select doc_id, j, length(x) as n, " + ", ".join(f"case when g{n} is not null then count(*) over (partition by doc_id, g{n}) end as c{n}" for n in widths) + " from g)",
        f"h as (select doc_id, n, {', '.join(map(covered, widths))} from c)",
        "s as (select doc_id, count(*) as n_words, sum(n) as word_chars, " + ", ".join(f"count(*) filter (h{n}) as words{n}, coalesce(sum(n) filter (h{n}), 0) as chars{n}" for n in widths) + " from h group by doc_id)",
        f"lw as (select doc_id, x from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '{_SPACED}'))",
        f"lr as (select doc_id, row_number() over (partition by doc_id, x) as r, length(array_to_string(regexp_extract_all(x, '{_SPACED}'), '')) as n from lw)",
        "ld as (select doc_id, count(*) as dup_lines, sum(n) as dup_chars from lr where r > 1 group by doc_id)",
        f"m as (select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup_lines, 0)::bigint as n_dup_lines, coalesce(words{rules.window}, 0)::bigint as n_repeat_words, coalesce(dup_chars, 0) as dup_chars, "
        + ", ".join(f"coalesce(chars{n}, 0) as chars{n}" for n in rules.grams)
        + " from d left join s using (doc_id) left join ld using (doc_id))",
        f"f as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.window_percent} * n_words as base_failed from m)",
    ]
    bad = " or ".join([*(f"chars{n}::double / greatest(word_chars, 1) > {b}::double" for n, b in rules.grams.items()), f"dup_chars::double / greatest(word_chars, 1) > {rules.line_chars}::double"])
    return "with " + ",\n".join(parts) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({bad}) as kept from f"


REPETITION = _repetition(Rules())

SETSKETCH = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as g from d, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select a as id, b as to_id from e union select r.id, e.b from r join e on r.to_id = e.a),
k as (select id, least(id, min(to_id)) as c from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.c, d.doc_id) as component_id, coalesce(k.c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join k on k.id = d.doc_id"""

RECOMPRESSION = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from d, unnest(range(1, len(w) - 50 + 2)) t(i)),
m as (select doc_id, i, min(doc_id) over (partition by g) as m from g),
x as (select distinct doc_id, j from m, unnest(range(i, i + 50)) t(j) where m < doc_id),
k as (select doc_id, count(x.j) as n_removed, string_agg(case when x.j is null then w end, ' ' order by j) as kept from (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as j from d) left join x using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)"""

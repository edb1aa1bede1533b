"""SQL equivalents, for DuckDB, of the operators whose modules have none of their own: by brute force, so for small tables."""

from __future__ import annotations

import re

from quillon.llm import line_dedup, mixing, quality_rules
from quillon.llm.decontamination import SHINGLE, SIMILARITY
from quillon.llm.secret_scan import BASE
from quillon.llm.suffix_dedup import LENGTH

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"

#: Every item-sized window of a document, or the whole of a shorter one, against every item with which it shares a shingle; counts of shingles are compared.
DECONTAMINATION = f"""
with it as (select distinct item_id, {_TOKENS} as t from benchmark),
i as (select item_id, len(t) as n, least({SHINGLE}, len(t)) as k, t from it where len(t) > 0),
ih as (select item_id, n, k, list_slice(t, p, p + k - 1) as g from (select *, unnest(range(1, n - k + 2)) as p from i)),
ic as (select item_id, n, k, g, count(*) as c from ih group by all),
dt as (select distinct doc_id, {_TOKENS} as t from documents),
ks as (select distinct k from i),
dg as (select doc_id, len(t) as m, k, p, list_slice(t, p, p + k - 1) as g from (select doc_id, t, k, unnest(range(1, len(t) - k + 2)) as p from dt, ks)),
pr as (select distinct dg.doc_id, ic.item_id, ic.n, ic.k, dg.m from dg join ic on ic.k = dg.k and ic.g = dg.g),
wd as (select doc_id, item_id, n, k, least(n, m) - k + 1 as width, m - k + 1 as every from pr where least(n, m) - k + 1 >= {SIMILARITY} * (n - k + 1)),
ws as (select *, unnest(range(1, every - width + 2)) as a from wd),
wc as (select ws.doc_id, ws.item_id, ws.a, ws.width, ws.n - ws.k + 1 as size, dg.g, count(*) as c from ws join dg on dg.doc_id = ws.doc_id and dg.k = ws.k and dg.p between ws.a and ws.a + ws.width - 1 group by all),
js as (select wc.doc_id, wc.item_id, wc.a, any_value(wc.width) + any_value(wc.size) as total, sum(least(wc.c, ic.c)) as shared from wc join ic on ic.item_id = wc.item_id and ic.g = wc.g group by wc.doc_id, wc.item_id, wc.a),
s as (select doc_id, item_id, shared / (total - shared) as s from js where shared / (total - shared) >= {SIMILARITY})
select doc_id, item_id, round(max(s), 6) as similarity, count(*) as n_windows from s group by doc_id, item_id
"""

#: Every 50-byte string of every document by its least doc_id; bytes as hex digits.
SUFFIXES = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) as i from d)),
m as (select s, min(doc_id) as least from w group by s having count(*) > 1),
g as (select distinct w.doc_id, w.i from w join m using (s) where w.doc_id > m.least),
r as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {LENGTH} then 0 else 1 end as new from g),
x as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from r),
u as (select doc_id, min(i) as a, max(i) + {LENGTH} as b from x group by doc_id, run),
k as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as s, a as e from u union all select doc_id, max(b), null from u group by doc_id),
c as (select k.doc_id, string_agg(substr(h, (2 * s + 1)::bigint, (2 * (coalesce(e, length(h) // 2) - s))::bigint), '' order by s) as kept from k join d using (doc_id) group by k.doc_id),
n as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from u group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join c using (doc_id) left join n using (doc_id)
"""

#: All pairs of documents that share a shingle, and the classes of the similar ones by their transitive closure.
JOIN = f"""
with recursive dt as (select doc_id, {_TOKENS} as t from documents),
dg as (select distinct doc_id, list_slice(t, p, p + k - 1) as g from (select doc_id, t, least({SHINGLE}, len(t)) as k, unnest(range(1, len(t) - least({SHINGLE}, len(t)) + 2)) as p from dt where len(t) > 0)),
sz as (select doc_id, count(*) as n from dg group by doc_id),
pr as (select a.doc_id as a, b.doc_id as b, count(*) as shared from dg a join dg b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
li as (select a, b from pr join sz x on x.doc_id = a join sz y on y.doc_id = b where shared >= {SIMILARITY} * (x.n + y.n - shared) - 1e-9),
tc(doc_id, other) as (select doc_id, doc_id from documents union select tc.doc_id, li.b from tc join li on li.a = tc.other),
cl as (select doc_id, min(other) as class_id, count(*) as class_size from tc group by doc_id),
nl as (select a, count(*) as n from li group by a)
select cl.doc_id, class_id, coalesce(nl.n, 0) as n_links, class_size from cl left join nl on nl.a = cl.doc_id
"""


def _marked(kind: str, order: int, pattern: str, keep: str) -> str:
    """(doc_id, kind, o, s, e) of the leftmost matches that do not overlap: each is put between marks, and the text split at them."""
    quoted = pattern.replace("'", "''")
    return f"""(select doc_id, '{kind}' as kind, {order} as o, s, s + length(x) as e from (
      select doc_id, string_split(part, chr(2))[1] as x, sum(length(part) - case when j > 1 then 1 else 0 end) over (partition by doc_id order by j) - length(part) + 1 as s, j
      from (select doc_id, unnest(ps) as part, generate_subscripts(ps, 1) as j from (select doc_id, string_split(regexp_replace(text, '{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as ps from d))
    ) where j > 1 and {keep})"""


_DOCS = "d as (select doc_id, coalesce(text, '') as text from documents)"
_NAMED = "(" + BASE[0].head + ")"
_SECRETS = [
    ("assign", _NAMED + "[A-Za-z0-9+/_.=-]+", "length(x) - length(regexp_extract(x, '" + _NAMED.replace("'", "''") + "', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(x) >= 20"),
    ("hex", "[0-9a-f]+", "length(x) >= 24"),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
]
SECRETS = f"""
with {_DOCS}, m as ({" union all ".join(_marked(k, o, p, keep) for o, (k, p, keep) in enumerate(_SECRETS))}),
a as (select doc_id, {", ".join(f"count_if(kind = '{k}')::bigint as n_{k}" for k, _, _ in _SECRETS[:3])},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (where o < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, o) as spans from m group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: case when i % 2 = 0 then substr({_DIGITS}, length({_DIGITS}) - i, 1)::int else 2 * substr({_DIGITS}, length({_DIGITS}) - i, 1)::int - 9 * (substr({_DIGITS}, length({_DIGITS}) - i, 1)::int > 4)::int end)) % 10 = 0"
_PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(x, '.'), lambda p: case when length(ltrim(p, '0')) > 3 then 999 else p::bigint end)) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) between 16 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15"),
]
PERSONAL = f"""
with {_DOCS}, m as ({" union all ".join(_marked(k, o, p, keep) for o, (k, p, keep) in enumerate(_PERSONAL))}),
a as (select doc_id, {", ".join(f"count_if(kind = '{k}')::bigint as n_{k}" for k, _, _ in _PERSONAL)}, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as base from m group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k, _, _ in _PERSONAL)}, sha256(coalesce(base, '')) as base_sha256 from d left join a using (doc_id)
"""


def _on(sql: str, table: str) -> str:
    """A query over ``table`` in place of documents."""
    return re.sub(r"\bdocuments\b", table, sql)


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lines(table: str) -> str:
    return f"(select doc_id, coalesce(source, chr(0)) as source, pos, line, {_KEY} as k from (select doc_id, source, u.line, u.pos from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as ls from {table}) x, lateral (select unnest(x.ls) as line, generate_subscripts(x.ls, 1) as pos) u))"


def _rest(table: str, gone: str) -> str:
    """``table`` with the texts that lose the lines for which ``gone`` holds, and n_chars counted anew for them."""
    return f"""(select t.doc_id, case when g.lost > 0 then g.rest else t.text end as text, t.lang, t.source, case when g.lost > 0 then length(g.rest) else t.n_chars end as n_chars
      from {table} t join (select l.doc_id, count_if({gone}) as lost, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where not ({gone})), '') as rest
        from {_lines(table)} l left join above_{table} a on a.k = l.k and (a.source is null or a.source = l.source) group by l.doc_id) g on g.doc_id = t.doc_id)"""


#: The five stages, one after another; a row is a document.
PIPELINE = f"""
with recursive ok as (select doc_id from ({quality_rules.ORACLE_SQL}) where kept),
above_documents as (select l.source, l.k, null::bigint as last_doc from {_lines("documents")} l join (select coalesce(source, chr(0)) as source, count(*) as n from documents group by 1) s on s.source = l.source
  where l.k <> '' group by l.source, l.k having count(distinct l.doc_id) >= {quality_rules.HOST_DOCS} and count(distinct l.doc_id) > any_value(s.n) * {quality_rules.HOST_SHARE}::double),
d1 as (select r.* from {_rest("documents", "a.k is not null")} r join ok using (doc_id)),
above_d1 as (select null::varchar as source, l.k, max(l.doc_id) as last_doc from {_lines("d1")} l where length(l.k) >= {line_dedup.MIN_CHARS} group by l.k having count(distinct l.doc_id) >= {line_dedup.MIN_DOCS}),
d2 as (select * from {_rest("d1", "a.k is not null and l.doc_id < a.last_doc")}),
d3 as (select d2.* from d2 join ({_on(JOIN, "d2")}) c on c.doc_id = d2.doc_id and c.class_id = d2.doc_id),
d4 as (select * from d3 where doc_id not in (select doc_id from ({_on(DECONTAMINATION, "d3")}))),
mx as ({_on(mixing.ORACLE_SQL, "d4")})
select d4.doc_id, d4.text, d4.lang, d4.source, d4.n_chars from d4 join mx using (doc_id), lateral (select unnest(range(0, case when mx.size > 0 then mx.taken // mx.size else 0 end))) r
"""

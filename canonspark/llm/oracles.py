"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from canonspark.llm.licenses import LEAST, PHRASES, TEMPLATES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _space_words(col: str) -> str:
    return (f"list_filter(string_split_regex(translate(coalesce({col}, ''), '{_UP}', '{_LOW}'), "
            r"'[\x20\x09-\x0D]+'), lambda x: x <> '')")


OP2 = f"""
with recursive w as (select doc_id, {_space_words('text')} ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+3], ' ') sh
      from w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
      where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(id, m) as (select a, b from e union select r.id, e.b from r join e on r.m = e.a),
c as (select id, least(id, min(m)) m from r group by id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(c.m, d.doc_id) component_id,
       d.doc_id = coalesce(c.m, d.doc_id) kept,
       coalesce(k.class_id, d.doc_id) class_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id
left join (select doc_id, min(doc_id) over (partition by h) class_id
           from (select doc_id, list_sort(list(sh)) h from s group by 1)) k on k.doc_id = d.doc_id
"""

def _alnum_words(col: str) -> str:
    return (f"list_filter(string_split_regex(translate(coalesce({col}, ''), '{_UP}', '{_LOW}'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


OP7 = f"""
with d as (select doc_id, {_alnum_words('text')} ws from documents),
b as (select cast(item_id as varchar) item_id, {_alnum_words('text')} ws from benchmark),
win as (select distinct item_id, least(len(ws), 13) k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') g
        from b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) t(i) where len(ws) > 0),
ks as (select distinct k from win),
g as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') g
      from d, ks, unnest(range(1, len(ws) - k + 2)) t(i) where len(ws) >= k),
m as (select g.doc_id, g.i, g.k, win.item_id from g join win on win.k = g.k and win.g = g.g),
hit as (select doc_id, count(distinct p) n_hit from m, unnest(range(i, i + k)) t(p) group by 1),
it as (select doc_id, list_sort(list(distinct item_id)) ids from m group by 1)
select d.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(len(ids), 0) as bigint) n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""

_ENTRY = ("select '{0}' list, {2} pattern, k * {3} % 300 + {4} n, '{5}' action from k where {1}")
_SPAM = "regexp_matches(host, 'spam|pills|casino')"
_ENTRIES = " union ".join(_ENTRY.format(*x) for x in (
    ("spam", _SPAM, "host", 1, 0, "add"), ("spam", _SPAM, "host", 1, 90, "remove"),
    ("spam", _SPAM, "host", 1, 150, "add"),
    ("language", "length(host) % 2 = 0", "host || '/de'", 3, 0, "add"),
    ("language", "length(host) % 4 = 0", "host || '/de'", 3, 60, "remove"),
    ("domain", "host like '%.org'", "'example.org'", 0, 40, "add"),
    ("domain", "host like '%.org'", "'example.org'", 0, 45, "remove"),
    ("domain", "host like 'blog.%'", "substr(host, 6)", 5, 10, "add")))

OP4 = f"""
with u as (select page_id, date '2024-01-01' + cast(page_id % 366 as integer) fetched,
    regexp_extract(translate(url, '{_UP}', '{_LOW}'), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) auth,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') segs
  from pages),
c as (select page_id, fetched, segs, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    auth, '^.*@', ''), ':[0-9]*$', ''), '\\.$', ''), '^www\\.', ''), '') host from u),
k as (select distinct host, length(host) * 7 + ascii(host[-9]) * 3 k from c where host is not null),
e as (select list, pattern, date '2024-01-01' + cast(n as integer) as day, bool_and(action = 'add') "on"
      from ({_ENTRIES}) group by 1, 2, 3),
cand as (select distinct page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) pattern
  from c where host is not null),
st as (select page_id, list, cand.pattern, arg_max("on", e.day) s from cand join e
       on e.pattern = cand.pattern and e.day <= cand.fetched group by 1, 2, 3),
a as (select page_id, list_sort(list(distinct list)) ls, list_sort(list(distinct list || ':' || pattern)) ps
      from st where s group by 1)
select c.page_id, c.fetched, c.host, coalesce(array_to_string(ls, ','), '') lists,
       coalesce(array_to_string(ps, ','), '') patterns, ls is not null blocked
from c left join a on a.page_id = c.page_id
"""

OP5 = """
with v as (select vec_id, list_transform(embedding, lambda e: cast(floor(cast(e as double) * 1024) as bigint)) v
           from embeddings where embedding is not null
             and len(list_filter(embedding, lambda e: e is null or not isfinite(cast(e as double)))) = 0),
c as (select vec_id, v[i] x, i from v, unnest(range(1, len(v) + 1)) t(i)),
s as (select q.vec_id query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) score
      from c q join c on c.i = q.i and c.vec_id <> q.vec_id where q.vec_id % 100 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
select query_id, cast(k as integer) "rank", vec_id, score from r where k <= 10
"""

def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = " union all ".join(
    f"select '{t.label}' label, {_list(t.words)} ws, {_list(t.key)} k, {t.key_at} key_at, {base} base"
    for base, ts in (("false", TEMPLATES), ("true", PHRASES)) for t in ts)

OP8 = f"""
with d as (select doc_id, {_alnum_words('text')} w from documents), t as ({_TEMPLATES}),
p as (select d.doc_id, t.*, i - 1 - t.key_at as start, d.w
      from d, t, unnest(range(1, len(d.w) - len(t.k) + 2)) u(i)
      where list_has_all(d.w, t.k) and d.w[i:i + len(t.k) - 1] = t.k),
s as (select doc_id, label, base, start, (select count(*) from unnest(range(1, len(ws) + 1)) x(j)
             where start + j >= 1 and w[start + j] = ws[j]) / cast(len(ws) as double) share from p),
a as (select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word,
             max(start) filter (base) last_word,
             list_sort(list(distinct label) filter (base)) bl,
             list_sort(list(distinct label) filter (base or share >= {LEAST})) al,
             max(share) filter (not base and share >= {LEAST}) best from s group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base,
       cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
       coalesce(array_to_string(bl, ','), '') base_labels, coalesce(array_to_string(al, ','), '') labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0) end score
from d left join a on a.doc_id = d.doc_id
"""

def _op13(levels: int = 7) -> str:
    """Levels are spelled out (8**7 rows a tree); a tree that has ended keeps its node."""
    def h(text: str) -> str:
        fields = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
        return "sha256(concat(" + ", ".join(
            f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"

    crc = ("xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''), "
           "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) "
           "else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)")
    low = f"translate(text, '{_UP}', '{_LOW}')"
    parts = [f"""l as (select doc_id, lang, {h('text')} leaf, {h(f"case when {crc} % 3 = 0 then {low} else text end")} claim
 from documents),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos from l),
t0 as (select coalesce('1' || lang, '0') tree, pos, leaf hash from p)"""]
    chains = []
    for name, first in (("t", "t0"), ("u", "u0")):
        if name == "u":
            parts.append(f"u0 as (select '' tree, row_number() over (order by tree) - 1 pos, hash from t{levels})")
        for k in range(levels):
            a, b = f"{name}{k}", f"{name}{k + 1}"
            parts.append(f"""{a}n as (select tree, count(*) n from {a} group by 1),
{a}k as (select tree, pos // 8 up, list(hash order by pos) kids from {a} group by 1, 2),
{b} as (select {a}k.tree, up pos, case when n = 1 then kids[1] else sha256(array_to_string(kids, '')) end hash
        from {a}k join {a}n on {a}n.tree = {a}k.tree)""")
            chains.append((name, k))
    parts.append(f"c0 as (select doc_id, leaf, claim fold, '' proof, coalesce('1' || lang, '0') tree, pos from p)")
    for i, (name, k) in enumerate(chains):
        a = f"{name}{k}"
        if (name, k) == ("u", 0):  # to the place of the subroot
            parts.append(f"""c{i}s as (select c{i}.* exclude (tree, pos), '' tree, r.pos pos, s.hash subroot
 from c{i} join t{levels} s on s.tree = c{i}.tree
 join (select row_number() over (order by tree) - 1 pos, tree from t{levels}) r on r.tree = c{i}.tree)""")
        src = f"c{i}s" if (name, k) == ("u", 0) else f"c{i}"
        extra = ", subroot" if name == "u" else ""
        parts.append(f"""c{i + 1} as (select doc_id, leaf, case when n = 1 then fold else
  sha256(concat(array_to_string(kids[1:x.pos % 8], ''), fold, array_to_string(kids[x.pos % 8 + 2:], ''))) end fold,
  case when n = 1 then proof else concat(proof, array_to_string(kids[1:x.pos % 8], ''),
    array_to_string(kids[x.pos % 8 + 2:], '')) end proof, x.tree, x.pos // 8 pos{extra}
 from {src} x join {a}k on {a}k.tree = x.tree and {a}k.up = x.pos // 8 join {a}n on {a}n.tree = x.tree)""")
    return "with " + ",\n".join(parts) + f"""
select doc_id, leaf, subroot, r.hash root, sha256(proof) proof_sha256, fold folded_root, fold = r.hash verified
from c{len(chains)} c join u{levels} r on r.tree = c.tree"""


OP13 = _op13()

OP11 = f"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
             '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws from p),
t as (select lang, cast(sum(len(ws)) as bigint) n from w group by 1),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*) f
      from w, (values (1), (2), (3), (4)) ks(k), unnest(range(1, len(ws) - k + 2)) u(i) where len(ws) >= k
      group by 1, 2, 3 having count(*) >= 30),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') ws from f where k > 1),
s as (select c.lang, c.phrase, c.a, j, l.f l, r.f r, cast(2000000 * cast(c.a as hugeint) // (l.f + r.f) as bigint) score
      from c, unnest(range(1, c.k)) u(j)
      join f l on l.lang = c.lang and l.phrase = array_to_string(ws[1:j], ' ')
      join f r on r.lang = c.lang and r.phrase = array_to_string(ws[j + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, array_to_string(ws[x:x + m - 1], ' ') phrase, max(a) longer
      from c, unnest(range(2, k)) u(m), unnest(range(1, k - m + 2)) v(x) where k > 2 group by 1, 2)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) "rank",
       b.phrase, a, l, r, n, score
from b join t on t.lang = b.lang left join i on i.lang = b.lang and i.phrase = b.phrase
where longer is null or 100 * longer < 80 * a
qualify row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) <= 2000
"""

OP12 = """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
o as (select payload_digest, max(page_id) original from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest,
       case when original <> page_id then 'revisit' else 'response' end record_type,
       case when original <> page_id then original end refers_to
from p left join o on o.payload_digest = p.payload_digest
"""

ORACLES: dict[str, str] = {
    "op2_near_dedup": OP2,
    "op4_url_filters": OP4,
    "op5_topk": OP5,
    "op7_decontaminate": OP7,
    "op8_licenses": OP8,
    "op11_phrases": OP11,
    "op12_warc": OP12,
    "op13_merkle": OP13,
}

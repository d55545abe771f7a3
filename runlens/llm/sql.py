"""SQL twins of the corpus operators that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from .licenses import GRAM, LONG, SHARE, templates

_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""
OP12 = rf"""
with recursive d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
f as (select r, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from d), bf as (select unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from b),
names as (select f, octet_length(encode(f)) as n from (select f from f union select f from bf)),
-- CRC-32 is linear: each byte adds a share that its distance from the end decides, and the length adds another
bits as (select b, b::bigint as c, 0 as k from range(256) t(b) union all select b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
t as (select b, c from bits where k = 8),
u as (select b::bigint as b, c, 0 as k from t union all select 256, 4294967295, -1 union all select u.b, xor(t.c, u.c >> 8), u.k + 1 from u join t on t.b = u.c & 255 where u.k < (select max(n) from names)),
bytes as (select f, n, n - i as k, ('0x' || hex(encode(f))[2 * i - 1 : 2 * i])::bigint as b from (select f, n, unnest(range(1, n + 1)) as i from names)),
crc as (select f, xor(4294967295, xor(bit_xor(u.c), any_value(v.c))) % 10000 as bucket from bytes join u using (b, k) join u v on v.b = 256 and v.k = bytes.n - 1 group by f),
s as (select bucket, count(*) as s from f join crc using (f) group by 1), t2 as (select bucket, count(*) as t from bf join crc using (f) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select sum(s) from s) + 10000) / ((coalesce(s, 0) + 1) * ((select sum(t) from t2) + 10000))))::bigint as gain from s full join t2 using (bucket)),
x as (select r, count(*) as n, sum(gain)::bigint as total from f join crc using (f) join g using (bucket) group by 1),
y as (select doc_id, len(w) >= 20 as ok, coalesce(n, 0) as n_features, coalesce(floor(total / n), 0)::bigint as weight, ('0x' || sha256('7:' || doc_id)[1:8])::bigint as h from d left join x using (r)),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from y),
k as (select *, row_number() over (partition by ok order by score desc, doc_id) as i, count(*) over (partition by ok) as n from z)
select doc_id, n_features, weight, score, case when ok and i <= floor(25 * n / 100) then i end as rank from k"""

OP11 = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), i as (select row_number() over () as q, item_id, {_WORDS} as w from benchmark),
p as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by all), a as (select q, t, count(*) as times from (select q, unnest(w) as t from i) group by all),
n as (select count(*) as n, sum(len(w))::bigint as l from d where len(w) > 0),
df as (select t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::bigint as w from p, n group by t),
s as (select q, r, sum(times * df.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n.n) // n.l))))::bigint as score from a join p using (t) join df using (t) join d using (r), n group by q, r),
k as (select q, r, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s join d using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k join i using (q) join d using (r) where rank <= 10"""


def _licenses() -> str:
    names = ", ".join(f"({i}, '{label}', {str(base).lower()}, {len(words)})" for i, label, base, words in templates())
    grams = ", ".join(f"({i}, {at}, '{' '.join(words[at : at + GRAM])}')" for i, _, _, words in templates() for at in range(len(words) - GRAM + 1))
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(GRAM))
    return rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), t(t, label, base, size) as (values {names}), g(t, a, gram) as (values {grams}),
v as (select r, i - 1 as pos, {gram} as gram from (select r, w, unnest(range(1, len(w) - {GRAM} + 2)) as i from d)),
k as (select r, t, pos - a as diagonal, a from v join g using (gram)),
o as (select r, t, diagonal, min(a) as low, max(a) as high, flatten(list([a + j for j in range({GRAM})])) as stand from k group by r, t, diagonal),
n as (select o.*, coalesce(diagonal - lag(diagonal) over (partition by r, o.t order by diagonal) > case when size >= {LONG} then size // 8 else 0 end, true)::int as new from o join t on o.t = t.t),
s as (select *, sum(new) over (partition by r, t order by diagonal) as span from n),
f as (select r, t, span, min(diagonal + low) as first, max(diagonal + high) + {GRAM - 1} as last, len(list_distinct(flatten(list(stand)))) as stand from s group by r, t, span),
x as (select r, label, base, first, stand / size as share, case when size >= {LONG} then stand / size >= {SHARE} and last - first < 1.25 * size else stand = size end as ok from f join t using (t)),
y as (select r, count(*) filter (where ok and base) as n, min(first) filter (where ok and base) as a, max(first) filter (where ok and base) as z, string_agg(distinct label, ',' order by label) filter (where ok and base) as b, string_agg(distinct label, ',' order by label) filter (where ok) as l, max(share) as score from x group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_base, a as first_word, z as last_word, coalesce(b, '') as base_labels, coalesce(l, '') as labels, coalesce(score, 0.0)::double as score from d left join y using (r)"""


OP13 = _licenses()

"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as T
from ..operators import texts as X
from ..session import table
from .aggregates import rounded
from .registry import query

_Q = {k: v.replace("'", "''") for k, v in T.REDACTIONS.items()}


def _redaction_sql() -> str:
    steps, prior = [], "select doc_id, text as t0 from documents"
    for i, (k, p) in enumerate(_Q.items()):
        steps.append(f"r{i} as (select *, len(regexp_extract_all(t{i}, '{p}'))::int as \"{k}\", regexp_replace(t{i}, '{p}', '[redacted:{k}]', 'g') as t{i + 1} from {f'r{i - 1}' if i else f'({prior})'})")
    named = ", ".join(f'"{k}"' for k in _Q)
    return "with " + ",\n".join(steps) + f" select doc_id, {named}, sha256(t{len(_Q)}) as said from r{len(_Q) - 1}"


@query(_redaction_sql())
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "said").drop("text").withColumn("said", F.sha2("said", 256))


_HITS = " - ".join(
    f"{w} * (length(lower(text)) - length(replace(lower(text), '{p.replace(chr(39), chr(39) * 2)}', ''))) / {len(p)}"
    for k, w in (("filler", 1.0), ("hedge", 0.5), ("apology", 1.0)) for p in T.SLOP[k]
)


@query(f"select doc_id, round(greatest(0, least(10, 10.0::double - {_HITS})), 6)::double as slop from documents")
def slop_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "documents").select("doc_id", T.slop_score(F.col("text")).alias("slop")), "slop")


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def canary_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""
with w as (select source, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}')) as word from documents),
c as (select source, word, count(*) as n from w where word not in ('the','and','that','with','for','was','this','from','are','has','have','not','you','but','und','der','die','les','que','des','est','una','los','las') group by all having count(*) >= 2)
select source, word, n from c qualify row_number() over (partition by source order by n desc, word) <= 18""")
def domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_words(table(spark, sf_dir, "documents"), "source", T.domain_words(F.col("text")), 18, least=2)


@query("""
with a as (select page_id, html, url, regexp_extract_all(html, '(?i)<link\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["''][^>]*>', 1) || regexp_extract_all(html, '(?i)<script\\b[^>]*\\bsrc\\s*=\\s*["'']([^"'']+)["'']', 1) as u from pages),
r as (select *, list_transform(u, lambda x: case when regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') then x when starts_with(x, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || x when starts_with(x, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || x else regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || x end) as w from a)
select page_id, len(list_distinct(w))::int as assets, array_to_string(list_sort(list_distinct(w)), ' ') as urls, regexp_matches(html, '(?i)<p(?:\\s[^>]*)?[^>]*>') as has_p from r""")
def html_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").withColumn("found", T.asset_urls(F.col("html"), F.col("url")))
    return found.select("page_id", F.size("found").alias("assets"), F.array_join(F.array_sort("found"), " ").alias("urls"), T.has_element(F.col("html"), "p").alias("has_p"))


@query("""
with m as (select event_id, event_type, case when event_id % 11 > 0 then event_type || ' at /srv/app-' || event_id % 3 || '/run.py after ' || round(value)::int || case event_id % 4 when 0 then 'ms' when 1 then 'm' when 2 then ' retries' else 'h' end else ' ' end as said from events),
s as (select event_id, case when trim(said) = '' then '(' || event_type || ' — no message)' else trim(said) end as base from m),
r as (select event_id, trim(regexp_replace(regexp_replace(regexp_replace(base, '(?:/[A-Za-z0-9_.@-]+){2,}', '<path>', 'g'), '(?i)\\b[0-9]+(?:\\.[0-9]+)?(ms|s|m|h|kb|mb|gb)?\\b', '#\\1', 'g'), '\\s+', ' ', 'g')) as sig from s)
select sig, count(*) as n, min(event_id) as first from r group by 1""")
def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    unit = F.when(i % 4 == 0, "ms").when(i % 4 == 1, "m").when(i % 4 == 2, " retries").otherwise("h")
    said = F.concat(kind, F.lit(" at /srv/app-"), (i % 3).cast("string"), F.lit("/run.py after "), F.round("value").cast("int").cast("string"), unit)
    sig = T.error_signature(F.when(i % 11 > 0, said).otherwise(" "), kind)
    return table(spark, sf_dir, "events").groupBy(sig.alias("sig")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""
with d as (select doc_id, text, strlen(text) as b, chr(10) || '[truncated: original ' || strlen(text) || ' bytes]' as mark from documents),
c as (select *, 400 - strlen(mark) as room, floor(length(text) * (400 - strlen(mark)) / b)::int as share from d)
select doc_id, case when b > 400 then left(text, list_max(list_filter(range(0, share + 1), lambda x: strlen(left(text, x)) <= room))) || mark else text end as cut, ceil(length(text) / 4.0)::bigint as tokens, substr(sha256(text), 1, 32) as wire from c""")
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import estimate_tokens

    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(text, 400).alias("cut"), estimate_tokens(text).cast("long").alias("tokens"), T.wire_id(text).alias("wire"))


@query("""
select case when ('0x' || substr(sha256(doc_id::varchar || 'split'), 1, 12))::bigint / 281474976710656.0::double < 0.2 then 'holdout' else 'search' end as split, count(*) as n, min(doc_id) as first from documents group by 1""")
def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(T.hash_to_unit(F.col("doc_id").cast("string"), "split") < 0.2, "holdout").otherwise("search")
    return table(spark, sf_dir, "documents").groupBy(tag.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(r"""
with t as (select o_orderkey, regexp_replace(o_totalprice::varchar, '\.0$', '') as price, o_orderpriority as p, o_custkey as c from orders),
c as (select *, '{"a":{"b":"' || p || '\n\u0001","nested":[],"€":null},"k":[' || c || ',100,0,0.000001,1e-7,1e+21,' || case when o_orderkey % 2 = 0 then '"\"q\\"' else 'true' end || '],"price":' || price || ',"😀":1,"ﬀ":2}' as j0 from t),
j as (select *, replace(j0, '"😀"', '"😀"') as j from c)
select o_orderkey, case when o_orderkey % 11 > 0 then j end as canonical, case when o_orderkey % 11 > 0 then 'sha256:' || sha256(j) end as digest from j""")
def canonical_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    parts = [
        ' { "ﬀ" : 2.0 , "price": ', price, ',\n "k": [', F.col("o_custkey").cast("string"), ", 1e2, -0.0, 1E-6, 0.0000001, 1000000000000000000000, ", F.when(k % 2 == 0, r'"\"q\\"').otherwise("true"),
        r'], "a": {"€": null, "nested" : [ ], "b": "', F.col("o_orderpriority"), r'\n\u0001"}, "😀": 1', F.when(k % 11 == 0, ', "x": NaN').when(k % 3 == 0, ', "price": ').otherwise(""), F.when((k % 11 > 0) & (k % 3 == 0), price).otherwise(""), "}",
    ]
    made = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.canonical_json(made).alias("canonical"), C.canonical_hash(made).alias("digest"))

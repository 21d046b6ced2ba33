"""Queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekline.llm import boilerplate, dfr, heavy, leakage, mojibake, neardup, neighbours, packing, termfreq
from seekline.plans.lineage import materialize
from seekline.sources.tables import table


def p1_found(spark, base):
    return neighbours.neighbour_pairs(table(spark, base, "documents"))


def p1_recall(spark, base):
    return neighbours.recall(table(spark, base, "documents"))


def p2_found(spark, base):
    return boilerplate.template_lines(table(spark, base, "documents"))


def p2_main(spark, base):
    return boilerplate.main_content(table(spark, base, "documents"))


def p3_found(spark, base):
    return neardup.duplicate_pairs(table(spark, base, "documents"), 3, 0.7)


def p3_groups(spark, base):
    return neardup.duplicate_groups(table(spark, base, "documents"))


def p4_frequencies(spark, base):
    return termfreq.term_frequencies(table(spark, base, "inverted_index"))


def p4_found(spark, base):
    return p4_frequencies(spark, base).where("mark is not null").select("term", "mark")


def p6_found(spark, base):
    return dfr.characteristic_terms_checked(table(spark, base, "inverted_index")).select("doc_id", "term")


def p6_dfr(spark, base):
    return dfr.characteristic_terms(table(spark, base, "inverted_index")).select("doc_id", "term", F.round("dfr", 6).alias("dfr"))


def p7_found(spark, base):
    return heavy.frequent_items(table(spark, base, "query_log"), "query_text", 0.002).select(F.col("item").alias("query_text"))


def p7_counts(spark, base):
    return heavy.frequent_items(table(spark, base, "query_log"), "query_text", 0.002).select(F.col("item").alias("query_text"), "exact_count")


def p8_containers(spark, base):
    return packing.pack(packing.token_sizes(table(spark, base, "documents")), table(spark, base, "token_budgets"))


def p8_fill(spark, base):
    return packing.fill_report(p8_containers(spark, base))


def p8_check(spark, base):
    sizes = materialize(packing.token_sizes(table(spark, base, "documents")), "sizes")
    return packing.packing_check(sizes, packing.pack(sizes, table(spark, base, "token_budgets")))


def p9_leaks(spark, base):
    return leakage.leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p9_found(spark, base):
    return p9_leaks(spark, base).select("doc_id", "item_id")


def p9_runs(spark, base):
    """Of the leaks, those by at least 15 words in a row."""
    return p9_leaks(spark, base).where("longest >= 15").select("doc_id", "item_id").distinct()


def p9_clean(spark, base):
    """The documents that are left when those with test material are taken out."""
    return leakage.without_leaks(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id")


def p10_found(spark, base):
    return mojibake.garbled_records(table(spark, base, "documents")).select("doc_id").distinct()


def p10_restored(spark, base):
    return mojibake.restored_texts(table(spark, base, "documents"))


def p10_restoration(spark, base):
    return mojibake.restoration(table(spark, base, "documents"))


QUERIES = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

_CLEAN = r"""
with whole as (
  select trim(lower(term)) as term, postings from inverted_index
  where trim(term) <> '' and postings is not null and json_valid(postings)),
entries as (select term, unnest(json_keys(postings)) as k, postings from whole),
p as (select term, cast(k as bigint) as doc_id, max(cast(json_extract_string(postings, '$."' || k || '"') as bigint)) as tf from entries group by 1, 2),
n as (select count(distinct doc_id) as docs from p),
t as (select term, count(*) as df, sum(tf) as total from p group by 1)
"""
_GRAMS = r"""w as (select doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || content), '[\p{L}\p{N}]+') as w from documents where content is not null),
g as (select distinct doc_id, unnest(list_transform(range(1, len(w) - COUNT + 2), lambda i: array_to_string(w[i:i + COUNT - 1], ' '))) as gram from w where len(w) >= COUNT),
n as (select doc_id, count(*) as n from g group by 1),
s as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as shared from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
pairs as (select doc_a, doc_b, shared = x.n and shared = y.n as equal from s join n x on x.doc_id = doc_a join n y on y.doc_id = doc_b where shared >= SHARE * (x.n + y.n - shared))"""
_QUERY = r"""
with cleaned as (select trim(regexp_replace(lower(query_text), '\s+', ' ', 'g')) as query_text from query_log),
counted as (select query_text, count(*) as exact_count from cleaned where query_text <> '' group by 1),
kept as (select * from counted where exact_count >= 0.002 * (select sum(exact_count) from counted))
"""
SQL = {
    # Up to 64 records of equal sets every pair is a row, as here; the words are runs of letters and digits.
    "p3_found": "with " + _GRAMS.replace("COUNT", "3").replace("SHARE", "0.7") + " select doc_a, doc_b from pairs",
    "p3_groups": "with recursive " + _GRAMS.replace("COUNT", "5").replace("SHARE", "0.8") + """, sided as (select doc_a as a, doc_b as b from pairs union all select doc_b, doc_a from pairs),
reach(a, b) as (select doc_id, doc_id from n union select r.a, e.b from reach r join sided e on e.a = r.b),
firsts as (select doc_id, coalesce(min(doc_a), doc_id) as rep from n left join pairs on doc_b = doc_id and equal group by n.doc_id),
linked as (select x.rep as a, count(distinct y.rep) as links from sided join firsts x on x.doc_id = a join firsts y on y.doc_id = b where x.rep <> y.rep group by 1),
grouped as (select a as doc_id, min(b) as group_id from reach group by 1)
select g.doc_id, g.group_id, coalesce(l.links, 0) as links from grouped g join firsts f on f.doc_id = g.doc_id left join linked l on l.a = f.rep""",
    "p4_frequencies": _CLEAN + "select term, cast(total as bigint) as total_count, df as doc_count, case when df <= 2 then 'rare' when df >= 0.2 * docs then 'common' end as mark from t, n",
    "p4_found": _CLEAN + "select term, case when df <= 2 then 'rare' else 'common' end as mark from t, n where df <= 2 or df >= 0.2 * docs",
    "p6_found": _CLEAN
    + """, s as (select p.doc_id, p.term, (1 + ln(p.tf)) * ln(n.docs / t.df) as score from p join t on p.term = t.term cross join n),
r as (select *, row_number() over (partition by doc_id order by score desc, term) as k from s) select doc_id, term from r where k <= 3""",
    "p6_dfr": _CLEAN
    + """, l as (select doc_id, sum(tf) as length from p group by 1), c as (select count(*) as docs, avg(length) as mean_length from l),
x as (select p.doc_id, p.term, p.tf * log2(1 + c.mean_length / l.length) as tfn, t.total / c.docs as rate from p join t on t.term = p.term join l on l.doc_id = p.doc_id cross join c),
s as (select doc_id, term, (log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1) as dfr from x),
r as (select *, row_number() over (partition by doc_id order by round(dfr, 9) desc, term) as k from s) select doc_id, term, round(dfr, 6) as dfr from r where k <= 3""",
    # No text may be lost, repeated or split though it fits, and no container overfull, whatever the tokenizer.
    "p8_check": "select cast(budget_id as bigint) as budget_id, (select count(*) from documents where length(text) > 0) as texts, 0 as lost, 0 as repeated, 0 as split, 0 as overfull from token_budgets",
    "p9_runs": r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k + 14], ' '))) as gram from d where len(w) >= 15),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k + 14], ' '))) as gram from i where len(w) >= 15)
select distinct doc_id, item_id from dg join ig using (gram)""",
    "p7_found": _QUERY + "select query_text from kept",
    "p7_counts": _QUERY + "select query_text, exact_count from kept",
}

"""Queries on references to pages that documents lack, lost or got later."""

from __future__ import annotations

from seekline.operators.orphans import Relation, orphan_cascade, orphan_report
from seekline.sources.tables import table


def _orphans(spark, base):
    """References to pages, by the cascade from documents over page scores to links; a page without a score row is looked up in documents itself."""
    links, ranks = table(spark, base, "links"), table(spark, base, "pagerank")
    relations = [
        Relation("links", "source_url", links, "pagerank", "found_at", root="documents"),
        Relation("links", "target_url", links, "pagerank", "found_at", root="documents"),
        Relation("pagerank", "url", ranks, "documents", "updated_at", key="url"),
    ]
    found = orphan_cascade(relations, {"documents": (table(spark, base, "documents"), "url", "created_at")}, (table(spark, base, "deleted_pages"), "url"))
    return found.withColumn("state", found["origin"])


def p5_found(spark, base):
    return _orphans(spark, base).select("ref_table", "ref_field", "url", "period", "state")


def p5_report(spark, base):
    return orphan_report(_orphans(spark, base))


def p5_cascade(spark, base):
    """Links hang on page scores and those on documents: a link is an inherited orphan where its page's score row is an orphan."""
    links, ranks = table(spark, base, "links"), table(spark, base, "pagerank")
    relations = [
        Relation("links", "source_url", links, "pagerank", "found_at"),
        Relation("links", "target_url", links, "pagerank", "found_at"),
        Relation("pagerank", "url", ranks, "documents", "updated_at", key="url"),
    ]
    parents = {"documents": (table(spark, base, "documents"), "url", "created_at")}
    return orphan_cascade(relations, parents, (table(spark, base, "deleted_pages"), "url")).select("ref_table", "ref_field", "url", "period", "state", "kind", "depth")


_BASE = r"""
with norm as (
  select t, f, ts, lower(regexp_extract(u, '(?i)^(https?://[^/?]*)', 1)) || substr(u, length(regexp_extract(u, '(?i)^(https?://[^/?]*)', 1)) + 1) as url
  from (select t, f, ts, regexp_replace(trim(u), '(?s)#.*$', '') as u from (
    select 'links' t, 'source_url' f, source_url u, found_at ts from links union all
    select 'links', 'target_url', target_url, found_at from links union all
    select 'pagerank', 'url', url, updated_at from pagerank union all
    select 'documents', 'url', url, created_at from documents union all
    select 'deleted', 'url', url, null from deleted_pages) x)
  where regexp_matches(u, '(?i)^https?://')),
docs as (select url, min(ts) born from norm where t = 'documents' group by url),
gone as (select distinct url from norm where t = 'deleted'),
refs as (select t, f, url, coalesce(strftime(ts at time zone 'UTC', '%Y-%m'), 'unknown') period, min(ts) first_at, count(*) n from norm where t in ('links', 'pagerank') group by 1, 2, 3, 4),
orphans as (
  select t ref_table, f ref_field, r.url, period, n,
    case when d.url is not null then 'late' when g.url is not null then 'deleted' else 'missing' end state
  from refs r left join docs d on d.url = r.url left join gone g on g.url = r.url
  where d.url is null or d.born > r.first_at)
"""

_CASCADE = _BASE.replace("with norm as", "with recursive norm as", 1) + r""",
scored as (select distinct url from norm where t = 'pagerank'),
found(ref_table, ref_field, url, period, state, kind, depth) as (
  select ref_table, ref_field, url, period, state, 'direct', 0 from orphans where ref_table = 'pagerank' union all
  select t, f, r.url, period, case when g.url is not null then 'deleted' else 'missing' end, 'direct', 0 from refs r left join gone g on g.url = r.url where t = 'links' and r.url not in (select url from scored) union all
  select r.t, r.f, r.url, r.period, 'inherited', 'inherited', p.depth + 1 from (select distinct url, depth from found where ref_table = 'pagerank' and state <> 'late') p join refs r on r.url = p.url and r.t = 'links')
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_cascade": p5_cascade}
SQL = {
    "p5_found": _BASE + "select ref_table, ref_field, url, period, state from orphans",
    "p5_cascade": _CASCADE + "select ref_table, ref_field, url, period, state, kind, cast(depth as int) as depth from found",
    "p5_report": _BASE + "select ref_table, ref_field, period, state, count(*) as urls, cast(sum(n) as bigint) as rows from orphans group by 1, 2, 3, 4",
}

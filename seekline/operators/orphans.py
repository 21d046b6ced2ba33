"""References to records that don't exist (problem 5): a fixpoint cascade.

Relations form a foreign-key graph.  A reference is a *direct* orphan when no
record has its key, and an *inherited* orphan when the record it names is
itself an orphan.  Starting from the direct orphans, semi-joins carry the
state down the graph until a pass finds nothing new, so cycles end too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekline.plans.lineage import materialize


@dataclass(frozen=True)
class Relation:
    """A table whose column ``field`` names keys of the table ``parent``.

    ``key`` is the column by which others name this table's records (None if
    nobody does), ``at`` the time of the reference.  ``root`` is the table that
    must hold a key of which ``parent`` has no record, and whose times make a
    reference late; without one it is ``parent``.
    """

    table: str
    field: str
    rows: DataFrame
    parent: str
    at: str | None = None
    key: str | None = None
    root: str | None = None


def normal_url(url: Column) -> Column:
    """The url without ``#`` and what follows, scheme and host in lower case; null unless it starts with http:// or https://."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?i)^(https?://[^/?]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), bare.substr(F.length(head) + 1, F.length(bare))))


def references(relations: Sequence[Relation]) -> DataFrame:
    """Each relation's references, pre-aggregated: ``ref_table, ref_field, url, period, first_at, parent, root, rows``.

    ``period`` is the month ``yyyy-MM`` of the reference, ``unknown`` for a
    null time.  Values that are null or no web address are skipped.
    """
    out = None
    for r in relations:
        time = F.col(r.at) if r.at else F.lit(None).cast("timestamp")
        one = r.rows.select(normal_url(F.col(r.field)).alias("url"), time.alias("at")).where("url is not null")
        one = one.groupBy("url", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("rows"))
        one = one.select(F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"), "url", "period", "first_at", F.lit(r.parent).alias("parent"), F.lit(r.root or r.parent).alias("root"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def direct_orphans(relations: Sequence[Relation], parents: dict[str, tuple[DataFrame, str, str | None]], deleted: tuple[DataFrame, str] | None = None, refs: DataFrame | None = None) -> DataFrame:
    """References whose key is missing, deleted or late: ``ref_table, ref_field, url, period, state, rows``.

    ``parents`` gives for each parent its rows, key column and time column;
    ``deleted`` lists keys taken out of the parents.  ``late`` means that the
    root's earliest time is after the earliest reference of that period.
    References are pre-aggregated by url and month before anything is
    shuffled, so a url that a third of all rows name is a few rows per task;
    ``refs`` has them where that is done already.
    """
    keys = None
    for name, (rows, key, time) in parents.items():
        one = rows.select(normal_url(F.col(key)).alias("url"), (F.col(time) if time else F.lit(None).cast("timestamp")).alias("born"))
        one = one.where("url is not null").groupBy("url").agg(F.min("born").alias("born")).select(F.lit(name).alias("parent"), "url", "born")
        keys = one if keys is None else keys.unionByName(one)
    if refs is None:
        refs = materialize(references(relations), "references")
    # The first step of the cascade: what no key keeps is an orphan, what a key keeps is late where the key came after it.
    lost = refs.join(keys.select("url", "parent"), ["url", "parent"], "left_anti")
    if any(r.root for r in relations):
        lost = lost.join(keys.select("url", F.col("parent").alias("root")), ["url", "root"], "left_anti")
    late = refs.join(keys.withColumnRenamed("parent", "root"), ["url", "root"]).where("born > first_at").withColumn("state", F.lit("late"))
    if deleted is not None:
        gone = deleted[0].select(normal_url(F.col(deleted[1])).alias("url")).where("url is not null").distinct()
        taken = lost.join(gone, "url", "left_semi").withColumn("state", F.lit("deleted"))
        missing = lost.join(gone, "url", "left_anti").withColumn("state", F.lit("missing"))
        orphans = late.select(*taken.columns).unionByName(taken).unionByName(missing)
    else:
        missing = lost.withColumn("state", F.lit("missing"))
        orphans = late.select(*missing.columns).unionByName(missing)
    return orphans.select("ref_table", "ref_field", "url", "period", "state", "rows")


def orphan_cascade(relations: Sequence[Relation], parents: dict[str, tuple[DataFrame, str, str | None]], deleted: tuple[DataFrame, str] | None = None, max_rounds: int = 50) -> DataFrame:
    """Direct and inherited orphans: ``ref_table, ref_field, url, period, state, kind, depth, rows, origin``.

    A relation whose parent is another relation's table (with a ``key``) hangs
    on it: its reference is a direct orphan where that table lacks the key, and
    inherited where every record of that key is an orphan.  Inherited orphans
    have the state ``inherited``.  Each round joins the references with the
    keys newly found to be orphans; the fixpoint is reached when none is new.
    ``origin`` is the state of the direct orphan that it comes from: ``deleted``
    where one of those is, else ``missing``.
    """
    tables = {r.table: r for r in relations if r.key}
    bases = dict(parents)
    for name, r in tables.items():
        bases[name] = (r.rows, r.key, None)
    refs = materialize(references(relations), "references")
    direct = direct_orphans(relations, bases, deleted, refs).withColumn("kind", F.lit("direct")).withColumn("depth", F.lit(0)).withColumn("origin", F.col("state"))
    if not any(r.parent in tables for r in relations):
        return direct
    refs = refs.where(F.col("parent").isin(*tables)).drop("first_at", "root")
    found = materialize(direct, "orphans")
    # (table, key, field): a record is an orphan once one of its own references is; a key, once all its records are.
    records = None
    for name, r in tables.items():
        one = r.rows.select(F.lit(name).alias("parent"), normal_url(F.col(r.key)).alias("key"), normal_url(F.col(r.field)).alias("up"), F.lit(r.field).alias("ref_field")).where("key is not null and up is not null")
        records = one if records is None else records.unionByName(one)
    records = materialize(records.distinct(), "records")
    settled = found.where("state <> 'late'").select("ref_table", "ref_field", "url", "origin").distinct()
    on = ["parent", "ref_field", "up"]
    for depth in range(1, max_rounds + 1):
        orphans = settled.select(F.col("ref_table").alias("parent"), "ref_field", F.col("url").alias("up"), "origin")
        bad = records.join(orphans, on, "left_semi").select("parent", "key").distinct()
        good = records.join(orphans, on, "left_anti").select("parent", "key").distinct()
        orphan_keys = bad.join(good, ["parent", "key"], "left_anti").withColumnRenamed("key", "url")
        fresh = refs.join(orphan_keys, ["parent", "url"], "left_semi").join(settled, ["ref_table", "ref_field", "url"], "left_anti")
        fresh = materialize(fresh.select("ref_table", "ref_field", "url", "period", F.lit("inherited").alias("state"), "rows", F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"), "parent"), "inherited")
        if fresh.isEmpty():
            return found
        taken = records.join(orphans.where("origin = 'deleted'"), on, "left_semi").select("parent", F.col("key").alias("url"))
        fresh = fresh.join(taken, ["parent", "url"], "left_semi").withColumn("origin", F.lit("deleted")).unionByName(fresh.join(taken, ["parent", "url"], "left_anti").withColumn("origin", F.lit("missing"))).drop("parent")
        found = materialize(found.unionByName(fresh), "orphans")
        settled = found.where("state <> 'late'").select("ref_table", "ref_field", "url", "origin").distinct()
    raise RuntimeError("the cascade did not settle")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, month and state: distinct urls and rows."""
    return orphans.groupBy("ref_table", "ref_field", "period", "state").agg(F.count(F.lit(1)).alias("urls"), F.sum("rows").alias("rows"))

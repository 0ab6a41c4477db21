"""Catalog operators over management tables: dynamic filters, pages, labels, rankings, reference counts, orphans, audits."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page sizes.
PAGE, MOST_PAGE, RECENT = 20, 100, 50


def where_given(df: DataFrame, conditions: Iterable[tuple[object, Column]]) -> DataFrame:
    """Rows that meet every condition whose value was given (is not None)."""
    return reduce(lambda d, c: d.where(c), (c for value, c in conditions if value is not None), df)


def project_filter(df: DataFrame, status=None, name=None, template=None, type_=None, since=None, folder=None, tag=None) -> DataFrame:
    """The dynamic project filter; columns as in the project table, ``tags`` an array of (name, color)."""
    return where_given(
        df,
        [
            (status, F.col("status") == status),
            (name, F.col("project_name").contains(name or "")),
            (template, F.col("bound_template_id") == template),
            (type_, F.col("contract_type").contains(type_ or "")),
            (since, F.col("updated_at") >= F.lit(since)),
            (folder, F.col("folder_id") == folder),
            (tag, F.exists("tags", lambda t: t["name"] == F.lit(tag)) if tag is not None else F.lit(True)),
        ],
    )


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page in a total order; arguments out of range are refused."""
    if offset < 0 or not 1 <= limit <= MOST_PAGE:
        raise ValueError("offset must not be negative, limit must be 1 to 100")
    return df.orderBy(*order).offset(offset).limit(limit)


def labelled(df: DataFrame, lookups: list[tuple[DataFrame, str, str, str, str, str]]) -> DataFrame:
    """Left lookups (table, key here, key there, value there, new name, default)."""
    for table, here, there, value, name, default in lookups:
        own = table.select(F.col(there).alias(f"_{name}_key"), F.col(value).alias(name))
        df = df.join(own, F.col(here) == F.col(f"_{name}_key"), "left").drop(f"_{name}_key").withColumn(name, F.coalesce(name, F.lit(default)))
    return df


def numbered(df: DataFrame, key: str, order: list[str], start: DataFrame | None = None, next_col: str = "next_number") -> DataFrame:
    """``version_number`` within ``key`` by ``order``, continuing each key's next number where given."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if start is None:
        return df.withColumn("version_number", rank)
    return df.withColumn("_k", rank).join(start.select(key, next_col), key, "left").withColumn("version_number", F.coalesce(next_col, F.lit(1)) + F.col("_k") - 1).drop("_k", next_col)


def next_numbers(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_number"))


def first_copies(df: DataFrame, key: str, content: str, order: list[str], id_col: str) -> DataFrame:
    """``duplicate_of``: the first row of the same key and content, null for that row itself."""
    first = F.first(id_col).over(Window.partitionBy(key, content).orderBy(*order))
    return df.withColumn("duplicate_of", F.when(first != F.col(id_col), first))


def round_gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """Keys whose rounds are not 1 .. n without gaps."""
    facts = df.groupBy(key).agg(F.max(number).alias("highest"), F.count_distinct(number).alias("rounds"), F.min(number).alias("lowest"))
    return facts.where("lowest <> 1 or highest <> rounds")


def orphans(df: DataFrame, key: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that no reference names: chained anti joins."""
    return reduce(lambda d, r: d.join(r[0].select(F.col(r[1]).alias(key)).where(F.col(key).isNotNull()), key, "left_anti"), references, df)


def reference_counts(sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """key, references: distinct (key, id) over the union of the sources (table, key column, id column)."""
    rows = reduce(DataFrame.union, (t.select(F.col(k).alias("key"), F.col(i).cast("string").alias("id")) for t, k, i in sources))
    return rows.distinct().groupBy("key").agg(F.count("*").alias("references"))


def payload_bytes(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_name, bytes of each table's payload column."""
    one = lambda n, t, c: t.agg(F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0)).alias("bytes")).select(F.lit(n).alias("table_name"), "bytes")
    return reduce(DataFrame.union, (one(n, t, c) for n, (t, c) in tables.items()))


def row_facts(df: DataFrame, key: str) -> DataFrame:
    """key, digest: a digest of every row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))


def fact_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows that only one side has or that differ."""
    x, y = row_facts(a, key).withColumnRenamed("digest", "before"), row_facts(b, key).withColumnRenamed("digest", "after")
    joined = x.join(y, "key", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return joined.select("key", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("difference"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, repeats counted."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def nearest(df: DataFrame, key: list[str], order: list[str], trusted: Column, value: str) -> DataFrame:
    """``previous`` and ``following``: the value of the nearest trusted row before and after, in one sort."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(trusted, F.col(value))
    return df.withColumns({"previous": F.last(own, ignorenulls=True).over(before), "following": F.last(own, ignorenulls=True).over(after)})


def overlaps(a: DataFrame, b: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of ranges [start, stop) of one key that overlap; ranges meet in bins of ``width``, each pair once.

    a: key, a_id, a_start, a_stop; b likewise. Only ranges that share a bin are compared.
    """
    binned = lambda df, s: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{s}_start") / width), F.floor((F.col(f"{s}_stop") - 1) / width)))).where(F.col(f"{s}_start") < F.col(f"{s}_stop"))
    met = binned(a.where("a_start < a_stop"), "a").join(binned(b.where("b_start < b_stop"), "b"), [*key, "bin"]).where("a_start < b_stop and b_start < a_stop")
    return met.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("bin")


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Consecutive equal values merged: key, run, value, length."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = (~F.lag(value).over(by).eqNullSafe(F.col(value)) | (F.row_number().over(by) == 1)).cast("int")
    named = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(key, "run").agg(F.first(value).alias("value"), F.count("*").alias("length"))


def highest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """Highest a.b.c version of each key, and the suggestion with the patch number raised."""
    parts = F.transform(F.split(version, "\\."), lambda x: x.cast("int"))
    best = df.where(F.col(version).rlike("^\\d+\\.\\d+\\.\\d+$")).groupBy(key).agg(F.max(F.struct(parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c"))).alias("v"))
    text = lambda c: F.concat_ws(".", F.col("v.a").cast("string"), F.col("v.b").cast("string"), c.cast("string"))
    return best.select(key, text(F.col("v.c")).alias("highest"), text(F.col("v.c") + 1).alias("suggested"))


def audit(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule of every row that breaks a rule."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace or join the rows of ``table`` by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def set_current(versions: DataFrame, template: str, version: str) -> DataFrame:
    """Exactly the named version of a template is current."""
    own = F.col("template_id") == template
    if versions.where(own & (F.col("id") == version)).limit(1).count() != 1:
        raise ValueError("the version does not belong to the template")
    return versions.withColumn("is_current", F.when(own, F.col("id") == version).otherwise(F.col("is_current")))


# Allowed status changes of a project.
TRANSITIONS = {"Active": ("Archived", "Recycled"), "Archived": ("Active", "Recycled"), "Recycled": ("Active",)}


def set_status(projects: DataFrame, project: str, status: str) -> DataFrame:
    """The project in its new status if the change is allowed, else an error."""
    now = projects.where(F.col("id") == project).select("status").head()
    if now is None or status not in TRANSITIONS.get(now.status, ()):
        raise ValueError("status change is not allowed")
    return projects.withColumn("status", F.when(F.col("id") == project, status).otherwise(F.col("status")))


def cascade_delete(tables: dict[str, DataFrame], root: str, key: str, ids: DataFrame, children: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted roots: ``children`` maps a table to its reference column."""
    gone = ids.select(F.col(key).alias("_gone"))
    drop = lambda df, c: df.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    return {n: drop(t, key) if n == root else drop(t, children[n]) if n in children else t for n, t in tables.items()}

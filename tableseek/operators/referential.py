"""Row samples of a database that stay consistent across its foreign keys.

Foreign-key metadata is small and lives on the driver; rows never do. Every sample
holds at most ``max_rows`` rows per table (and per scope value, when several
databases share one schema), so sampled sides of joins are bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key
from tableseek.operators.ranking import top_k
from tableseek.session import cut_lineage

# A sampled side with at most this many rows is broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class ForeignKey:
    child: str
    parent: str
    child_columns: tuple[str, ...]
    parent_columns: tuple[str, ...]


def parent_first_order(tables: Sequence[str], fks: Sequence[ForeignKey]) -> list[str]:
    """Parents before children; tables on cycles come last, sorted."""
    waiting = {t: {fk.parent for fk in fks if fk.child == t and fk.parent != t} for t in tables}
    order: list[str] = []
    while True:
        ready = sorted(t for t, parents in waiting.items() if not parents - set(order))
        if not ready:
            return order + sorted(waiting)
        order += ready
        for table in ready:
            del waiting[table]


def child_first_order(tables: Sequence[str], fks: Sequence[ForeignKey]) -> list[str]:
    """Children before the parents they reference; tables on cycles come last."""
    flipped = [ForeignKey(fk.parent, fk.child, fk.parent_columns, fk.child_columns) for fk in fks]
    return parent_first_order(tables, flipped)


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def reference_keys(parent: DataFrame, fk: ForeignKey, scope: Sequence[str], bound: int | None) -> DataFrame:
    """Distinct non-null parent keys named like the child's columns."""
    keys = parent.filter(~any_null(fk.parent_columns)).select(
        *scope, *[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.child_columns, strict=True)]
    ).distinct()
    return F.broadcast(keys) if bound is not None and bound <= BROADCAST_ROWS else keys


def eligible(child: DataFrame, fk: ForeignKey, parent: DataFrame, scope: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """Child rows whose key has a NULL component or exists in the parent."""
    on = [*scope, *fk.child_columns]
    keys = reference_keys(parent, fk, scope, bound).withColumn("_hit", F.lit(True))
    joined = child.join(keys, on, "left")
    return joined.filter(F.col("_hit") | any_null(fk.child_columns)).drop("_hit")


def dangling(child: DataFrame, fk: ForeignKey, parent: DataFrame, scope: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    keys = reference_keys(parent, fk, scope, bound)
    return child.filter(~any_null(fk.child_columns)).join(keys, [*scope, *fk.child_columns], "left_anti")


def base_sample(
    df: DataFrame, table: str, key: Sequence[str], max_rows: int, seed: int, scope: Sequence[str] = ()
) -> DataFrame:
    """At most max_rows rows in the hash order of (table, scope, key)."""
    hashed = df.withColumn("_h", hash_key(F.lit(table), *scope, *key, seed=seed))
    if scope:
        return top_k(hashed, scope, ["_h", *key], max_rows, rank="_r").drop("_h", "_r")
    return hashed.orderBy("_h", *key).limit(max_rows).drop("_h")


def sample_database(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    fks: Sequence[ForeignKey],
    max_rows: int,
    seed: int = 42,
    scope: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Per table at most max_rows rows that are eligible under every sampled parent.

    Walks the tables parents first. Each finished sample is checkpointed: later steps
    and retries then read max_rows rows instead of the chain of scans behind them.
    """
    bound = None if scope else max_rows
    sampled: dict[str, DataFrame] = {}
    for table in parent_first_order(list(tables), fks):
        rows = tables[table]
        for fk in fks:
            if fk.child == table and fk.parent in sampled:
                rows = eligible(rows, fk, sampled[fk.parent], scope, bound)
        sampled[table] = cut_lineage(base_sample(rows, table, keys[table], max_rows, seed, scope))
    return sampled


def prune_to_closure(
    sampled: Mapping[str, DataFrame], fks: Sequence[ForeignKey], scope: Sequence[str] = (), bound: int | None = None
) -> tuple[dict[str, DataFrame], int]:
    """Repeat the semi-joins until no row is removed; returns the rest and the removed count."""
    current = dict(sampled)
    sizes = {t: df.count() for t, df in current.items()}
    removed = 0
    while True:
        before = removed
        for fk in fks:
            kept = cut_lineage(eligible(current[fk.child], fk, current[fk.parent], scope, bound))
            n = kept.count()
            removed += sizes[fk.child] - n
            current[fk.child], sizes[fk.child] = kept, n
        if removed == before:
            return current, removed


def closure_report(
    sampled: Mapping[str, DataFrame], fks: Sequence[ForeignKey], scope: Sequence[str] = (), bound: int | None = None
) -> DataFrame:
    """Dangling non-null references per foreign key; all zero when the sample is closed."""
    parts = []
    for fk in fks:
        bad = dangling(sampled[fk.child], fk, sampled[fk.parent], scope, bound)
        parts.append(
            bad.agg(F.count("*").alias("n_dangling")).select(
                F.lit(fk.child).alias("child"), F.lit(fk.parent).alias("parent"),
                F.lit(",".join(fk.child_columns)).alias("child_columns"), "n_dangling",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def size_report(sampled: Mapping[str, DataFrame], max_rows: int) -> DataFrame:
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in sampled.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("within_cap", F.col("n_rows") <= max_rows)


def aligned_sample(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    fks: Sequence[ForeignKey],
    max_rows: int,
    seed: int = 42,
    align: bool = True,
) -> dict[str, DataFrame]:
    """Parents show the rows their children's final samples refer to.

    Walks the tables children first. The referenced keys are at most max_rows per
    foreign key, each matched through its own parent column; a parent nobody refers to
    gets its base sample.
    """
    order = child_first_order(list(tables), fks) if align else list(tables)
    final: dict[str, DataFrame] = {}
    for table in order:
        incoming = [fk for fk in fks if fk.parent == table and fk.child in final and fk.child != table]
        base = base_sample(tables[table], table, keys[table], max_rows, seed)
        if not (align and incoming):
            final[table] = cut_lineage(base)
            continue
        hits = []
        for fk in incoming:
            wanted = final[fk.child].filter(~any_null(fk.child_columns)).select(
                *[F.col(c).alias(p) for c, p in zip(fk.child_columns, fk.parent_columns, strict=True)]
            ).distinct()
            wanted = wanted.withColumn("_h", hash_key(F.lit(table), *fk.parent_columns, seed=seed))
            wanted = wanted.orderBy("_h", *fk.parent_columns).limit(max_rows).drop("_h")
            small = F.broadcast(wanted) if max_rows <= BROADCAST_ROWS else wanted
            hits.append(tables[table].join(small, list(fk.parent_columns), "left_semi"))
        found = reduce(DataFrame.unionByName, hits).dropDuplicates(list(keys[table]))
        aligned = cut_lineage(base_sample(found, table, keys[table], max_rows, seed))
        final[table] = cut_lineage(base) if aligned.isEmpty() else aligned
    return final


def decode_schema_keys(schemas: DataFrame) -> DataFrame:
    """Index-pair foreign keys of schema records to names; out-of-range pairs are dropped.

    Input (db_id, table_names_original, column_names_original as [table index, name],
    foreign_keys as [child index, parent index]). All lookups stay inside the record.
    """
    pairs = schemas.select("db_id", "table_names_original", "column_names_original", F.explode("foreign_keys").alias("_p"))
    pairs = pairs.filter(F.size("_p") == 2)

    def spec(position: int) -> Column:
        index = F.element_at("_p", position)
        return F.when(index >= 0, F.get("column_names_original", index))

    def table(column_spec: Column) -> Column:
        index = F.get(column_spec, F.lit(0)).try_cast("int")
        return F.when(index >= 0, F.get("table_names_original", index))

    decoded = pairs.select(
        "db_id",
        table(spec(1)).alias("child"),
        F.get(spec(1), F.lit(1)).alias("child_column"),
        table(spec(2)).alias("parent"),
        F.get(spec(2), F.lit(1)).alias("parent_column"),
    )
    return decoded.dropna()


def merge_foreign_keys(live: DataFrame, fallback: DataFrame, columns: DataFrame) -> DataFrame:
    """Live foreign keys override schema-record ones; keys over missing columns are dropped.

    Keys are (db_id, child, child_column, parent, parent_column); columns is the live
    catalog (db_id, table_name, column_name). Names match case-insensitively and come
    out in their live spelling.
    """
    names = ["child", "child_column", "parent", "parent_column"]
    tagged = live.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    lowered = [F.lower(n).alias(f"_{n}") for n in names]
    best = tagged.select("*", *lowered).groupBy("db_id", *[f"_{n}" for n in names]).agg(F.min("_p").alias("_p"))
    low = columns.select(
        "db_id", F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), "table_name", "column_name"
    )
    for side in ("child", "parent"):
        own = low.select(
            "db_id", F.col("_t").alias(f"_{side}"), F.col("_c").alias(f"_{side}_column"),
            F.col("table_name").alias(side), F.col("column_name").alias(f"{side}_column"),
        )
        best = best.join(own, ["db_id", f"_{side}", f"_{side}_column"])
    origin = F.when(F.col("_p") == 0, "live").otherwise("schema")
    return best.select("db_id", *names, origin.alias("origin"))


def flag_foreign_keys(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """is_foreign_key on a column catalog(db_id, table_name, column_name)."""
    flags = fks.select("db_id", F.col("child").alias("table_name"), F.col("child_column").alias("column_name")).distinct()
    marked = columns.join(flags.withColumn("_fk", F.lit(True)), ["db_id", "table_name", "column_name"], "left")
    return marked.withColumn("is_foreign_key", F.coalesce("_fk", F.lit(False))).drop("_fk")

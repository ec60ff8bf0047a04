"""Exact ranking and joining for keys of any size: no task sees a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldmill.llm.common import stored


def row_index(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """0-based position of each row within ``keys`` by (bucket, *order).

    ``bucket`` must grow with the order. Rows are ranked inside (keys, bucket), then shifted by
    the counts of the earlier buckets, so one group spreads over as many tasks as it has buckets.
    """
    # one struct holds the keys and the bucket: structs are equal where both have nulls, so a plain join finds the shifts
    # where the ranks were taken, without another shuffle of the rows
    tagged = df.withColumn("_at", F.struct(*keys, bucket.alias("_bucket")))
    counts = tagged.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy(F.col("_at._bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = counts.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_at").orderBy(*order)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside) - 1)
    return (ranked.join(shifts.hint("merge"), "_at", "left")
            .withColumn(name, F.col("_rank") + F.col("_shift")).select(*df.columns, name))


def previous_values(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                    columns: list[str]) -> DataFrame:
    """Adds `prev_<c>`: the last non-NULL value of c in earlier rows of ``keys`` by (bucket, *order).

    Looked up inside the bucket first, then in the closing values of the earlier buckets, so a
    group of any size is spread over as many tasks as it has buckets.
    """
    tagged = df if "_bucket" in df.columns else df.withColumn("_bucket", bucket)
    at = F.struct(*order)
    ends = tagged.groupBy(*keys, "_bucket").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_end_{c}") for c in columns])
    chain = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        *[F.last(f"_end_{c}", ignorenulls=True).over(chain).alias(f"_before_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    near = tagged.select("*", *[
        F.last(c, ignorenulls=True).over(inside).alias(f"_near_{c}") for c in columns])
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = near.join(ends, on, "left")
    return joined.select(*df.columns, *[
        F.coalesce(f"_near_{c}", f"_before_{c}").alias(f"prev_{c}") for c in columns])


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
               spread: Column | None = None, salts: int = 0) -> DataFrame:
    """Equi-join where ``small`` has one row per key and ``big`` may have very many of one key.

    By default a sort-merge join, as the size of ``small`` cannot be told from the files it comes from: adaptive
    execution splits a hot partition of ``big`` and hands each piece the same rows of ``small``. With ``salts``
    the split is made in the plan instead: rows of ``big`` are dealt out by ``spread`` and ``small`` is repeated
    once per salt.
    """
    if not salts:
        return big.join(small.hint("merge"), keys, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def bucketed_join(big: DataFrame, small: DataFrame, keys: list[str], bucket: Column, how: str = "left") -> DataFrame:
    """Equi-join where ``small`` has one row per key, spread by (keys, bucket): no task gets all rows of a hot key.

    The (key, bucket) pairs of ``big``, reduced before their shuffle, say how often a row of ``small`` is repeated. What follows and
    groups by (keys, bucket), with the bucket under the name `_bucket`, needs no further exchange.
    """
    tagged = big.withColumn("_bucket", bucket)
    copies = tagged.select(*keys, "_bucket").distinct().join(small.hint("merge"), keys)
    return tagged.join(copies.hint("merge"), [*keys, "_bucket"], how)


def asked_for(table: DataFrame, asking: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``table`` whose key occurs in ``asking``.

    The distinct keys are written first, so that their real size decides: few keys are broadcast and ``table`` is not shuffled.
    """
    return table.join(stored(asking.select(*keys).distinct(), "asked-for"), keys, "left_semi")


def day_bucket(ts: Column) -> Column:
    """Order-keeping bucket for event times."""
    return F.date_trunc("day", ts)

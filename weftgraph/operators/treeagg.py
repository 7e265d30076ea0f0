"""Aggregation per key by a tree of partial states, for tables where few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk of the first round, and states that one node of the tree merges.
CHUNK_ROWS, FAN_IN = 1 << 16, 16
#: Input splits that the rounds over counts reduce to one: FAN_IN to the power of the rounds.
COUNT_ROUNDS = 4


def tree_aggregate(df: DataFrame, keys: list[str], member: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows and distinct ``member`` values of each key, without one task that takes all of a hot key.

    Returns ``keys``, ``n_rows`` and ``n_members``.

    * Leaf: each input split is combined where it is read, to one row per (key, member) (Spark's partial aggregation);
      these meet in chunks by the hash of key *and* member. There are as many chunks as the table has ``chunk_rows``
      rows, so a chunk of the hottest key has a fixed size whatever the table's, and every member is counted in one place.
    * Rounds: states are (rows, members); states of disjoint member sets merge by addition. Each round merges at most
      ``fan_in`` chunks, until one is left: log(chunks) rounds, and the last reducer of the hottest key receives ``fan_in``
      partials.

    Only the leaf round moves member values; later rounds move two numbers a key and chunk. The number of chunks comes
    from a count of the rows, which Parquet answers from its footers.

    Nulls: a null key is a key of its own, a null member counts as a row and not as a member. Empty input gives no
    rows. Repeated rows count as rows each time and as one member. Other columns are ignored; the working names
    carry the prefix ``_ta_`` so that columns of any other name cannot clash.
    """
    k = [F.col(f"`{c}`").alias(f"_ta_k{i}") for i, c in enumerate(keys)]
    names = [f"_ta_k{i}" for i in range(len(keys))]
    chunks = left = max(1, -(-df.count() // chunk_rows))
    states = (
        df.select(*k, F.col(f"`{member}`").alias("_ta_m"))
        .groupBy(*names, "_ta_m")
        .agg(F.count(F.lit(1)).alias("_ta_n"))
        .withColumn("_ta_d", F.when(F.col("_ta_m").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long"))
        .withColumn("_ta_c", F.pmod(F.xxhash64("_ta_m"), F.lit(chunks)))
    )
    while True:
        states = states.groupBy(*names, "_ta_c").agg(F.sum("_ta_n").alias("_ta_n"), F.sum("_ta_d").alias("_ta_d"))
        if left <= 1:
            break
        left = -(-left // fan_in)
        states = states.withColumn("_ta_c", F.floor(F.col("_ta_c") / F.lit(fan_in)) if left > 1 else F.lit(0).cast("long"))
    return states.select(
        *[F.col(f"_ta_k{i}").alias(c) for i, c in enumerate(keys)],
        F.col("_ta_n").alias("n_rows"),
        F.col("_ta_d").alias("n_members"),
    )


def tree_counts(df: DataFrame, keys: list[str], fan_in: int = FAN_IN, rounds: int = COUNT_ROUNDS) -> DataFrame:
    """Rows of each key as ``n_rows``: the rounds of ``tree_aggregate`` where no members are asked for.

    A chunk is an input split, combined where it is read to one row a key; each round merges the states of ``fan_in``
    neighbouring splits, so no reducer receives all partials of a hot key while there are ``fan_in ** rounds`` splits or
    fewer. Nothing but a key, a split and a count is ever shuffled. Null keys count as keys.
    """
    names = [f"_ta_k{i}" for i in range(len(keys))]
    states = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)], F.spark_partition_id().cast("long").alias("_ta_c"), F.lit(1).cast("long").alias("_ta_n"))
    for r in range(rounds):
        states = states.withColumn("_ta_c", F.floor(F.col("_ta_c") / F.lit(fan_in)) if r else F.col("_ta_c")).groupBy(*names, "_ta_c").agg(F.sum("_ta_n").alias("_ta_n"))
    states = states.groupBy(*names).agg(F.sum("_ta_n").alias("n_rows"))
    return states.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "n_rows")


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, n_rows) of the keys without nulls whose rows make up at least ``share`` of all rows, nulls and repeats included."""
    total = df.agg(F.count(F.lit(1)).alias("_ta_total"))
    found = tree_counts(df, keys)
    for c in keys:
        found = found.where(F.col(f"`{c}`").isNotNull())
    return (
        found.join(F.broadcast(total))
        .where(F.col("n_rows") >= F.lit(share) * F.col("_ta_total"))
        .drop("_ta_total")
    )

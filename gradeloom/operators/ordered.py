"""Order-dependent joins and numbering that no single hot key can turn into one task.

Time (or position) is cut into buckets. Work inside a bucket is a window over
(key, bucket); what crosses a bucket edge travels as one summary row per
bucket, produced by a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


#: default bucket: about 70 minutes of epoch milliseconds. Only buckets that hold rows exist.
TIME_BUCKET = 1 << 22


def bucket_of(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str,
                  payload: list[str], right_seq: str | None = None, width: int = TIME_BUCKET) -> DataFrame:
    """Each left row gets `payload` of the newest right row with right_ts <= ts, else NULLs.

    On equal right_ts the larger `right_seq` wins. One shuffle on (key, bucket):
    left rows, right rows and one carry row per bucket are ordered together.
    """
    seq = F.col(right_seq) if right_seq else F.lit(0)
    row = F.struct(F.col(right_ts).cast("bigint").alias("_t"), seq.cast("bigint").alias("_s"),
                   *[F.col(c) for c in payload])
    events = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, bucket_of(F.col(right_ts), width).alias("_bucket"), row.alias("_row"))
    own = left.select(*keys, bucket_of(F.col(ts), width).alias("_bucket"), F.col(ts).cast("bigint").alias("_at"),
                      F.struct(*left.columns).alias("_left"))

    last = events.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.struct("_row._t", "_row._s")).alias("_row"))
    wanted = own.select(*keys, "_bucket").distinct().withColumn("_row", F.lit(None).cast(last.schema["_row"].dataType))
    per_bucket = last.unionByName(wanted).groupBy(*keys, "_bucket").agg(F.first("_row", ignorenulls=True).alias("_row"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_bucket", F.last("_row", ignorenulls=True).over(earlier).alias("_row")).filter(
        "_row IS NOT NULL")

    none_left = F.lit(None).cast(own.schema["_left"].dataType).alias("_left")
    none_row = F.lit(None).cast(last.schema["_row"].dataType).alias("_row")
    mixed = (carry.select(*keys, "_bucket", F.lit(None).cast("bigint").alias("_at"), F.lit(0).alias("_side"),
                          F.lit(0).cast("bigint").alias("_s"), none_left, "_row")
             .unionByName(events.select(*keys, "_bucket", F.col("_row._t").alias("_at"), F.lit(1).alias("_side"),
                                        F.col("_row._s").alias("_s"), none_left, "_row"))
             .unionByName(own.select(*keys, "_bucket", "_at", F.lit(2).alias("_side"),
                                     F.lit(0).cast("bigint").alias("_s"), "_left", none_row)))
    upto = W.partitionBy(*keys, "_bucket").orderBy(F.asc_nulls_first("_at"), "_side", "_s").rowsBetween(
        W.unboundedPreceding, 0)
    seen = mixed.withColumn("_hit", F.last("_row", ignorenulls=True).over(upto)).filter("_side = 2")
    return seen.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns],
                       F.col("_hit._t").alias(right_ts if right_ts not in left.columns else f"{right_ts}_right"),
                       *[F.col(f"_hit.{c}").alias(c) for c in payload])


def previous_value(df: DataFrame, keys: list[str], position: Column, column: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Add the value of `column` in the row before, by a unique integer position per key.

    A lag inside each (key, bucket); a bucket's first row takes the last value
    of the bucket before it, from one summary row per bucket.
    """
    placed = df.withColumn("_at", position.cast("bigint")).withColumn("_bucket", bucket_of(F.col("_at"), width))
    ends = placed.groupBy(*keys, "_bucket").agg(F.max_by(column, "_at").alias("_end"))
    carry = ends.select(*keys, "_bucket", F.lag("_end").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    inside = W.partitionBy(*keys, "_bucket").orderBy("_at")
    lagged = placed.withColumn("_lag", F.lag(column).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return lagged.join(carry, [*keys, "_bucket"]).select(
        *df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")).alias(out))


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, payload: list[str],
                max_gap: int, right_seq: str | None = None, width: int = TIME_BUCKET) -> DataFrame:
    """As-of backward, kept only when the match is at most `max_gap` older."""
    found = asof_backward(left, right, keys, ts, right_ts, payload, right_seq, width)
    return found.filter(F.col(right_ts).isNotNull() & (F.col(ts) - F.col(right_ts) <= max_gap))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Add `root` and `relative` of the longest `prefix` that is a parent folder of the path.

    Every parent folder of a path becomes one key, so the match is an equality
    join whatever the number of roots. Paths with a `..` step, and paths below
    no root, get NULLs.
    """
    parts = F.split(F.col(path), "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                          lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = paths.select(path).distinct().withColumn("prefix", F.explode(parents))
    best = keyed.join(roots.select("prefix", "root"), "prefix").groupBy(path).agg(
        F.max_by(F.struct("prefix", "root"), F.length("prefix")).alias("_b"))
    relative = F.expr(f"substring({path}, length(_b.prefix) + 2)")
    safe = ~F.array_contains(F.split(relative, "/"), "..")
    return paths.join(best, path, "left").select(
        *paths.columns, F.when(safe, F.col("_b.root")).alias("root"), F.when(safe, relative).alias("relative"))


def keep_first(df: DataFrame, keys: list[str], order: str = "ingest_seq") -> DataFrame:
    """The earliest row per key, by a unique order.

    `min_by` aggregates map-side, so copies never gather in one task; one
    aggregate per column lets unread columns be pruned.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank_in_group") -> DataFrame:
    """First k rows per group. The rank limit is also applied before the shuffle (window group limit)."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def running_number(df: DataFrame, order: str, out: str = "position", width: int = 1 << 20) -> DataFrame:
    """1-based position of each row by the unique numeric column `order`.

    Positions inside a bucket come from a window; each bucket starts at the
    prefix sum of bucket counts, a table of (value range / width) rows.
    """
    b = df.withColumn("_bucket", bucket_of(F.col(order), width))
    counts = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    inside = b.withColumn("_rn", F.row_number().over(W.partitionBy("_bucket").orderBy(order)))
    return inside.join(starts, "_bucket").withColumn(out, (F.col("_start") + F.col("_rn")).cast("bigint")).drop(
        "_bucket", "_start", "_rn")


def gap_clusters(df: DataFrame, keys: list[str], position: str, max_gap: int, out: str = "cluster",
                 width: int = 1 << 16) -> DataFrame:
    """Number clusters per key from 0: a new one starts where the gap to the previous position exceeds max_gap.

    Clusters depend only on the distinct positions of a key. Those are bucketed;
    each bucket reports its ends and inner breaks, and a prefix sum over buckets
    gives the number every bucket starts from.
    """
    pos = df.select(*keys, F.col(position).alias("_p")).distinct().withColumn("_bucket", bucket_of(F.col("_p"), width))
    inner = W.partitionBy(*keys, "_bucket").orderBy("_p")
    broken = pos.withColumn("_brk", F.coalesce((F.col("_p") - F.lag("_p").over(inner) > max_gap).cast("bigint"), F.lit(0)))
    local = broken.withColumn("_run", F.sum("_brk").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "_bucket").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.sum("_brk").alias("_n"))
    across = W.partitionBy(*keys).orderBy("_bucket")
    edge = F.coalesce((F.col("_lo") - F.lag("_hi").over(across) > max_gap).cast("bigint"), F.lit(0))
    starts = ends.withColumn("_edge", edge).select(
        *keys, "_bucket", (F.sum(F.col("_edge") + F.col("_n")).over(across.rowsBetween(W.unboundedPreceding, 0))
                           - F.col("_n")).alias("_start"))
    numbered = local.join(starts, [*keys, "_bucket"]).select(
        *keys, F.col("_p").alias(position), (F.col("_start") + F.col("_run")).alias(out))
    return df.join(numbered, [*keys, position])

"""Building blocks that keep one hot group from landing in one task.

A window over a whole group sorts that group in a single task. Here ordered work is cut into
buckets that follow the order: rows are worked on inside (group, bucket), and only one row per
bucket is combined over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.session import scratch_path, shared_dir


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as a table below the shared folder and read from there. Unlike a checkpoint it is computed once, and
    its bytes are known when a join is planned, so a small one is broadcast and the large side stays where it is."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the keys of the left side are kept."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    same = None
    for k, r in names.items():
        one = left[k].eqNullSafe(other[r])
        same = one if same is None else same & one
    return left.join(other, same, how).drop(*names.values())


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a table of one row per key to a large one; NULL keys are keys. Adaptive execution measures the small
    side's bytes and broadcasts it below spark.sql.autoBroadcastJoinThreshold; beyond, a key with very many rows
    is split by the skew join."""
    return join_same(big, small, keys, how)


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, value: Column,
                  out: str) -> DataFrame:
    """Inclusive running sum of value over (keys, order). bucket must not decrease along the order
    and must be a function of it. NULL keys form a group of their own; rows without an order value come first, in a
    bucket of their own."""
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_value").over(inside))
    return (
        join_same(local, offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_value", "_local", "_offset")
    )


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, out: str) -> DataFrame:
    """1-based position inside keys along a unique order."""
    return running_total(df, keys, bucket, order, F.lit(1).cast("long"), out)


def with_halo(df: DataFrame, keys: Sequence[str], position: str, size: int = 4096) -> DataFrame:
    """Cut groups with consecutive positions into chunks and lend each chunk the row before and
    after it. Afterwards a lag/lead over (keys, _chunk) is right for every row with _own; a missing
    neighbour means a true end of the group."""
    chunk = F.floor(F.col(position) / size)
    left_edge = F.pmod(F.col(position), F.lit(size)) == 0
    right_edge = F.pmod(F.col(position), F.lit(size)) == size - 1
    homes = F.filter(
        F.array(chunk, F.when(left_edge & (chunk > 0), chunk - 1), F.when(right_edge, chunk + 1)),
        lambda c: c.isNotNull(),
    )
    return (
        df.withColumn("_chunk", F.explode(homes))
        .withColumn("_own", F.col("_chunk") == F.floor(F.col(position) / size))
    )


#: values of an interval that is looked into whole
LEAF = 1 << 16
#: edges of a histogram, one less than a power of two
EDGES = 255
#: of the sketch that the edges come from: ranks are right to one in so many
ACCURACY = 10000


def _placed(rows: DataFrame, edges: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Adds _bin: 2 p for values between edge p - 1 and edge p, 2 p + 1 for those equal to edge p. The place is
    found by halving, one step a projection, in generated code."""
    out = join_small(rows, edges, keys).withColumn("_p", F.lit(0))
    step = (parts + 1) // 2
    while step:
        out = out.withColumn("_p", F.col("_p") + F.when(F.get("_edges", F.col("_p") + (step - 1)) < F.col("_v"), step).otherwise(0))
        step //= 2
    on = F.coalesce(F.get("_edges", "_p") == F.col("_v"), F.lit(False))
    return out.withColumn("_bin", 2 * F.col("_p") + on.cast("int")).drop("_p", "_edges")


def _leaves(rows: DataFrame, keys: Sequence[str], ranks: Column | None, leaf: int, parts: int) -> DataFrame:
    """Cuts every group into intervals of at most leaf rows, or of equal values, in the order of _v.

    rows: keys, _v (those without are left out), _n (copies a row stands for). They are computed once and stored. In every
    round the intervals that are still too large get a histogram: edges from a sketch of their rows, exact counts between the
    edges, values equal to an edge in bins of their own. So the rows of an interval shrink about by the number of edges,
    whatever the distribution, and a group of any size ends after a few rounds. A bin's place follows from the bins before it
    in its own interval, never from the whole group.

    With ranks (an array of 0-based ranks, from the number of _copies of a group) only intervals that hold one of them are
    kept; _ranks and the group's _total come with their rows. Returns keys, _id (an interval's number), _before (copies before
    the interval), _v, _n.
    """
    keys, ids = list(keys), [*keys, "_id"]
    # an interval's number begins with that of the interval it was cut from, so it stays unique over all rounds
    # the source is read once: a round passes its rows four times, and the source may cost far more than its three columns.
    # rows without a value go afterwards, as a filter before would be pushed into the source and repeat the formula of _v there
    rows = stored(rows.select(*keys, "_v", "_n", F.lit(1).cast("long").alias("_id"))).filter("_v IS NOT NULL")
    every = [F.count("*").alias("_rows"), F.sum("_n").alias("_copies"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    intervals = rows.groupBy(*ids).agg(*every).withColumns({
        "_before": F.lit(0).cast("long"), **({} if ranks is None else {"_ranks": ranks, "_total": F.col("_copies")})})
    intervals = stored(intervals)
    told = ["_before"] if ranks is None else ["_before", "_ranks", "_total"]
    done: DataFrame | None = None
    while True:
        small = (F.col("_rows") <= leaf) | (F.col("_lo") == F.col("_hi"))
        has_small, has_open = intervals.agg(F.bool_or(small), F.bool_or(~small)).first()
        if has_small or done is None and not has_open:
            ended = join_small(rows, intervals.filter(small).select(*ids, *told), ids).select(*ids, *told, "_v", "_n")
            done = ended if done is None else done.unionAll(ended)
        if not has_open:
            return done
        open_ = intervals.filter(~small).select(*ids, *told)
        rows = join_small(rows, open_.select(*ids), ids)
        edges = stored(rows.groupBy(*ids).agg(F.percentile_approx(
            "_v", [(i + 1) / (parts + 1) for i in range(parts)], ACCURACY).alias("_edges")))
        placed = _placed(rows, edges, ids, parts)
        # a window over the bins of one interval, at most 2 parts + 1
        upto = Window.partitionBy(*ids).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = placed.groupBy(*ids, "_bin").agg(*every).withColumn("_below", F.coalesce(F.sum("_copies").over(upto), F.lit(0)))
        bins = join_small(bins, open_, ids).withColumn("_before", F.col("_before") + F.col("_below")).drop("_below")
        number = F.col("_id") * (2 * parts + 2) + F.col("_bin")
        if ranks is not None:
            bins = bins.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (
                r < F.col("_before") + F.col("_copies")))).filter(F.size("_ranks") > 0)
        intervals = stored(bins.withColumn("_id", number).drop("_bin"))
        rows = stored(join_small(placed.withColumn("_id", number).drop("_bin"), intervals.select(*ids), ids))


def _running(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds _upto, the copies up to a value in its group; the window meets one leaf."""
    inside = Window.partitionBy(*keys, "_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return leaves.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))


def average_ranks(df: DataFrame, keys: Sequence[str], col: str, copies: str, out: str, leaf: int = LEAF,
                  parts: int = EDGES) -> DataFrame:
    """Distinct values of col with their average 1-based rank inside keys, where each row of df stands
    for a number of equal rows given by the column copies. At least one key."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(col).alias("_v")).agg(F.sum(copies).cast("long").alias("_n"))
    ranked = _running(_leaves(counts, keys, None, leaf, parts), keys)
    return ranked.select(*keys, F.col("_v").alias(col), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float], leaf: int = LEAF,
                    parts: int = EDGES) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per name in probs. Groups of all sizes go the same
    way: the intervals that hold a wanted rank are narrowed until they have at most leaf rows."""
    group = list(keys) or ["_all"]
    x = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(col).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n"))

    def place(total: str) -> dict[str, Column]:
        return {name: F.lit(p) * (F.col(total) - 1) for name, p in probs.items()}

    wanted = F.array_distinct(F.concat(*[F.array(F.floor(h), F.ceil(h)) for h in place("_copies").values()]))
    leaves = _leaves(x, group, wanted, leaf, parts)
    # equal values of a leaf are one row; a leaf of one value alone may hold any number of them
    held = leaves.groupBy(*group, "_id", "_before", "_v").agg(
        F.sum("_n").alias("_n"), F.first("_ranks").alias("_ranks"), F.first("_total").alias("_total"))
    found = _running(held, group).select(*group, "_total", "_v", F.explode(F.filter("_ranks", lambda r: (
        r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))).alias("_rank"))
    # at most two ranks a quantile
    values = found.groupBy(*group).agg(
        F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def quantile(h: Column) -> Column:
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        return low + (h - F.floor(h)) * (high - low)

    return values.select(*keys, *[quantile(h).alias(name) for name, h in place("_total").items()])


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                  right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of equal keys whose closed integer spans touch. Both sides are laid over cells of the
    given width, so the join is an equi-join on (keys, cell); a pair is kept in the first cell it
    shares, once. Columns besides the keys must have different names on both sides."""
    def cells(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(
            F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width))))

    a, b = cells(left, left_span), cells(right, right_span)
    first = F.greatest(F.floor(F.col(left_span[0]) / width), F.floor(F.col(right_span[0]) / width))
    touch = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0]))
    return a.join(b, [*keys, "_cell"]).filter(touch & (F.col("_cell") == first)).drop("_cell")


def previous_value(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str,
                   out: str) -> DataFrame:
    """value of the row before, along a unique order inside keys; NULL for the first row. bucket must
    not decrease along the order. Inside a bucket this is a lag; the first row of a bucket takes the
    last row of the bucket before. NULL keys form a group; rows without an order value come first."""
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    tails = (
        cut.groupBy(*keys, "_bucket").agg(F.max(F.struct(*order, F.col(value).alias("_last"))).alias("_t"))
        .select(*keys, "_bucket", F.lag("_t._last").over(across).alias("_carry"))
    )
    return (
        join_same(cut.withColumns({"_lag": F.lag(value).over(inside), "_rn": F.row_number().over(inside)}),
                  tails, [*keys, "_bucket"])
        .withColumn(out, F.when(F.col("_rn") > 1, F.col("_lag")).otherwise(F.col("_carry")))
        .drop("_bucket", "_lag", "_rn", "_carry")
    )

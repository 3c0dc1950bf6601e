"""Global order without one big task: row positions, top groups, promoted records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def number_rows(rows: DataFrame, order, name="position", partitions=None) -> DataFrame:
    """1-based position of every row in a total order.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and only the
    per-partition counts (one row each) are added up. `order` must end in a unique column, so
    that a crowded sort value still splits over partitions. The sorted rows are written once,
    so counts and numbers come from the same partitioning.
    """
    if partitions is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = settle(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    block = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = numbered.groupBy(block.alias("_block")).agg(F.count("*").alias("n"))
    # One row per partition: this window is bounded by the number of partitions.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_block", block)
        .join(starts, "_block")
        .withColumn(name, F.col("_start") + local + 1)
        .drop("_at", "_block", "_start")
    )


def locale_key(column):
    """Order as a reader expects it, not byte by byte."""
    return F.collate(column, "UNICODE")


def catalog_order(sort: str):
    """Sort columns of catalog entries: by label, or by holes with unknown last."""
    if sort == "name":
        return [locale_key(F.col("label")), locale_key(F.col("record_id")), F.col("record_id")]
    if sort == "holes":
        return [F.col("physical_holes").asc_nulls_last(), locale_key(F.col("label")), F.col("record_id")]
    raise ValueError("unknown sort: " + sort)


def sort_struct(sort: str):
    """The same order as one comparable value."""
    label = locale_key(F.col("label")).alias("label")
    if sort == "name":
        return F.struct(label, "record_id")
    return F.struct(F.col("physical_holes").isNull().alias("unknown"), "physical_holes", label, "record_id")


def browse_window(
    entries: DataFrame, matches, sort="name", limit=60, active_course=None, active_facility=None, focused_group=None
):
    """The first `limit` groups of matching entries, siblings kept together.

    The selected course's group comes first, then the selected facility's; with no facility
    selected, courses without a facility come next. A focused group is shown even past the
    limit, after all others. Returns (rows with their group rank, one row saying whether there is more).

    Only one row per group is ranked, and only the top `limit` of those are kept.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    kept = entries.where(matches)
    first = sort_struct(sort)
    active = F.coalesce(F.col("course_id") == active_course, F.lit(False)) if active_course else F.lit(False)
    groups = kept.groupBy("group_id").agg(
        F.min(first).alias("first"), F.max(F.col("facility_id").isNull()).alias("orphan"), F.max(active).alias("active")
    )
    promotion = F.when(F.col("active"), 0)
    if active_facility is not None:
        promotion = promotion.when(F.col("group_id") == active_facility, 1).otherwise(3)
    else:
        promotion = promotion.when(F.col("orphan"), 2).otherwise(3)
    # Two more than shown: one of them may be the focused group.
    top = groups.orderBy(promotion, "first").limit(limit + 2).select("group_id", promotion.alias("promotion"), "first")
    ranked = top.withColumn("group_rank", F.row_number().over(Window.orderBy("promotion", "first"))).select(
        "group_id", "group_rank"
    )
    shown = ranked.where(F.col("group_rank") <= limit)
    more = ranked.where(F.col("group_rank") > limit)
    if focused_group is not None:
        more = more.where(F.col("group_id") != focused_group)
        focus = entries.sparkSession.createDataFrame([(focused_group, limit + 1)], "group_id string, group_rank int")
        shown = shown.unionByName(focus).groupBy("group_id").agg(F.min("group_rank").alias("group_rank"))
    rows = kept.join(shown, "group_id").withColumn("selected", active)
    order = [F.col("group_rank"), F.col("selected").desc(), *catalog_order(sort)]
    return rows.orderBy(*order), more.agg((F.count("*") > 0).alias("more"))


def selected_first(rows: DataFrame, course_id: str, facility_id: str, order) -> DataFrame:
    """The selected course, then its facility's courses, then the others, each in `order`."""
    rank = (
        F.when(F.col("course_id") == course_id, 0).when(F.col("facility_id") == facility_id, 1).otherwise(2)
    )
    return number_rows(rows.withColumn("rank", rank), [F.col("rank"), *order])


def last_card(cards: DataFrame, ordinal: str, fields) -> DataFrame:
    """Per facility the last card in order; combined before the shuffle."""
    return (
        cards.where(F.col("facility_id").isNotNull())
        .groupBy("facility_id")
        .agg(F.max_by(F.struct(*fields), ordinal).alias("card"))
        .select("facility_id", "card.*")
    )


def travel_metrics(times: DataFrame) -> DataFrame:
    """Longest and summed time per course; unknown as soon as one origin's time is."""
    known = F.count("seconds") == F.count("*")
    return times.groupBy("course_id").agg(
        F.when(known, F.max("seconds")).alias("maximum"), F.when(known, F.sum("seconds")).alias("combined")
    )


def planning_rank(cards: DataFrame, metric: str) -> DataFrame:
    """Order by a metric with unknown last; a rank only where the metric is known."""
    order = [F.col(metric).asc_nulls_last(), locale_key(F.col("label")), F.col("course_id")]
    numbered = number_rows(cards, order)
    return numbered.withColumn("rank", F.when(F.col(metric).isNotNull(), F.col("position")))

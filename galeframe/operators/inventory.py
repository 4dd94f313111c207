"""Validation of file inventories: coverage, required children, completeness of a folder tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions.text import issue_kind
from galeframe.operators.scale import join_same, join_small, previous_value


def missing_years(files: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Expected years without a covering file. files: keys, start_year, end_year; expected: keys, first_year,
    last_year."""
    keys = list(keys)
    wanted = expected.select(*keys, F.explode(F.sequence("first_year", "last_year")).alias("missing_year"))
    covered = files.filter("start_year IS NOT NULL").select(
        *keys, F.explode(F.sequence("start_year", "end_year")).alias("missing_year")).distinct()
    return wanted.join(covered, [*keys, "missing_year"], "left_anti")


def pending_files(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Yearly outputs a task still lacks; a task with all of them has no row."""
    keys = list(keys)
    wanted = expected.select(*keys, F.explode(F.sequence("first_year", "last_year")).alias("year"))
    return wanted.join(present.select(*keys, "year"), [*keys, "year"], "left_anti")


def _year(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4).cast("int")


def _as_date(c: Column, kind: Column) -> Column:
    text = c.cast("string")
    return F.try_to_timestamp(F.when(kind == "month", F.concat(text, F.lit("01"))).otherwise(text), F.lit("yyyyMMdd")).cast("date")


def coverage(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do the ranges of each key cover what is expected, without gaps?

    ranges: keys, kind (month, day or year), start_int, end_int, expected_start, expected_end. The end
    compared is that of the range starting last. Months and days tolerate a start up to 2020 where 2015
    is expected and an end from 2095 where 2100 is; the end is not looked at once the start has failed,
    gaps not once either has.
    """
    keys = list(keys)
    c = F.col
    steps = previous_value(
        ranges, keys, F.floor(c("start_int") / F.when(c("kind") == "day", 10000).otherwise(100)),
        ["start_int", "end_int"], "end_int", "_before")
    is_year = c("kind") == "year"
    before, start = _as_date(c("_before"), c("kind")), _as_date(c("start_int"), c("kind"))
    steps = steps.withColumns({"_b": before, "_s": start}).withColumn(
        "_next", F.when(c("kind") == "month", F.add_months("_b", 1)).otherwise(F.date_add("_b", 1)))
    fits = F.when(is_year, F.floor(c("_before") / 100) + 1 == F.floor(c("start_int") / 100)).otherwise(c("_next") == c("_s"))
    gap_text = F.when(is_year, F.concat(
        F.lit("Gap between period ending "), F.floor(c("_before") / 100).cast("string"),
        F.lit(" and period starting "), F.floor(c("start_int") / 100).cast("string"))
    ).otherwise(F.concat(F.lit("Gap between "), c("_before").cast("string"), F.lit(" and "), c("start_int").cast("string")))
    steps = steps.withColumn("_hole", c("_before").isNotNull() & ~fits).drop("_b", "_s", "_next")
    gap = F.when(c("_hole"), F.struct(c("start_int").alias("at"), c("end_int").alias("to"), gap_text.alias("text")))
    g = steps.withColumn("_gap", gap).groupBy(*keys, "kind", "expected_start", "expected_end").agg(
        F.count("*").alias("n_ranges"), F.min("start_int").alias("actual_start"),
        F.max_by("end_int", F.struct("start_int", "end_int")).alias("actual_end"), F.min("_gap").alias("_first_gap"))
    g = g.withColumns({
        "_late": c("actual_start") > c("expected_start"), "_early": c("actual_end") < c("expected_end"),
        "_late_ok": ~is_year & (_year(c("expected_start")) == 2015) & (_year(c("actual_start")) <= 2020),
        "_early_ok": ~is_year & (_year(c("expected_end")) == 2100) & (_year(c("actual_end")) >= 2095),
    }).withColumns({"_start_ok": ~c("_late") | c("_late_ok"), "_end_ok": ~c("_early") | c("_early_ok")})
    scale = F.when(is_year, 100).otherwise(1)

    def text(event: str, actual: str, wanted: str, expected: str, mild: str) -> Column:
        return F.concat(
            F.lit(f"Coverage {event} "), F.when(c(mild), "a little").otherwise("too"), F.lit(f" {actual}: "),
            F.floor(c(f"actual_{expected}") / scale).cast("string"), F.lit(f", expected {wanted}: "),
            F.floor(c(f"expected_{expected}") / scale).cast("string"))

    return g.withColumns({
        "start_issue": F.when(c("_late"), text("starts", "late", "by", "start", "_late_ok")),
        "end_issue": F.when(c("_early") & (c("_start_ok") | is_year), text("ends", "early", "until", "end", "_early_ok")),
        "gap_issue": F.when(c("_start_ok") & c("_end_ok"), c("_first_gap.text")),
        "complete": c("_start_ok") & c("_end_ok") & c("_first_gap").isNull(),
    }).drop("_late", "_early", "_late_ok", "_early_ok", "_start_ok", "_end_ok", "_first_gap")


def fill_flags(files: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first file is flagged where the start is a little late, else the last one where the end is a
    little early. files: keys, start_int, end_int; covered: output of coverage."""
    keys = list(keys)
    span = F.struct("start_int", "end_int")
    edges = files.groupBy(*keys).agg(F.min(span).alias("_first"), F.max(span).alias("_last"))
    late = F.coalesce(F.col("start_issue").contains("a little late"), F.lit(False))
    early = F.coalesce(F.col("end_issue").contains("a little early"), F.lit(False))
    notes = covered.select(*keys, late.alias("_late"), early.alias("_early"))
    is_first, is_last = span == F.col("_first"), span == F.col("_last")
    first_flag = is_first & F.col("_late")
    return join_small(files, edges.join(notes, keys), keys).withColumn(
        "fill_required", first_flag | (~first_flag & is_last & F.col("_early"))).drop("_first", "_last", "_late", "_early")


def priority_pick(df: DataFrame, keys: Sequence[str], grid: str = "grid") -> DataFrame:
    """One grid per key by the fixed order; the others are listed as skipped. Keys with no known grid keep
    all of theirs."""
    keys = list(keys)
    rank = F.array_position(F.array(*[F.lit(g) for g in K.GRID_PRIORITY]), F.col(grid))
    best = df.groupBy(*keys).agg(F.min(F.when(rank > 0, rank)).alias("_best"))
    out = df.join(best, keys)
    chosen = F.col("_best").isNull() | (rank == F.col("_best"))
    picked = F.element_at(F.array(*[F.lit(g) for g in K.GRID_PRIORITY]), F.col("_best").cast("int"))
    return out.withColumns({
        "selected": F.coalesce(chosen, F.lit(False)),
        "note": F.when(~chosen, F.concat(F.lit("Grid Priority: Validation skipped; lower priority than selected grid '"), picked, F.lit("'"))),
    }).drop("_best")


def grid_kind(meta: DataFrame, dims: str = "dims", coord_rank: str = "coord_rank") -> DataFrame:
    """regular, curvilinear (2-D coordinates over i/j) or forbidden (a mesh dimension)."""
    mesh = F.arrays_overlap(F.col(dims), F.array(*[F.lit(d) for d in K.FORBIDDEN_DIMS]))
    return meta.withColumn(
        "grid_kind", F.when(mesh, "forbidden").when(F.col(coord_rank) == 2, "curvilinear").otherwise("regular"))


def check_children(children: DataFrame, parent: Sequence[str], child: str, required: Sequence[str] = (),
                   exact_count: int | None = None, at_least_one: Sequence[str] = (),
                   expected: DataFrame | None = None) -> DataFrame:
    """Rule breaks of each parent, one row per issue. The names under a parent fold into one set. expected names
    the parents that should be there, so that one without children breaks its rules too."""
    parent = list(parent)
    have = children.groupBy(*parent).agg(F.array_sort(F.collect_set(child)).alias("_have"))
    if expected is not None:
        every = children.select(*parent).unionByName(expected.select(*parent)).distinct()
        have = join_same(every, have, parent, "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    issues = []

    def listed(a: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))

    if required:
        lacking = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("_have"))
        issues.append(F.when(F.size(lacking) > 0, F.concat(F.lit("Missing required folders: "), listed(lacking))))
    if at_least_one:
        options = F.array(*[F.lit(o) for o in at_least_one])
        issues.append(F.when(~F.arrays_overlap("_have", options), F.concat(
            F.lit("Must have at least one of: "), listed(options), F.lit(", found: "), listed(F.col("_have")))))
    if exact_count is not None:
        issues.append(F.when(F.size("_have") != exact_count, F.concat(
            F.lit(f"Expected {exact_count} folder(s), found "), F.size("_have").cast("string"), F.lit(": "), listed(F.col("_have")))))
    return have.select(*parent, F.explode(F.array(*issues)).alias("issue")).filter("issue IS NOT NULL")


def completeness(leaves: DataFrame, levels: Sequence[str], own_issues: DataFrame | None = None) -> DataFrame:
    """Status of every node of the tree. leaves: the levels, complete, issue. own_issues: path (array of
    level values) and issue of inner nodes. A node is complete when it has no issue of its own and all
    below it are complete.

    Each leaf goes to its ancestors inside one aggregation; only booleans and counts travel, the issue
    texts stay in their own table.
    """
    base = leaves.select(F.array(*[F.col(c) for c in levels]).alias("_path"), F.col("complete").alias("_ok"),
                         F.col("issue").isNotNull().cast("int").alias("_i"))
    if own_issues is not None:
        base = base.unionByName(own_issues.select(F.col("path").alias("_path"), F.lit(False).alias("_ok"), F.lit(1).alias("_i")))
    up = base.select(F.explode(F.sequence(F.lit(1), F.size("_path"))).alias("_d"), "_path", "_ok", "_i")
    own = F.col("_d") == F.size("_path")
    nodes = up.groupBy(F.slice("_path", F.lit(1), F.col("_d")).alias("path")).agg(
        F.bool_and("_ok").alias("complete"), F.sum("_i").alias("n_issues"),
        F.sum(F.when(own, F.col("_i")).otherwise(0)).alias("own_issues"), F.count_if(~F.col("_ok")).alias("_bad"),
        F.count_if(F.col("_ok")).alias("_good"))
    level = F.element_at(F.array(*[F.lit(c) for c in levels]), F.size("path"))
    return nodes.withColumn("level", level).withColumn(
        "name", F.element_at("path", -1)).select("level", "path", "name", "complete", "n_issues", "own_issues", "_bad", "_good")


def incomplete_only(nodes: DataFrame) -> DataFrame:
    """Nodes below which nothing is complete; is_top marks the highest node of each such branch."""
    none_ok = nodes.filter("_good = 0 AND NOT complete")
    parent = none_ok.select(F.col("path").alias("_parent"))
    above = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    tops = none_ok.withColumn("_parent", above).join(parent, "_parent", "left_anti").select("path", F.lit(True).alias("is_top"))
    return none_ok.join(tops, "path", "left").withColumn("is_top", F.coalesce("is_top", F.lit(False))).select(
        "level", "path", "is_top")


def select_complete(nodes: DataFrame, level: str, complete_only: bool = True) -> DataFrame:
    out = nodes.filter(F.col("level") == level)
    return (out.filter("complete") if complete_only else out).select(F.concat_ws("/", "path").alias("name")).distinct()


def first_failure(nodes: DataFrame, issues: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Per incomplete model, its first failing node in depth-first order with an issue. issues: path, issue.
    A parent sorts before its children and siblings by name, which is the order of the paths."""
    top = nodes.filter((F.size("path") == 1) & ~F.col("complete")).select(F.col("path")[0].alias(levels[0]))
    spot = issues.groupBy(F.col("path")[0].alias(levels[0])).agg(F.min(F.struct("path", "issue")).alias("_f"))
    steps = F.transform(
        F.col("_f.path"), lambda v, i: F.concat(F.element_at(F.array(*[F.lit(c) for c in levels]), i + 1), F.lit("="), v))
    return top.join(spot, levels[0], "left").select(
        levels[0],
        F.coalesce(F.array_join(steps, " -> "), F.lit("failed at the root, no issue found below")).alias("failed_at"),
        F.col("_f.issue").alias("issue"))


def triage(status: DataFrame) -> DataFrame:
    """Variants by what is wrong: complete, only the global folder, short of files. status: model, variant,
    time_period, basin, complete, found. Per period the first short basin speaks; one row per message."""
    keys = ["model", "variant"]
    other = F.col("basin") != K.GLOBAL_BASIN
    per_period = status.groupBy(*keys, "time_period").agg(
        F.bool_and("complete").alias("_ok"), F.count_if(other).alias("_others"),
        F.min(F.when(other & ~F.col("complete"), F.struct("basin", "found"))).alias("_short"))
    message = F.format_string(
        "Basin='%s' in %s: Expected at least %d draw files, found %d.",
        F.col("_short.basin"), F.col("time_period"), F.lit(K.NUM_DRAWS), F.col("_short.found"))
    whole = per_period.groupBy(*keys).agg(F.bool_and("_ok").alias("_ok"), F.sum("_others").alias("_others"))
    done = whole.filter("_ok").select(*keys, F.lit("complete").alias("status"), F.lit(None).cast("string").alias("message"))
    bare = whole.filter("NOT _ok AND _others = 0").select(*keys, F.lit("only_global").alias("status"), F.lit(None).cast("string").alias("message"))
    short = per_period.filter("_short IS NOT NULL").select(*keys, F.lit("short_of_files").alias("status"), message.alias("message"))
    return done.unionByName(bare).unionByName(short)


def files_by_status(files: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Total, complete and to-be-filled files, overall and by each dimension. One in-row explode feeds one
    map-side combined aggregation."""
    rows = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    return files.select("fill_required", F.inline(rows)).groupBy("dimension", "value").agg(
        F.count("*").alias("total"), F.count_if(~F.col("fill_required")).alias("complete"),
        F.count_if("fill_required").alias("fill_required"))


def model_summary(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per level (all and complete nodes, distinct names) and issues by kind, as long rows."""
    levels = nodes.groupBy("level").agg(
        F.count("*").alias("total"), F.count_if("complete").alias("complete"), F.count_distinct("name").alias("names"))
    rows = levels.select(F.inline(F.array(*[
        F.struct(F.concat(F.col("level"), F.lit(f".{m}")).alias("item"), F.col(m).alias("n")) for m in ("total", "complete", "names")])))
    kinds = issues.groupBy(issue_kind(F.col("issue")).alias("_k")).agg(F.count("*").alias("n"))
    return rows.unionByName(kinds.select(F.concat(F.lit("issue."), "_k").alias("item"), "n"))


def flatten_tree(nested: DataFrame, levels: Sequence[str], root: str) -> DataFrame:
    """Nested maps (one per level, then an array of files) -> one row per file with its parents."""
    out, current = nested, F.col(root)
    kept: list[str] = []
    for level in levels:
        out = out.select(*kept, F.explode(current).alias(level, "_next"))
        kept, current = [*kept, level], F.col("_next")
    return out.select(*kept, F.explode("_next").alias("file"))


def nest_rows(flat: DataFrame, levels: Sequence[str], leaf: str, out: str = "tree") -> DataFrame:
    """Flat rows -> one nested map per value of the first level; the last level maps to leaf. Meant for the
    edge, below folders whose names come from the rule tables (scenarios, variables, grids): the map of one
    root is then bounded by those tables. File lists stay flat."""
    current, value = flat, leaf
    for depth in range(len(levels) - 1, 0, -1):
        entry = F.struct(levels[depth], value)
        current = current.groupBy(*levels[:depth]).agg(F.map_from_entries(F.collect_list(entry)).alias("_tree"))
        value = "_tree"
    return current.withColumnRenamed("_tree", out)


def edge_fill(yearly: DataFrame, keys: Sequence[str], first: int = 2015, last: int = 2100) -> DataFrame:
    """Copies the first year back to 2015 where data begins by 2020, and the last year on to 2100 where it
    ends from 2095; values unchanged. The copies are made in the row, from per-key bounds."""
    keys = list(keys)
    bounds = yearly.groupBy(*keys).agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"))
    y, y0, y1 = F.col("year"), F.col("_y0"), F.col("_y1")
    back = F.when((y == y0) & (y0 > first) & (y0 <= 2020), F.sequence(F.lit(first), y0 - 1))
    ahead = F.when((y == y1) & (y1 < last) & (y1 >= 2095), F.sequence(y1 + 1, F.lit(last)))
    none = F.array().cast("array<int>")
    years = F.concat(F.array(y), F.coalesce(back, none), F.coalesce(ahead, none))
    rows = join_small(yearly, bounds, keys).withColumn("_year", F.explode(years))
    return rows.withColumn("filled", F.col("_year") != y).withColumn("year", F.col("_year")).drop("_year", "_y0", "_y1")

"""Queries: file inventory and folder tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import text
from galeframe.operators import inventory as I
from galeframe.operators import reshape as R_
from galeframe.operators.scale import saved
from galeframe.plans import views as V
from galeframe.plans.registry import ora, query
from galeframe.sources import manifest as M

_MAN = """man AS (SELECT *, regexp_matches(file_name, '^[A-Za-z0-9]+_[A-Za-z0-9]+_[^_]+_[^_]+_[^_]+_[^_]+_(\\d{6}|\\d{8})-(\\d{6}|\\d{8})\\.nc$') AS ok,
  TRY_CAST(regexp_extract(file_name, '_(\\d+)-(\\d+)\\.nc$', 1) AS INT) AS start_int, TRY_CAST(regexp_extract(file_name, '_(\\d+)-(\\d+)\\.nc$', 2) AS INT) AS end_int FROM fx_files)"""


def manifest(spark, sf_dir):
    """The inventory as a stored table: several operators read it more than once."""
    return saved(M.scan_manifest(V.files(spark, sf_dir), "file_name"))


@query("s1_scan_manifest", ora("fx_files", """
SELECT file_name, CASE WHEN ok THEN variable END AS file_variable, CASE WHEN ok THEN freq END AS file_frequency, CASE WHEN ok THEN model END AS file_model,
  CASE WHEN ok THEN 'gn' END AS file_grid, start_int, end_int,
  CASE WHEN ok THEN CONCAT(y0, '-01-01') END AS start_date, CASE WHEN ok THEN CONCAT(y1, CASE WHEN freq = 'day' THEN '-12-31' ELSE '-12-01' END) END AS end_date,
  CASE WHEN NOT ok THEN CONCAT('File ''', file_name, ''' doesn''t match naming convention') END AS issue FROM man""", _MAN))
def _(spark, sf_dir):
    return M.scan_manifest(V.files(spark, sf_dir), "file_name").select(
        "file_name", "file_variable", "file_frequency", "file_model", "file_grid", "start_int", "end_int",
        F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "issue")


@query("f12_frequency_match", ora("fx_tree", """
SELECT DISTINCT variable, frequency, LOWER(frequency) LIKE '%mon%' AS monthly, CASE variable WHEN 'ua' THEN LOWER(frequency) LIKE '%day%' ELSE LOWER(frequency) LIKE '%mon%' END AS ok FROM fx_tree"""))
def _(spark, sf_dir):
    c = F.col
    return V.tree(spark, sf_dir).select("variable", "frequency").distinct().select(
        "variable", "frequency", text.is_monthly(c("frequency")).alias("monthly"), text.frequency_match(c("variable"), c("frequency")).alias("ok"))


_KEYS = ["model", "variable"]


@query("j4_missing_years", ora("fx_files", """
SELECT model, variable, CAST(y AS INT) AS missing_year FROM (SELECT DISTINCT model, variable FROM fx_files) k CROSS JOIN range(2015, 2101) AS r(y)
WHERE NOT EXISTS (SELECT 1 FROM fx_files f WHERE f.model = k.model AND f.variable = k.variable AND f.file_name NOT LIKE 'bad%' AND r.y BETWEEN f.y0 AND f.y1)"""))
def _(spark, sf_dir):
    man = manifest(spark, sf_dir).withColumns({"start_year": F.year("start_date"), "end_year": F.year("end_date")})
    expected = man.select(*_KEYS).distinct().withColumns({"first_year": F.lit(K.START_YEAR["ssp585"]), "last_year": F.lit(K.END_YEAR["ssp585"])})
    return I.missing_years(man, _KEYS, expected)


_RANGES = _MAN + """,
rg AS (SELECT *, LAG(end_int) OVER (PARTITION BY model, variable ORDER BY start_int, end_int) AS before,
    CASE WHEN freq = 'day' THEN 20150101 ELSE 201501 END AS es, CASE WHEN freq = 'day' THEN 21001231 ELSE 210012 END AS ee FROM man WHERE ok),
gp AS (SELECT *, CASE WHEN before IS NOT NULL AND (before // CASE WHEN freq = 'day' THEN 10000 ELSE 100 END) + 1 <> y0
     THEN CONCAT('Gap between ', before, ' and ', start_int) END AS gap FROM rg),
cv AS (SELECT model, variable, freq, es, ee, COUNT(*) AS n_ranges, MIN(start_int) AS a0, arg_max(end_int, start_int) AS a1, MIN(y0) AS b0, arg_max(y1, start_int) AS b1,
    arg_min(gap, start_int) FILTER (WHERE gap IS NOT NULL) AS first_gap FROM gp GROUP BY ALL),
cf AS (SELECT *, a0 <= es OR b0 <= 2020 AS s_ok, a1 >= ee OR b1 >= 2095 AS e_ok FROM cv),
cov AS (SELECT model, variable, n_ranges, CASE WHEN a0 > es THEN CONCAT('Coverage starts ', CASE WHEN s_ok THEN 'a little' ELSE 'too' END, ' late: ', a0, ', expected by: ', es) END AS start_issue,
  CASE WHEN s_ok AND a1 < ee THEN CONCAT('Coverage ends ', CASE WHEN e_ok THEN 'a little' ELSE 'too' END, ' early: ', a1, ', expected until: ', ee) END AS end_issue,
  CASE WHEN s_ok AND e_ok THEN first_gap END AS gap_issue, s_ok AND e_ok AND first_gap IS NULL AS complete FROM cf)"""


def _ranges(spark, sf_dir):
    day = F.col("freq") == "day"
    return manifest(spark, sf_dir).filter("issue IS NULL").select(
        *_KEYS, "file_name", F.when(day, "day").otherwise("month").alias("kind"), "start_int", "end_int",
        F.when(day, 20150101).otherwise(201501).alias("expected_start"), F.when(day, 21001231).otherwise(210012).alias("expected_end"))


@query("w4_coverage_gaps", ora("fx_files", "SELECT model, variable, n_ranges, start_issue, end_issue, gap_issue, complete FROM cov", _RANGES))
def _(spark, sf_dir):
    return I.coverage(_ranges(spark, sf_dir), _KEYS).select(*_KEYS, "n_ranges", "start_issue", "end_issue", "gap_issue", "complete")


@query("w4_period_coverage", ora("fx_bins", """
SELECT model, n_ranges, NULL::STRING AS start_issue, CASE WHEN e < 2100 THEN CONCAT('Coverage ends too early: ', e, ', expected until: 2100') END AS end_issue, e >= 2100 AS complete
FROM (SELECT model, COUNT(*) AS n_ranges, arg_max(end_year, start_year) AS e FROM fx_bins GROUP BY model)"""))
def _(spark, sf_dir):
    ranges = V.bins(spark, sf_dir).select(
        "model", F.lit("year").alias("kind"), (F.col("start_year") * 100).alias("start_int"), (F.col("end_year") * 100).alias("end_int"),
        F.lit(201500).alias("expected_start"), F.lit(210000).alias("expected_end"))
    return I.coverage(ranges, ["model"]).select("model", "n_ranges", "start_issue", "end_issue", "complete")


_FLAGS = _RANGES + """,
fl AS (SELECT f.model, f.variable, f.file_name, f.start_int, f.y0, f.y1, (f.start_int = MIN(f.start_int) OVER w AND COALESCE(c.start_issue LIKE '%a little late%', false)) AS a,
   (f.start_int = MAX(f.start_int) OVER w AND COALESCE(c.end_issue LIKE '%a little early%', false)) AS b
   FROM man f JOIN cov c ON c.model = f.model AND c.variable = f.variable WHERE f.ok WINDOW w AS (PARTITION BY f.model, f.variable))"""


def flagged(spark, sf_dir):
    rg = _ranges(spark, sf_dir)
    return I.fill_flags(rg.select(*_KEYS, "file_name", "start_int", "end_int"), I.coverage(rg, _KEYS), _KEYS)


@query("w5_edge_fill_flags", ora("fx_files", "SELECT model, variable, file_name, a OR b AS fill_required FROM fl", _FLAGS))
def _(spark, sf_dir):
    return flagged(spark, sf_dir).select("model", "variable", "file_name", "fill_required")


@query("a22_files_by_status", ora("fx_files", """
SELECT dimension, value, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT (a OR b)) AS complete, COUNT(*) FILTER (WHERE a OR b) AS fill_required FROM (
  SELECT 'all' AS dimension, 'all' AS value, a, b FROM fl UNION ALL SELECT 'model', model, a, b FROM fl UNION ALL SELECT 'variable', variable, a, b FROM fl) GROUP BY ALL""", _FLAGS))
def _(spark, sf_dir):
    return I.files_by_status(flagged(spark, sf_dir), _KEYS)


@query("w6_edge_year_fill", ora("fx_files", """
SELECT model, variable, CAST(y AS INT) AS year, file_name, false AS filled FROM yr
UNION ALL SELECT model, variable, CAST(UNNEST(range(2015, y0)) AS INT), file_name, true FROM (SELECT *, MIN(y) OVER (PARTITION BY model, variable) AS y0 FROM yr) WHERE y = y0 AND y0 <= 2020
UNION ALL SELECT model, variable, CAST(UNNEST(range(y1 + 1, 2101)) AS INT), file_name, true FROM (SELECT *, MAX(y) OVER (PARTITION BY model, variable) AS y1 FROM yr) WHERE y = y1 AND y1 >= 2095""",
    _MAN + ", yr AS (SELECT model, variable, file_name, UNNEST(range(y0, y1 + 1)) AS y FROM man WHERE ok)"))
def _(spark, sf_dir):
    man = manifest(spark, sf_dir).filter("issue IS NULL")
    yearly = man.select(*_KEYS, "file_name", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("year"))
    return I.edge_fill(yearly, _KEYS).select("model", "variable", "year", "file_name", "filled")


@query("j19_file_presence", ora("fx_files", """
SELECT model, variable, CAST(y AS INT) AS year FROM (SELECT DISTINCT model, variable FROM fx_files) k CROSS JOIN range(2015, 2061) AS r(y)
WHERE NOT EXISTS (SELECT 1 FROM fx_files f WHERE f.model = k.model AND f.variable = k.variable AND r.y BETWEEN f.y0 AND f.y1)"""))
def _(spark, sf_dir):
    files = V.files(spark, sf_dir)
    expected = files.select(*_KEYS).distinct().withColumns({"first_year": F.lit(2015), "last_year": F.lit(2060)})
    present = files.select(*_KEYS, F.explode(F.sequence("y0", "y1")).alias("year"))
    return I.pending_files(expected, present, _KEYS)


@query("o3_first_or_last_file", ora("fx_files", """
SELECT model, variable, MIN(file_name) AS first_file, MAX(file_name) AS last_file FROM fx_files GROUP BY model, variable"""))
def _(spark, sf_dir):
    files = V.files(spark, sf_dir).select(*_KEYS, "file_name")
    first = M.representative(files, _KEYS, "file_name", "first").withColumnRenamed("file_name", "first_file")
    last = M.representative(files, _KEYS, "file_name", "last").withColumnRenamed("file_name", "last_file")
    return first.join(last, _KEYS)


@query("u2_set_difference", ora("fx_files", """
SELECT model, CONCAT('[', STRING_AGG(v, ', ' ORDER BY o), ']') AS lacking FROM (SELECT DISTINCT model FROM fx_files) k CROSS JOIN
 (VALUES ('ua', 1), ('va', 2), ('tos', 3), ('psl', 4), ('hus', 5), ('ta', 6)) AS w(v, o) WHERE NOT EXISTS (SELECT 1 FROM fx_files f WHERE f.model = k.model AND f.variable = w.v) GROUP BY model"""))
def _(spark, sf_dir):
    have = V.files(spark, sf_dir).groupBy("model").agg(F.collect_set("variable").alias("have"))
    lacking = F.array_except(F.array(*[F.lit(v) for v in K.VARIABLES]), F.col("have"))
    return have.select("model", F.concat(F.lit("["), F.array_join(lacking, ", "), F.lit("]")).alias("lacking"))


@query("u2_rows_in_both", ora("fx_files fx_tree", """
SELECT model, variable, 'both' AS side FROM (SELECT model, variable FROM fx_files INTERSECT SELECT model, variable FROM fx_tree WHERE complete)
UNION ALL SELECT model, variable, 'files only' FROM (SELECT model, variable FROM fx_files EXCEPT SELECT model, variable FROM fx_tree WHERE complete)"""))
def _(spark, sf_dir):
    a = V.files(spark, sf_dir).select(*_KEYS)
    b = V.tree(spark, sf_dir).filter("complete").select(*_KEYS)
    return R_.rows_in_both(a, b).withColumn("side", F.lit("both")).unionByName(
        R_.rows_only_in(a, b).withColumn("side", F.lit("files only")))


# --- folder tree ------------------------------------------------------------------------------

LEVELS = ["model", "variant", "scenario", "variable", "grid", "frequency"]
_PICK = """pk AS (SELECT t.*, list_position(['gn', 'gr', 'gr1', 'gr2'], grid) AS r, MIN(list_position(['gn', 'gr', 'gr1', 'gr2'], grid)) OVER (PARTITION BY model, variant, scenario, variable) AS best FROM fx_tree t)"""


@query("w10_priority_pick", ora("fx_tree", """
SELECT model, variant, scenario, variable, grid, r = best AS selected,
  CASE WHEN r <> best THEN CONCAT('Grid Priority: Validation skipped; lower priority than selected grid ''', ['gn', 'gr', 'gr1', 'gr2'][best], '''') END AS note FROM pk""", _PICK))
def _(spark, sf_dir):
    rows = V.tree(spark, sf_dir).select("model", "variant", "scenario", "variable", "grid")
    return I.priority_pick(rows, ["model", "variant", "scenario", "variable"])


@query("a18_required_children", ora("fx_tree", """
SELECT model, variant, CONCAT('Missing required folders: [', STRING_AGG(w.s, ', ' ORDER BY w.o), ']') AS issue FROM (SELECT DISTINCT model, variant FROM fx_tree) k
CROSS JOIN (VALUES ('historical', 1), ('ssp126', 2), ('ssp245', 3), ('ssp585', 4)) AS w(s, o)
WHERE NOT EXISTS (SELECT 1 FROM fx_tree t WHERE t.model = k.model AND t.variant = k.variant AND t.scenario = w.s) GROUP BY model, variant
UNION ALL SELECT model, variant, CONCAT('Expected 4 folder(s), found ', n, ': [', l, ']') FROM
 (SELECT model, variant, COUNT(DISTINCT scenario) AS n, STRING_AGG(DISTINCT scenario, ', ' ORDER BY scenario) AS l FROM fx_tree GROUP BY ALL) WHERE n <> 4"""))
def _(spark, sf_dir):
    return I.check_children(V.tree(spark, sf_dir), ["model", "variant"], "scenario", required=K.SCENARIOS, exact_count=4)


def _nodes(spark, sf_dir):
    tree = V.tree(spark, sf_dir)
    need = ["historical", "ssp126", "ssp585"]
    own = I.check_children(tree, ["model", "variant"], "scenario", required=need).select(F.array("model", "variant").alias("path"), "issue")
    return I.completeness(tree, LEVELS, own)


_NODES = """own AS (SELECT model, variant, CONCAT('Missing required folders: [', STRING_AGG(w.s, ', ' ORDER BY w.o), ']') AS issue FROM (SELECT DISTINCT model, variant FROM fx_tree) k
  CROSS JOIN (VALUES ('historical', 1), ('ssp126', 2), ('ssp585', 4)) AS w(s, o)
  WHERE NOT EXISTS (SELECT 1 FROM fx_tree t WHERE t.model = k.model AND t.variant = k.variant AND t.scenario = w.s) GROUP BY model, variant),
lf AS (SELECT [model, variant, scenario, variable, grid, frequency] AS p, complete AS ok, CASE WHEN issue IS NULL THEN 0 ELSE 1 END AS i FROM fx_tree
       UNION ALL SELECT [model, variant], false, 1 FROM own),
up AS (SELECT p[1:d] AS p, ok, i FROM (SELECT *, UNNEST(range(1, len(p) + 1)) AS d FROM lf)),
nodes AS (SELECT p, BOOL_AND(ok) AS complete, SUM(i) AS n_issues, BOOL_OR(ok) AS any_ok FROM up GROUP BY p)"""

_LEVEL_SQL = "['model', 'variant', 'scenario', 'variable', 'grid', 'frequency'][len(p)]"


@query("a17_completeness_rollup", ora("fx_tree", f"SELECT {_LEVEL_SQL} AS level, array_to_string(p, '/') AS path, complete, CAST(n_issues AS BIGINT) AS n_issues FROM nodes", _NODES))
def _(spark, sf_dir):
    return _nodes(spark, sf_dir).select("level", F.concat_ws("/", "path").alias("path"), "complete", "n_issues")


@query("f10_incomplete_only", ora("fx_tree", f"""
SELECT {_LEVEL_SQL} AS level, array_to_string(p, '/') AS path, NOT EXISTS (SELECT 1 FROM nodes q WHERE NOT q.any_ok AND q.p = n.p[1:len(n.p) - 1]) AS is_top FROM nodes n WHERE NOT any_ok""", _NODES))
def _(spark, sf_dir):
    return I.incomplete_only(_nodes(spark, sf_dir)).withColumn("path", F.concat_ws("/", "path"))


@query("f11_complete_only", ora("fx_tree", "SELECT array_to_string(p, '/') AS name FROM nodes WHERE len(p) = 2 AND complete", _NODES))
def _(spark, sf_dir):
    return I.select_complete(_nodes(spark, sf_dir), "variant")


def _issues(spark, sf_dir):
    tree = V.tree(spark, sf_dir)
    leaf = tree.filter("issue IS NOT NULL").select(F.array(*[F.col(c) for c in LEVELS]).alias("path"), "issue")
    own = I.check_children(tree, ["model", "variant"], "scenario", required=["historical", "ssp126", "ssp585"])
    return leaf.unionByName(own.select(F.array("model", "variant").alias("path"), "issue"))


_ISSUES = _NODES + """,
iss AS (SELECT [model, variant, scenario, variable, grid, frequency] AS p, issue FROM fx_tree WHERE issue IS NOT NULL UNION ALL SELECT [model, variant], issue FROM own)"""


@query("a24_first_failure", ora("fx_tree", """
SELECT n.p[1] AS model, COALESCE(array_to_string(list_transform(range(1, len(f.p) + 1), lambda i: CONCAT(['model', 'variant', 'scenario', 'variable', 'grid', 'frequency'][i], '=', f.p[i])), ' -> '),
  'failed at the root, no issue found below') AS failed_at, f.issue FROM nodes n LEFT JOIN (SELECT p[1] AS m, MIN(p) AS p, arg_min(issue, p) AS issue FROM iss GROUP BY 1) f ON f.m = n.p[1]
WHERE len(n.p) = 1 AND NOT n.complete""", _ISSUES))
def _(spark, sf_dir):
    return I.first_failure(_nodes(spark, sf_dir), _issues(spark, sf_dir), LEVELS)


@query("a23_model_summary", ora("fx_tree", f"""
SELECT CONCAT(l, '.total') AS item, COUNT(*) AS n FROM (SELECT {_LEVEL_SQL} AS l FROM nodes) GROUP BY l
UNION ALL SELECT CONCAT(l, '.complete'), COUNT(*) FILTER (WHERE complete) FROM (SELECT {_LEVEL_SQL} AS l, complete FROM nodes) GROUP BY l
UNION ALL SELECT CONCAT(l, '.names'), COUNT(DISTINCT nm) FROM (SELECT {_LEVEL_SQL} AS l, p[len(p)] AS nm FROM nodes) GROUP BY l
UNION ALL SELECT CONCAT('issue.', CASE WHEN issue LIKE '%:%' THEN split_part(issue, ':', 1) ELSE issue[1:50] END), COUNT(*) FROM iss GROUP BY 1""", _ISSUES))
def _(spark, sf_dir):
    return I.model_summary(_nodes(spark, sf_dir), _issues(spark, sf_dir))


@query("a20_variant_triage", ora("fx_draws fx_bins", """
SELECT DISTINCT model, variant, CASE WHEN all_ok THEN 'complete' ELSE 'short_of_files' END AS status, CASE WHEN NOT all_ok THEN message END AS message FROM (
 SELECT model, 'r1i1p1f1' AS variant, time_period, BOOL_AND(BOOL_AND(complete)) OVER (PARTITION BY model) AS all_ok,
  CONCAT('Basin=''', MIN(basin) FILTER (WHERE NOT complete), ''' in ', time_period, ': Expected at least 250 draw files, found ', arg_min(found, basin) FILTER (WHERE NOT complete), '.') AS message
 FROM st GROUP BY model, time_period) WHERE all_ok OR message IS NOT NULL""", """
fd AS (SELECT basin, COUNT(*) AS found FROM fx_draws GROUP BY basin),
st AS (SELECT b.model, CONCAT(CAST(b.start_year AS STRING), '-', CAST(b.end_year AS STRING)) AS time_period, fd.basin, fd.found, fd.found >= 250 AS complete FROM fx_bins b CROSS JOIN fd)"""))
def _(spark, sf_dir):
    from galeframe.operators import draws as D
    from galeframe.operators import planning as P

    found = D.basin_check(V.draws(spark, sf_dir)).select("basin", "found", "complete")
    tasks = P.with_time_period(V.bins(spark, sf_dir)).select("model", "variant", "time_period").withColumn(
        "basin", F.explode(F.array(*[F.lit(b) for b in K.BASINS])))
    return I.triage(tasks.join(found, "basin"))


_TREE_KEYS = ["model", "variant", "scenario", "variable"]


@query("u4_nest_rows", ora("fx_tree", """
SELECT model, CAST(COUNT(DISTINCT (variant, scenario)) AS BIGINT) AS n_folders, MIN(grid) FILTER (WHERE variant = 'r1i1p1f1' AND scenario = 'ssp126' AND variable = 'tos') AS example_grid,
  COUNT(DISTINCT (variant, scenario, variable)) AS n_leaves FROM fx_tree GROUP BY model"""))
def _(spark, sf_dir):
    flat = V.tree(spark, sf_dir).groupBy(*_TREE_KEYS).agg(F.min("grid").alias("grid"))
    nested = I.nest_rows(flat, _TREE_KEYS, "grid")
    folders = F.flatten(F.transform(F.map_values("tree"), lambda m: F.map_values(m)))
    return nested.select(
        "model", F.size(folders).cast("long").alias("n_folders"),
        F.try_element_at(F.try_element_at(F.try_element_at("tree", F.lit("r1i1p1f1")), F.lit("ssp126")), F.lit("tos")).alias("example_grid"),
        F.aggregate(folders, F.lit(0).cast("long"), lambda a, m: a + F.size(m)).alias("n_leaves"))


@query("u3_flatten_tree", ora("fx_files", "SELECT model, variable, freq, file_name AS file FROM fx_files"))
def _(spark, sf_dir):
    c = F.col
    inner = F.create_map(c("variable"), F.create_map(c("freq"), F.array("file_name")))
    nested = V.files(spark, sf_dir).select(F.create_map(c("model"), inner).alias("root"))
    return I.flatten_tree(nested, ["model", "variable", "freq"], "root")


@query("g4_curvilinear_detect", ora("fx_tree", """
SELECT model, variant, scenario, variable, grid, CASE WHEN grid = 'gr2' THEN 'forbidden' WHEN grid = 'gn' THEN 'curvilinear' ELSE 'regular' END AS grid_kind FROM fx_tree"""))
def _(spark, sf_dir):
    mesh, native = F.col("grid") == "gr2", F.col("grid") == "gn"
    meta = V.tree(spark, sf_dir).select(
        *_TREE_KEYS, "grid", F.when(mesh, F.array(F.lit("time"), F.lit("ncells"))).otherwise(F.array(F.lit("time"), F.lit("y"), F.lit("x"))).alias("dims"),
        F.when(native, 2).otherwise(1).alias("coord_rank"))
    return I.grid_kind(meta).drop("dims", "coord_rank")


@query("o1_stable_sort", ora("fx_files", "SELECT model, variable, file_name, y0 FROM fx_files ORDER BY model, variable, y0, file_name"))
def _(spark, sf_dir):
    return R_.stable_sort(V.files(spark, sf_dir).select("model", "variable", "file_name", "y0"), ["model", "variable", "y0"])


@query("o2_head_n", ora("fx_files", "SELECT model, variable, file_name, y0 FROM fx_files ORDER BY y0, model, variable, file_name LIMIT 20"))
def _(spark, sf_dir):
    # the limit is the operator: first twenty in a full order
    return R_.head(V.files(spark, sf_dir).select("model", "variable", "file_name", "y0"), ["y0", "model", "variable"], 20)

"""Queries of the engine itself, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom import catalog_support
from tabloom.functions import rounding
from tabloom.operators.assembly import run_assembly
from tabloom.operators.confidential import run_confidential
from tabloom.operators.pipeline import run_pipeline
from tabloom.operators.pipeline_sql import read_and_prepare_sql_code
from tabloom.operators.report import SUCCESS
from tabloom.operators.sql_script import SqlScript
from tabloom.operators.summary import run_summary
from tabloom.plans.combos import expand_compact_summary_groups, generate_combinations
from tabloom.registry import ORACLES, QUERIES, add, table
from tabloom.sources.controlfile import ControlTable, as_control_table, merge_progress
from tabloom.sources.work import new_path

# summary

#: Inputs with missing values, as the tables have almost none.
_INPUTS = {
    "lineitem": ("lineitem", ["*", "nullif(l_quantity, 7) AS qty", "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS hole", "CAST(NULL AS bigint) AS nothing"]),
    "orders": ("orders", ["*", "nullif(o_orderstatus, 'P') AS status", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price"]),
    "events": ("events", ["*", "nullif(event_type, 'click') AS kind"]),
}
_ENTITY = ("SELECT o_custkey % 7 AS part, o_orderstatus AS status, min(o_orderkey) AS e__min, max(o_orderkey) AS e__max, min(o_custkey) AS cust, count(*) AS n, "
           "CAST(NULL AS bigint) AS none__min, CAST(NULL AS bigint) AS none__max FROM orders GROUP BY o_custkey, o_orderstatus")  # fmt: skip


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "entity":
        return spark.sql(_ENTITY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    base, columns = _INPUTS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def _with(name: str) -> str:
    if name == "entity":
        return f"WITH t AS ({_ENTITY}) "
    base, columns = _INPUTS[name]
    return f"WITH t AS (SELECT {', '.join(columns)} FROM {base}) "


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Sums of doubles differ in their last digits between engines."""
    return df.select(*(F.round(f"`{c}`", digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def summary(name: str, data: str, rows: list[dict], select: str, **options) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run_summary(rows, _input(spark, sf_dir, data), **options).df)

    add(name, _with(data) + select, fn)


_BY_FLAG = "SELECT 'l_returnflag' AS grplabel1, l_returnflag AS group1, {0} FROM t GROUP BY l_returnflag"
for _kind, _cell, _sql in (
    ("count", "qty", "count(qty) AS count"),
    ("distinct", "qty", "count(DISTINCT qty) AS distinct"),
    ("sum", "qty", "round(sum(qty), 2) AS sum"),
    ("stddev", "qty", "round(stddev_samp(qty), 2) AS stddev"),
    ("max", "qty", "max(qty) AS max"),
    ("min", "qty", "min(qty) AS min"),
    ("seed", "l_suppkey", "sum(((l_suppkey % 100) + 100) % 100)::BIGINT AS seed"),
    ("entity", "l_suppkey", "nullif(count(DISTINCT l_suppkey), 0) AS entity"),
):
    summary(f"summary_{_kind}", "lineitem", [{"GROUP1": "l_returnflag", _kind.upper(): f"[{_cell}]"}], _BY_FLAG.format(_sql.replace(" AS distinct", ' AS "distinct"')))

summary("summary_sum_all_null", "lineitem", [{"GROUP1": "l_returnflag", "SUM": "hole", "MAX": "hole", "COUNT": "hole"}], _BY_FLAG.format("coalesce(round(sum(hole), 2), 0) AS sum, max(hole) AS max, count(hole) AS count"))
summary("summary_sum_sql_mode", "lineitem", [{"GROUP1": "l_returnflag", "SUM": "hole"}], _BY_FLAG.format("round(sum(hole), 2) AS sum"), null_mode="sql")
summary("summary_entity_zero_is_null", "lineitem", [{"GROUP1": "l_returnflag", "ENTITY": "hole"}], _BY_FLAG.format("nullif(count(DISTINCT hole), 0) AS entity"))
summary("summary_multi_agg", "orders", [{"GROUP1": "o_orderpriority", "COUNT1": "price", "COUNT2": "o_custkey", "SUM.1": "price", "DISTINCT05": "o_custkey"}],
        "SELECT 'o_orderpriority' AS grplabel1, o_orderpriority AS group1, count(price) AS count1, count(o_custkey) AS count2, round(sum(price), 2) AS \"sum.1\", count(DISTINCT o_custkey) AS distinct05 FROM t GROUP BY o_orderpriority")
summary("summary_global", "orders", [{"LABEL": "all orders", "COUNT": "o_orderkey", "MIN": "price", "MAX": "price"}], "SELECT 'all orders' AS label, count(o_orderkey) AS count, round(min(price), 2) AS min, round(max(price), 2) AS max FROM t")
summary("summary_two_groups", "orders", [{"GROUP1": "o_orderstatus", "GROUP2": "o_orderpriority", "COUNT": "o_orderkey"}],
        "SELECT 'o_orderstatus' AS grplabel1, o_orderstatus AS group1, 'o_orderpriority' AS grplabel2, o_orderpriority AS group2, count(o_orderkey) AS count FROM t GROUP BY o_orderstatus, o_orderpriority")


def _stacked(spark: SparkSession, sf_dir: str, share: str = "apart") -> DataFrame:
    rows = [
        {"ENABLED": "TRUE", "LABEL": "by flag", "GROUP1": "l_returnflag", "COUNT": "qty", "SUM": "l_tax"},
        {"ENABLED": "TRUE", "LABEL": "by status", "GROUP1": "l_linestatus", "COUNT": "qty"},
        {"ENABLED": "yes", "LABEL": "by number", "GROUP1": "l_linenumber", "COUNT": "qty", "SUM": "qty", "WHERE": "{l_quantity > 10}"},
        {"ENABLED": "1", "LABEL": "all", "SUM": "l_discount"},
        {"ENABLED": "no", "LABEL": "off", "COUNT": "qty"},
    ]
    return rounded(run_summary(rows, _input(spark, sf_dir, "lineitem"), share=share).df)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the jobs that write two result files say of their control rows."""
    rows = [
        {"FILE": "flags.csv", "GROUP1": "l_returnflag", "COUNT": "qty"},
        {"FILE": "flags.csv", "GROUP1": "l_returnflag", "GROUP2": "l_linestatus", "SUM": "qty", "WHERE": "{l_quantity > 45}"},
        {"FILE": "parts.csv", "GROUP1": "l_partkey", "DISTINCT": "l_suppkey"},
        {"FILE": "parts.csv", "GROUP1": "l_linenumber", "MAX": "qty", "WHERE": "{l_quantity < 0}"},
    ]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # one gives nothing
        got = run_summary(rows, _input(spark, sf_dir, "lineitem"), save_folder=new_path(spark, "outcomes"), write=True)
    return spark.createDataFrame([(o.row, o.file, o.rows, o.status == SUCCESS) for o in got.outcomes], "row int, file string, rows long, ended boolean")


add("summary_stacked_rows", _with("lineitem") + " UNION ALL ".join((
    "SELECT 'by flag' AS label, 'l_returnflag' AS grplabel1, l_returnflag AS group1, count(qty) AS count, round(sum(l_tax), 2) AS sum FROM t GROUP BY l_returnflag",
    "SELECT 'by status', 'l_linestatus', l_linestatus, count(qty), NULL FROM t GROUP BY l_linestatus",
    "SELECT 'by number', 'l_linenumber', l_linenumber::VARCHAR, count(qty), round(sum(qty), 2) FROM t WHERE l_quantity > 10 GROUP BY l_linenumber",
    "SELECT 'all', NULL, NULL, NULL, round(sum(l_discount), 2) FROM t",
)), _stacked)
for _mode in ("rollup", "sets"):
    add(f"summary_shared_{_mode}", ORACLES["summary_stacked_rows"], lambda s, d, m=_mode: _stacked(s, d, m))
add("summary_outcomes", _with("lineitem") + """ SELECT 0 AS "row", 'flags.csv' AS file, count(DISTINCT l_returnflag) AS rows, true AS ended FROM t
    UNION ALL SELECT 1, 'flags.csv', count(*), true FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM t WHERE l_quantity > 45)
    UNION ALL SELECT 2, 'parts.csv', count(DISTINCT l_partkey), true FROM t UNION ALL SELECT 3, 'parts.csv', 0, true""", _outcomes)  # fmt: skip
summary("summary_distinct_bitmaps", "lineitem", [{"GROUP1": "l_returnflag", "DISTINCT1": "l_suppkey", "DISTINCT2": "l_orderkey", "DISTINCT3": "l_partkey", "DISTINCT4": "l_linestatus", "ENTITY": "nothing", "COUNT": "qty"}],
        _BY_FLAG.format("count(DISTINCT l_suppkey) AS distinct1, count(DISTINCT l_orderkey) AS distinct2, count(DISTINCT l_partkey) AS distinct3, count(DISTINCT l_linestatus) AS distinct4, NULL::BIGINT AS entity, count(qty) AS count"), distinct="bitmaps")
summary("summary_na_groups_removed", "orders", [{"GROUP1": "status", "COUNT": "o_orderkey"}], "SELECT 'status' AS grplabel1, status AS group1, count(o_orderkey) AS count FROM t WHERE status IS NOT NULL GROUP BY status")
summary("summary_na_groups_kept", "orders", [{"GROUP1": "status", "COUNT": "o_orderkey"}], "SELECT 'status' AS grplabel1, status AS group1, count(o_orderkey) AS count FROM t GROUP BY status", remove_na_from_groups=False)
summary("summary_where_multi", "events", [{"GROUP1": "event_type", "COUNT": "event_id", "WHERE1": "{value > 20 & user_id != 3}", "WHERE2": "{user_id %in% c(1, 3, 5, 7, 9, 11)}"}],
        "SELECT 'event_type' AS grplabel1, event_type AS group1, count(event_id) AS count FROM t WHERE value > 20 AND user_id <> 3 AND user_id IN (1, 3, 5, 7, 9, 11) GROUP BY event_type")
summary("summary_dynamic_ifelse", "orders", [{"GROUP1": "o_orderpriority", "SUM": "{ifelse(price > 100000, 1, 0)}", "COUNT": "{ifelse(price > 100000, o_custkey, NA)}"}],
        "SELECT 'o_orderpriority' AS grplabel1, o_orderpriority AS group1, sum(CASE WHEN price > 100000 THEN 1 WHEN price <= 100000 THEN 0 END)::BIGINT AS sum, count(CASE WHEN price > 100000 THEN o_custkey END) AS count FROM t GROUP BY o_orderpriority")
summary("summary_dynamic_in", "orders", [{"GROUP1": "o_orderpriority", "SUM": "{ifelse(status %in% c('O', 'F'), 1, 0)}"}],
        "SELECT 'o_orderpriority' AS grplabel1, o_orderpriority AS group1, sum(CASE WHEN coalesce(status IN ('O', 'F'), false) THEN 1 ELSE 0 END)::BIGINT AS sum FROM t GROUP BY o_orderpriority")
summary("summary_dynamic_isna", "orders", [{"GROUP1": "o_orderpriority", "SUM": "{ifelse(is.na(status) | o_custkey %% 2 == 0, 1, 0)}"}],
        "SELECT 'o_orderpriority' AS grplabel1, o_orderpriority AS group1, sum(CASE WHEN status IS NULL OR o_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS sum FROM t GROUP BY o_orderpriority")
summary("summary_dynamic_arith", "orders", [{"GROUP1": "o_orderstatus", "SUM": "{2 * price - o_totalprice / 4}", "MAX": "{round(price / 1000)}"}],
        "SELECT 'o_orderstatus' AS grplabel1, o_orderstatus AS group1, round(sum(2 * price - o_totalprice / 4), 2) AS sum, max(round_even(price / 1000, 0)) AS max FROM t GROUP BY o_orderstatus")
summary("summary_dynamic_case_when", "orders", [{"LABEL": "sizes", "DISTINCT": "{case_when(price < 50000 ~ 'low', price < 150000 ~ 'mid', TRUE ~ 'high')}", "COUNT": "{paste0(status, o_orderpriority)}", "SUM": "{nchar(o_orderpriority) + pmin(o_custkey, 10)}"}],
        "SELECT 'sizes' AS label, count(DISTINCT CASE WHEN price < 50000 THEN 'low' WHEN price < 150000 THEN 'mid' ELSE 'high' END) AS \"distinct\", count(*) AS count, sum(length(o_orderpriority) + least(o_custkey, 10))::BIGINT AS sum FROM t")

_HALVES = "u AS (SELECT part, status, e__min AS e, cust, n FROM t UNION ALL SELECT part, status, e__max, NULL, NULL FROM t) "
_E = _with("entity").rstrip() + ", " + _HALVES
add("summary_entity_min_max", _E + "SELECT 'part' AS grplabel1, part::VARCHAR AS group1, nullif(count(DISTINCT e), 0) AS entity, count(cust) AS count, sum(n)::BIGINT AS sum FROM u GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "e", "COUNT": "cust", "SUM": "n"}], _input(s, d, "entity")).df)
add("summary_entity_min_only", _with("entity") + "SELECT 'part' AS grplabel1, part::VARCHAR AS group1, nullif(count(DISTINCT e__min), 0) AS entity FROM t GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "e"}], _input(s, d, "entity").drop("e__max")).df)
add("summary_entity_max_only", _with("entity") + "SELECT 'part' AS grplabel1, part::VARCHAR AS group1, nullif(count(DISTINCT e__max), 0) AS entity FROM t GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "e"}], _input(s, d, "entity").drop("e__min")).df)
add("summary_entity_where", _with("entity").rstrip() + ", w AS (SELECT * FROM t WHERE n >= 2), u AS (SELECT part, e__min AS e FROM w UNION ALL SELECT part, e__max FROM w) SELECT 'part' AS grplabel1, part::VARCHAR AS group1, nullif(count(DISTINCT e), 0) AS entity FROM u GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "e", "WHERE": "{n >= 2}"}], _input(s, d, "entity")).df)
add("summary_entity_where_after_union", _E + "SELECT 'part' AS grplabel1, part::VARCHAR AS group1, nullif(count(DISTINCT e), 0) AS entity FROM u WHERE n >= 2 GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "e", "WHERE": "{n >= 2}"}], _input(s, d, "entity"), entity_where="after_union").df)
add("summary_remove_empty_entity", _with("entity") + "SELECT 'part' AS grplabel1, part::VARCHAR AS group1, NULL::BIGINT AS entity, count(cust) AS count FROM t GROUP BY part",
    lambda s, d: run_summary([{"GROUP1": "part", "ENTITY": "none", "COUNT": "cust"}], _input(s, d, "entity"), drop_empty_entities=True).df.withColumn("entity", F.col("entity").cast("bigint")))


# combinations


def _expanded(rows: list[dict]) -> Callable[[SparkSession, str], DataFrame]:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _input(spark, sf_dir, "lineitem")
        return run_summary(expand_compact_summary_groups(as_control_table(rows), df.columns), df).df

    return fn


def _grouped_sql(*sets: tuple[str, ...], width: int) -> str:
    out = []
    for names in sets:
        cells = []
        for i in range(width):
            n = names[i] if i < len(names) and names[i] else None
            cells += [f"'{n}' AS grplabel{i + 1}" if n else f"NULL AS grplabel{i + 1}", f"{n}::VARCHAR AS group{i + 1}" if n else f"NULL AS group{i + 1}"]
        keys = [n for n in names if n]
        out.append(f"SELECT {', '.join(cells)}, count(qty) AS count FROM t" + (f" GROUP BY {', '.join(keys)}" if keys else ""))
    return _with("lineitem") + " UNION ALL ".join(out)


_F, _S, _N = "l_returnflag", "l_linestatus", "l_linenumber"
add("compact_or", _grouped_sql((_F,), (_S,), (_N,), width=1), _expanded([{"GROUP1": f"{_F} | {_S} | {_N}", "COUNT": "qty"}]))
add("compact_plus", _grouped_sql((_F, _N), (_F, None), (_S, _N), (_S, None), width=2), _expanded([{"GROUP1": f"{_F} | {_S}", "GROUP2": f"{_N} | +", "COUNT": "qty"}]))
add("compact_prefix", _grouped_sql((_F, "l_linestatus"), (_F, "l_linenumber"), width=2), lambda s, d: run_summary(expand_compact_summary_groups(as_control_table([{"GROUP1": _F, "GROUP2": "line_*", "COUNT": "qty"}]), ["line_status", "line_number"]), _input(s, d, "lineitem").withColumnsRenamed({"l_linestatus": "line_status", "l_linenumber": "line_number"})).df.replace({"line_status": "l_linestatus", "line_number": "l_linenumber"}, subset=["grplabel2"]))
add("compact_suffix", _grouped_sql((_F, "l_linestatus"), width=2), lambda s, d: run_summary(expand_compact_summary_groups(as_control_table([{"GROUP1": _F, "GROUP2": "*_stat", "COUNT": "qty"}]), ["line_stat", "other"]), _input(s, d, "lineitem").withColumnRenamed("l_linestatus", "line_stat")).df.replace({"line_stat": "l_linestatus"}, subset=["grplabel2"]))


def _combos(*sets, **options) -> Callable[[SparkSession, str], DataFrame]:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = generate_combinations(*sets, **options)
        names = {c: f"GROUP{i}" for i, c in enumerate(made.columns, 1)}
        rows = ControlTable([*names.values(), "COUNT"], [{**{names[c]: v for c, v in r.items()}, "COUNT": "qty"} for r in made.rows])
        return run_summary(rows, _input(spark, sf_dir, "lineitem")).df

    return fn


add("combos_pairwise", _grouped_sql((_F, _S), (_F, _N), (_S, None), (_S, _N), width=2), _combos([_F, _S], [_S, _N]))
add("combos_always", _grouped_sql((_F, _S), (_F, _N), (_F, None), width=2), _combos([_S, _N, None], always=[_F]))


# assembly

_MASTER = "SELECT c_custkey, y, make_date(y, 1, 1) AS year_start, make_date(y, 12, 31) AS year_end FROM (SELECT c_custkey, {0} AS y FROM customer)"
_SPELLS = ("SELECT o_custkey, CAST(o_orderdate AS date) AS began, ended, o_totalprice AS price, supp, o_orderpriority AS priority, CAST(o_orderkey AS bigint) AS okey FROM orders JOIN "
           "(SELECT l_orderkey, CAST(max(l_shipdate) AS date) AS ended, max(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")  # fmt: skip


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MASTER.format("explode(array(1996, 1997))").replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPELLS.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))


def measure_row(method: str, kind: str, value: str = "[price]", name: str = "out", **other) -> dict:
    return {
        "description": name, "population_uid": "[c_custkey]", "period_start": "[year_start]", "period_end": "[year_end]", "measure_table": "[spells]",
        "measure_uid": "[o_custkey]", "measure_start": "[began]", "measure_end": "[ended]", "measure_value": value, "output_name": f'"{name}"', "output_method": method, "output_type": kind,
    } | other


def assembled(rows: list[dict], make_master: Callable = master, digits: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        measures = {"spells": spells(spark, sf_dir), "events": table(spark, sf_dir, "events")}
        return rounded(run_assembly(spark, rows, make_master(spark, sf_dir), measures).df.drop("year_start", "year_end"), digits)

    return fn


def assembly_sql(outputs: str, ps: str = "year_start", pe: str = "year_end", columns: str = "c_custkey, y", base: str | None = None) -> str:
    m = base or _MASTER.format("unnest([1996, 1997])")
    return (
        f"WITH m AS ({m}), s AS ({_SPELLS}), k AS (SELECT DISTINCT c_custkey AS uid, {ps} AS ps, {pe} AS pe FROM m), "
        f"r AS (SELECT uid, ps, pe, {outputs} FROM k JOIN s ON uid = o_custkey AND ps <= ended AND began <= pe GROUP BY uid, ps, pe) "
        f"SELECT m.* EXCLUDE (year_start, year_end), r.* EXCLUDE (uid, ps, pe) FROM m LEFT JOIN r ON m.c_custkey = r.uid AND m.{ps} = r.ps AND m.{pe} = r.pe"
        if ps in ("year_start",) and pe in ("year_end",)
        else f"WITH m AS ({m}), s AS ({_SPELLS}), x AS (SELECT *, {ps} AS ps, {pe} AS pe FROM m), k AS (SELECT DISTINCT c_custkey AS uid, ps, pe FROM x), "
        f"r AS (SELECT uid, ps, pe, {outputs} FROM k JOIN s ON uid = o_custkey AND ps <= ended AND began <= pe GROUP BY uid, ps, pe) "
        f"SELECT x.* EXCLUDE (year_start, year_end, ps, pe), r.* EXCLUDE (uid, ps, pe) FROM x LEFT JOIN r ON x.c_custkey = r.uid AND x.ps = r.ps AND x.pe = r.pe"
    )


_OVERLAP = "(date_diff('day', greatest(ps, began), least(pe, ended)) + 1)"
_LENGTH = "(date_diff('day', began, ended) + 1)"
for _m, _k, _v, _sql in (
    ("MIN", "FLOAT", "[price]", "round(min(price), 2)"),
    ("MAX", "VARCHAR(20)", "[priority]", "max(priority)"),
    ("EXISTS", "INT", "[price]", "CASE WHEN count(price) >= 1 THEN 1 END"),
    ("COUNT", "INT", '"1"', "count(*)::INT"),
    ("MEAN", "FLOAT", "[price]", "round(avg(price), 6)"),
    ("DISTINCT", "BIGINT", "[supp]", "count(DISTINCT supp)"),
    ("SUM", "FLOAT", "[price]", "round(sum(price), 2)"),
    ("SUM_WITHIN", "FLOAT", "[price]", f"round(sum({_OVERLAP}::DOUBLE / nullif({_LENGTH}, 0) * price), 2)"),
    ("DURATION", "INT", "[price]", f"sum(CASE WHEN price IS NOT NULL THEN {_OVERLAP} END)::INT"),
):
    add(f"assembly_{_m.lower()}", assembly_sql(f"{_sql} AS out"), assembled([measure_row(_m, _k, _v)], digits=6 if _m == "MEAN" else 2))
add("assembly_entity", assembly_sql("min(supp) AS out__min, max(supp) AS out__max"), assembled([measure_row("entity", "BIGINT", "[supp]")]))
add("assembly_constant_period", assembly_sql("count(price)::INT AS out", "DATE '1996-01-01'", "DATE '1998-06-30'"), assembled([measure_row("COUNT", "INT", period_start='"1996-01-01"', period_end='"1998-06-30"')]))
add("assembly_dynamic_period", assembly_sql("round(sum(price), 2) AS out", "(year_start - INTERVAL 1 YEAR)::DATE", "year_start"), assembled([measure_row("SUM", "FLOAT", period_start="{ DATEADD(YEAR, -1, [year_start]) }", period_end="[year_start]")]))
add("assembly_dynamic_value", assembly_sql("count(CASE WHEN price > 100000 THEN supp END)::INT AS out"), assembled([measure_row("COUNT", "INT", "{IIF([price] > 100000, [supp], NULL)}")]))
add("assembly_typed_output", assembly_sql("sum(floor(price))::BIGINT AS total, sum(floor(price))::DOUBLE AS exact, min(priority)[1:3] AS short"),
    lambda s, d: assembled([measure_row("SUM", "BIGINT", "{FLOOR([price])}", name="total"), measure_row("SUM", "DECIMAL(14,1)", "{FLOOR([price])}", name="exact"), measure_row("MIN", "VARCHAR(3)", "[priority]", name="short")])(s, d).withColumn("exact", F.col("exact").cast("double")))
add("assembly_duplicate_master", assembly_sql("count(price)::INT AS out", base=f"{_MASTER.format('unnest([1996, 1997])')} UNION ALL {_MASTER.format('1996')}"), assembled([measure_row("COUNT", "INT")], lambda s, d: master(s, d).unionByName(master(s, d).where("y = 1996"))))
add("assembly_null_uid", assembly_sql("count(price)::INT AS out", base=f"SELECT nullif(c_custkey % 50, 0) AS c_custkey, y, year_start, year_end FROM ({_MASTER.format('unnest([1996, 1997])')})"), assembled([measure_row("COUNT", "INT")], lambda s, d: master(s, d).withColumn("c_custkey", F.expr("nullif(c_custkey % 50, 0)"))))
add("assembly_overwrite_column", assembly_sql("count(price)::INT AS out"), assembled([measure_row("COUNT", "INT")], lambda s, d: master(s, d).withColumn("out", F.lit("old"))))
_EVENT = {"measure_table": "[db].[dbo].[events]", "measure_uid": "[user_id]", "measure_start": "[ts]", "measure_end": "[ts]", "period_start": '"2024-01-01"', "period_end": '"2024-12-31"'}
add("assembly_batched_multi_measure", assembly_sql("round(sum(price), 2) AS spent, count(price)::INT AS n").replace("SELECT m.*", "SELECT q.*, e.clicks FROM (SELECT m.*", 1) + ") q LEFT JOIN (SELECT user_id, count(value)::INT AS clicks FROM events WHERE ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY user_id) e ON q.c_custkey = e.user_id",
    assembled([measure_row("SUM", "FLOAT", name="spent"), measure_row("COUNT", "INT", "[value]", name="clicks", **_EVENT), measure_row("COUNT", "INT", name="n")]))

_CLASH = ("_ps", "_uid", "_new0", "_kuid", "uid", "out0", "__uid")
add("assembly_clashing_names", assembly_sql("count(price)::INT AS out, round(sum(price), 2) AS \"_new1\"", base=f"SELECT *, {', '.join(f'{i} AS {c}' for i, c in enumerate(_CLASH))} FROM ({_MASTER.format('unnest([1996, 1997])')})"),
    assembled([measure_row("COUNT", "INT"), measure_row("SUM", "FLOAT", name="_new1")], lambda s, d: master(s, d).withColumns({c: F.lit(i) for i, c in enumerate(_CLASH)})))


def _written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master table of the session, changed in place by two runs."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tabloom_work LOCATION '{new_path(spark, 'database')}'")
    name = "tabloom_work.assembly_written_back"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    master(spark, sf_dir).write.saveAsTable(name)
    for row in (measure_row("COUNT", "INT", name="n"), measure_row("SUM", "FLOAT", name="spent")):
        run_assembly(spark, [row], "[server].[tabloom_work].[assembly_written_back]", {"spells": spells(spark, sf_dir)}, write_to=name)
    return rounded(spark.table(name).drop("year_start", "year_end"))


add("assembly_written_back", assembly_sql("count(price)::INT AS n, round(sum(price), 2) AS spent"), _written_back)


#: A third of all events under one uid, and its every day a period.
_HOT_SPELLS = "SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS who, CAST(ts AS date) AS began, CAST(ts AS date) + CAST(event_id % 40 AS int) AS ended, value FROM events"
_HOT_MASTER = f"SELECT DISTINCT who, began AS first, began + 6 AS last FROM ({_HOT_SPELLS})"
_HOT = [("COUNT", "BIGINT", "n", "count(value)"), ("SUM", "FLOAT", "total", "round(sum(value), 2)"), ("MIN", "FLOAT", "least", "min(value)"), ("MAX", "FLOAT", "most", "max(value)"),
        ("MEAN", "FLOAT", "mean", "round(avg(value), 2)"), ("EXISTS", "INT", "some", "CASE WHEN count(value) >= 1 THEN 1 END"), ("DURATION", "BIGINT", "days", "sum(CASE WHEN value IS NOT NULL THEN least(last, ended) - greatest(first, began) + 1 END)::BIGINT"),
        ("SUM_WITHIN", "FLOAT", "share", "round(sum((least(last, ended) - greatest(first, began) + 1)::DOUBLE / (ended - began + 1) * value), 2)"), ("DISTINCT", "BIGINT", "kinds", "count(DISTINCT value)")]


def _hot_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    spells_, days = (spark.sql(q.replace("FROM events", "FROM {events}"), events=events) for q in (_HOT_SPELLS, _HOT_MASTER))
    rows = [measure_row(m, k, "[value]", name=n, population_uid="[who]", period_start="[first]", period_end="[last]", measure_uid="[who]") for m, k, n, _ in _HOT]
    return rounded(run_assembly(spark, rows, days, {"spells": spells_}, sweep=200).df)


add("assembly_sweep_hot_uid", f"WITH s AS ({_HOT_SPELLS}), k AS ({_HOT_MASTER}) SELECT k.who, first, last, {', '.join(f'{q} AS {n}' for _, _, n, q in _HOT)} FROM k JOIN s ON k.who = s.who AND first <= ended AND began <= last GROUP BY k.who, first, last", _hot_uid)


# confidential

_COUNTS = "SELECT l_suppkey, count(*) AS n, count(*) % 61 AS small, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_suppkey"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_COUNTS.replace("::BIGINT", "").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def u_sql(seed: str) -> str:
    return f"(('0x' || substr(md5(CAST({seed} AS varchar)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def rr_sql(x: str, seed: str, base: int, thresholds=()) -> str:
    rest = f"((({x}) % {base} + {base}) % {base})"
    out = f"(({x}) - {rest} + CASE WHEN {rest} = 0 OR {u_sql(seed)} < ({base}.0 - {rest}) / {base}.0 THEN 0 ELSE {base} END)"
    for t in sorted(thresholds):
        out = f"(CASE WHEN ({x}) >= {t} AND {out} < {t} THEN {out} + {base} WHEN ({x}) < {t} AND {out} >= {t} THEN {out} - {base} ELSE {out} END)"
    return out


def grr_sql(x: str, seed: str, thresholds=()) -> str:
    cases = []
    for (low, base), (least, most) in reversed(list(zip(rounding.BANDS, rounding.BAND_THRESHOLDS, strict=True))):
        cases.append(f"WHEN abs({x}) >= {low} THEN " + rr_sql(f"abs({x})", seed, base, [t for t in thresholds if least <= t <= most]))
    return f"(sign({x}) * (CASE {' '.join(cases)} END))::BIGINT"


def conf(name: str, column: Callable[[], F.Column], sql: str) -> None:
    add(name, f"WITH t AS ({_COUNTS}) SELECT l_suppkey, {sql} AS out FROM t", lambda s, d: counts(s, d).select("l_suppkey", column().alias("out")))


conf("conf_rr3_seeded", lambda: rounding.random_rounding(F.col("n"), F.col("l_suppkey")), rr_sql("n", "l_suppkey", 3))
conf("conf_rr3_threshold", lambda: rounding.random_rounding(F.col("small"), F.col("l_suppkey"), 3, [6, 20]), rr_sql("small", "l_suppkey", 3, [6, 20]))
conf("conf_rr_base_n", lambda: rounding.random_rounding(F.col("n"), F.col("l_suppkey"), 7), rr_sql("n", "l_suppkey", 7))
conf("conf_grr_seeded", lambda: rounding.graduated_random_rounding(F.col("total"), F.col("l_suppkey")), grr_sql("total", "l_suppkey"))
conf("conf_grr_threshold", lambda: rounding.graduated_random_rounding(F.col("small"), F.col("l_suppkey"), [20, 42]), grr_sql("small", "l_suppkey", [20, 42]))
conf("conf_negative", lambda: rounding.random_rounding(F.lit(30) - F.col("small"), F.col("l_suppkey")), rr_sql("30 - small", "l_suppkey", 3))
for _b in (10, 100, 1000):
    conf(f"conf_conv{_b}", lambda b=_b: rounding.conventional_rounding(F.col("total") * 5, b), f"(round_even(total * 5 / {_b}.0, 0) * {_b}.0)::DOUBLE")
conf("conf_suppress", lambda: rounding.suppress_small(F.col("n"), F.col("small"), 20), "CASE WHEN coalesce(small, 0) >= 20 THEN n END")
conf("conf_suppress_na", lambda: rounding.suppress_small(F.col("n"), F.expr("nullif(small, 25)"), 20, 100), "CASE WHEN coalesce(nullif(small, 25), 100) >= 20 THEN n END")
conf("conf_suppress_text", lambda: rounding.suppress_small(F.concat(F.lit("s"), "l_suppkey"), F.col("small"), 30), "CASE WHEN small >= 30 THEN 's' || l_suppkey END")
conf("conf_stable_seeds", lambda: F.round(rounding.uniform(rounding.stable_seeds(F.col("small"), F.col("l_suppkey"))), 9),
     f"round({u_sql('CASE WHEN small >= 30 THEN $$0|v|$$ || small::DOUBLE ELSE $$0|r|$$ || l_suppkey END')}, 9)")
add("conf_missing_to", f"WITH t AS ({_COUNTS}) SELECT l_suppkey, coalesce(nullif(small, 7), 9999) AS small, round_even(coalesce(nullif(small, 7), 9999) / 10.0, 0)::DOUBLE * 10 AS conf_small FROM t",
    lambda s, d: run_confidential([{"cmd": "MISSING_TO", "small": "9999"}, {"cmd": "ROUND", "small": "conv10"}], counts(s, d).select("l_suppkey", F.expr("nullif(small, 7)").alias("small"))))
add("conf_rename_drop", f"WITH t AS ({_COUNTS}) SELECT l_suppkey, n AS number, CASE WHEN n >= 600 THEN round_even(n / 100.0, 0)::DOUBLE * 100 END AS conf_number FROM t",
    lambda s, d: run_confidential([{"cmd": "RENAME", "n": "number"}, {"cmd": "DROP", "small": "drop", "total": "TRUE"}, {"cmd": "ROUND", "n": "CONV100"}, {"cmd": "SUPPRESS", "n": "number < 600"}], counts(s, d)))
add("conf_full_control_file",
    f"WITH t AS ({_COUNTS}) SELECT l_suppkey, n, small AS few, total, CASE WHEN small >= 6 THEN {rr_sql('n', 'l_suppkey', 3)} END AS conf_n, CASE WHEN small >= 6 THEN {rr_sql('small', 'l_suppkey', 3, [6])} END AS conf_few, "
    f"CASE WHEN n >= 550 THEN {grr_sql('total', 'l_suppkey')} END AS conf_total FROM t",
    lambda s, d: run_confidential([
        {"cmd": "RENAME", "small": "few"}, {"cmd": "ROUND", "n": "RR3", "small": "rr3", "total": "GRR"}, {"cmd": "SEED", "n": "l_suppkey", "small": "l_suppkey", "total": "l_suppkey"},
        {"cmd": "SUPPRESS", "n": "few < 6", "small": "6 > few", "total": "n < 550"}, {"cmd": "NOTES", "n": "x"}], counts(s, d)))


# pipeline


def _scripts(files: dict[str, str]) -> str:
    folder = catalog_support.folder()
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of three batches: a view, a view on it, a query."""
    folder = _scripts({"a.sql": "/* parts */\nCREATE OR REPLACE TEMP VIEW big AS SELECT * FROM pipeline_orders WHERE o_totalprice > 100000 -- ;\nGO\nCREATE OR REPLACE TEMP VIEW by_status AS SELECT o_orderstatus AS status, count(*) AS n FROM big GROUP BY o_orderstatus;\nSELECT * FROM by_status\n"})
    table(spark, sf_dir, "orders").createOrReplaceTempView("pipeline_orders")
    out = None
    for batch in read_and_prepare_sql_code(os.path.join(folder, "a.sql")):
        out = spark.sql(batch.code)
    return out


_TSQL = """
-- limits by status, in a table of the script's own
DROP TABLE IF EXISTS #limits
CREATE TABLE #limits ([order status] VARCHAR(5), least FLOAT);
INSERT INTO #limits VALUES ('O', <LEAST>), ('F', 50000), ('P', NULL)

SELECT o.o_orderstatus AS status, ISNULL(o.o_orderpriority, N'none') AS [the priority], o.o_totalprice AS price
INTO #big
FROM [no_db].[global_temp].[script_orders] o WITH (NOLOCK)
INNER JOIN #limits l ON o.o_orderstatus = l.[order status]
WHERE o.o_totalprice > l.least
GO
UPDATE #big SET [the priority] = CONCAT('low', RIGHT([the priority], 3)) WHERE [the priority] = '5-LOW';
DELETE FROM #big WHERE status = 'F' AND [the priority] = '2-HIGH'
INSERT INTO #big (status, price)
SELECT TOP 1 'top', o_totalprice
FROM [script_orders_view]
ORDER BY o_totalprice DESC
GO
WITH counted AS (
    SELECT status, [the priority] AS priority, COUNT_BIG(*) AS n, CAST(ROUND(MAX(price), 2) AS FLOAT) AS most
    FROM #big
    GROUP BY status, [the priority]
)
SELECT * FROM counted WHERE n > IIF(status = 'top', 0, 1)
"""


def _tsql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script in SQL Server's style, with tables of its own and an injected value."""
    script, out = SqlScript(spark), None
    table(spark, sf_dir, "orders").createOrReplaceGlobalTempView("script_orders")
    script.session.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("script_orders_view")
    for batch in read_and_prepare_sql_code(os.path.join(_scripts({"a.sql": _TSQL}), "a.sql"), {"<LEAST>": "100000"}):
        if batch.code.strip():
            out = script.run(batch.code) or out
    return out


def _setvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scripts({"a.sql": ":setvar limit 200000\n:setvar col o_orderpriority\nSELECT $(col) AS priority, count(*) AS n FROM pipeline_orders WHERE o_totalprice > $(limit) GROUP BY $(col)\n"})
    table(spark, sf_dir, "orders").createOrReplaceTempView("pipeline_orders")
    (batch,) = (b for b in read_and_prepare_sql_code(os.path.join(folder, "a.sql")) if b.code.strip())
    return spark.sql(batch.code)


def _stop(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    folder = _scripts({"good.sql": "SELECT 1\n", "bad.sql": "SELECT * FROM no_such_table\n", "late.sql": "SELECT 2\n"})
    rows = [{"order": str(i), "folder": folder, "file": f} for i, f in ((3, "STOP IF ANY FAILURES"), (1, "good.sql"), (4, "late.sql"), (2, "bad.sql"))]
    return {r["file"]: str(r["status"]).split(":")[0] for r in run_pipeline(rows, spark).rows}


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_name").collect()]
    control = ControlTable(["ENABLED", "name", "status"], [{"ENABLED": "TRUE" if i % 2 == 0 else "no", "name": r, "status": "old"} for i, r in enumerate(regions)])
    progress = ControlTable(["name", "status"], [{"name": r, "status": "new"} for r in regions[:3]])
    merged = merge_progress(control, progress)
    return spark.createDataFrame([(r["name"], r["status"]) for r in merged.rows], "name string, status string")


add("pipeline_sql_batches", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus", _batches)
add("pipeline_tsql_own_tables",
    "WITH big AS (SELECT o_orderstatus AS status, CASE WHEN o_orderpriority = '5-LOW' THEN 'lowLOW' ELSE o_orderpriority END AS priority, o_totalprice AS price FROM orders WHERE o_totalprice > CASE o_orderstatus WHEN 'O' THEN 100000 WHEN 'F' THEN 50000 END), "
    "every AS (SELECT * FROM big WHERE NOT (status = 'F' AND priority = '2-HIGH') UNION ALL SELECT 'top', NULL, max(o_totalprice) FROM orders) "
    "SELECT status, priority, count(*) AS n, round(max(price), 2) AS most FROM every GROUP BY status, priority HAVING count(*) > CASE WHEN status = 'top' THEN 0 ELSE 1 END", _tsql)
add("pipeline_setvar", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority", _setvar)
catalog_support.check("pipeline_stop_on_failure", {"STOP IF ANY FAILURES": "Stopped", "good.sql": "Successful completion", "late.sql": "None", "bad.sql": "Stopped with error"}, _stop)
add("progress_merge", "SELECT r_name AS name, CASE WHEN (row_number() OVER (ORDER BY r_name)) % 2 = 0 THEN 'old' WHEN row_number() OVER (ORDER BY r_name) <= 3 THEN 'new' END AS status FROM region", _merge)


# all together


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' orders came to by year, summarised by segment and nation, and made confidential."""
    base = master(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    built = run_assembly(spark, [measure_row("COUNT", "INT", name="orders"), measure_row("SUM", "FLOAT", name="spent"), measure_row("ENTITY", "BIGINT", "[supp]", name="supplier")], base, {"spells": spells(spark, sf_dir)}).df
    summed = run_summary([
        {"LABEL": "by segment", "GROUP1": "c_mktsegment", "COUNT": "orders", "SUM": "orders", "ENTITY": "supplier", "SEED": "c_custkey"},
        {"LABEL": "by nation", "GROUP1": "c_nationkey", "COUNT": "orders", "SUM": "orders", "ENTITY": "supplier", "SEED": "c_custkey", "WHERE": "{y == 1996}"},
    ], built).df
    return run_confidential([
        {"cmd": "ROUND", "count": "RR3", "sum": "GRR"}, {"cmd": "SEED", "count": "seed", "sum": "seed"}, {"cmd": "SUPPRESS", "count": "count < 6", "sum": "entity < 2"}], summed)


_FLAG_BASE = (
    f"WITH m AS (SELECT a.*, c_mktsegment, c_nationkey FROM ({_MASTER.format('unnest([1996, 1997])')}) a JOIN customer USING (c_custkey)), s AS ({_SPELLS}), "
    "r AS (SELECT c_custkey, year_start, count(price)::INT AS orders, min(supp) AS s1, max(supp) AS s2 FROM (SELECT DISTINCT c_custkey, year_start, year_end FROM m) JOIN s ON c_custkey = o_custkey AND year_start <= ended AND began <= year_end GROUP BY c_custkey, year_start), "
    "b AS (SELECT m.*, orders, s1, s2 FROM m LEFT JOIN r ON m.c_custkey = r.c_custkey AND m.year_start = r.year_start), "
    "h AS (SELECT c_mktsegment, c_nationkey, y, c_custkey, orders, s1 AS e FROM b UNION ALL SELECT c_mktsegment, c_nationkey, y, NULL, NULL, s2 FROM b), "
)


def _flag_part(label: str, g: str, where: str) -> str:
    return f"SELECT '{label}' AS label, '{g}' AS grplabel1, {g}::VARCHAR AS group1, count(orders) AS count, coalesce(sum(orders), 0)::BIGINT AS sum, nullif(count(DISTINCT e), 0) AS entity, coalesce(sum(c_custkey % 100), 0)::BIGINT AS seed FROM h {where} GROUP BY {g}"


add("flagship_end_to_end",
    _FLAG_BASE + f"u AS ({_flag_part('by segment', 'c_mktsegment', '')} UNION ALL {_flag_part('by nation', 'c_nationkey', 'WHERE y = 1996')}) "
    f"SELECT *, CASE WHEN count >= 6 THEN {rr_sql('count', 'seed', 3, [6])} END AS conf_count, CASE WHEN coalesce(entity, 0) >= 2 THEN {grr_sql('sum', 'seed')} END AS conf_sum FROM u",
    flagship)

__all__ = ["ORACLES", "QUERIES", "flagship"]

"""Registered queries over the star schema, each with its DuckDB SQL.

Relational families are written once as Spark SQL text or DataFrame code and once as
DuckDB SQL; the audit, lake and format operators are run through their real code.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, csvguard, discovery, docs, lake, lakemap, slicing
from ..operators.rules import parse_rule
from ..sources import files, readers, registry
from . import relational, sqlgate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


# --- rule audits --------------------------------------------------------------

RULES = ("l_quantity >= 10", "l_discount <= 0.05", "l_returnflag == 'N'")
CODE_SQL = "(case when coalesce(l_quantity >= 10, false) then 0 else 1 end + case when coalesce(l_discount <= 0.05, false) then 0 else 2 end + case when coalesce(l_returnflag = 'N', false) then 0 else 4 end)"


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flag_rules(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"), RULES)


@query(f"select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, ({CODE_SQL})::bigint as audit_error_code from lineitem")
def rule_audit_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).drop(audit.CLEAN)


@query(f"select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag from lineitem where {CODE_SQL} = 0")
def rule_audit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split(_audited(spark, sf_dir))[0]


@query(f"select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, ({CODE_SQL})::bigint as audit_error_code from lineitem where {CODE_SQL} <> 0")
def rule_audit_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split(_audited(spark, sf_dir))[1]


@query(f"select ({CODE_SQL})::bigint as audit_error_code, count(*)::bigint as n from lineitem group by 1")
def rule_audit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).groupBy("audit_error_code").agg(F.count("*").alias("n"))


MANY = tuple(f"l_quantity {'>=' if i % 2 else '<'} {i % 50}" if i % 3 else f"l_partkey != {i * 7}" for i in range(70))
MANY_SQL = ", ".join(f"case when not ({r.replace('!=', '<>')}) then {i} end" for i, r in enumerate(MANY))


@query(f"select l_orderkey, l_linenumber, list_filter([{MANY_SQL}], lambda x: x is not null) as audit_violated_rules from lineitem")
def rule_audit_70_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return audit.flag_rules(df, MANY).select("l_orderkey", "l_linenumber", "audit_violated_rules")


@query("select count(*)::bigint as total_rows, count(*)::bigint as clean_rows, 0::bigint as trash_rows from lineitem")
def rule_audit_missing_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.flag_rules(table(spark, sf_dir, "lineitem"), ["no_such_column > 5"]))


@query("select count(*)::bigint as total_rows, count(*)::bigint as clean_rows, 0::bigint as trash_rows from lineitem")
def rule_audit_bad_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.flag_rules(table(spark, sf_dir, "lineitem"), ["l_linenumber >= 2.5", "l_quantity > abc"]))


@query("select o_orderstatus, (case when o_orderstatus >= 'O' then 0 else 1 end + case when o_orderpriority <> '5-LOW' then 0 else 2 end)::bigint as audit_error_code, count(*)::bigint as n from orders group by 1, 2")
def rule_audit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = audit.flag_rules(table(spark, sf_dir, "orders"), ["o_orderstatus >= O", "o_orderpriority != '5-LOW'"])
    return flagged.groupBy("o_orderstatus", "audit_error_code").agg(F.count("*").alias("n"))


@query("select event_id, (case when coalesce(nullif(user_id % 7, 0) <> 3, false) then 0 else 1 end + case when coalesce(case when user_id % 5 = 0 then null else value end > 50, false) then 0 else 2 end)::bigint as audit_error_code from events")
def rule_audit_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.expr("nullif(user_id % 7, 0)").alias("k"), F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END").alias("v"))
    return audit.flag_rules(df, ["k != 3", "v > 50"]).select("event_id", "audit_error_code")


STATIC = audit.Thresholds(1, 5, 20000.0, 100.0, "passenger", "fare", "distance")


@query("select code as audit_error_code, count(*)::bigint as n from (select (case when l_linenumber::bigint between 1 and 5 then 0 else 1 end + case when l_extendedprice < 20000.0 then 2 else 0 end + case when l_extendedprice < 20000.0 and l_quantity > 0 then 4 else 0 end)::bigint as code from lineitem) group by 1")
def static_audit_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("passenger"), F.col("l_extendedprice").alias("fare"), F.col("l_quantity").alias("distance"))
    return audit.flag_static(df, STATIC).groupBy("audit_error_code").agg(F.count("*").alias("n"))


@query("select l_linenumber::bigint as passenger, l_extendedprice as fare, l_quantity as distance from lineitem where l_linenumber between 1 and 5 and l_extendedprice >= 20000.0")
def static_audit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("passenger"), F.col("l_extendedprice").alias("fare"), F.col("l_quantity").alias("distance"))
    return audit.split(audit.flag_static(df, STATIC))[0]


@query("select 1::bigint as total_files, 0::bigint as pruned_dirs, count(*)::bigint as total_rows, count(case when o_totalprice > 100000 and o_orderstatus <> 'P' then 1 end)::bigint as clean_rows, count(case when not (o_totalprice > 100000 and o_orderstatus <> 'P') then 1 end)::bigint as trash_rows from orders")
def filter_summary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lake.filter_files(spark, f"{sf_dir}/orders.parquet", ["o_totalprice > 100000", "o_orderstatus != 'P'"])
    return spark.createDataFrame([tuple(found.values())], "total_files long, pruned_dirs long, total_rows long, clean_rows long, trash_rows long")


# --- slices and samples ---------------------------------------------------------


@query("select * exclude (o_orderdate), strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders limit 50 offset 1200")
def slice_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.slice_rows(spark, f"{sf_dir}/orders.parquet", 1200, 50).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("select c_name, c_custkey from customer limit 20 offset 100")
def slice_cols_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.slice_rows(spark, f"{sf_dir}/customer.parquet", 100, 20, ["c_name", "c_custkey"])


@query("select p_partkey, p_name, p_size from part where p_partkey is not null limit 10")
def preview_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.preview(spark, f"{sf_dir}/part.parquet", 10)[0].select("p_partkey", "p_name", "p_size")


# --- SQL over paths ---------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 order by o_totalprice desc, o_orderkey")
def sql_path_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT o_orderkey, o_totalprice FROM '{sf_dir}/orders.parquet' WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey")


@query("select c_mktsegment, count(*)::bigint as n, round(avg(c_acctbal), 2) as avg_balance from customer group by 1")
def sql_path_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"""SELECT "c_mktsegment", COUNT(*) AS n, ROUND(AVG(c_acctbal), 2) AS avg_balance FROM '{sf_dir}/customer.parquet' GROUP BY c_mktsegment""")


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def sql_path_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT a.n_name AS a, b.n_name AS b FROM '{sf_dir}/nation.parquet' a JOIN '{sf_dir}/nation.parquet' b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("with big as (select * from orders where o_totalprice > 150000) select o_orderstatus, count(*)::bigint as n, 'from ''x''' as note from big group by 1")
def sql_path_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"WITH big AS (SELECT * FROM '{sf_dir}/orders.parquet' WHERE o_totalprice > 150000) SELECT o_orderstatus, COUNT(*) AS n, 'from ''x''' AS note FROM big GROUP BY o_orderstatus")


@query("select r_name, count(*)::bigint as n from nation join region on n_regionkey = r_regionkey group by 1")
def sql_path_two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT r_name, COUNT(*) AS n FROM '{sf_dir}/nation.parquet', '{sf_dir}/region.parquet' WHERE n_regionkey = r_regionkey GROUP BY r_name")


@query("select approx_n > 0 as found, strpos(max_name, 'C')::int as place from (select count(distinct c_name) as approx_n, max(c_name) as max_name from customer)")
def sql_path_renamed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT approx_distinct(c_name) > 0 AS found, strpos(max(c_name), 'C') AS place FROM '{sf_dir}/customer.parquet'")


# --- lake operators ------------------------------------------------------------------


@query("select n_nationkey, n_name, n_regionkey, null::bigint as s_suppkey from nation union all select null, null, null, s_suppkey from supplier")
def union_by_name_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.union([table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").select("s_suppkey")])


NUMBER_SQL = csvguard.NUMBER.replace("'", "''")


@query(f"select doc_id, md5(cell) as cell from (select doc_id, case when left(t, 1) in ('=', '+', '@') or (left(t, 1) = '-' and not regexp_matches(t, '{NUMBER_SQL}')) then '''' || t else t end as cell from (select doc_id, case doc_id % 6 when 0 then '=' when 1 then '+' when 2 then '@' when 3 then '-' else '' end || case when doc_id % 12 = 3 then doc_id::varchar else text end as t from documents))")
def csv_guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("concat(CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' WHEN 3 THEN '-' ELSE '' END, CASE WHEN doc_id % 12 = 3 THEN CAST(doc_id AS STRING) ELSE text END)")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(csvguard.guarded(t)).alias("cell"))


@query("select (row_index // 700)::bigint as part, count(*)::bigint as n, min(o_orderkey) as least, max(o_orderkey) as most from (select o_orderkey, row_number() over () - 1 as row_index from orders) group by 1")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "orders").select("o_orderkey", F.col("_metadata.row_index").alias("__row"))
    return lake.part_numbers(numbered, 700).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("select count(*)::bigint as total_rows, min(c_custkey) as \"min:c_custkey\", max(c_custkey) as \"max:c_custkey\", min(c_name) as \"min:c_name\", max(c_name) as \"max:c_name\", min(c_acctbal) as \"min:c_acctbal\", max(c_acctbal) as \"max:c_acctbal\", min(c_mktsegment) as \"min:c_mktsegment\", max(c_mktsegment) as \"max:c_mktsegment\" from customer")
def lake_map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lakemap.column_bounds(table(spark, sf_dir, "customer"))


@query("select coalesce(d.p, m.p) as rel_path, case when m.p is null then 'unindexed' when d.p is null then 'missing' when d.s = m.s and d.t = m.t then 'healthy' else 'modified' end as status from (select 'f' || n_nationkey as p, n_nationkey::bigint as s, 5::bigint as t from nation where n_nationkey < 20) d full join (select 'f' || n_nationkey as p, (n_nationkey + (n_nationkey % 7 = 6)::int)::bigint as s, 5::bigint as t from nation where n_nationkey >= 4) m on d.p = m.p")
def doctor_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    disk = nation.where("n_nationkey < 20").selectExpr("concat('f', n_nationkey) AS rel_path", "CAST(n_nationkey AS BIGINT) AS size_bytes", "5L AS mtime_ms")
    mapped = nation.where("n_nationkey >= 4").selectExpr("concat('f', n_nationkey) AS rel_path", "CAST(n_nationkey + CAST(n_nationkey % 7 = 6 AS INT) AS BIGINT) AS size_bytes", "5L AS mtime_ms")
    return lakemap.classify(disk, mapped)


@query("select 6::bigint as total_files, (select count(*) from nation) + (select count(*) from region) + (select count(*) from supplier) + (select count(*) from customer) + (select count(*) from part) + (select count(*) from orders) as total_rows")
def lake_map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{sf_dir}/{n}.parquet" for n in ("nation", "region", "supplier", "customer", "part", "orders")]
    entries = lakemap._entries(spark, sf_dir, paths)[0]
    rows = [(e["rel_path"], e["size_bytes"], e["mtime_ms"], e["total_rows"], e["stats_json"]) for e in entries]
    frame = spark.createDataFrame(rows, "rel_path string, size_bytes long, mtime_ms long, total_rows long, stats_json string")
    return lakemap.totals(frame).select("total_files", "total_rows")


@query("select * from (values ('order_items', 'orders', 'orders_id'), ('order_items', 'products', 'products_id'), ('orders', 'users', 'users_id'), ('payments', 'orders', 'orders_id')) t(source, target, label)")
def er_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"users": ["id", "username"], "products": ["id", "price"], "orders": ["id", "user_id"], "order_items": ["id", "order_id", "product_id"], "payments": ["id", "order_id"]}
    return spark.createDataFrame(docs.edges(tables), "source string, target string, label string")


@query("select * from (values (1::bigint, 'n_nationkey', 'int', 'Yes'), (2, 'n_name', 'string', 'Yes'), (3, 'n_regionkey', 'int', 'Yes')) t(number, name, type, nullable)")
def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(docs.dictionary_rows(table(spark, sf_dir, "nation").schema), "number long, name string, type string, nullable string")


@query("select * from (values ('year=2026/month=08/a.csv', true), ('year=2025/month=08/a.csv', false), ('month=8/YEAR=2026/a.csv', true), ('a.csv', true)) t(path, fits)")
def partition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [parse_rule("year >= 2026"), parse_rule("month == '08'")]
    paths = ["year=2026/month=08/a.csv", "year=2025/month=08/a.csv", "month=8/YEAR=2026/a.csv", "a.csv"]
    return spark.createDataFrame([(p, all(discovery.rule_fits(r, discovery.partitions(p)) for r in rules)) for p in paths], "path string, fits boolean")


# --- formats: written and read back ------------------------------------------------

FLAT = "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def _roundtrip(name: str, write: Callable[[DataFrame, str], None], extension: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        write(_flat(spark, sf_dir), f"{folder}/{name}.{extension}")
        return readers.read_file(spark, f"{folder}/{name}.{extension}", typed=True).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

    run.__name__ = f"roundtrip_{name}"
    query(FLAT)(run)


_roundtrip("parquet", lambda df, p: df.write.parquet(p), "parquet")
_roundtrip("orc", lambda df, p: df.write.orc(p), "orc")
_roundtrip("csv", lambda df, p: df.write.option("header", True).csv(p), "csv")
_roundtrip("tsv", lambda df, p: df.write.option("header", True).option("sep", "\t").csv(p), "tsv")
_roundtrip("psv", lambda df, p: df.write.option("header", True).option("sep", "|").csv(p), "psv")
_roundtrip("txt", lambda df, p: df.write.option("header", True).option("sep", ";").csv(p), "txt")


def _roundtrip_lines(name: str, extension: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        _flat(spark, sf_dir).coalesce(1).write.json(f"{folder}/stage")
        made = next(c.path for c in files.children(spark, f"{folder}/stage") if c.path.rpartition("/")[2].startswith("part-"))
        files.move(spark, made, f"{folder}/one.{extension}")
        return readers.read_file(spark, f"{folder}/one.{extension}").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

    run.__name__ = f"roundtrip_{name}"
    query(FLAT)(run)


_roundtrip_lines("json", "ndjson")
_roundtrip_lines("jsonl", "jsonl")


@query(FLAT)
def roundtrip_own_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register_delimited("caret", "^")
    path = f"{scratch(spark)}/t.caret"
    _flat(spark, sf_dir).write.option("header", True).option("sep", "^").csv(path)
    return readers.read_file(spark, path, typed=True).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# --- lake operators on written folders ---------------------------------------------


def _by_nation(spark: SparkSession, sf_dir: str) -> str:
    """Customers as a Hive folder, a file a nation."""
    folder = f"{scratch(spark)}/lake"
    table(spark, sf_dir, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(folder)
    return folder


PASSENGERS = "l_linenumber between 1 and 5 and l_extendedprice >= 20000.0"


def _trips(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{scratch(spark)}/trips"
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("passenger"), F.col("l_extendedprice").alias("fare"), F.col("l_quantity").alias("distance"), "l_orderkey")
    rows.withColumn("returned", F.col("l_orderkey") % 3).write.partitionBy("returned").parquet(folder)
    return folder


def _of_folder(spark: SparkSession, folder: str, side: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("returned").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"), F.sum("passenger").alias("passengers")).withColumn("side", F.lit(side))


SIDE_SQL = "select (l_orderkey % 3)::int as returned, count(*)::bigint as n, min(l_orderkey) as least, sum(l_linenumber)::bigint as passengers, case when {0} then 'clean' else 'trash' end as side from lineitem {1} group by 1, 5"


@query(SIDE_SQL.format(PASSENGERS, ""))
def lake_clean_and_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _trips(spark, sf_dir)
    lake.write_clean_and_trash(spark, folder, f"{folder}-clean", f"{folder}-trash", thresholds=STATIC)
    return _of_folder(spark, f"{folder}-clean", "clean").unionByName(_of_folder(spark, f"{folder}-trash", "trash"))


@query(SIDE_SQL.format(PASSENGERS, f"where {PASSENGERS}"))
def lake_gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _trips(spark, sf_dir)
    lake.write_gold(spark, folder, f"{folder}-gold", "1.0", thresholds=STATIC)
    return _of_folder(spark, f"{folder}-gold", "clean")


@query("select (row_index // 4000 + 1)::bigint as part, count(*)::bigint as n, min(row_index)::bigint as least, max(o_orderkey) as most from (select o_orderkey, row_number() over () - 1 as row_index from orders) group by 1")
def lake_split_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/split"
    lake.split_file(spark, f"{sf_dir}/orders.parquet", 4000, folder)
    read = spark.read.parquet(f"{folder}/*.parquet").select("o_orderkey", F.regexp_extract("_metadata.file_path", r"_part_(\d+)\.", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row"))
    return read.groupBy("part").agg(F.count("*").alias("n"), ((F.col("part") - 1) * 4000 + F.min("row")).alias("least"), F.max("o_orderkey").alias("most"))


@query(FLAT)
def lake_ingest_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/raw"
    _flat(spark, sf_dir).write.option("header", True).csv(folder)
    lake.ingest(spark, folder, f"{folder}-lake", normalize=True)
    return spark.read.parquet(f"{folder}-lake").selectExpr("CAST(c_custkey AS BIGINT) AS c_custkey", "c_name", "CAST(c_nationkey AS BIGINT) AS c_nationkey", "CAST(c_acctbal AS DOUBLE) AS c_acctbal", "c_mktsegment")


@query("select count(distinct case when c_nationkey >= 10 then c_nationkey end)::bigint as total_files, count(distinct case when c_nationkey < 10 then c_nationkey end)::bigint as pruned_dirs, count(case when c_nationkey >= 10 then 1 end)::bigint as total_rows, count(case when c_nationkey >= 10 and c_acctbal > 0 then 1 end)::bigint as clean_rows, count(case when c_nationkey >= 10 and not c_acctbal > 0 then 1 end)::bigint as trash_rows from customer")
def filter_pruned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lake.filter_files(spark, _by_nation(spark, sf_dir), ["c_nationkey >= 10", "c_acctbal > 0"])
    return spark.createDataFrame([tuple(found.values())], "total_files long, pruned_dirs long, total_rows long, clean_rows long, trash_rows long")


@query("select * from (select 'healthy' as status, count(distinct c_nationkey)::bigint as n from customer where c_nationkey <> 0 union all select 'missing', count(distinct c_nationkey)::bigint from customer where c_nationkey = 0 union all select 'unindexed', 1::bigint union all select 'rows after healing', (select count(*) from customer where c_nationkey <> 0) + (select count(*) from nation))")
def lake_doctor_heals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _by_nation(spark, sf_dir)
    lakemap.create_map(spark, folder)
    files.delete(spark, f"{folder}/c_nationkey=0")
    lake.write_file(spark, table(spark, sf_dir, "nation"), f"{folder}/new.parquet")
    report = lakemap.doctor(spark, folder, heal=True)
    rows = [("healthy", report["healthy_files"]), *((s, len(report[f"{s}_files"])) for s in ("missing", "unindexed"))]
    total = lakemap.totals(lakemap.map_frame(spark, folder)).select(F.lit("rows after healing").alias("status"), F.col("total_rows").alias("n"))
    return spark.createDataFrame(rows, "status string, n long").union(total)


@query("select c_mktsegment, count(*)::bigint as n from customer where c_acctbal > 0 group by 1")
def sql_path_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT c_mktsegment, COUNT(*) AS n FROM '{_by_nation(spark, sf_dir)}' WHERE c_acctbal > 0 GROUP BY 1")


@query("select time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00') as bin, count(*)::bigint as n from events group by 1")
def sql_path_date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT date_bin(INTERVAL '15' MINUTE, ts) AS bin, COUNT(*) AS n FROM '{sf_dir}/events.parquet' GROUP BY 1")


@query("select c_custkey, len(string_split(c_name, '#'))::int as parts, len(range(3, c_nationkey::bigint + 1))::int as steps from customer")
def sql_path_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlgate.query(spark, f"SELECT c_custkey, size(string_to_array(c_name, '#')) AS parts, size(generate_series(3, c_nationkey)) AS steps FROM '{sf_dir}/customer.parquet'")


relational.register(query)

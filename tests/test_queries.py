"""Every registered query against its SQL in DuckDB."""

import collections
import os

import pytest

import __spark_entry__ as entry
from quarrylake.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_whole_full_join_keeps_every_row(spark, data):
    got = QUERIES["join_full"](spark, data)
    for column, table in (("c_custkey", "customer"), ("o_orderkey", "orders")):
        assert got.select(column).where(f"{column} is not null").distinct().count() == spark.read.parquet(f"{data}/{table}.parquet").count()
    assert got.where("c_custkey is null").count() and got.where("o_orderkey is null").count()


#: Texts that the gate rewrites, or has to leave as they are.
REWRITTEN = [
    "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders} -- all\n WHERE o_totalprice > 1000 QUALIFY rn <= 2 -- two\n ORDER BY o_totalprice DESC, 2 LIMIT 50;",
    "SELECT DISTINCT c_nationkey FROM {customer} QUALIFY DENSE_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) < 4 ORDER BY c_nationkey",
    "SELECT DISTINCT ON (1) c_nationkey AS k, c_custkey, c_acctbal AS b FROM {customer} WHERE c_acctbal IS DISTINCT FROM 0 ORDER BY k DESC NULLS LAST, b, c_custkey LIMIT 7",
    "SELECT n_name AS a FROM {nation} QUALIFY ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1 UNION ALL SELECT c_name FROM {customer} QUALIFY ROW_NUMBER() OVER (ORDER BY c_name) = 1",
    "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT c_nationkey FROM {customer} QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 ORDER BY k DESC LIMIT 9",
    "SELECT *, SUM(n_nationkey) OVER w AS s FROM {nation} WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey) QUALIFY COUNT(*) OVER w = 2",
    "SELECT x FROM (SELECT n_name AS x, n_regionkey AS {word} FROM {nation}) WHERE {word} = 1 ORDER BY x",
    "SELECT q.k FROM (SELECT n_regionkey AS k, n_nationkey FROM {nation} QUALIFY ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1) q JOIN {nation} n ON n.n_nationkey = q.n_nationkey ORDER BY q.k",
    "SELECT n_name FROM {nation} WHERE n_comment_of = ' QUALIFY 1 ' OR n_regionkey = 2 ORDER BY n_name".replace("n_comment_of", "n_name"),
]


@pytest.mark.parametrize("text", REWRITTEN)
def test_qualify_and_distinct_on(spark, data, duck, text):
    from quarrylake.errors import QueryError
    from quarrylake.plans import sqlgate

    got = sqlgate.query(spark, text.format(word="qualify", **{t: f"'{data}/{t}.parquet'" for t in TABLES}))
    want = duck.sql(text.format(word='"qualify"', **{t: t for t in TABLES}))
    assert got.columns == want.columns
    found, wanted = ([tuple(map(plain, r)) for r in x] for x in (got.collect(), want.fetchall()))
    assert found == wanted if "ORDER BY" in text.rsplit(")", 1)[-1] else sorted(found) == sorted(wanted)
    with pytest.raises(QueryError):
        sqlgate.query(spark, f"SELECT DISTINCT ON (n_name) n_name FROM '{data}/nation.parquet' QUALIFY 1 = 1")


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_plans_push_down(spark, data):
    plan = QUERIES["sql_path_filter_sort"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    audit_plan = QUERIES["rule_audit_histogram"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in audit_plan and "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in audit_plan


def test_rest_does_not_import_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "quarrylake")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read(), n

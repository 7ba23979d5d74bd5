"""Queries by name over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.spatial import point
from quarry.schema import DataType, IndexKind, SchemaBuilder
from quarry.session import Session
from quarry.sources.files import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: The key of each table, in whose order rows stand; lineitem has none.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "labels": "doc_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registered(spark: SparkSession, sf_dir: str, name: str) -> Session:
    session = Session(spark, f"{shared_folder(spark)}/quarry-tables-{uuid.uuid4().hex}")
    df = _table(spark, sf_dir, name)
    if name == "part":
        df = df.select("p_partkey", point("p_size", "p_retailprice").alias("at"), "p_size", "p_retailprice")
    if name == "events":
        df = df.select("event_id", point("user_id", "value").alias("at"))
    if name == "labels":
        df = df.withColumn("good", F.col("quality") == 1)
    session.register(name, df, KEYS.get(name, ()))
    return session


def _flat(df: DataFrame) -> DataFrame:
    """Points as two columns."""
    return df.select(*[c for c in df.columns if c != "at"], *([F.col("at.x").alias("x"), F.col("at.y").alias("y")] if "at" in df.columns else []))


def _select(table: str, sql: str) -> Query:
    return lambda spark, sf_dir: _flat(_registered(spark, sf_dir, table).frame(sql))


_POINTS = "(SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part)"
_EVENTS = "(SELECT event_id, user_id::DOUBLE AS x, value AS y FROM events)"
_D = "(x - 25.0::DOUBLE) * (x - 25.0::DOUBLE) + (y - 950.5::DOUBLE) * (y - 950.5::DOUBLE)"
_NEAR = f"{_D} <= (SELECT max(d) FROM (SELECT {_D} AS d FROM {_POINTS} ORDER BY d LIMIT 7))"
_PARTS = f"SELECT p_partkey, x, y FROM {_POINTS} WHERE "

#: name: (table, statement, SQL twin; None: the statement itself).
SELECTS: dict[str, tuple[str, str, str | None]] = {
    "scan_all": ("nation", "SELECT * FROM nation", None),
    "project_cols": ("customer", "SELECT c_name, c_custkey FROM customer", None),
    "filter_eq": ("orders", "SELECT * FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_neq": ("orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_lt": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice < 100000.0", None),
    "filter_gt": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.0", None),
    "filter_le": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 150000.5", None),
    "filter_ge": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000.5", None),
    "filter_between": ("part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", None),
    "filter_between_reversed": ("part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 20 AND 10", None),
    "filter_between_varchar": ("customer", "SELECT c_name FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000900'", None),
    "filter_bool": ("labels", "SELECT doc_id FROM labels WHERE good", "SELECT doc_id FROM labels WHERE quality = 1"),
    "filter_and": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40.0 AND l_returnflag = 'R'", None),
    "filter_or": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49.0 OR l_discount = 0.0", None),
    "filter_not": ("lineitem", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE NOT l_tax <= 0.05", None),
    "filter_nested": ("lineitem", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_quantity < 5.0 OR NOT (l_returnflag = 'N' AND l_tax BETWEEN 0.02 AND 0.06)) AND l_linenumber <> 3", None),
    "precedence": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND NOT o_totalprice < 200000.0", None),
    "point_eq": ("part", "SELECT p_partkey, at FROM part WHERE at = (28.0, 900.1)", _PARTS + "x = 28.0 AND y = 900.1"),
    "point_neq": ("part", "SELECT p_partkey, at FROM part WHERE at != (28.0, 900.1)", _PARTS + "NOT (x = 28.0 AND y = 900.1)"),
    "within_rectangle": ("part", "SELECT p_partkey, at FROM part WHERE at WITHIN RECTANGLE (10.0, 920.0, 30.0, 960.0)", _PARTS + "x BETWEEN 10.0 AND 30.0 AND y BETWEEN 920.0 AND 960.0"),
    "within_circle": ("part", "SELECT p_partkey, at FROM part WHERE at WITHIN CIRCLE (25.0, 950.5, 30.0)", _PARTS + f"{_D} <= 900.0"),
    "within_circle_events": ("events", "SELECT event_id, at FROM events WHERE at WITHIN CIRCLE (50.0, 50.0, 25.5)", f"SELECT event_id, x, y FROM {_EVENTS} WHERE (x - 50.0::DOUBLE) * (x - 50.0::DOUBLE) + (y - 50.0::DOUBLE) * (y - 50.0::DOUBLE) <= 25.5::DOUBLE * 25.5::DOUBLE"),
    "knn": ("part", "SELECT p_partkey, at FROM part WHERE at KNN (25.0, 950.5, 7)", _PARTS + _NEAR),
    "knn_and_filter": ("part", "SELECT p_partkey, at FROM part WHERE p_size > 24 AND at KNN (25.0, 950.5, 7)", _PARTS + f"x > 24 AND {_NEAR}"),
    "not_knn": ("part", "SELECT p_partkey, at FROM part WHERE NOT at KNN (25.0, 950.5, 7)", _PARTS + f"NOT ({_NEAR})"),
    "knn_more_than_table": ("part", "SELECT p_partkey FROM part WHERE at KNN (0.0, 0.0, 100000000)", "SELECT p_partkey FROM part"),
    "rect_or_circle": ("part", "SELECT p_partkey, at FROM part WHERE at WITHIN RECTANGLE (1.0, 900.0, 5.0, 950.0) OR at WITHIN CIRCLE (25.0, 950.5, 12.5)", _PARTS + f"x BETWEEN 1.0 AND 5.0 AND y BETWEEN 900.0 AND 950.0 OR {_D} <= 156.25"),
    "order_asc": ("supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal", None),
    "order_desc": ("supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC", None),
    "order_hidden": ("supplier", "SELECT s_name FROM supplier ORDER BY s_acctbal LIMIT 9", "SELECT s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 9"),
    "limit_only": ("region", "SELECT * FROM region LIMIT 3", "SELECT * FROM region ORDER BY r_regionkey LIMIT 3"),
    "topk_asc": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10"),
    "topk_desc": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "topk_most": ("orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey LIMIT 14000", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 14000"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(*SELECTS["topk_desc"][:2])(spark, sf_dir)


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.ordering import page
    from quarry.plans.parser import parse

    planned = _registered(spark, sf_dir, "orders").plan(parse("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate")[0])
    return planned.project(page(planned.rows, planned.keys, 100, 50))


def _declared(spark: SparkSession) -> Session:
    return Session(spark, f"{shared_folder(spark)}/quarry-tables-{uuid.uuid4().hex}")


def _must(session: Session, sql: str) -> None:
    result, message = session.execute_sql(sql)
    if "successful" not in message:
        raise RuntimeError(message)


def _csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _declared(spark)
    path = f"{session.catalog.warehouse}-csv"
    _table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    _must(session, "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(40), n_regionkey INT)")
    session.import_csv("nation", path)
    return session.frame("SELECT * FROM nation")


def _create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _declared(spark)
    _must(
        session,
        "CREATE TABLE t (id INT PRIMARY KEY INDEX BTREE, name VARCHAR(10), score FLOAT, ok BOOL, day DATE, at POINT INDEX RTREE);"
        "INSERT INTO t VALUES (1, 'one', 1.5, TRUE, '2024-02-29', (1.0, 2.5)); INSERT INTO t VALUES (-1, '', -2.25, FALSE, '1999-12-31', (0.0, -3.0));",
    )
    return _flat(session.frame("SELECT id, name, score, ok, at FROM t"))


def _insert_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _declared(spark)
    _must(session, "CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(10)); INSERT INTO t (name, id) VALUES ('two', 2); INSERT INTO t (id, name) VALUES (2, 'again')")
    return session.frame("SELECT * FROM t")


def _suppliers(spark: SparkSession, sf_dir: str) -> Session:
    session = _declared(spark)
    _must(session, "CREATE TABLE supplier (s_suppkey INT PRIMARY KEY, s_name VARCHAR(30), s_nationkey INT)")
    session.import_frame("supplier", _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    return session


def _after(statement: str, then: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _suppliers(spark, sf_dir)
        _must(session, statement)
        return session.frame(then)

    return run


def _script_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = _registered(spark, sf_dir, "nation").execute_sql("SELECT * FROM nation; -- the last counts\nSELECT n_name FROM nation WHERE n_regionkey = 1;")
    return spark.createDataFrame([tuple(r) for r in result["records"]], "n_name string")


def _indexed_orders(kind: str, where: str, drop: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _declared(spark)
        session.catalog.create(SchemaBuilder("orders").column("o_orderkey", DataType.INT, primary=True).column("o_custkey", DataType.INT).column("o_orderstatus", DataType.VARCHAR, length=1).build())
        session.import_frame("orders", _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
        _must(session, f"CREATE INDEX i ON orders USING {kind} (o_custkey)")
        if drop:
            _must(session, "DROP INDEX i ON orders")
        return session.frame(f"SELECT * FROM orders WHERE {where}")

    return run


def _indexed_points(where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _declared(spark)
        session.catalog.create(SchemaBuilder("part").column("p_partkey", DataType.INT, primary=True).column("at", DataType.POINT).build())
        session.import_frame("part", _table(spark, sf_dir, "part").select("p_partkey", point("p_size", "p_size").alias("at")))
        _must(session, "CREATE INDEX i ON part (at)")
        return _flat(session.frame(f"SELECT * FROM part WHERE {where}"))

    return run


_GRID = "(SELECT p_partkey, p_size::DOUBLE AS x, p_size::DOUBLE AS y FROM part)"
_GRID_D = "(x - 20.0) * (x - 20.0) + (y - 20.0) * (y - 20.0)"
_ORDER_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE "
_INDEX_KINDS = [k.value.lower() for k in IndexKind if k not in (IndexKind.NONE, IndexKind.RTREE)]

#: name: (query, SQL twin) of what is more than one SELECT.
OTHERS: dict[str, tuple[Query, str]] = {
    "page_offset": (_page, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100"),
    "csv_import": (_csv_import, "SELECT * FROM nation"),
    "create_insert_select": (_create_insert, "SELECT * FROM (VALUES (1, 'one', 1.5::DOUBLE, true, 1.0::DOUBLE, 2.5::DOUBLE), (-1, '', -2.25, false, 0.0, -3.0)) t(id, name, score, ok, x, y)"),
    "insert_reordered_columns": (_insert_reordered, "SELECT * FROM (VALUES (2, 'two'), (2, 'again')) t(id, name)"),
    "delete_where": (_after("DELETE FROM supplier WHERE s_nationkey < 10", "SELECT * FROM supplier"), "SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey FROM supplier WHERE NOT s_nationkey < 10"),
    "delete_not": (_after("DELETE FROM supplier WHERE NOT s_nationkey BETWEEN 5 AND 15", "SELECT s_suppkey, s_nationkey FROM supplier"), "SELECT s_suppkey::INT AS s_suppkey, s_nationkey FROM supplier WHERE s_nationkey BETWEEN 5 AND 15"),
    "delete_reinsert": (_after("DELETE FROM supplier WHERE s_suppkey > 5; INSERT INTO supplier VALUES (7, 'seven', 1)", "SELECT s_suppkey, s_name FROM supplier"), "SELECT s_suppkey::INT AS s_suppkey, s_name FROM supplier WHERE s_suppkey <= 5 UNION ALL SELECT 7, 'seven'"),
    "drop_if_exists": (_after("DROP TABLE IF EXISTS nothing; CREATE TABLE IF NOT EXISTS supplier (x INT PRIMARY KEY)", "SELECT s_suppkey FROM supplier LIMIT 4"), "SELECT s_suppkey::INT AS s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 4"),
    "script_last_result": (_script_last, "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "drop_index_same_result": (_indexed_orders("BTREE", "o_custkey >= 100", drop=True), _ORDER_ROWS + "o_custkey >= 100"),
    "index_rtree_rect": (_indexed_points("at WITHIN RECTANGLE (5.0, 5.0, 12.0, 20.0)"), f"SELECT * FROM {_GRID} WHERE x BETWEEN 5 AND 12 AND y BETWEEN 5 AND 20"),
    "index_rtree_circle": (_indexed_points("at WITHIN CIRCLE (20.0, 20.0, 5.0)"), f"SELECT * FROM {_GRID} WHERE {_GRID_D} <= 25.0"),
    "index_rtree_knn": (_indexed_points("at KNN (20.0, 20.0, 9)"), f"SELECT * FROM {_GRID} WHERE {_GRID_D} <= (SELECT max(d) FROM (SELECT {_GRID_D} AS d FROM {_GRID} ORDER BY d LIMIT 9))"),
}
for _kind in _INDEX_KINDS:
    OTHERS[f"index_{_kind}_eq"] = _indexed_orders(_kind.upper(), "o_custkey = 100"), _ORDER_ROWS + "o_custkey = 100"
    OTHERS[f"index_{_kind}_range"] = _indexed_orders(_kind.upper(), "o_custkey BETWEEN 50 AND 90"), _ORDER_ROWS + "o_custkey BETWEEN 50 AND 90"


def queries() -> dict[str, Query]:
    return {n: _select(table, sql) for n, (table, sql, _) in SELECTS.items()} | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: twin or sql for n, (_, sql, twin) in SELECTS.items()} | {n: sql for n, (_, sql) in OTHERS.items()}

"""The engine: statements in, results out."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError, QuarryError
from quarry.functions.coerce import from_column, shown, stored
from quarry.operators.filters import to_column
from quarry.operators.ordering import limited, page, sort_keys
from quarry.plans import syntax as s
from quarry.plans.parser import parse
from quarry.plans.printer import statement_lines
from quarry.schema import ROW_ID, DataType, IndexKind, TableSchema, check_index
from quarry.sources.catalog import Catalog
from quarry.sources.csv_import import read_csv
from quarry.sources.files import shared_folder

log = logging.getLogger("quarry")


@dataclass
class Counters:
    """What statements have touched since the last reset. Of reads: the files that were opened, their bytes, and the rows
    of the row groups and pages that the pushed filters left, in all passes (a sort samples its input first)."""

    files_read: int = 0
    bytes_read: int = 0
    rows_read: int = 0
    parts_written: int = 0
    files_rewritten: int = 0
    rows_returned: int = 0

    def reset(self) -> None:
        for f in fields(self):
            setattr(self, f.name, 0)

    def add_scans(self, df: DataFrame) -> None:
        """Count what the scans of an executed DataFrame have read, by their metrics."""
        for scan in _leaves(df._jdf.queryExecution().executedPlan()):
            metrics = scan.metrics()
            for name, mine in (("numFiles", "files_read"), ("filesSize", "bytes_read"), ("numOutputRows", "rows_read")):
                if metrics.contains(name):
                    setattr(self, mine, getattr(self, mine) + metrics.apply(name).value())


def _leaves(plan) -> list:
    """The leaves of a physical plan, through the stages of its adaptive execution."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _leaves(plan.plan())
    below = plan.children()
    return [x for i in range(below.size()) for x in _leaves(below.apply(i))] or [plan]


@dataclass
class Planned:
    """A SELECT as a DataFrame: filtered and limited, not yet ordered for delivery or projected."""

    rows: DataFrame
    keys: list
    columns: list[str]

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.columns])


@dataclass
class Session:
    """Tables of one warehouse folder, and DataFrames registered beside them.

    Without a warehouse, a folder below spark.checkpoint.dir is used.
    """

    spark: SparkSession
    warehouse: str | None = None
    counters: Counters = field(default_factory=Counters)

    def __post_init__(self):
        self.catalog = Catalog(self.spark, self.warehouse or f"{shared_folder(self.spark)}/quarry-tables")
        self._external: dict[str, tuple[DataFrame, list[str]]] = {}

    # tables

    def register(self, name: str, df: DataFrame, key: str | list[str] = ()) -> None:
        """Let statements read a DataFrame. key: the columns whose order is the table's, as row numbers are elsewhere."""
        self._external[name.lower()] = df, [key] if isinstance(key, str) else list(key)

    def _source(self, name: str) -> tuple[DataFrame, list[str]]:
        if found := self._external.get(name.lower()):
            return found
        df = self.catalog.read(self.catalog.load(name))
        return df, [ROW_ID]

    def import_frame(self, table: str, df: DataFrame) -> None:
        """Append a DataFrame's rows, in bulk; its columns have the table's names."""
        schema = self.catalog.load(table).schema
        if sorted(df.columns) != sorted(schema.names()):
            raise EngineError("the specified columns don't match the table's columns")
        texts = [c for c in schema.columns if c.type is DataType.VARCHAR]
        if texts:
            most = df.agg(*[F.max(F.length(F.col(f"`{c.name}`").cast("string"))) for c in texts]).first()
            for c, n in zip(texts, most, strict=True):
                if n is not None and n > c.length:
                    raise EngineError(f"a value is longer than VARCHAR({c.length}) (column '{c.name}')")
        self.catalog.append(table, df.select(*[from_column(F.col(f"`{c.name}`"), c).alias(c.name) for c in schema.columns]), clustered=True)
        self.counters.parts_written += 1

    def import_csv(self, table: str, path: str, multiline: bool = False) -> None:
        schema = self.catalog.load(table).schema
        self.catalog.append(table, read_csv(self.spark, path, schema, multiline))
        self.counters.parts_written += 1

    # queries

    def plan(self, q: s.Select) -> Planned:
        df, tie = self._source(q.table)
        visible = [c for c in df.columns if c != ROW_ID]
        if q.order_by is not None and q.order_by not in visible:
            raise EngineError(f"ordered by column '{q.order_by}' doesn't exist")
        columns = visible if q.columns is None else list(q.columns)
        if missing := [c for c in columns if c not in visible]:
            raise EngineError(f"some columns don't exist: {', '.join(missing)}")
        if q.limit is not None and q.limit <= 0:
            raise EngineError("the limit must be positive")
        keys = sort_keys(q.order_by, q.ascending, tie)
        rows = df if q.where is None else df.where(to_column(q.where, df))
        return Planned(limited(rows, keys, q.limit), keys, columns)

    def frame(self, sql: str) -> DataFrame:
        """One SELECT as a lazy DataFrame, for composition: its rows are in no particular order."""
        statements = parse(sql)
        if len(statements) != 1 or not isinstance(statements[0], s.Select):
            raise EngineError("expected a single SELECT")
        planned = self.plan(statements[0])
        return planned.project(planned.rows)

    def _result(self, planned: Planned) -> dict[str, list]:
        ordered = planned.project(planned.rows.orderBy(*planned.keys) if planned.keys else planned.rows)
        records = [[shown(v) for v in row] for row in ordered.collect()]
        self.counters.add_scans(ordered)
        self.counters.rows_returned += len(records)
        return {"columns": planned.columns, "records": records}

    def iterate(self, sql: str) -> Iterator[list]:
        """The records of one SELECT in order, a task's rows in the driver at a time: for results that execute_sql, which
        holds all of them, is too small for."""
        statements = parse(sql)
        if len(statements) != 1 or not isinstance(statements[0], s.Select):
            raise EngineError("expected a single SELECT")
        planned = self.plan(statements[0])
        for row in planned.project(planned.rows.orderBy(*planned.keys) if planned.keys else planned.rows).toLocalIterator():
            self.counters.rows_returned += 1
            yield [shown(v) for v in row]

    # statements

    def _create_table(self, q: s.CreateTable) -> None:
        if q.table.lower() in self._external:
            raise EngineError(f"table '{q.table}' already exists")
        self.catalog.create(TableSchema(q.table.lower(), q.columns), q.if_not_exists)

    def _insert(self, q: s.Insert) -> None:
        schema = self.catalog.load(q.table).schema
        if q.columns and sorted(q.columns) != sorted(schema.names()):
            raise EngineError("the specified columns don't match the table's columns")
        if len(q.values) != len(schema.columns):
            raise EngineError("the number of values doesn't match the number of columns")
        given = dict(zip(q.columns or schema.names(), q.values, strict=True))
        row = tuple(stored(given[c.name], c) for c in schema.columns)
        self.catalog.append(q.table, self.spark.createDataFrame([row], _visible(schema)))
        self.counters.parts_written += 1

    def _delete(self, q: s.Delete) -> None:
        table = self.catalog.load(q.table)
        if q.where is None:
            raise EngineError("invalid condition")
        condition = to_column(q.where, self.catalog.read(table))
        _, files = self.catalog.delete(table, condition)
        self.counters.files_rewritten += files
        self.counters.parts_written += files > 0

    def _create_index(self, q: s.CreateIndex) -> None:
        if len(q.columns) > 1:
            raise EngineError("an index on more than one column is not supported")
        table = self.catalog.load(q.table)
        c = table.schema.column(q.columns[0])
        if c is None:
            raise EngineError(f"column '{q.columns[0]}' doesn't exist")
        if c.index is not IndexKind.NONE:
            raise EngineError(f"column '{c.name}' already has an index")
        kind = q.kind or (IndexKind.RTREE if c.type is DataType.POINT else IndexKind.BTREE)
        check_index(kind, c.type)
        self.catalog.rewrite(replace(table, schema=_with(table.schema, replace(c, index=kind, index_name=q.index))))
        self.counters.parts_written += 1

    def _drop_index(self, q: s.DropIndex) -> None:
        table = self.catalog.load(q.table)
        c = next((c for c in table.schema.columns if c.index_name == q.index), None)
        if c is None:
            raise EngineError(f"index '{q.index}' on table '{q.table}' doesn't exist")
        if c.primary:
            raise EngineError("the primary key's index cannot be dropped")
        self.catalog.change(table, _with(table.schema, replace(c, index=IndexKind.NONE, index_name=None)))

    def run(self, statement: s.Statement) -> tuple[dict | None, str]:
        """(result, message) of one statement; raises what is wrong with it."""
        log.info("%s", type(statement).__name__)
        if isinstance(statement, s.Select):
            return self._result(self.plan(statement)), "Selection successful"
        done: dict[type, tuple[Callable[[Any], None], str]] = {
            s.CreateTable: (self._create_table, "Table created successfully"),
            s.DropTable: (lambda q: self.catalog.drop(q.table, q.if_exists), "Table dropped successfully"),
            s.Insert: (self._insert, "Insertion successful"),
            s.Delete: (self._delete, "Deletion successful"),
            s.CreateIndex: (self._create_index, "Index created successfully"),
            s.DropIndex: (self._drop_index, "Index dropped successfully"),
        }
        action, message = done[type(statement)]
        action(statement)
        return None, message

    def execute_sql(self, sql: str) -> tuple[dict | None, str]:
        """Run a script in order, after all of it was parsed. Returns the last (result, message); errors are messages."""
        try:
            out: tuple[dict | None, str] = (None, "")
            for statement in parse(sql):
                out = self.run(statement)
            return out
        except QuarryError as e:
            log.warning("%s", e)
            return None, str(e)

    def run_page(self, sql: str, limit: int, offset: int = 0) -> dict:
        """A script whose last SELECT is cut to a page: {data, total, message, execution_time}. total counts all rows."""
        began, data, total = time.perf_counter(), {"columns": [], "records": []}, 0
        try:
            statements = parse(sql)
            for statement in statements[:-1]:
                self.run(statement)
            if isinstance(statements[-1], s.Select):
                planned = self.plan(statements[-1])
                message = "Selection successful"
                rows = planned.project(page(planned.rows, planned.keys, offset, limit)).collect()
                last = len(rows) < limit and (rows or not offset)  # a last page tells the total
                total = offset + len(rows) if last else planned.rows.count()
                data = {"columns": planned.columns, "records": [[shown(v) for v in row] for row in rows]}
                self.counters.rows_returned += len(rows)
            else:
                _, message = self.run(statements[-1])
        except QuarryError as e:
            message = str(e)
        return {"data": data, "total": total, "message": message, "execution_time": time.perf_counter() - began}

    def explain_sql(self, sql: str) -> str:
        """The syntax trees of a script, and Spark's plan below each SELECT."""
        out = []
        for statement in parse(sql):
            out += statement_lines(statement)
            if isinstance(statement, s.Select):
                planned = self.plan(statement)
                plan = planned.project(planned.rows)._jdf.queryExecution()
                out.append(plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(out)


def _visible(schema: TableSchema):
    kinds = schema.spark()
    return type(kinds)([f for f in kinds.fields if f.name != ROW_ID])


def _with(schema: TableSchema, column) -> TableSchema:
    return replace(schema, columns=tuple(column if c.name == column.name else c for c in schema.columns))

"""Bounded, read-only SQL over the public views of one pinned snapshot.

A statement is translated, parsed by Spark, checked against the namespace, analysed (the bind step), optionally
rewritten by one pass, wrapped with a row limit and collected through a bounded iterator.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import hashlib
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.plans.dialect import UnsupportedSql, tokenize, translate

VERSION = "cairnlake-query-v1"
SAFE_INTEGER = 2**53 - 1
PLAN_LIMIT = 64_000
# Functions that reach outside the session or the views.
DENIED_FUNCTIONS = frozenset(
    """read_csv read_csv_auto read_json read_json_auto read_ndjson read_parquet parquet_scan parquet_metadata read_text read_blob glob http_get http_post
    postgres_scan sqlite_scan mysql_scan postgres_query attach current_setting query query_table getenv duckdb_secrets which_secret sniff_csv load_aws_credentials
    java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length read_files from_avro current_user session_user user""".split()
)
# Plan roots of statements that only read or inspect.
QUERY_ROOTS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join Window UnresolvedWith WithCTE SubqueryAlias UnresolvedInlineTable UnresolvedHaving OneRowRelation UnresolvedSubqueryColumnAliases LocalRelation Generate UnresolvedOrdinal UnresolvedRelation WithWindowDefinition TableValuedFunction UnresolvedTableValuedFunction Limit Range LateralJoin".split()
)


@dataclass(frozen=True)
class Limits:
    """Budgets of one execution."""

    max_rows: int = 1_000
    max_bytes: int = 8 * 2**20
    max_seconds: float = 20.0
    max_params: int = 100
    max_param_values: int = 100_000
    max_request_bytes: int = 4 * 2**20


class QueryError(Exception):
    """An error of the service's taxonomy: ``code`` and a message."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass
class Prepared:
    sql: str
    spark_sql: str
    frame: DataFrame | None
    kind: str
    diagnostics: list[dict[str, str]]
    passes: list[dict[str, str]]
    plan: str
    snapshot: int | None


@dataclass
class Result:
    columns: list[str]
    types: list[str]
    rows: list[list[Any]]
    truncated: str | None
    snapshot: int | None
    diagnostics: list[dict[str, str]]
    passes: list[dict[str, str]] = field(default_factory=list)
    version: str = VERSION


@dataclass(frozen=True)
class PassDecision:
    """What a rewrite pass decided: applied, deferred, not_applicable, budget_exceeded or contract_mismatch."""

    name: str
    status: str
    code: str = ""
    frame: DataFrame | None = None


RewritePass = Callable[[SparkSession, str, DataFrame], PassDecision]


def wire(v: Any) -> Any:
    """A value as JSON carries it: unsafe integers, decimals and non-finite doubles as text, bytes in base64."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return v if abs(v) <= SAFE_INTEGER else str(v)
    if isinstance(v, float):
        return v if math.isfinite(v) else ("NaN" if v != v else "Infinity" if v > 0 else "-Infinity")
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(v, dict):
        return {str(k): wire(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: wire(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple, set)):
        return [wire(x) for x in v]
    return str(v)


def shape(sql: str) -> str:
    """A fingerprint of a statement's form: literals and parameters replaced, white space and case levelled."""
    forms = {"string": "?", "number": "?", "param": "?"}
    text = " ".join(forms.get(t.kind, t.text.lower()) for t in tokenize(sql))
    return hashlib.sha256(re.sub(r"\? (?:, \? )+", "? ", text).encode()).hexdigest()[:16]


class Engine:
    """SQL service over a session's views.

    ``relations`` are the names a statement may read; with ``namespaces``, ``ns.name`` is accepted too. Only one
    operation runs at a time; a second one is refused at once.
    """

    def __init__(self, spark: SparkSession, relations: Sequence[str], namespaces: Sequence[str] = ("public_v1", "experimental"), limits: Limits = Limits(), snapshot: int | None = None, passes: Sequence[tuple[str, RewritePass]] = ()):
        self.spark, self.relations, self.namespaces = spark, {r.lower() for r in relations}, {n.lower() for n in namespaces}
        self.limits, self.snapshot, self.passes, self.history = limits, snapshot, list(passes), []
        self._slot = threading.Lock()

    # -- stages ---------------------------------------------------------------------------------------------------
    def _check_request(self, sql: str, params: Sequence[Any] | dict[str, Any]) -> None:
        if len(sql.encode()) > self.limits.max_request_bytes:
            raise QueryError("resource_limit", "the statement is too long")
        values = list(params.values()) if isinstance(params, dict) else list(params)
        if len(values) > self.limits.max_params:
            raise QueryError("resource_limit", f"at most {self.limits.max_params} parameters")

        def count(v: Any) -> int:
            return sum(map(count, v)) if isinstance(v, (list, tuple)) else 1

        if sum(map(count, values)) > self.limits.max_param_values:
            raise QueryError("resource_limit", f"at most {self.limits.max_param_values} parameter values")

    def _walk(self, plan: Any, ctes: set[str]) -> Iterator[tuple[str, Any]]:
        name = plan.getClass().getSimpleName()
        if name == "UnresolvedWith":
            pairs = plan.cteRelations()
            inner = set(ctes)
            for i in range(pairs.size()):
                inner.add(str(pairs.apply(i)._1()).lower())
            for i in range(pairs.size()):
                yield from self._walk(pairs.apply(i)._2(), inner)
            ctes = inner
        yield name, (plan, ctes)
        kids = plan.children()
        for i in range(kids.size()):
            yield from self._walk(kids.apply(i), ctes)
        exprs = plan.expressions()
        for i in range(exprs.size()):
            yield from self._walk_expression(exprs.apply(i), ctes)

    def _walk_expression(self, e: Any, ctes: set[str]) -> Iterator[tuple[str, Any]]:
        name = e.getClass().getSimpleName()
        yield name, (e, ctes)
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):  # InSubquery holds a ListQuery among its children
            yield from self._walk(e.plan(), ctes)
        kids = e.children()
        for i in range(kids.size()):
            yield from self._walk_expression(kids.apply(i), ctes)

    def validate(self, spark_sql: str) -> None:
        """Raises unless the statement is one query over the allowed relations and functions."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(spark_sql)
        except Exception as e:  # noqa: BLE001
            raise QueryError("sql_invalid", str(getattr(e, "java_exception", e)).split("\n")[0][:400]) from None
        root = plan.getClass().getSimpleName()
        if root not in QUERY_ROOTS:
            raise QueryError("sql_invalid", f"only queries are allowed, not {root}")
        try:
            found = list(self._walk(plan, set()))
        except Py4JError as e:  # what cannot be checked is not allowed
            raise QueryError("sql_invalid", f"the statement cannot be checked: {e}"[:400]) from None
        for name, (node, ctes) in found:
            if name == "UnresolvedRelation":
                parts = node.multipartIdentifier()
                path = [str(parts.apply(i)).lower() for i in range(parts.size())]
                if len(path) == 1 and path[0] in ctes:
                    continue
                if len(path) > 2 or path[-1] not in self.relations or len(path) == 2 and path[0] not in self.namespaces:
                    raise QueryError("sql_invalid", f"unknown relation {'.'.join(path)}")
            elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
                parts = node.nameParts() if name == "UnresolvedFunction" else node.name()
                last = str(parts.apply(parts.size() - 1)).lower()
                if last in DENIED_FUNCTIONS or last.startswith(("duckdb_", "pragma_", "ducklake_")):
                    raise QueryError("sql_invalid", f"function {last} is not allowed")

    def frame(self, sql: str, params: Sequence[Any] | dict[str, Any] = ()) -> tuple[str, DataFrame]:
        """The analysed query. Readings that Spark alone can decide are tried in turn: ``len`` of a string or of a
        list, and names in WHERE that are aliases of the select list."""
        args: Any = dict(params) if isinstance(params, dict) else list(params)
        if args and isinstance(args, list) and re.search(r"\$\d", sql):
            args = {f"p{i + 1}": v for i, v in enumerate(args)}
        len_as, aliases, last = "length", frozenset(), None
        for _ in range(8):
            try:
                text = translate(sql, len_as, aliases)
            except UnsupportedSql as e:
                raise QueryError("sql_invalid", str(e)) from None
            self.validate(text)
            try:
                text = self._plain_names(text)
                return text, self.spark.sql(text, args) if args else self.spark.sql(text)
            except (AnalysisException, ParseException) as e:
                last = e
                missing = re.search(r"\[UNRESOLVED_COLUMN[^\]]*\].*?name `([^`]+)`", str(e))
                if "DATATYPE_MISMATCH" in str(e) and len_as == "length" and re.search(r"\blen\s*\(", sql, re.I):
                    len_as = "size"
                elif missing and missing.group(1).lower() not in aliases:
                    aliases |= {missing.group(1).lower()}
                else:
                    break
        raise QueryError("sql_invalid", str(last).split("\n")[0][:600])

    def _plain_names(self, text: str) -> str:
        """``public_v1.capture`` as the view's own name; other namespaces are prefixes of view names."""
        for ns in self.namespaces:
            to = "" if ns == "public_v1" else f"{ns}_"
            text = re.sub(rf"\b{ns}\s*\.\s*(\w+)", rf"{to}\1", text, flags=re.I)
        return text

    def prepare(self, sql: str, params: Sequence[Any] | dict[str, Any] = (), experimental: bool = False) -> Prepared:
        """Validation, bind, plan and the passes' decisions, without executing."""
        self._check_request(sql, params)
        head = sql.strip().split(None, 2)
        kind = head[0].upper() if head else ""
        if kind in ("DESCRIBE", "SUMMARIZE", "EXPLAIN", "SHOW"):
            return self._inspect(kind, sql, params)
        text, df = self.frame(sql, params)
        diagnostics, decisions = [], []
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if re.search(r"\bCROSS\s+JOIN\b", sql, re.I):
            diagnostics.append({"code": "cartesian_product", "message": "the query contains a cross join"})
        if len(plan) > PLAN_LIMIT:
            plan = plan[:PLAN_LIMIT]
            diagnostics.append({"code": "plan_truncated", "message": f"the plan is cut at {PLAN_LIMIT} characters"})
        for name, run in self.passes if experimental else ():
            d = run(self.spark, sql, df)
            decisions.append({"name": name, "status": d.status, "code": d.code})
            if d.status in ("applied", "deferred"):
                df = d.frame if d.frame is not None else df
                break
        return Prepared(sql, text, df, "query", diagnostics, decisions, plan, self.snapshot)

    def _inspect(self, kind: str, sql: str, params: Any) -> Prepared:
        rest = sql.strip()[len(kind) :].strip().rstrip(";")
        if kind == "EXPLAIN":
            rest = re.sub(r"^ANALYZE\b", "", rest, flags=re.I).strip()
            text, df = self.frame(rest, params)
            rows = [(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)]
            return Prepared(sql, text, self.spark.createDataFrame(rows, "explain string"), "explain", [], [], rows[0][0], self.snapshot)
        if kind == "SHOW":
            m = re.fullmatch(r"TABLES\s+FROM\s+(\w+)", rest, re.I)
            if not m or m.group(1).lower() not in self.namespaces:
                raise QueryError("sql_invalid", "only SHOW TABLES FROM a public schema is allowed")
            df = self.spark.createDataFrame([(r,) for r in sorted(self.relations)], "name string")
            return Prepared(sql, sql, df, "show", [], [], "", self.snapshot)
        query = rest if re.match(r"(SELECT|WITH)\b", rest, re.I) else f"SELECT * FROM {rest}"
        text, df = self.frame(query, params)
        if kind == "DESCRIBE":
            rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
            out = self.spark.createDataFrame(rows, "column_name string, column_type string, `null` string")
        else:
            out = summarize(df)
        return Prepared(sql, text, out, kind.lower(), [], [], "", self.snapshot)

    def _bounded(self, df: DataFrame, limits: Limits) -> Iterator[list[Any]]:
        for row in df.limit(limits.max_rows + 1).toLocalIterator(prefetchPartitions=False):
            yield [wire(v) for v in row]

    def execute(self, sql: str, params: Sequence[Any] | dict[str, Any] = (), experimental: bool = False, limits: Limits | None = None) -> Result:
        """The bounded result of a statement. ``truncated`` is rows, bytes or null."""
        limits = limits or self.limits
        if not self._slot.acquire(blocking=False):
            raise QueryError("service_busy", "another query is running")
        began, group, state = time.time(), f"query-{uuid.uuid4().hex}", "failed"
        timer = threading.Timer(limits.max_seconds, lambda: self.spark.sparkContext.cancelJobGroup(group))
        try:
            # The deadline covers binding and the jobs of passes too.
            self.spark.sparkContext.setJobGroup(group, "query", interruptOnCancel=True)
            timer.start()
            p = self.prepare(sql, params, experimental)
            rows, size, cut = [], 0, None
            for row in self._bounded(p.frame, limits):
                if len(rows) >= limits.max_rows:
                    cut = "rows"
                    break
                size += len(json.dumps(row, ensure_ascii=False).encode())
                if size > limits.max_bytes:
                    cut = "bytes"
                    break
                rows.append(row)
            state = "ok"
            types = [f.dataType.simpleString() for f in p.frame.schema.fields]
            return Result(p.frame.columns, types, rows, cut, p.snapshot, p.diagnostics, p.passes)
        except QueryError as e:
            state = e.code
            raise
        except (PySparkException, Py4JError) as e:
            over = time.time() - began >= limits.max_seconds
            text = str(e)
            state = "resource_limit" if over else "helper_limit" if "accepts at most" in text else "query_failed"
            raise QueryError(state, "the time limit was reached" if over else text.split("\n")[0][:400]) from None
        finally:
            timer.cancel()
            self._slot.release()
            self.history.append({"at": began, "seconds": time.time() - began, "state": state, "shape": self._shape(sql)})

    @staticmethod
    def _shape(sql: str) -> str:
        try:
            return shape(sql)
        except UnsupportedSql:
            return "invalid"

    def stream(self, sql: str, params: Sequence[Any] = (), batch_rows: int = 1024, batch_bytes: int = 256 * 2**10) -> Iterator[str]:
        """NDJSON frames: metadata, batches of rows, then complete or error."""
        try:
            r = self.execute(sql, params)
        except QueryError as e:
            yield json.dumps({"type": "error", "code": e.code, "message": e.message})
            return
        yield json.dumps({"type": "metadata", "columns": r.columns, "types": r.types, "snapshot": r.snapshot, "version": r.version})
        batch, size = [], 0
        for row in r.rows:
            batch.append(row)
            size += len(json.dumps(row))
            if len(batch) >= batch_rows or size >= batch_bytes:
                yield json.dumps({"type": "rows", "rows": batch})
                batch, size = [], 0
        if batch:
            yield json.dumps({"type": "rows", "rows": batch})
        yield json.dumps({"type": "complete", "rows": len(r.rows), "truncated": r.truncated})

    def urls(self, sql: str, limit: int, params: Sequence[Any] = ()) -> list[str]:
        """Seed or follow SQL: a query of the one column ``url``; distinct normalised URLs in order of the result."""
        from cairnlake.functions.urls import normalize_url

        r = self.execute(sql, params)
        if r.columns != ["url"]:
            raise QueryError("sql_invalid", "the query must have the one column url")
        if r.truncated:
            raise QueryError("resource_limit", "the result is incomplete")
        out: dict[str, None] = {}
        for (u,) in r.rows:
            n = normalize_url(u)
            if n:
                out.setdefault(n)
        if len(out) > limit:
            raise QueryError("resource_limit", f"more than {limit} urls")
        return list(out)


def summarize(df: DataFrame) -> DataFrame:
    """``column_name, column_type, min, max, approx_unique, count, null_percentage`` of each column, in one scan."""
    plain = [f for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"), F.approx_count_distinct(c).alias(f"u{i}"), F.count(c).alias(f"c{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
            F.col(f"u{i}").alias("approx_unique"), F.col("n").alias("count"),
            F.when(F.col("n") > 0, F.round((F.col("n") - F.col(f"c{i}")) * 100.0 / F.col("n"), 2)).alias("null_percentage"),
        )
        for i, f in enumerate(plain)
    ]
    return one.select(F.inline(F.array(*rows)))


def exported(result: Result, form: str) -> str:
    """A result as CSV or JSON text."""
    if form == "json":
        return json.dumps([dict(zip(result.columns, r)) for r in result.rows], ensure_ascii=False)
    if form != "csv":
        raise ValueError(form)
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(result.columns)
    for r in result.rows:
        w.writerow(["" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v for v in r])
    return out.getvalue()

"""SQL over a catalog of views, with the session features of the query shell."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import dialect
from logweir.plans import catalog
from logweir.sources.nodes import node_answers
from logweir.sources.tables import parsed_answers, typed

#: A view's loader: gives its rows.
Loader = Callable[[SparkSession], DataFrame]


class StatementError(ValueError):
    """A statement that can't be run as it is."""


@dataclass
class Status:
    """How the last statement went: which answers its tables came from, and seconds to plan it.

    Counts and reasons are worked out when they are asked for, from the answers as they are kept.
    """

    answers: list[DataFrame] = field(default_factory=list)
    latency: float = 0.0

    @property
    def failures(self) -> list[DataFrame]:
        """(node_id, reason) for each table."""
        return [a.filter(F.col("error").isNotNull()).select("node_id", F.col("error").alias("reason")) for a in self.answers]

    @property
    def contacted(self) -> int:
        """Answers asked for; a node counts once for each table."""
        return sum(a.select("node_id").distinct().count() for a in self.answers)

    @property
    def failed_count(self) -> int:
        return sum(f.count() for f in self.failures)

    @property
    def failed(self) -> dict[int, str]:
        """{node_id: reason} of all failures; nodes are a cluster's list, so it is bounded by that."""
        return {r["node_id"]: r["reason"] for f in self.failures for r in f.toLocalIterator()}


class Engine:
    """Views by name, SQL over them in SQLite's or Spark's spelling, and a cache with a time to live.

    A statement only plans; rows are computed when the DataFrame that it returns is used, so filters and
    columns reach the views' scans.  Nodes' answers that are kept are read once within the time to live, on
    executors, in memory or on disk.
    """

    def __init__(self, spark: SparkSession, ttl: int = 60):
        self.spark, self.ttl, self.status = spark, ttl, Status()
        self.views: dict[str, tuple[Loader, str]] = {}
        self.cached: dict[str, tuple[float, DataFrame]] = {}
        self.answers: dict[str, Loader] = {}
        self.kept: dict[str, tuple[float, DataFrame]] = {}
        self.pretty = False
        self.last_query: str | None = None
        dialect.register(spark)

    def register(self, name: str, loader: Loader, description: str = "") -> None:
        self.views[name] = (loader, description)
        self.cached.pop(name, None)

    def register_parquet(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.register(n, lambda s, n=n: s.read.parquet(f"{folder}/{n}.parquet"), f"{n} in {folder}")

    def _columns(self, name: str, columns: dict[str, str] | None) -> dict[str, str]:
        columns = columns or catalog.declared().get(name)
        if columns is None:
            raise StatementError(f"{name} isn't in the catalog; its columns must be declared")
        return columns

    def register_answers(self, name: str, answers: DataFrame, columns: dict[str, str] | None = None, keep: bool = True) -> None:
        """A table from the nodes' JSON answers (node_id, answer), with the catalog's columns or those given."""
        columns = self._columns(name, columns)
        self._register_answers(name, lambda s: parsed_answers(answers), columns, keep)

    def register_nodes(self, name: str, nodes: dict[int, str], command: str | None = None, columns: dict[str, str] | None = None, keep: bool = False) -> None:
        """A table that the ``nodes`` (id -> address) answer with, each in a partition of its own.

        Answers that aren't kept are asked for by each statement, and only of the nodes that it constrains
        node_id to; with ``keep`` all are asked once within the time to live.
        """
        columns = self._columns(name, columns)
        self._register_answers(name, lambda s: node_answers(s, nodes, command or f"info {name} --json"), columns, keep)

    def _register_answers(self, name: str, loader: Loader, columns: dict[str, str], keep: bool) -> None:
        def kept(spark: SparkSession) -> DataFrame:
            if not keep:
                return loader(spark)
            at, df = self.kept.get(name, (0.0, None))
            if df is None or time.monotonic() - at > self.ttl:
                if df is not None:
                    df.unpersist()
                df = loader(spark).persist(StorageLevel.MEMORY_AND_DISK)
                self.kept[name] = (time.monotonic(), df)
            return df

        self.answers[name] = kept
        def rows(spark: SparkSession) -> DataFrame:
            found = typed(kept(spark).filter(F.col("error").isNull()), columns)
            return found.select(*columns) if name in catalog.declared() else found

        self.register(name, rows, f"answers of {name}")

    def tables(self) -> list[str]:
        return sorted(self.views)

    def describe(self, name: str) -> list[tuple[str, str]]:
        return self.view(name).dtypes

    def get_cache_ttl(self) -> int:
        return self.ttl

    def set_cache_ttl(self, seconds: int) -> int:
        self.ttl = int(seconds)
        return self.ttl

    def view(self, name: str) -> DataFrame:
        """A view's rows; its plan is kept for the time to live."""
        at, df = self.cached.get(name, (0.0, None))
        if df is None or time.monotonic() - at > self.ttl:
            df = self.views[name][0](self.spark)
            self.cached[name] = (time.monotonic(), df)
        return df

    def translated(self, statement: str) -> str:
        """A statement in Spark's SQL, by the types of the columns of the views that it names."""
        words = dialect.names_in(statement)
        types: dict[str, str] = {}
        for n in self.views:
            if n.lower() in words:
                for column, kind in self.view(n).dtypes:
                    types[column] = kind if types.get(column, kind) == kind else "several"
        session = {"get_cache_ttl": lambda: str(self.ttl), "set_cache_ttl": lambda s: str(self.set_cache_ttl(int(s)))}
        return dialect.to_spark(statement, types, session)

    def sql(self, statement: str) -> DataFrame:
        """Plan a statement; tables that ask for predicates are refused without them."""
        began = time.monotonic()
        self.last_query = statement
        try:
            words = dialect.names_in(statement)
            used = [n for n in self.views if n.lower() in words]
            text = self.translated(statement)
            for n in used:
                self.view(n).createOrReplaceTempView(n)
            out = self.spark.sql(text)
        except (ValueError, AnalysisException, ParseException) as e:
            raise StatementError(str(e)) from e
        for n in used:
            if n in catalog.REQUIRED:
                require(out, n, catalog.REQUIRED[n])
        self.status = Status([self.answers[n](self.spark) for n in used if n in self.answers], time.monotonic() - began)
        return out

    def script(self, statements: str) -> list[DataFrame]:
        """Statements separated by semicolons, outside quotes and comments."""
        parts = re.findall(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|[^;'\"])+", statements, re.S)
        return [self.sql(p) for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]

    def verb(self, line: str) -> str | DataFrame:
        """A line of the shell: SQL, ``describe t``, or ``:tables``, ``:ttl [s]``, ``:pretty [on|off]``, ``:last_query``."""
        words = line.strip().rstrip(";").split()
        if not words:
            return ""
        head, rest = words[0].lower(), words[1:]
        if head == "describe" and rest:
            return "\n".join(f"{c} {t}" for c, t in self.describe(rest[0]))
        if head == ":tables":
            return "\n".join(self.tables())
        if head == ":ttl":
            return str(self.set_cache_ttl(int(rest[0])) if rest else self.ttl)
        if head == ":pretty":
            self.pretty = rest[0].lower() == "on" if rest else not self.pretty
            return "on" if self.pretty else "off"
        if head == ":last_query":
            return self.last_query or ""
        if head.startswith(":"):
            raise StatementError(f"{head} isn't a verb")
        return self.sql(line)

    def command(self, line: str) -> str:
        """A node's text command: ``info TABLE [column=value ...] [--json]`` or ``stats [--json]``, answered from the view of that name."""
        words = line.split()
        style = "json" if "--json" in words else "table"
        words = [w for w in words if not w.startswith("--")]
        if words and words[0] == "info" and len(words) > 1:
            name, filters = words[1], words[2:]
        elif words and words[0] == "stats":
            name, filters = "stats", words[1:]
        else:
            raise StatementError(f"no such command: {line}")
        if name not in self.views:
            raise StatementError(f"no such table: {name}")
        kinds = dict(self.view(name).dtypes)
        tests = []
        for f in filters:
            column, _, value = f.partition("=")
            if column not in kinds:
                raise StatementError(f"{name} has no column {column}")
            tests.append(f"{column} = {dialect.quoted(value) if kinds[column] == 'string' else int(value)}")
        return rendered(self.sql(f"SELECT * FROM {name}" + (f" WHERE {' AND '.join(tests)}" if tests else "")), style)

    def shown(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """With ``:pretty`` on: sequence numbers as ``eXnY`` and times as text, by the declared types of a table's columns."""
        kinds = catalog.declared().get(name or "", {})
        if not self.pretty:
            return df
        from logweir.functions import lsn, scalars

        how = {"LSN": lsn.lsn_to_string, "TIME": scalars.pretty_time}
        return df.select(*[how[kinds[c]](F.col(c)).alias(c) if kinds.get(c) in how else F.col(c) for c in df.columns])

    def markdown(self) -> str:
        """Documentation of the views: a table of columns for each."""
        out = []
        for n in self.tables():
            out.append(f"## {n}\n{self.views[n][1]}\n\n| column | type |\n|---|---|")
            out += [f"| {c} | {t} |" for c, t in self.describe(n)]
        return "\n".join(out) + "\n"


def require(df: DataFrame, table: str, columns: tuple[str, ...]) -> None:
    """Refuse a statement that reads ``table`` without comparing all of ``columns``, by its analysed plan."""

    def compared(condition) -> set[int]:
        kind = condition.getClass().getSimpleName()
        if kind == "And":
            return compared(condition.left()) | compared(condition.right())
        if kind in ("EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "InSubquery", "Between"):
            found = condition.references().iterator()
            out = set()
            while found.hasNext():
                out.add(found.next().exprId().id())
            return out
        if kind == "RuntimeReplaceable" or hasattr(condition, "replacement") and kind == "With":
            return compared(condition.replacement())
        return set()

    def each(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def walk(plan, known: set[int]) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "Filter":
            known = known | compared(plan.condition())
        elif kind == "Join" and plan.condition().isDefined():
            known = known | compared(plan.condition().get())
        elif kind == "SubqueryAlias" and plan.alias().lower() == table:
            for a in each(plan.output()):
                if a.name() in columns and a.exprId().id() not in known:
                    raise StatementError(f"{table} asks for a predicate on {a.name()}")
            return
        for child in each(plan.children()):
            walk(child, known)
        for sub in each(plan.subqueries()):
            walk(sub, set())

    walk(df._jdf.queryExecution().analyzed(), set())


def rendered(df: DataFrame, style: str = "table", rows: int = 1000, header: bool = True) -> str:
    """The first rows as text: ``table``, ``list``, ``line``, ``csv`` or ``json`` (headers and rows); headers that repeat are numbered.

    If there are more rows than asked for, a last line says so; ``json`` has the key ``more`` then.
    """
    import json

    names = list(df.columns)
    for n in {n for n in names if names.count(n) > 1}:
        k = 0
        for i, x in enumerate(names):
            if x == n:
                names[i], k = f"{n}[{k}]", k + 1
    found = df.limit(rows + 1).collect()
    more = len(found) > rows
    if style == "json":
        table = {"headers": names, "rows": [[None if v is None else str(v) for v in r] for r in found[:rows]]}
        return json.dumps(table | {"more": True} if more else table)
    cells = [["" if v is None else str(v) for v in r] for r in found[:rows]]
    note = [f"({rows} rows shown, there are more)"] * more
    if style == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if re.search(r'[",\n]', v) else v
        return "\n".join([",".join(map(quote, r)) for r in [names] * header + cells] + note)
    if style == "list":
        return "\n".join(["|".join(r) for r in [names] * header + cells] + note)
    if style == "line":
        width = max(map(len, names), default=0)
        return "\n\n".join(["\n".join(f"{n:>{width}} = {v}" for n, v in zip(names, r, strict=True)) for r in cells] + note)
    widths = [max([len(n), *(len(r[i]) for r in cells)]) for i, n in enumerate(names)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [names] * header + cells]
    if header:
        lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join(lines + note)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables of one shape, one behind the other."""
    return reduce(DataFrame.unionAll, parts)

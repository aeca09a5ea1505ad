"""Read-only SQL over datasets registered as lazy views, and over views that the workspace keeps."""

from __future__ import annotations

import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import clamp
from ledgerloom.plans.dialect import each, kind_of, nodes, subplans, table_parts, translated
from ledgerloom.session import literal_rows
from ledgerloom.sources.contracts import GATED
from ledgerloom.sources.files import Files
from ledgerloom.sources.zones import Zones

_TOKEN = re.compile(
    r"""(?P<keep>'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|`[^`]*`)|"(?P<name>(?:[^"]|"")+)"|\b(?P<cast>(?:SAFE_)?CAST\s*\()"""
    r"""|(?P<open>\()|\bAS\s+(?P<type>REAL|TEXT|INT64|FLOAT64|NUMERIC|BIGNUMERIC|BOOL|BYTES)\s*(?=\))|(?P<close>\))"""
    r"""|(?P<project>@@project_id\b)""", re.IGNORECASE | re.DOTALL)
_TYPES = {"real": "DOUBLE", "text": "STRING", "int64": "BIGINT", "float64": "DOUBLE", "numeric": "DECIMAL(38,9)",
          "bignumeric": "DECIMAL(38,18)", "bool": "BOOLEAN", "bytes": "BINARY"}

# What the parsed form of a query may consist of; anything else is refused.
_PLANS = frozenset("""
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join Union Distinct Intersect Except SubqueryAlias
    UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable
    OneRowRelation LocalRelation WithWindowDefinition LateralJoin Generate Pivot UnresolvedOrdinal
""".split())
_JVM_CALLS = frozenset(("reflect", "try_reflect", "java_method"))


def bridge_dialect(query: str, project: str = "") -> str:
    """Rewrite what Spark's parser does not read: "names", CAST, and the project's variable.

    CAST gives null where the text is no number, date and so on, and takes SQLite's types REAL
    and TEXT and the warehouse's; those words are left alone outside a CAST's own brackets.
    """
    brackets: list[bool] = []

    def swap(match: re.Match) -> str:
        if match["name"] is not None:
            return "`" + match["name"].replace('""', '"').replace("`", "``") + "`"
        if match["cast"] or match["open"]:
            brackets.append(bool(match["cast"]))
            return "TRY_CAST(" if match["cast"] else "("
        if match["type"]:
            return f"AS {_TYPES[match['type'].lower()]}" if brackets and brackets[-1] else match[0]
        if match["project"]:
            return "'" + project.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if match["close"]:
            if brackets:
                brackets.pop()
            return ")"
        return match["keep"]

    return _TOKEN.sub(swap, query)


def sql_name(file: str, fallback: str = "dataset") -> str:
    """Driver-side twin of ``functions.text.table_name``."""
    stem = re.sub(r"^(.+)\.[^.]+$", r"\1", file.rsplit("/", 1)[-1])
    return re.sub("[^a-z0-9_]+", "_", stem.lower()).strip("_") or fallback


class SqlWorkspace:
    """Views of its own. Queries see these and nothing else, and run nothing but Spark's own functions.

    A table has a short name, and the warehouse's names ``dataset.table`` and ``project.dataset.table``,
    quoted or not. Tables of other datasets than the workspace's own have only the longer ones. With a
    ``folder`` the views made by ``create_view`` are kept there for later sessions.
    """

    def __init__(self, spark: SparkSession, project: str = "ledgerloom", dataset: str = "analytics", folder: str | None = None):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.project, self.dataset, self.folder = project, dataset, folder and folder.rstrip("/")
        self.tables: list[str] = []
        self.views: dict[str, str] = {}
        self._long: dict[tuple[str, str], str] = {}
        self._functions: frozenset[str] | None = None
        if self.folder:
            files = Files(spark)
            for file in files.names(self.folder):
                view = json.loads(files.read_marker(f"{self.folder}/{file}"))
                self.views[view["name"]] = view["query"]

    def register(self, name: str, df: DataFrame, dataset: str | None = None) -> str:
        """Register a frame read through ``self.spark`` as a view; nothing is loaded."""
        table, dataset = sql_name(name), sql_name(dataset or self.dataset)
        own = dataset == sql_name(self.dataset)
        if own and table in self.views:
            raise ValueError(f"There is a view {table}.")
        view = table if own else f"{dataset}__{table}"
        df.createOrReplaceTempView(view)
        if own and table not in self.tables:
            self.tables.append(table)
        self._long[dataset, table] = view
        return view

    def _view_of(self, parts: list[str]) -> str | None:
        """The view behind a longer table name."""
        if parts[-2:] == ["information_schema", "tables"]:
            dataset = parts[-3] if len(parts) > 2 else self.dataset
            if parts[:-3] in ([], [self.project.lower()]):
                return self._listing(sql_name(dataset))
        *project, dataset, table = parts
        if project not in ([], [self.project.lower()]):
            return None
        dataset, table = sql_name(dataset), sql_name(table)
        if dataset == sql_name(self.dataset) and table in self.views:
            return table
        return self._long.get((dataset, table))

    def _listing(self, dataset: str) -> str:
        """A view with a row for each table and view of a dataset."""
        rows = [(self.project, d, t, "BASE TABLE") for d, t in sorted(self._long) if d == dataset]
        if dataset == sql_name(self.dataset):
            rows += [(self.project, dataset, name, "VIEW") for name in sorted(self.views)]
        columns = "table_catalog, table_schema, table_name, table_type"
        listed = literal_rows(self.spark, rows, columns) if rows else self.spark.createDataFrame([], columns.replace(",", " string,") + " string")
        listed.createOrReplaceTempView(f"{dataset}__information_schema__tables")
        return f"{dataset}__information_schema__tables"

    # Views

    def create_view(self, statement: str) -> str:
        """Keep a view: ``CREATE [OR REPLACE] VIEW name AS query``; its name.

        The query is checked now, and again whenever the view is used, because its tables may have
        changed by then. A view may use others, but not itself in any way.
        """
        text = bridge_dialect((statement or "").strip().rstrip(";").rstrip(), self.project)
        try:
            plan = self._parse(text)
        except PySparkException as error:
            raise ValueError(f"Not a readable statement: {error}") from error
        if kind_of(plan) not in ("CreateView", "CreateViewCommand") or not plan.originalText().isDefined():
            raise ValueError("Only CREATE VIEW name AS query makes a view.")
        if kind_of(plan) == "CreateViewCommand" or each(plan.userSpecifiedColumns()):
            raise ValueError("A view has no options and takes its query's column names.")
        *front, name = [p.lower() for part in each(plan.child().nameParts()) for p in part.split(".")]
        if front not in ([], [self.dataset.lower()], [self.project.lower(), self.dataset.lower()]):
            raise ValueError(f"No such dataset here: {'.'.join(front)}.")
        name = sql_name(name)
        if name in self.tables:
            raise ValueError(f"There is a table {name}.")
        if name in self.views and not plan.replace():
            raise ValueError(f"There is a view {name}.")
        before, self.views[name] = self.views.get(name), plan.originalText().get()
        try:
            self._define(name, ())
        except (ValueError, PySparkException) as error:
            if before is None:
                del self.views[name]
            else:
                self.views[name] = before
            raise ValueError(f"Not a view: {error}") from error
        if self.folder:
            files, aside = Files(self.spark), f"{self.folder}/.{name}.next"
            files.write_marker(aside, json.dumps({"name": name, "query": self.views[name]}))
            files.move(aside, f"{self.folder}/{name}.json")
        return name

    def drop_view(self, name: str) -> None:
        """Forget a view; those that use it fail from then on."""
        name = sql_name(name)
        del self.views[name]
        self.spark.catalog.dropTempView(name)
        if self.folder:
            Files(self.spark).remove(f"{self.folder}/{name}.json")

    def _define(self, name: str, above: tuple[str, ...]) -> None:
        """Make a kept view one of the session's, and those that it uses before it."""
        if name in above:
            raise ValueError(f"A view uses itself: {' > '.join([*above, name])}.")
        self._query(self.views[name], (*above, name)).createOrReplaceTempView(name)

    def _parse(self, text: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def _query(self, text: str, above: tuple[str, ...] = ()) -> DataFrame:
        """The checked frame of a query's text, with the views that it uses defined."""
        # New lines keep a trailing comment from swallowing the bracket.
        text = translated(self._parse, f"SELECT * FROM (\n{text}\n)", self._view_of)
        plan = self._parse(text)
        self._check(plan, frozenset(self.tables) | frozenset(self.views) | frozenset(self._long.values()) | self._listings())
        for node, _ in nodes(plan):
            if kind_of(node) == "UnresolvedRelation" and table_parts(node)[0] in self.views:
                self._define(table_parts(node)[0], above)
        return self.spark.sql(text)

    def _listings(self) -> frozenset[str]:
        return frozenset(f"{d}__information_schema__tables" for d in {sql_name(self.dataset), *(d for d, _ in self._long)})

    def register_zones(self, root: str) -> list[str]:
        """Every stored dataset, finance first; a later one takes over a name."""
        zones = Zones(self.spark, root)
        for kind in ("finance", "external"):
            for file in zones.files.names(f"{zones.root}/published/{kind}"):
                path = zones.stored(file, kind)
                if file.startswith("__") or path is None or zones.files.size(path) == 0:
                    continue
                gated = kind == "finance" and file in GATED
                if gated and zones.resolve(file) is None:
                    continue
                try:
                    self.register(file, zones.read_stored(path))
                except ValueError:
                    continue  # no header, no table
        return sorted(self.tables)

    def parsed(self, query: str) -> DataFrame:
        """The frame of one SELECT or WITH query, without a row limit.

        The text is parsed as a subquery, which commands and several statements are not.
        """
        text = (query or "").strip()
        if not text:
            raise ValueError("There is no query text.")
        text = bridge_dialect(text.rstrip(";").rstrip(), self.project)
        if not text.lower().startswith(("select", "with")):
            raise ValueError("Only a SELECT or WITH query can be run.")
        try:
            return self._query(text)
        except PySparkException as error:
            raise ValueError(f"Not a readable query: {error}") from error

    def _check(self, plan, tables: frozenset[str]) -> None:
        """Refuse a parsed plan with nodes, tables or functions that a query may not use.

        The names of a WITH are tables in it and nowhere else.
        """
        kind = kind_of(plan)
        if kind not in _PLANS:
            raise ValueError(f"Not allowed in a query: {kind}.")
        if kind == "UnresolvedRelation":
            parts = each(plan.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in tables:
                raise ValueError(f"No such table here: {'.'.join(parts)}.")
        inner = each(plan.innerChildren()) if kind == "UnresolvedWith" else []
        if inner:
            tables = tables | {p.alias().lower() for p in inner}
        for part in [*inner, *each(plan.children())]:
            self._check(part, tables)
        if kind == "Generate":
            self._check_expression(plan.generator(), tables)
        for expression in each(plan.expressions()):
            self._check_expression(expression, tables)

    def _check_expression(self, expression, tables: frozenset[str]) -> None:
        kind = kind_of(expression)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = expression.nameParts() if kind == "UnresolvedFunction" else expression.name().nameParts()
            if self._functions is None:
                self._functions = frozenset(r.function for r in self.spark.sql("SHOW SYSTEM FUNCTIONS").collect()) - _JVM_CALLS
            if name.size() != 1 or name.apply(0).lower() not in self._functions:
                raise ValueError(f"No such function here: {'.'.join(each(name))}.")
        for plan in subplans(expression):
            self._check(plan, tables)
        for part in each(expression.children()):
            self._check_expression(part, tables)

    def readonly_sql(self, query: str, limit: int = 200, cap: int = 1000) -> DataFrame:
        """At most ``limit`` rows (1 to ``cap``); no query text can lift the limit."""
        return self.parsed(query).limit(clamp(limit, 1, cap))

    def readonly_sql_capped(self, query: str, limit: int = 100) -> DataFrame:
        """The warehouse variant: at most 500 rows, 100 unless asked."""
        return self.readonly_sql(query, limit, cap=500)

    def validate(self, examples: dict[str, str]) -> DataFrame:
        """(example, ok, row_count, error) for each query text, over all its rows."""
        out = None
        for name, query in examples.items():
            try:
                counted = self.parsed(query).agg(F.count("*").alias("row_count"))
                row = counted.select(F.lit(name).alias("example"), F.lit(True).alias("ok"),
                                     "row_count", F.lit(None).cast("string").alias("error"))
            except ValueError as error:
                row = self.spark.range(1).select(
                    F.lit(name).alias("example"), F.lit(False).alias("ok"),
                    F.lit(None).cast("bigint").alias("row_count"), F.lit(str(error)).alias("error"))
            out = row if out is None else out.unionByName(row)
        return out

    def catalog_list(self, database: str | None = None) -> DataFrame:
        """This workspace's tables, or a database's, by name, each with a preview query."""
        if database is None:
            listed = [t for t in self.spark.catalog.listTables() if t.isTemporary and t.name in {*self.tables, *self.views}]
        else:
            listed = [t for t in self.spark.catalog.listTables(database) if not t.isTemporary]
        prefix = f"{database}." if database else ""
        rows = sorted(
            (t.name, t.tableType, f"SELECT * FROM {prefix}{t.name} LIMIT 100") for t in listed
        )
        if not rows:
            return self.spark.createDataFrame(
                [], "table_id string, table_type string, select_preview_sql string"
            )
        return literal_rows(self.spark, rows, "table_id, table_type, select_preview_sql")

    def database_list(self) -> DataFrame:
        names = sorted(d.name for d in self.spark.catalog.listDatabases())
        return literal_rows(self.spark, [(n,) for n in names], "dataset_id")

"""The engine: databases and series tables over files, and one entry for SQL text.

Statements that Spark does not have are routed here; queries are rewritten and
handed to Spark.  A table is a folder of Parquet files: inserts append batches with
a sequence number, reads keep each field's newest value per series and time,
deletes and updates write a new version of the folder and then switch to it.

Time is stored as whole nanoseconds (column ``__ns``), cut to the precision of the
database, and shown as a timestamp in microseconds; points that differ by less stay apart.
The catalog lies beside the tables, in ``catalog.json``, so another engine on
the same root knows them.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import gis, scalars, selectors, series_ops
from tickforge.functions.ticks import from_nanos, micros
from tickforge.model import SeriesTable, delete_where, latest, show_series, show_tag_values, update, written_rows
from tickforge.plans import accounts, rewrite
from tickforge.plans.tokens import SqlError, Token, arguments, closing, join, tokenize, unquote
from tickforge.session import configure
from tickforge.sources import files
from tickforge.streaming import jobs

# SQL type names of native columns.
TYPES = {"BIGINT": "bigint", "BIGINT UNSIGNED": "decimal(20,0)", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean"}
GEOMETRIES = tuple(gis.WKB_TYPES)
CODECS = ("DEFAULT", "NULL", "DELTA", "QUANTILE", "GZIP", "BZIP", "GORILLA", "SNAPPY", "ZSTD", "ZLIB", "BITPACK", "DELTATS")


# Options of a database and what they are unless set; names of the metadata views and their columns.
OPTIONS = {"ttl": "INF", "shard": "1", "vnode_duration": "365d", "replica": "1", "precision": "NS"}
VIEWS = {
    "databases": "tenant_name string, database_name string, ttl string, shard bigint, vnode_duration string, replica bigint, precision string",
    "tables": "table_tenant string, table_database string, table_name string, table_type string, table_engine string, table_options string",
    "columns": "tenant_name string, database_name string, table_name string, column_name string, column_type string, ordinal_position bigint, column_default string, is_nullable boolean, data_type string, compression_codec string",
    "queries": "query_id string, query_type string, query_text string, state string",
}
UNITS = {"NS": 1, "US": 1_000, "MS": 1_000_000}
#: Microseconds of the units of a time to live.
SPANS = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000}


@dataclass
class Stored:
    table: SeriesTable
    path: str
    batches: int = 0
    geometry: dict[str, str] = field(default_factory=dict)
    merged: bool = False  # whether no series and time comes twice
    codecs: dict[str, str] = field(default_factory=dict)


def _stored_from(t: dict) -> Stored:
    return Stored(SeriesTable(**(t["table"] | {"tags": tuple(t["table"]["tags"])})), **{k: v for k, v in t.items() if k != "table"})


class Engine:
    """SQL over series tables in a session."""

    def __init__(self, spark: SparkSession, root: str, database: str = "public", tenant: str = "default", user: str = "root") -> None:
        self.spark, self.root, self.database = configure(spark), root.rstrip("/"), database
        self.session = {"current_tenant": tenant, "current_user": user, "current_role": "owner", "current_database": database}
        self.variables = {"server_version": "1.0", "cluster_name": "spark", "deployment_mode": "singleton", "node_id": "1"}
        self.databases: dict[str, dict[str, Stored]] = {database: {}}
        self.options: dict[str, dict[str, str]] = {database: dict(OPTIONS)}
        self.externals: dict[str, DataFrame] = {}
        self.streams: dict[str, dict[str, str]] = {}  # stream tables: what their WITH says
        self.reading: dict[str, tuple[str, str]] = {}  # running jobs and the tables they read
        self.accounts = accounts.Accounts({tenant: {"comment": "system tenant"}}, {user: {"granted_admin": "true"}}, {}, {tenant: {user: "owner"}})
        self.dropped: dict[str, list] = {}  # databases on their way out: until when they can be recovered, options, tables
        self.once = False  # whether stream jobs handle what is there and stop
        scalars.register(spark)
        gis.register(spark)
        series_ops.register(spark)
        for name, (args, result, body) in rewrite.HELPERS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
        self._load()

    # -- catalog --------------------------------------------------------------

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _load(self) -> None:
        fs, path = self._file("catalog.json")
        if fs.exists(path):
            text = self.spark.read.option("wholetext", "true").text(f"{self.root}/catalog.json").first()[0]
            known = json.loads(text)
            self.options |= known["options"]
            self.dropped = known.get("dropped", {})
            if "accounts" in known:
                self.accounts = accounts.Accounts(**known["accounts"])
            for d, tables in known["databases"].items():
                self.databases[d] = {n: _stored_from(t) for n, t in tables.items()}
        self._publish_all()

    def _save(self) -> None:
        """Write the catalog beside the old one and put it in its place."""
        text = json.dumps({"options": self.options, "dropped": self.dropped, "accounts": asdict(self.accounts), "databases": {d: {n: asdict(t) for n, t in ts.items()} for d, ts in self.databases.items()}})
        fs, path = self._file("catalog.json")
        _, new = self._file(f"catalog-{uuid.uuid4().hex}.tmp")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def _publish_all(self) -> None:
        for name in self.databases[self.database]:
            self._publish(name)

    def _named(self, tokens: list[Token], i: int) -> tuple[str, int]:
        """The table named at ``i``, ``table`` or ``database.table``, and the place after it."""
        if tokens[i + 1 : i + 2] == ["."]:
            if unquote(tokens[i]).lower() not in self.databases:
                raise SqlError(f"database not found: {unquote(tokens[i])}")
            return f"{unquote(tokens[i]).lower()}.{unquote(tokens[i + 2])}", i + 3
        return unquote(tokens[i]), i + 1

    def _split(self, name: str) -> tuple[str, str]:
        d, _, t = name.rpartition(".")
        return (d, t.lower()) if d in self.databases else (self.database, name.lower())

    def metadata(self, name: str, schema: str = "information_schema") -> DataFrame:
        """A view of ``information_schema`` or ``cluster_schema``."""
        tenant = self.session["current_tenant"]
        if f"{schema}.{name}" in accounts.VIEWS:
            return self._rows(self.accounts.rows(f"{schema}.{name}", tenant, self.session["current_role"]), accounts.VIEWS[f"{schema}.{name}"])
        if schema != "information_schema":
            raise SqlError(f"table not found: {schema}.{name}")
        every = [(d, s) for d, ts in self.databases.items() for s in ts.values()]
        if name == "databases":
            rows = [(tenant, d, o["ttl"], int(o["shard"]), o["vnode_duration"], int(o["replica"]), o["precision"].upper()) for d, o in self.options.items()]
        elif name == "tables":
            rows = [(tenant, d, s.table.name, "BASE TABLE", "SERIES", "") for d, s in every]
            rows += [(tenant, self.database, n, "BASE TABLE", "EXTERNAL", "") for n in self.externals] + [(tenant, self.database, n, "BASE TABLE", "STREAM", "") for n in self.streams]
        elif name == "columns":
            rows = []
            for d, s in every:
                t = s.table
                kinds = [(t.time, "TIME", f"TIMESTAMP({self.options[d]['precision'].upper()})"), *((c, "TAG", "STRING") for c in t.tags), *((c, "FIELD", k.upper()) for c, k in t.fields.items())]
                rows += [(tenant, d, t.name, c, role, i, "NULL", role != "TIME", kind, s.codecs.get(c, "DEFAULT")) for i, (c, role, kind) in enumerate(kinds)]
        elif name == "queries":
            rows = [(q.id, "stream", q.name or "", "RUNNING") for q in self.spark.streams.active]
        else:
            raise SqlError(f"table not found: information_schema.{name}")
        return self._rows(rows, VIEWS[name])

    # -- tables ---------------------------------------------------------------

    def _stored(self, name: str) -> Stored:
        d, t = self._split(name)
        found = self.databases[d].get(t)
        if found is None:
            raise SqlError(f"table not found: {name}")
        return found

    def create_table(self, table: SeriesTable, geometry: dict[str, str] | None = None, if_not_exists: bool = False, codecs: dict[str, str] | None = None, database: str | None = None) -> None:
        d = database or self.database
        tables, name = self.databases[d], table.name.lower()
        if name in tables:
            if if_not_exists:
                return
            raise SqlError(f"table exists: {table.name}")
        tables[name] = Stored(table, f"{self.root}/{d}/{name}-{uuid.uuid4().hex}", 0, geometry or {}, codecs=codecs or {})
        self._save()
        self._publish(f"{d}.{name}")

    def _schema(self, t: SeriesTable) -> str:
        return ", ".join([f"`{t.time}` timestamp_ntz", *(f"`{c}` string" for c in t.tags), *(f"`{c}` {k}" for c, k in t.fields.items())])

    def _stored_schema(self, t: SeriesTable) -> str:
        return ", ".join(["__ns bigint", *(f"`{c}` string" for c in t.tags), *(f"`{c}` {k}" for c, k in t.fields.items())])

    def _points(self, name: str) -> DataFrame:
        """The rows of a table after upserts and within the database's time to live, with ``__ns``."""
        s, (d, _) = self._stored(name), self._split(name)
        t = s.table
        if s.batches == 0:
            rows = self.spark.createDataFrame([], self._stored_schema(t))
        elif s.merged:
            rows = self.spark.read.schema(self._stored_schema(t)).parquet(s.path)
        else:
            rows = latest(self.spark.read.schema(self._stored_schema(t) + ", __seq bigint").parquet(s.path), list(t.tags), "__ns", list(t.fields), "__seq")
        out = rows.select(from_nanos(F.col("__ns")).alias(t.time), *t.tags, *t.fields, "__ns")
        ttl = self.options[d].get("ttl", "INF").strip().lower()
        if ttl not in ("inf", "0"):
            number, unit = (ttl[:-1], ttl[-1]) if ttl[-1] in SPANS else (ttl, "d")
            out = out.where(F.col("__ns") >= (F.unix_micros(F.current_timestamp()) - F.lit(int(float(number) * SPANS[unit]))) * 1000)
        return out

    def table(self, name: str) -> DataFrame:
        """The rows of a table after upserts."""
        return self._points(name).drop("__ns")

    def _publish(self, name: str) -> None:
        d, t = self._split(name)
        rows = self.table(f"{d}.{t}")
        rows.createOrReplaceTempView(f"tf_{d}_{t}")
        if d == self.database:
            rows.createOrReplaceTempView(self._stored(name).table.name)

    def _nanos(self, d: str, time: str, kind: str) -> F.Column:
        """Nanoseconds of a time column: whole numbers count units of the database's precision, times are cut to it."""
        unit = UNITS[self.options[d].get("precision", "NS").upper()]
        if kind in ("byte", "short", "integer", "long") or kind.startswith("decimal"):
            return F.col(time).cast("long") * unit
        ns = micros(F.col(time).cast("timestamp_ntz")) * 1000
        return ns - F.pmod(ns, F.lit(unit))

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> int:
        """Append rows by column name; returns how many."""
        s, (d, _) = self._stored(name), self._split(name)
        t, given = s.table, rows.toDF(*columns) if columns else rows
        target = self.spark.createDataFrame([], self._stored_schema(t).replace("__ns", f"`{t.time}`", 1))
        if t.time in given.columns:
            given = given.withColumn(t.time, self._nanos(d, t.time, given.schema[t.time].dataType.typeName()))
        shaped = files.by_name(given, target, None)
        for column, kind in s.geometry.items():
            shaped = shaped.withColumn(column, F.when(F.col(column).isNull() | gis.is_valid(kind)(F.col(column)), F.col(column)).otherwise(F.raise_error(F.lit(f"not a {kind}")).cast("string")))
        ns = F.when(F.col(t.time).isNull(), F.raise_error(F.lit("a row needs a time")).cast("bigint")).otherwise(F.col(t.time))
        ready = written_rows(shaped.withColumn("__ns", ns).drop(t.time), list(t.fields))
        s.batches, s.merged = s.batches + 1, False
        self._save()
        ready.withColumn("__seq", F.lit(s.batches).cast("long") * (1 << 33) + F.monotonically_increasing_id() % (1 << 33)).write.mode("append").parquet(s.path)
        self._publish(name)
        return self.spark.read.schema("__seq bigint").parquet(s.path).where(F.col("__seq") >= s.batches * (1 << 33)).count()

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Put rows with ``__ns`` in the place of a table's rows; refused while a stream job reads them."""
        s, key = self._stored(name), self._split(name)
        active = {q.id for q in self.spark.streams.active}
        if any(q in active and source == key for q, source in self.reading.items()):
            raise SqlError(f"a stream job reads {name}")
        path = re.sub(r"-[0-9a-f]{32}$", "", s.path) + "-" + uuid.uuid4().hex
        rows.drop(s.table.time).withColumn("__seq", F.lit(0).cast("long")).write.parquet(path)
        s.path, s.batches, s.merged = path, max(1, s.batches), True
        self._save()
        self._publish(name)

    # -- statements -----------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        """Run one statement."""
        tokens = tokenize(text.strip().rstrip(";"))
        if not tokens:
            raise SqlError("an empty statement")
        head = " ".join(t.upper() for t in tokens[:4])
        for start, handler in self._routes():
            if head.startswith(start):
                return handler(tokens)
        return self.query(join(tokens))

    def _routes(self):
        return (
            ("CREATE DATABASE", self._create_database),
            ("ALTER DATABASE", self._alter_database),
            ("DROP DATABASE", self._drop_database),
            ("COMPACT DATABASE", self._compact),
            ("RECOVER DATABASE", self._recover),
            *((f"{verb} {what}", self._account) for verb in ("CREATE", "DROP", "ALTER") for what in ("TENANT", "USER", "ROLE")),
            ("GRANT ", self._account),
            ("REVOKE ", self._account),
            ("SHOW DATABASES", lambda _: self._rows([(d,) for d in sorted(self.databases)], "database_name string")),
            ("SHOW TABLES", lambda _: self._rows([(s.table.name,) for s in self.databases[self.database].values()], "table_name string")),
            ("SHOW SERIES", self._show_series),
            ("SHOW TAG VALUES", self._show_tag_values),
            ("SHOW QUERIES", lambda _: self._rows([(q.id, q.name) for q in self.spark.streams.active], "query_id string, name string")),
            ("DESCRIBE TABLE", self._describe),
            ("DESCRIBE DATABASE", lambda t: self._rows(sorted(self.options[unquote(t[2]).lower()].items()), "option string, value string")),
            ("CREATE EXTERNAL TABLE", self._create_external),
            ("CREATE STREAM TABLE", self._create_stream),
            ("CREATE STREAM ", self._no_stream),
            ("KILL QUERY", self._kill),
            ("CREATE TABLE", self._create_table),
            ("DROP TABLE", self._drop_table),
            ("ALTER TABLE", self._alter_table),
            ("INSERT ", self._insert),
            ("DELETE ", self._delete),
            ("UPDATE ", self._update),
            ("COPY INTO", self._copy),
            ("EXPLAIN", self._explain),
        )

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _done(self, n: int | None = None) -> DataFrame:
        return self._rows([(n,)] if n is not None else [], "rows long")

    def _no_stream(self, tokens: list[Token]) -> DataFrame:
        raise SqlError("this statement is not supported; see tickforge.streaming")

    def query(self, text: str, streaming: bool = False) -> DataFrame:
        """A query in the engine's dialect."""
        if not streaming and any(unquote(t).lower() in self.streams for t in tokenize(text)):
            raise SqlError("a stream table is read by INSERT ... SELECT only")
        text = join(self._qualified(tokenize(text)))
        special = self._generating(tokenize(text)) or self._selecting(tokenize(text))
        if special is not None:
            return special
        ready = rewrite.select(text, self.variables, self.session, streaming)
        return self.spark.sql(rewrite.integer_division(ready, self._analyses) if "/" in ready else ready)

    def _qualified(self, tokens: list[Token]) -> list[Token]:
        """``database.table`` as the name of a view; the tables that a query names are published by this engine first."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t, name = tokens[i], unquote(tokens[i]).lower()
            dotted = tokens[i + 1 : i + 2] == ["."] and i + 2 < len(tokens) and out and (out[-1] == "," or out[-1].isword("FROM", "JOIN"))
            view = unquote(tokens[i + 2]).lower() if dotted else ""
            if dotted and name in ("information_schema", "cluster_schema"):
                self.metadata(view, name).createOrReplaceTempView(f"tf_{name}_{view}")
                out.append(Token(f"tf_{name}_{view}", "word"))
                i += 3
            elif dotted and view in self.databases.get(name, {}):
                self._publish(f"{name}.{view}")
                out.append(Token(f"tf_{name}_{view}", "word"))
                if not (i + 3 < len(tokens) and (tokens[i + 3].isword("AS") or tokens[i + 3].kind == "quoted")):
                    bare = i + 3 >= len(tokens) or tokens[i + 3].kind != "word" or tokens[i + 3].isword("WHERE", "GROUP", "ORDER", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "HAVING", "UNION", "INTERSECT", "EXCEPT", "OFFSET", "WINDOW", "SEMI", "ANTI")
                    out += [Token("AS", "word"), tokens[i + 2]] if bare else []
                i += 3
            else:
                if t.kind in ("word", "quoted") and name in self.databases[self.database] and out and (out[-1] == "," or out[-1].isword("FROM", "JOIN")):
                    self._publish(name)
                out.append(t)
                i += 1
        return out

    def _analyses(self, text: str) -> bool:
        try:
            self.spark.sql(text).schema  # noqa: B018
            return True
        except Exception:  # any error of the analyser means: not this form
            return False

    def _generating(self, tokens: list[Token]) -> DataFrame | None:
        """``SELECT f(time, value[, 'options']) FROM …`` of a function that makes a series."""
        known = {"timestamp_repair": series_ops.timestamp_repair, "value_fill": series_ops.value_fill, "value_repair": series_ops.value_repair}
        if len(tokens) < 3 or not tokens[0].isword("SELECT") or tokens[1].lower() not in known:
            if any(t.lower() in known and tokens[i + 1 : i + 2] == ["("] for i, t in enumerate(tokens)):
                raise SqlError("a function that makes a series stands alone in its SELECT list")
            return None
        args, end = arguments(tokens, 2)
        if not 2 <= len(args) <= 3:
            raise SqlError(f'The function "{tokens[1]}" does not accept {len(args)} function arguments.')
        if end + 1 >= len(tokens) or not tokens[end + 1].isword("FROM"):
            raise SqlError("a function that makes a series stands alone in its SELECT list")
        rows = self.query(f"SELECT {join(args[0])} AS time, {join(args[1])} AS value {join(tokens[end + 1 :])}")
        out = known[tokens[1].lower()](rows, [], "time", "value", unquote(args[2][0]) if len(args) == 3 else None)
        return out.select(F.timestamp_micros("time").cast("timestamp_ntz").alias("time"), "value").orderBy("time")

    def _selecting(self, tokens: list[Token]) -> DataFrame | None:
        """``SELECT topk(column, k), …``: sort, cut, project."""
        at = [i for i, t in enumerate(tokens) if t.isword("TOPK", "BOTTOM") and tokens[i + 1 : i + 2] == ["("]]
        if not at:
            return None
        if len(at) > 1 or not tokens[0].isword("SELECT"):
            raise SqlError("one selector function per SELECT")
        args, end = arguments(tokens, at[0] + 1)
        if len(args) != 2 or args[1][0].kind != "number":
            raise SqlError("a selector takes a column and a number")
        column = join(args[0])
        pick = selectors.topk if tokens[at[0]].isword("TOPK") else selectors.bottom
        rest = [*tokens[: at[0]], *tokenize(f"({column}) AS __selected"), *tokens[end + 1 :]]
        out = pick(self.query(join(rest)), "__selected", int(args[1][0]))
        return out.withColumnRenamed("__selected", column.strip("`\""))

    def _create_stream(self, tokens: list[Token]) -> DataFrame:
        """``CREATE STREAM TABLE s [(columns)] WITH (db = …, table = …, event_time_column = …[, watermark_delay = …]) ENGINE = …``."""
        i = 6 if tokens[3].isword("IF") else 3
        name = unquote(tokens[i])
        if name.lower() in self.streams and i == 3:
            raise SqlError(f"table exists: {name}")
        at = next((k for k, t in enumerate(tokens) if t.isword("WITH")), None)
        if at is None:
            raise SqlError("a stream table names its source")
        options = {a[0].lower(): unquote(a[2]) for a in arguments(tokens, at + 1)[0]}
        if not {"table", "event_time_column"} <= set(options):
            raise SqlError("a stream table needs table and event_time_column")
        d = options.setdefault("db", self.database).lower()
        s = self.databases.get(d, {}).get(options["table"].lower())
        if s is None:
            raise SqlError(f"table not found: {options['table']}")
        names = (s.table.time, *s.table.tags, *s.table.fields)
        if tokens[i + 1] == "(":
            missing = [unquote(c[0]) for c in arguments(tokens, i + 1)[0] if unquote(c[0]) not in names]
            if missing:
                raise SqlError(f"column not found: {missing[0]}")
        if options["event_time_column"] != s.table.time:
            raise SqlError("the event-time column is the table's time")
        self._open_stream(name, options)
        self.streams[name.lower()] = options
        return self._done()

    def _open_stream(self, name: str, options: dict[str, str]) -> tuple[str, str]:
        """Publish a stream over the table's present folder; returns the table's key."""
        d, t = options["db"].lower(), options["table"].lower()
        s = self.databases[d].get(t)
        if s is None:
            raise SqlError(f"table not found: {options['table']}")
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(s.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        schema = self.spark.createDataFrame([], self._stored_schema(s.table)).schema
        stream = jobs.StreamTable(s.path, schema, s.table.time, options.get("watermark_delay", "0 seconds"), nanos="__ns")
        stream.read(self.spark).createOrReplaceTempView(name)
        return d, t

    def _start_stream(self, name: str, rows: DataFrame, columns: list[str], source: tuple[str, str]) -> DataFrame:
        """Run INSERT ... SELECT from a stream table as a job; returns its id.  Results are upserted by series and time."""
        query = jobs.start(rows.toDF(*columns), lambda batch, _: self.insert(name, batch, columns), f"{self.root}/jobs/{uuid.uuid4().hex}", self.once)
        self.reading[query.id] = source
        return self._rows([(query.id,)], "query_id string")

    def _kill(self, tokens: list[Token]) -> DataFrame:
        jobs.kill_query(self.spark, unquote(tokens[2]))
        return self._done()

    def _create_database(self, tokens: list[Token]) -> DataFrame:
        i = 5 if tokens[2].isword("IF") else 2
        name = unquote(tokens[i]).lower()
        if name in self.databases and i == 2:
            raise SqlError(f"database exists: {name}")
        given = self._options(tokens[i + 1 :])
        self.databases.setdefault(name, {})
        self.options.setdefault(name, OPTIONS | given)
        self._save()
        return self._done()

    def _options(self, tokens: list[Token]) -> dict[str, str]:
        words = [unquote(t) for t in tokens if not t.isword("WITH", "SET") and t not in (",", "=")]
        given = {k.lower(): v for k, v in zip(words[::2], words[1::2])}
        if given.get("precision", "NS").upper() not in UNITS:
            raise SqlError(f"unknown precision: {given['precision']}")
        if not re.fullmatch(r"(?i)inf|\d+(\.\d+)?[dhm]?", given.get("ttl", "INF").strip()):
            raise SqlError(f"unknown time to live: {given['ttl']}")
        return given

    def _alter_database(self, tokens: list[Token]) -> DataFrame:
        name = unquote(tokens[2]).lower()
        if name not in self.databases:
            raise SqlError(f"database not found: {name}")
        given = self._options(tokens[3:])
        if "precision" in given:
            raise SqlError("the precision of a database cannot be changed")
        self.options[name] |= given
        self._save()
        self._publish_all()
        return self._done()

    def _compact(self, tokens: list[Token]) -> DataFrame:
        """Merge the batches of each table of a database, so that reads need no aggregation."""
        name = unquote(tokens[2]).lower()
        for t, s in self.databases[name].items():
            if s.batches and not s.merged:
                self._replace(f"{name}.{t}", self._points(f"{name}.{t}"))
        return self._done()

    def _drop_database(self, tokens: list[Token]) -> DataFrame:
        """``DROP DATABASE [IF EXISTS] d [AFTER '7d']``; with a time it can be recovered until then."""
        i = 4 if tokens[2].isword("IF") else 2
        name = unquote(tokens[i]).lower()
        tables = self.databases.pop(name, None)
        if tables is None and i == 2:
            raise SqlError(f"database not found: {name}")
        options = self.options.pop(name, None)
        if tables is not None and i + 2 < len(tokens) and tokens[i + 1].isword("AFTER"):
            span = unquote(tokens[i + 2]).lower()
            if not re.fullmatch(r"\d+[dhm]", span):
                raise SqlError(f"unknown span of time: {span}")
            self.dropped[name] = [time.time() + int(span[:-1]) * SPANS[span[-1]] / 1e6, options, {n: asdict(t) for n, t in tables.items()}]
        self._save()
        return self._done()

    def _recover(self, tokens: list[Token]) -> DataFrame:
        i = 4 if tokens[2].isword("IF") else 2
        name = unquote(tokens[i]).lower()
        until, options, tables = self.dropped.pop(name, (0, None, None))
        if until < time.time():
            if i == 4:
                return self._done()
            raise SqlError(f"no database to recover: {name}")
        self.options[name], self.databases[name] = options, {n: _stored_from(t) for n, t in tables.items()}
        self._save()
        return self._done()

    def _account(self, tokens: list[Token]) -> DataFrame:
        self.accounts.run(tokens, set(self.databases), self.session["current_tenant"])
        self._save()
        return self._done()

    def _create_table(self, tokens: list[Token]) -> DataFrame:
        maybe = tokens[2].isword("IF")
        full, i = self._named(tokens, 5 if maybe else 2)
        d, _ = self._split(full)
        columns, _ = arguments(tokens, i)
        tags: list[str] = []
        fields, geometry, codecs = {}, {}, {}
        for c in columns:
            if c[0].isword("TAGS"):
                tags = [unquote(a[0]) for a in arguments(c, 1)[0]]
                continue
            name, kind = unquote(c[0]), c[1:]
            codec = next((k for k, t in enumerate(kind) if t.isword("CODEC")), None)
            if codec is not None:
                if kind[codec + 2].upper() not in CODECS:
                    raise SqlError(f"unknown codec: {kind[codec + 2]}")
                codecs[name] = kind[codec + 2].upper()
                kind = kind[:codec]
            if kind and kind[0].isword("GEOMETRY"):
                shape, srid = (a[0] for a in arguments(kind, 1)[0])
                if shape.upper() not in GEOMETRIES or srid != "0":
                    raise SqlError(f"unknown geometry: {join(kind)}")
                fields[name], geometry[name] = "string", shape.upper()
                continue
            written = " ".join(t.upper() for t in kind)
            if written not in TYPES:
                raise SqlError(f"unknown type: {written}")
            fields[name] = TYPES[written]
        bare = full.rpartition(".")[2] if d != self.database or "." in full else full
        self.create_table(SeriesTable(bare, tuple(tags), fields, precision=self.options[d].get("precision", "NS").lower()), geometry, maybe, codecs, d)
        return self._done()

    def _drop_table(self, tokens: list[Token]) -> DataFrame:
        maybe = tokens[2].isword("IF")
        full, _ = self._named(tokens, 4 if maybe else 2)
        d, name = self._split(full)
        found = self.databases[d].pop(name, None)
        if found is None and self.externals.pop(name, None) is None and self.streams.pop(name, None) is None and not maybe:
            raise SqlError(f"table not found: {full}")
        if d == self.database:
            self.spark.catalog.dropTempView(found.table.name if found else name)
        self._save()
        return self._done()

    def _alter_table(self, tokens: list[Token]) -> DataFrame:
        full, i = self._named(tokens, 2)
        tokens = [*tokens[:2], Token(full, "word"), *tokens[i:]]
        s, what = self._stored(full), " ".join(t.upper() for t in tokens[3:5])
        t, name = s.table, unquote(tokens[4 if what.split()[0] in ("ADD", "DROP") and not tokens[4].isword("FIELD", "TAG", "COLUMN") else 5])
        rows = self._points(full)
        tags, fields = list(t.tags), dict(t.fields)
        if tokens[3].isword("ADD"):
            if name in (t.time, *tags, *fields):
                raise SqlError(f"column exists: {name}")
            if tokens[4].isword("TAG"):
                tags.append(name)
                rows = rows.withColumn(name, F.lit(None).cast("string"))
            else:
                at = tokens.index(next(x for x in tokens if unquote(x) == name))
                fields[name] = TYPES[" ".join(x.upper() for x in tokens[at + 1 :] if x.kind == "word" and not x.isword("CODEC", *CODECS))]
                rows = rows.withColumn(name, F.lit(None).cast(fields[name]))
        elif tokens[3].isword("DROP"):
            if name in tags or name == t.time:
                raise SqlError("tags and the time cannot be dropped")
            if name not in fields:
                raise SqlError(f"column not found: {name}")
            if len(fields) == 1:
                raise SqlError("the last field cannot be dropped")
            fields.pop(name)
            rows = rows.drop(name)
        elif tokens[3].isword("RENAME"):
            new = unquote(tokens[-1])
            if name == t.time:
                raise SqlError("the time cannot be renamed")
            if new in (t.time, *tags, *fields):
                raise SqlError(f"column exists: {new}")
            tags = [new if c == name else c for c in tags]
            fields = {new if c == name else c: k for c, k in fields.items()}
            rows = rows.withColumnRenamed(name, new)
        elif not tokens[3].isword("ALTER"):
            raise SqlError(f"unknown change: {what}")
        filled = s.batches
        s.table = SeriesTable(t.name, tuple(tags), fields, t.time, t.precision)
        if filled and not tokens[3].isword("ALTER"):
            self._replace(full, rows)
        else:
            self._save()
            self._publish(full)
        return self._done()

    def _describe(self, tokens: list[Token]) -> DataFrame:
        t = self._stored(self._named(tokens, 2)[0]).table
        rows = [(t.time, "TIMESTAMP", "TIME"), *((c, "STRING", "TAG") for c in t.tags), *((c, k.upper(), "FIELD") for c, k in t.fields.items())]
        return self._rows(rows, "column_name string, data_type string, column_type string")

    def _insert(self, tokens: list[Token]) -> DataFrame:
        i = 2 if tokens[1].isword("INTO") else 1
        name, i = self._named(tokens, i)
        columns = None
        t = self._stored(name).table
        if tokens[i] == "(" and not tokens[i + 1].isword("SELECT", "WITH", "VALUES"):
            args, end = arguments(tokens, i)
            columns, i = [unquote(a[0]) for a in args], end + 1
            columns = [next((c for c in (t.time, *t.tags, *t.fields) if c.lower() == x.lower()), x) for x in columns]
            if t.time not in columns:
                raise SqlError("an insert names the time")
        else:
            columns = [t.time, *t.tags, *t.fields] if t.tags else [t.time, *t.fields]
        used = {unquote(x).lower() for x in tokens[i:]} & set(self.streams)
        if used:
            source = [self._open_stream(n, self.streams[n]) for n in sorted(used)][0]
            return self._start_stream(name, self.query(join(tokens[i:]), streaming=True), columns, source)
        rows = self.query(join(tokens[i:])) if not tokens[i].isword("VALUES") else self.spark.sql(rewrite.select(join(tokens[i:])))
        return self._done(self.insert(name, rows.toDF(*columns), columns))

    def _where(self, tokens: list[Token], i: int) -> str:
        at = next((k for k in range(i, len(tokens)) if tokens[k].isword("WHERE")), None)
        return "true" if at is None else rewrite.select(join(tokens[at + 1 :]))

    def _delete(self, tokens: list[Token]) -> DataFrame:
        name, _ = self._named(tokens, 2)
        if any(t.isword("USING", "RETURNING") for t in tokens):
            raise SqlError("a delete takes no USING and no RETURNING")
        s = self._stored(name)
        self._replace(name, delete_where(self._points(name), self._where(tokens, 3), s.table))
        return self._done()

    def _update(self, tokens: list[Token]) -> DataFrame:
        name, i = self._named(tokens, 1)
        end = next((k for k, t in enumerate(tokens) if t.isword("WHERE")), len(tokens))
        parts, _ = arguments([Token("(", "op"), *tokens[i + 1 : end], Token(")", "op")], 0)
        sets = {unquote(p[0]): rewrite.select(join(p[2:])) for p in parts}
        self._replace(name, update(self._points(name), sets, self._where(tokens, 3), self._stored(name).table))
        return self._done()

    def _show_series(self, tokens: list[Token]) -> DataFrame:
        name, at = self._shown(tokens)
        t = self._stored(name).table
        return self._tail(tokens, at, lambda where: show_series(self.table(name), t.name, list(t.tags), where), t)

    def _shown(self, tokens: list[Token]) -> tuple[str, int]:
        """The table of a SHOW, ``[ON database] FROM table``, and the place after it."""
        at = next(k for k, t in enumerate(tokens) if t.isword("FROM"))
        name, end = self._named(tokens, at + 1)
        on = next((k for k in range(at) if tokens[k].isword("ON")), None)
        if on is not None:
            if unquote(tokens[on + 1]).lower() not in self.databases:
                raise SqlError(f"database not found: {unquote(tokens[on + 1])}")
            name = f"{unquote(tokens[on + 1]).lower()}.{name.rpartition('.')[2]}"
        return name, end

    def _tail(self, tokens: list[Token], i: int, build, t: SeriesTable) -> DataFrame:
        """WHERE (tags and time only), ORDER BY, LIMIT and OFFSET of a SHOW."""
        stop = next((k for k in range(i, len(tokens)) if tokens[k].isword("ORDER", "LIMIT", "OFFSET")), len(tokens))
        where = rewrite.select(join(tokens[i + 1 : stop])) if i < stop and tokens[i].isword("WHERE") else None
        if where is not None and any(x.kind == "word" and x in t.fields for x in tokens[i:stop]):
            raise SqlError("a filter of SHOW may only use tags and time")
        build(where).createOrReplaceTempView("__shown")
        return self.spark.sql(rewrite.select("SELECT * FROM __shown " + join(tokens[stop:])))

    def _show_tag_values(self, tokens: list[Token]) -> DataFrame:
        name, at = self._shown(tokens)
        t = self._stored(name).table
        if [x.upper() for x in tokens[at : at + 2]] != ["WITH", "KEY"]:
            raise SqlError("expected WITH KEY")
        i, negated = at + 2, False
        if tokens[i].isword("NOT"):
            negated, i = True, i + 1
        if tokens[i].isword("IN"):
            names, end = arguments(tokens, i + 1)
            keys, i = [unquote(n[0]) for n in names], end + 1
        elif tokens[i] in ("=", "!=", "<>"):
            negated, keys, i = negated or tokens[i] != "=", [unquote(tokens[i + 1])], i + 2
        else:
            raise SqlError("this form of WITH KEY is not supported")
        chosen = [c for c in t.tags if (c in keys) != negated]
        missing = [k for k in keys if k not in t.tags]
        if missing and not negated:
            raise SqlError(f"no such tag: {missing[0]}")
        return self._tail(tokens, i, lambda where: show_tag_values(self.table(name), chosen, where), t)

    def _create_external(self, tokens: list[Token]) -> DataFrame:
        """``CREATE EXTERNAL TABLE t [(columns)] STORED AS f [WITH HEADER ROW] [DELIMITER 'c'] … LOCATION 'p'``."""
        i = 6 if tokens[3].isword("IF") else 3
        name, schema, k = unquote(tokens[i]), None, i + 1
        if tokens[k] == "(":
            end = closing(tokens, k)
            sizes = {"NUMERIC": "decimal", "VARCHAR": "varchar", "INTEGER": "int"}
            schema = join([Token(sizes.get(t.upper(), t), t.kind) for t in tokens[k + 1 : end]])
            schema, k = re.sub(r"varchar\s*\([^)]*\)|varchar", "string", schema), end + 1
        words = [t.upper() for t in tokens]
        parted = next((j for j in range(k, len(tokens)) if tokens[j].isword("PARTITIONED")), None)
        if parted is not None and schema:  # folders name these columns
            have = {unquote(t).lower() for t in tokenize(schema)}
            schema = ", ".join([schema, *(f"`{unquote(c[0])}` string" for c in arguments(tokens, parted + 2)[0] if unquote(c[0]).lower() not in have)])
        after = lambda w, n=1: unquote(tokens[words.index(w, k) + n]) if w in words[k:] else None
        df = files.read_files(self.spark, after("LOCATION"), after("STORED", 2), schema, "HEADER" in words[k:], after("DELIMITER") or ",", (after("TYPE") or "").lower() or None)
        self.externals[name.lower()] = df
        df.createOrReplaceTempView(name)
        return self._done()

    def _copy(self, tokens: list[Token]) -> DataFrame:
        """``COPY INTO t[(columns)] FROM 'uri' …`` and ``COPY INTO 'uri' FROM t | (query) …``."""
        options = {}
        for key in ("FILE_FORMAT", "COPY_OPTIONS"):
            at = next((k for k, t in enumerate(tokens) if t.isword(key)), None)
            if at is not None:
                options |= {a[0].upper(): unquote(a[2]) for a in arguments(tokens, at + 2)[0]}
        self._connect(tokens)
        fmt, sep, header = options.get("TYPE", "csv").lower(), options.get("DELIMITER", ","), options.get("WITH_HEADER", "true").lower() == "true"
        at = next(k for k, t in enumerate(tokens) if t.isword("FROM"))
        if tokens[2].kind == "string":
            source = self.query(join(tokens[at + 2 : closing(tokens, at + 1)])) if tokens[at + 1] == "(" else self.query("SELECT * FROM " + join(tokens[at + 1 : self._named(tokens, at + 1)[1]]))
            files.copy_into_location(source, unquote(tokens[2]), fmt, header, sep)
            return self._done(source.count())
        name, k = self._named(tokens, 2)
        columns = [unquote(a[0]) for a in arguments(tokens, k)[0]] if tokens[k] == "(" else None
        t = self._stored(name).table
        infer = options.get("AUTO_INFER_SCHEMA", "false").lower() == "true"
        rows = files.read_files(self.spark, unquote(tokens[at + 1]), fmt, None if infer else self._schema(t), header, sep)
        return self._done(self.insert(name, rows, columns))

    def _connect(self, tokens: list[Token]) -> None:
        """``CONNECTION = (key = 'value', …)``: settings of the S3 store; others are refused."""
        at = next((k for k, t in enumerate(tokens) if t.isword("CONNECTION")), None)
        if at is None:
            return
        keys = {"access_key_id": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "endpoint_url": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "token": "fs.s3a.session.token"}
        for a in arguments(tokens, at + 2)[0]:
            if a[0].lower() not in keys:
                raise SqlError(f"unknown setting of a connection: {a[0]}")
            self.spark.sparkContext._jsc.hadoopConfiguration().set(keys[a[0].lower()], unquote(a[2]))

    def _explain(self, tokens: list[Token]) -> DataFrame:
        k = 1
        while tokens[k].isword("ANALYZE", "VERBOSE", "FORMAT", "EXTENDED"):
            k += 2 if tokens[k].isword("FORMAT") else 1
        df = self.query(join(tokens[k:]))
        if any(t.isword("ANALYZE") for t in tokens[1:k]):  # run it, then show the plan that ran
            start = time.perf_counter()
            n = len(df.collect()) if not df._jdf.queryExecution().analyzed().isStreaming() else 0
            ran = df._jdf.queryExecution().executedPlan().toString()
            return self._rows([(f"{ran}\nrows: {n}, seconds: {time.perf_counter() - start:.3f}",)], "plan string")
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if any(t.isword("VERBOSE") for t in tokens[:k]) else "formatted"))
        return self._rows([(plan,)], "plan string")

"""Tables as snapshot folders under one root, their metadata in a manifest that is replaced in one rename."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators import fulltext

TYPES = {"INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType()}
#: Declared columns of the built-in tables.
BUILT_IN = {
    "agent_sessions": "id string, agent_id string, state string, context map<string,string>, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "agent_memories": "id string, session_id string, type string, content string, importance double, access_count bigint, associations array<string>, embedding array<float>, created_at timestamp, accessed_at timestamp",
    "agent_decisions": "id string, session_id string, parent_id string, type string, input string, output string, reasoning string, tools_used array<string>, duration_ms bigint, token_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, created_at timestamp",
    "knowledge_entities": "id string, type string, name string, properties map<string,string>, source string, confidence double, created_at timestamp, updated_at timestamp",
    "knowledge_relations": "id string, type string, source_id string, target_id string, properties map<string,string>, weight double, created_at timestamp",
    "data_lineage": "data_id string, source_type string, source_ids array<string>, steps array<struct<type:string,operation:string,parameters:map<string,string>,timestamp:timestamp>>, decision_ids array<string>, created_at timestamp",
}
ALIASES = {"sessions": "agent_sessions", "memories": "agent_memories", "decisions": "agent_decisions", "entities": "knowledge_entities", "relations": "knowledge_relations", "lineage": "data_lineage"}
INDEX_KINDS = ("HASH", "BTREE", "INVERTED")
#: Folders that a table or index has at most; before one more, all but the first are merged.
PARTS = 64


class CatalogError(ValueError):
    pass


class ConstraintError(ValueError):
    pass


@dataclass
class Column:
    name: str
    type: str
    length: int | None = None
    nullable: bool = True
    primary_key: bool = False
    default: object = None

    @property
    def spark(self) -> T.DataType:
        return TYPES[self.type] if self.type in TYPES else T._parse_datatype_string(self.type)

    @property
    def declared(self) -> str:
        return f"{self.type}({self.length})" if self.length else self.type


@dataclass
class Table:
    name: str
    columns: list[Column]
    version: int = 0
    built_in: bool = False
    #: The versions whose folders together hold the rows.
    parts: list[int] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True) for c in self.columns])

    @property
    def key(self) -> str | None:
        return next((c.name for c in self.columns if c.primary_key), "id" if any(c.name == "id" for c in self.columns) else None)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise CatalogError(f"unknown column {name} of {self.name}")


@dataclass
class Index:
    name: str
    table: str
    column: str
    type: str = "BTREE"
    unique: bool = False
    parts: list[int] = field(default_factory=list)


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._load() or self._first()

    # Manifest

    def _first(self) -> State:
        tables = {}
        for name, ddl in BUILT_IN.items():
            columns = [Column(f.name, f.dataType.simpleString(), primary_key=i == 0) for i, f in enumerate(T._parse_datatype_string(ddl).fields)]
            tables[name] = Table(name, columns, built_in=True)
        return State(tables)

    def _load(self) -> State | None:
        path = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(path):
            return None
        got = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect()))
        tables = {k: Table(v["name"], [Column(**c) for c in v["columns"]], v["version"], v["built_in"], v["parts"]) for k, v in got["tables"].items()}
        return State(tables, {k: Index(**v) for k, v in got["indexes"].items()})

    def _save(self, state: State) -> None:
        text = json.dumps({"tables": {k: asdict(v) for k, v in state.tables.items()}, "indexes": {k: asdict(v) for k, v in state.indexes.items()}})
        new, old = self._path(f"{self.root}/manifest.new"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = context._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration()).rename(new, old, how)
        self.state = state

    # Names

    def table(self, name: str) -> Table:
        name = ALIASES.get(name, name)
        if name not in self.state.tables:
            raise CatalogError(f"unknown table {name}")
        return self.state.tables[name]

    def _own(self, name: str) -> Table:
        t = self.table(name)
        if t.built_in:
            raise CatalogError(f"{t.name} is built in")
        return t

    def read(self, name: str) -> DataFrame:
        """The table's latest snapshot in its declared columns; columns added since are null in older rows."""
        t = self.table(name)
        if not t.version:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*self._folders("table", t.name, t.parts))

    def _folders(self, kind: str, name: str, parts: list[int]) -> list[str]:
        return [f"{self.root}/{kind}/{name}/v={p}" for p in parts]

    def index_table(self, name: str) -> DataFrame:
        i = self._index(name)
        t = self.table(i.table)
        kind = dict(self.read(t.name).dtypes)
        if not t.version:
            key = "term string" if i.type == "INVERTED" else f"key {kind[i.column]}, folded {kind[i.column]}"
            return self.spark.createDataFrame([], f"{key}, row_id {kind[t.key]}")
        return self.spark.read.parquet(*self._folders("index", name, i.parts))

    def _index(self, name: str) -> Index:
        if name not in self.state.indexes:
            raise CatalogError(f"unknown index {name}")
        return self.state.indexes[name]

    # Snapshots

    def replace(self, name: str, rows: DataFrame, table: Table | None = None) -> None:
        """Write rows as the table's next snapshot with its indexes, then make the manifest name it. Readers of the old snapshot go on."""
        state = copy.deepcopy(self.state)
        t = copy.deepcopy(table or self.table(name))
        t.version = self.table(name).version + 1
        t.parts = [t.version]
        state.tables[t.name] = t
        new = self._write(t, rows)
        for i in state.indexes.values():
            if i.table == t.name:
                self._build(i, t, new)
                i.parts = [t.version]
        self._save(state)

    def append(self, name: str, rows: DataFrame) -> int:
        """Write rows as one more folder of the table and of its indexes; the folders before it stay as they are. How many rows."""
        state = copy.deepcopy(self.state)
        t = state.tables[self.table(name).name]
        mine = [i for i in state.indexes.values() if i.table == t.name]
        if len(t.parts) >= PARTS:
            t.version += 1
            self.spark.read.schema(t.schema).parquet(*self._folders("table", t.name, t.parts[1:])).write.mode("overwrite").parquet(f"{self.root}/table/{t.name}/v={t.version}")
            t.parts = [t.parts[0], t.version]
            for i in mine:
                if len(i.parts) > 2:
                    side = self.spark.read.parquet(*self._folders("index", i.name, i.parts[1:]))
                    side.sortWithinPartitions(side.columns[0]).write.mode("overwrite").parquet(f"{self.root}/index/{i.name}/v={t.version}")
                    i.parts = [i.parts[0], t.version]
        old = self.read(t.name)
        t.version += 1
        t.parts.append(t.version)
        new = self._write(t, rows)
        for i in mine:
            if i.unique and not fulltext.unique_clashes(old, new, i.column).isEmpty():
                raise ConstraintError(f"index {i.name}: values are not unique")
            self._build(i, t, new)
            i.parts.append(t.version)
        self._save(state)
        return new.count()

    def _write(self, t: Table, rows: DataFrame) -> DataFrame:
        """Write rows as the folder of the table's version, and read them again."""
        folder = f"{self.root}/table/{t.name}/v={t.version}"
        rows.select(*[F.col(c.name).cast(c.spark).alias(c.name) for c in t.columns]).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(t.schema).parquet(folder)

    def _build(self, i: Index, t: Table, rows: DataFrame) -> None:
        if i.unique and not fulltext.unique_violations(rows, i.column).isEmpty():
            raise ConstraintError(f"index {i.name}: values are not unique")
        out = fulltext.inverted_index(rows, i.column, t.key) if i.type == "INVERTED" else fulltext.key_index(rows, i.column, t.key)
        out.sortWithinPartitions(out.columns[0]).write.mode("overwrite").parquet(f"{self.root}/index/{i.name}/v={t.version}")

    # Statements

    def create_table(self, name: str, columns: list[Column], if_not_exists: bool = False) -> None:
        if ALIASES.get(name, name) in self.state.tables:
            if if_not_exists:
                return
            raise CatalogError(f"table {name} exists")
        if len({c.name for c in columns}) < len(columns) or sum(c.primary_key for c in columns) > 1:
            raise CatalogError("columns repeat, or there are several primary keys")
        state = copy.deepcopy(self.state)
        state.tables[name] = Table(name, columns)
        self._save(state)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if if_exists and ALIASES.get(name, name) not in self.state.tables:
            return
        t = self._own(name)
        state = copy.deepcopy(self.state)
        del state.tables[t.name]
        gone = [i for i in state.indexes if state.indexes[i].table == t.name]
        for i in gone:
            del state.indexes[i]
        self._save(state)
        for folder in [f"table/{t.name}", *(f"index/{i}" for i in gone)]:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def add_column(self, name: str, column: Column) -> None:
        t = copy.deepcopy(self._own(name))
        if any(c.name == column.name for c in t.columns):
            raise CatalogError(f"column {column.name} exists")
        t.columns.append(column)
        state = copy.deepcopy(self.state)
        state.tables[t.name] = t
        self._save(state)

    def drop_column(self, name: str, column: str) -> None:
        t = copy.deepcopy(self._own(name))
        c = t.column(column)
        if c.primary_key or self._indexed(t.name, column):
            raise CatalogError(f"column {column} is a key or indexed")
        rows = self.read(name).drop(column)
        t.columns.remove(c)
        self.replace(name, rows, t)

    def modify_column(self, name: str, column: Column) -> None:
        t = copy.deepcopy(self._own(name))
        old = t.column(column.name)
        if old.type != column.type and (old.primary_key or self._indexed(t.name, column.name)):
            raise CatalogError(f"column {column.name} is a key or indexed")
        column.primary_key = old.primary_key
        rows = self.read(name).withColumn(column.name, F.col(column.name).cast(column.spark))
        t.columns[t.columns.index(old)] = column
        self.replace(name, rows, t)

    def _indexed(self, table: str, column: str) -> bool:
        return any(i.table == table and i.column == column for i in self.state.indexes.values())

    def create_index(self, name: str, table: str, column: str, kind: str = "BTREE", unique: bool = False, if_not_exists: bool = False) -> None:
        if name in self.state.indexes:
            if if_not_exists:
                return
            raise CatalogError(f"index {name} exists")
        t = self.table(table)
        t.column(column)
        kind = {"FULLTEXT": "INVERTED"}.get(kind, kind)
        if kind not in INDEX_KINDS or unique and kind == "INVERTED":
            raise CatalogError(f"no such index: {'UNIQUE ' * unique}{kind}")
        i = Index(name, t.name, column, kind, unique)
        if t.version:
            self._build(i, t, self.read(t.name))
            i.parts = [t.version]
        state = copy.deepcopy(self.state)
        state.indexes[name] = i
        self._save(state)

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if if_exists and name not in self.state.indexes:
            return
        self._index(name)
        state = copy.deepcopy(self.state)
        del state.indexes[name]
        self._save(state)
        self._fs.delete(self._path(f"{self.root}/index/{name}"), True)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.state.tables)], "table_name string")

    def describe(self, name: str) -> DataFrame:
        rows = [(c.name, c.declared, "NO" if c.primary_key or not c.nullable else "YES", "PRI" if c.primary_key else "", None if c.default is None else str(c.default)) for c in self.table(name).columns]
        return self.spark.createDataFrame(rows, "field string, type string, `null` string, key string, `default` string")

    def show_indexes(self, table: str | None = None) -> DataFrame:
        name = ALIASES.get(table, table)
        rows = [(i.name, i.table, i.column, i.type, i.unique) for i in sorted(self.state.indexes.values(), key=lambda i: i.name) if name in (None, i.table)]
        return self.spark.createDataFrame(rows, "name string, `table` string, `column` string, type string, `unique` boolean")

    # Rows

    def checked(self, t: Table, rows: DataFrame) -> DataFrame:
        """New rows with types, NOT NULL and lengths held against the table's columns."""
        bad = F.array(*[x for c in t.columns for x in violations(c)])
        found = rows.select(F.explode(F.filter(bad, lambda x: x.isNotNull()))).limit(1).collect() if t.columns else []
        if found:
            raise ConstraintError(found[0][0])
        return rows

    def insert(self, name: str, rows: DataFrame) -> int:
        """Append rows: missing columns get their default; ids that are missing get a UUID in text columns."""
        t = self.table(name)
        unknown = [c for c in rows.columns if c not in [x.name for x in t.columns]]
        if unknown:
            raise CatalogError(f"unknown column {unknown[0]} of {t.name}")
        cols = []
        for c in t.columns:
            given = F.col(c.name) if c.name in rows.columns else F.lit(c.default)
            if c.name == t.key and c.name == "id" and c.spark == T.StringType():
                given = F.coalesce(given, F.expr("uuid()"))
            cols.append(given.cast(c.spark).alias(c.name))
        new = self.checked(t, rows.select(*cols))
        if t.key and not new.groupBy(t.key).count().where("count > 1").isEmpty() or t.key and not new.join(self.read(name), t.key, "left_semi").isEmpty():
            raise ConstraintError(f"duplicate key in {t.name}")
        return self.append(name, new)

    def update(self, name: str, changes: dict[str, F.Column], where: F.Column) -> int:
        """Set columns of the rows where the condition is true; all values are those of the row before."""
        t = self.table(name)
        hit = F.coalesce(where, F.lit(False))
        old = self.read(name)
        n = old.where(hit).count()
        if n:
            new = old.select(*[F.when(hit, changes[c.name].cast(c.spark)).otherwise(F.col(c.name)).alias(c.name) if c.name in changes else F.col(c.name) for c in t.columns])
            self.checked(t, new)
            if t.key in changes and not new.groupBy(t.key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"duplicate key in {t.name}")
            self.replace(name, new)
        return n

    def delete(self, name: str, where: F.Column) -> int:
        """Remove the rows where the condition is true; those where it is null stay."""
        hit = F.coalesce(where, F.lit(False))
        old = self.read(name)
        n = old.where(hit).count()
        if n:
            self.replace(name, old.where(~hit))
        return n

    def lookup(self, index: str, equal=None, low=None, high=None, match: str | None = None) -> DataFrame:
        """Rows of an index's table by key, inclusive range or tokens; the predicate is held against the rows themselves again."""
        i = self._index(index)
        t = self.table(i.table)
        rows, side = self.read(t.name), self.index_table(index)
        if match is not None:
            return fulltext.match_index(rows, side, t.key, match)
        test = lambda c: (c == F.lit(equal)) if equal is not None else F.lit(True)
        if low is not None or high is not None:
            test = lambda c: (c >= F.lit(low) if low is not None else F.lit(True)) & (c <= F.lit(high) if high is not None else F.lit(True))
        hit = side.where(test(F.col("key"))).select("row_id")
        return rows.join(hit, rows[t.key] == hit["row_id"], "left_semi").where(test(F.col(i.column)))


def violations(c: Column) -> list[F.Column]:
    """Messages of a row that breaks a column's rules, else null."""
    out = []
    if c.primary_key or not c.nullable:
        out.append(F.when(F.col(c.name).isNull(), F.lit(f"{c.name} must not be NULL")))
    if c.length:
        out.append(F.when(F.octet_length(F.col(c.name)) > c.length, F.lit(f"{c.name} is longer than {c.length} bytes")))
    return out or [F.lit(None).cast("string")]


__all__ = ["BUILT_IN", "Catalog", "CatalogError", "Column", "ConstraintError", "Index", "Table", "violations"]

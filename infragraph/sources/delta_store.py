"""A store of keyed tables that is merged when it is read: a bucketed base, and small deltas over it.

Each table has a key. Rows are written as deltas, of which the newest one with a key wins; a row may say that its key is
gone. Base and deltas are Parquet in the same number of buckets, by a part of the key, so that looking up the keys of a
batch shuffles the batch and never the stored rows. A batch of n rows writes n rows; deltas are merged with each other
once there are ``max_deltas``, and into the base once they hold ``share`` of its rows, which makes the work of
rewriting proportional to what is written.

What counts is the newest manifest below ``_log``, a small JSON file that names the folders of each table; a new one
appears by a rename that fails if its number is taken. Folders that no manifest names, left by a crash, are never read and
go with ``vacuum``. A ``View`` is a manifest in hand: it stays readable while later ones are committed, and ``stage``
gives one with another delta, which nobody else sees before it is committed.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE, SEQ = "__gone", "__seq"


@dataclass(frozen=True)
class KeyedTable:
    """``bucket`` is a part of ``keys``: the columns that deal rows into buckets."""

    schema: T.StructType
    keys: tuple[str, ...]
    bucket: tuple[str, ...]


@contextlib.contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Inside, a join on all of a key takes rows that are dealt by a part of it as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole; an error if it is there already."""
    jvm = spark._jvm
    part = f"{path}.{uuid.uuid4().hex}"
    fs, at = _fs(spark, part)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(at), context.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def _opened(spark: SparkSession, schema: T.StructType, bucket: tuple[str, ...], n: int, path: str) -> DataFrame:
    """Files in buckets as a table that knows them; its catalog entry goes again at once."""
    name = f"opened_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(bucket)}) INTO {n} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return out


@dataclass(frozen=True)
class View:
    """The tables as one manifest, and what is staged over it, has them."""

    spark: SparkSession
    path: str
    tables: dict[str, KeyedTable]
    state: dict

    # reading

    def _part(self, table: str, folder: str, delta: bool) -> DataFrame:
        t = self.tables[table]
        schema = T.StructType([*t.schema.fields, T.StructField(GONE, T.BooleanType())]) if delta else t.schema
        return _opened(self.spark, schema, t.bucket, self.state["buckets"], f"{self.path}/{folder}")

    def base(self, table: str) -> DataFrame | None:
        found = self.state["tables"][table]["base"]
        return self._part(table, found[0], False) if found else None

    def newest(self, table: str) -> DataFrame | None:
        """Of each key in the deltas the last row, and whether it is gone."""
        t, out = self.tables[table], None
        deltas = self.state["tables"][table]["deltas"]
        for i, (folder, _) in enumerate(deltas):
            own = self._part(table, folder, True).withColumn(SEQ, F.lit(i))
            out = own if out is None else out.unionByName(own)
        if out is None or len(deltas) == 1:
            return None if out is None else out.drop(SEQ)
        rest = [c for c in (*t.schema.names, GONE) if c not in t.keys]
        last = out.groupBy(*t.keys).agg(F.max_by(F.struct(*rest), SEQ).alias("r"))
        return last.select(*t.keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*t.schema.names, GONE)

    def _pieces(self, table: str, where: str | Column | None = None, columns: list[str] | None = None) -> list[DataFrame]:
        """The stored rows in two pieces: those of the base that no delta has, and those of the deltas."""
        t = self.tables[table]
        names = list(dict.fromkeys([*t.keys, *(columns or t.schema.names)]))
        base, newest, out = self.base(table), self.newest(table), []
        if base is not None:
            kept = base.where(where) if where is not None else base
            kept = kept.select(*names)
            out.append(kept if newest is None else kept.join(newest.select(*t.keys), list(t.keys), "left_anti").select(*names))
        if newest is not None:
            kept = newest.where(~F.col(GONE))
            out.append((kept.where(where) if where is not None else kept).select(*names))
        return out or [self.spark.createDataFrame([], t.schema).select(*names)]

    def read(self, table: str, where: str | Column | None = None) -> DataFrame:
        """All rows of the table, or those of a condition."""
        first, *more = self._pieces(table, where)
        for x in more:
            first = first.unionByName(x)
        return first

    def lookup(self, table: str, wanted: DataFrame) -> DataFrame:
        """``wanted``, which has the key's columns, with ``stored``: the stored row of the key as a struct, or null."""
        t = self.tables[table]
        keys, base, newest = list(t.keys), self.base(table), self.newest(table)
        row = F.struct(*t.schema.names)
        none = F.lit(None).cast(t.schema)
        out = wanted
        if newest is not None:
            out = out.join(newest.select(*keys, row.alias("__delta"), GONE), keys, "left")
        if base is not None:
            out = out.join(base.select(*keys, row.alias("__base")), keys, "left")
        stored = F.col("__base") if base is not None else none
        if newest is not None:
            stored = F.when(F.col(GONE).isNull(), stored).when(~F.col(GONE), F.col("__delta")).otherwise(none)
        return out.select(*[F.col(f"`{c}`") for c in wanted.columns], stored.alias("stored"))

    def unmatched(self, table: str, wanted: DataFrame, where: str | Column) -> DataFrame:
        """Stored rows of a condition whose key is not among ``wanted``."""
        keys, out = list(self.tables[table].keys), None
        for piece in self._pieces(table, where):
            own = piece.join(wanted.select(*keys), keys, "left_anti").select(*self.tables[table].schema.names)
            out = own if out is None else out.unionByName(own)
        return out

    def matching(self, table: str, wanted: DataFrame) -> DataFrame:
        """Stored rows whose bucket columns are among ``wanted``, which has these, each once."""
        on, out = list(self.tables[table].bucket), None
        for piece in self._pieces(table):
            own = piece.join(wanted.select(*on), on, "left_semi").select(*self.tables[table].schema.names)
            out = own if out is None else out.unionByName(own)
        return out

    # writing

    def _written(self, table: str, rows: DataFrame) -> list:
        t, n = self.tables[table], self.state["buckets"]
        name, folder = f"written_{uuid.uuid4().hex}", f"{table}/{uuid.uuid4().hex}"
        with co_partitioned(self.spark):
            rows.repartition(n, *t.bucket).write.option("compression", "zstd").option("path", f"{self.path}/{folder}").bucketBy(n, *t.bucket).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return [folder, self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").count()]

    def stage(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> View:
        """A view with the rows of ``rows``, a key at most once, and without the keys of ``gone``."""
        t = self.tables[table]
        delta = rows.select(*t.schema.names, F.lit(False).alias(GONE))
        if gone is not None:
            rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in t.keys else F.col(f.name) for f in t.schema]
            delta = delta.unionByName(gone.select(*rest, F.lit(True).alias(GONE)))
        own = self.state["tables"][table]
        return self._with(table, own | {"deltas": [*own["deltas"], self._written(table, delta)]})

    def _with(self, table: str, own: dict) -> View:
        return replace(self, state=self.state | {"tables": self.state["tables"] | {table: own}})

    def noted(self, **notes: object) -> View:
        """A view whose manifest holds these notes too."""
        return replace(self, state=self.state | {"notes": self.state["notes"] | notes})

    def compacted(self, max_deltas: int = 8, share: float = 0.25) -> View:
        """A view whose tables have fewer deltas where they are many, and none where they are large."""
        out = self
        for table, own in self.state["tables"].items():
            base, deltas = own["base"], own["deltas"]
            if deltas and sum(n for _, n in deltas) >= share * (base[1] if base else 0):
                out = out._with(table, {"base": self._written(table, self.read(table)), "deltas": []})
            elif len(deltas) >= max_deltas:
                out = out._with(table, own | {"deltas": [self._written(table, self.newest(table))]})
        return out


class DeltaStore:
    """The views of one store, and their commits; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, KeyedTable], buckets: int | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def versions(self) -> list[int]:
        fs, at = _fs(self.spark, f"{self.path}/_log")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def view(self, version: int | None = None) -> View:
        """The newest version or a given one; before the first, empty tables."""
        known = self.versions()
        if version is None and not known:
            return View(self.spark, self.path, self.tables, {"version": -1, "buckets": self.buckets, "notes": {}, "tables": {t: {"base": None, "deltas": []} for t in self.tables}})
        fs, at = _fs(self.spark, f"{self.path}/_log/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(at)
        try:
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return View(self.spark, self.path, self.tables, state)

    def commit(self, view: View) -> View:
        """Makes a staged view the newest version; fails if another one was committed since it was taken."""
        state = view.state | {"version": view.state["version"] + 1}
        _write_once(self.spark, f"{self.path}/_log/{state['version']:012d}.json", json.dumps(state))
        return replace(view, state=state)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the manifests but for the last ``keep`` and all folders that these do not name; returns how many folders."""
        known = self.versions()
        used = {x[0] for v in known[-keep:] for t in self.view(v).state["tables"].values() for x in [*([t["base"]] if t["base"] else []), *t["deltas"]]}
        for v in known[:-keep]:
            fs, at = _fs(self.spark, f"{self.path}/_log/{v:012d}.json")
            fs.delete(at, False)
        dropped = 0
        for table in self.tables:
            fs, at = _fs(self.spark, f"{self.path}/{table}")
            for x in fs.listStatus(at) if fs.exists(at) else []:
                if f"{table}/{x.getPath().getName()}" not in used:
                    fs.delete(x.getPath(), True)
                    dropped += 1
        return dropped

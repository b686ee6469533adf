"""Keyed conditional merge, history of changed rows, and versioned tables to publish them."""

from __future__ import annotations

import bisect
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOREVER = "9999-12-31 00:00:00"


def differs(compared: list[str], left: str = "_t", right: str = "_s") -> Column:
    """Whether any compared column changes; null is a value like any other."""
    return ~F.struct(*[F.col(f"{left}.{c}") for c in compared]).eqNullSafe(F.struct(*[F.col(f"{right}.{c}") for c in compared]))


def merged(target: DataFrame, source: DataFrame, keys: list[str], compared: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` inserted, or taken over where a compared column differs.

    Rows that the source lacks stay. Adds ``change``: inserted, updated or none. The source has one
    row a key; where it doesn't, reduce it first (``latest.last_wins``). One full outer join on the
    keys, so both sides are shuffled once, or not at all if they are bucketed by them.
    """
    rest = [c for c in target.columns if c not in keys]
    compared = rest if compared is None else compared
    t = target.select(*keys, F.struct(*rest).alias("_t")) if rest else target.withColumn("_t", F.struct(F.lit(1).alias("x")))
    s = source.select(*keys, F.struct(*rest).alias("_s")) if rest else source.select(*keys, F.struct(F.lit(1).alias("x")).alias("_s"))
    both = t.join(s, keys, "full_outer")
    change = F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNotNull() & (differs(compared) if compared else F.lit(False)), "updated").otherwise("none")
    both = both.withColumn("change", change)
    taken = F.when(F.col("change") == "none", F.col("_t")).otherwise(F.col("_s"))
    both = both.withColumn("_v", taken)
    return both.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest], "change").select(*target.columns, "change")


def changes(result: DataFrame) -> DataFrame:
    return result.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def with_history(current: DataFrame, history: DataFrame, result: DataFrame, keys: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(current, history) after a merge at ``at``: a changed row's old version is closed and kept.

    ``current`` has valid_from and valid_to, ``result`` is what ``merged`` gave on its other columns.
    """
    names = [c for c in current.columns if c not in ("valid_from", "valid_to")]
    old = current.join(result.where("change = 'updated'").select(*keys), keys, "left_semi").withColumn("valid_to", at)
    since = current.select(*keys, F.col("valid_from").alias("_from"))
    now = result.join(since, keys, "left")
    now = now.withColumn("valid_from", F.when(F.col("change") == "none", F.col("_from")).otherwise(at)).withColumn("valid_to", F.lit(FOREVER).cast("timestamp"))
    return now.select(*names, "valid_from", "valid_to"), history.unionByName(old.select(*history.columns))


def as_of(current: DataFrame, history: DataFrame, moment: Column) -> DataFrame:
    """The rows that held at ``moment``."""
    both = current.unionByName(history)
    return both.where((F.col("valid_from") <= moment) & (moment < F.col("valid_to")))


def temporal(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, valid_from, valid_to), the item a struct."""
    return df.select(F.struct(*columns).alias("item"), "valid_from", "valid_to")


class Conflict(Exception):
    """Another writer has published the next version first."""


#: Buckets of a table that merges rewrite in parts.
BUCKETS = 16
#: Rows of one file of a table kept in key order; a fuller one is split when it is next rewritten.
FILE_ROWS = 1_000_000
#: Seconds for which prune spares what no version names: a writer may be staging it.
STAGING_SECONDS = 24 * 3600
_BUCKET, _PART, _SPLIT = "_bucket", "_part", "_split"
#: Under this name a pointer has the list of a table's files and their key ranges.
_FILES = "~"


class Store:
    """Versioned Parquet tables of one folder that numbered pointer files publish together.

    Writers stage any number of tables in a fresh folder; ``publish`` makes them current with one
    rename to the next number. A pointer is never changed or replaced, so readers see all of one
    version, a failed stage leaves the last one current, and of two writers that read the same version
    one gets a ``Conflict``. Merged tables are kept in buckets of their keys, or in files of disjoint
    ranges in an order of their keys, and a merge rewrites only the buckets or files that it touches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._Path(self.path).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), conf)
        self._no_option = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def versions(self) -> list[int]:
        found = self._fs.globStatus(self._Path(f"{self.path}/VERSION-*"))
        return sorted(int(f.getPath().getName().partition("-")[2]) for f in found or [])

    def _pointer(self, version: int) -> str:
        return f"{self.path}/VERSION-{version:012d}"

    def _tables(self, version: int | None) -> dict[str, dict[str, str]]:
        """Folders by table and bucket; tables without buckets have one folder, under no name."""
        out: dict[str, dict[str, str]] = {}
        if version is not None:
            for r in self.spark.read.text(self._pointer(version)).collect():
                name, bucket, where = r.value.split("\t")
                out.setdefault(name, {})[bucket] = where
        return out

    def _latest(self) -> int | None:
        return max(self.versions(), default=None)

    def _read(self, entry: dict[str, str] | None) -> DataFrame | None:
        if entry and _FILES in entry:
            where = [r.file for r in self.spark.read.parquet(entry[_FILES]).select("file").collect()]
        else:
            where = [w for b, w in (entry or {}).items() if b != "#"]
        return self.spark.read.parquet(*where).drop("change", _BUCKET, _PART, _SPLIT) if where else None

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as the last version has it, or one before."""
        return self._read(self._tables(self._latest() if version is None else version).get(name))

    def files(self, name: str, version: int | None = None) -> DataFrame:
        """(file, lo, hi, n) of a table in key order: each file's least and greatest key, and its rows."""
        return self.spark.read.parquet(self._tables(self._latest() if version is None else version)[name][_FILES])

    def read_between(self, name: str, low, high, version: int | None = None) -> DataFrame:
        """Rows of a table in key order whose first ordered column lies between two values, from the files that can hold such."""
        files = self.files(name, version)
        first = files.schema["lo"].dataType.names[0]
        kind = self.read(name, version).schema[first].dataType
        ends = [_ordinal(F.lit(x).cast(kind), kind) for x in (low, high)]
        where = [r.file for r in files.where((F.col(f"hi.{first}") >= ends[0]) & (F.col(f"lo.{first}") <= ends[1])).collect()]
        rows = self.spark.read.parquet(*where).drop("change", _PART, _SPLIT) if where else self.read(name, version).limit(0)
        return rows.where(F.col(first).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))

    def _move(self, version: int | None, tables: dict[str, dict[str, str]]) -> None:
        fresh = self._Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write("".join(f"{n}\t{b}\t{w}\n" for n, parts in sorted(tables.items()) for b, w in sorted(parts.items())).encode())
        out.close()
        try:
            self._context.rename(fresh, self._Path(self._pointer((version or 0) + 1)), self._no_option)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {(version or 0) + 1} is there") from e
            raise

    def change(self) -> Change:
        """A change of any number of tables, based on the last version."""
        return Change(self)

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Writes all tables, then makes them current at once; other tables keep their version."""
        change = self.change()
        for name, df in tables.items():
            change.put(name, df)
        change.publish()

    def merge(self, name: str, source: DataFrame, keys: list[str], compared: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
        """Merges ``source`` (one row a key) into a table of buckets and publishes it; returns counts by change.

        Only buckets that have keys of the source are read and rewritten. The first merge makes the table.
        """
        change = self.change()
        counts = change.merge(name, source, keys, compared, buckets)
        change.publish()
        return counts

    def merge_ordered(self, name: str, source: DataFrame, keys: list[str], by: list[str], compared: list[str] | None = None, rows: int = FILE_ROWS) -> DataFrame:
        """Merges ``source`` into a table whose files are ranges of the keys in the order of ``by``, and publishes it.

        With the time first, a batch of recent rows rewrites the last files, however long the table is.
        """
        change = self.change()
        counts = change.merge_ordered(name, source, keys, by, compared, rows)
        change.publish()
        return counts

    def _folders(self, version: int) -> set[str]:
        """Names of the folders that a version needs."""
        needed = set()
        for entry in self._tables(version).values():
            where = {w for b, w in entry.items() if b != "#"}
            if _FILES in entry:
                where |= {r.file for r in self.spark.read.parquet(entry[_FILES]).select("file").collect()}
            needed |= {w.split(f"{self.path}/", 1)[-1].split("/", 1)[0] for w in where}
        return needed

    def prune(self, keep: int = 2, staging: float = STAGING_SECONDS) -> None:
        """Deletes all but the last ``keep`` versions and the folders that only those had.

        A folder that no version has may be a writer's that hasn't published yet: it goes once nothing
        has been staged in it for ``staging`` seconds. The folders of versions that another prune
        deleted go at that age too.
        """
        versions = self.versions()
        used = set().union(*(self._folders(v) for v in versions[-keep:]))
        ended = set().union(*(self._folders(v) for v in versions[:-keep]))
        for v in versions[:-keep]:
            self._fs.delete(self._Path(self._pointer(v)), False)
        for f in self._fs.listStatus(self._Path(self.path)):
            name, age = f.getPath().getName(), time.time() - f.getModificationTime() / 1000
            if f.isDirectory() and name not in used and (name in ended or age > staging):
                self._fs.delete(f.getPath(), True)


def _ordinal(value: Column, kind: T.DataType) -> Column:
    """``value`` as something whose order Python and Spark agree on: moments as microseconds, dates as days."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), value)
    return F.unix_date(value) if isinstance(kind, T.DateType) else value


def _key(df: DataFrame, by: list[str]) -> Column:
    return F.struct(*(_ordinal(F.col(c), df.schema[c].dataType).alias(c) for c in by))


def _comparable(key) -> tuple:
    """A key for Python to compare; nulls come first, as in Spark."""
    return tuple((v is not None, v) for v in key)


def _located(source: DataFrame, by: list[str], least: list[tuple]) -> DataFrame:
    """``source`` with the number of the file that each row belongs to: the last that begins at or before its key, or the first."""
    schema = T.StructType([*source.schema.fields, T.StructField(_PART, T.IntegerType())])
    if len(least) < 2:
        return source.withColumn(_PART, F.lit(0))

    def number(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("_key")).to_pylist()
            found = [max(0, bisect.bisect_right(least, _comparable(k.values())) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int32())], [*batch.schema.names[:-1], _PART])

    return source.withColumn("_key", _key(source, by)).mapInArrow(number, schema)


class Change:
    """Tables staged on top of one version of a store, published together."""

    def __init__(self, store: Store):
        self.store, self.version = store, store._latest()
        self.tables, self.folder = store._tables(self.version), f"{store.path}/{uuid.uuid4().hex}"

    def _touch(self) -> None:
        """A new file in the staging folder, so that its age counts from now."""
        self.store._fs.create(self.store._Path(f"{self.folder}/.staged-{uuid.uuid4().hex}"), True).close()

    def read(self, name: str) -> DataFrame | None:
        """A table as it is with what has been staged."""
        return self.store._read(self.tables.get(name))

    def put(self, name: str, df: DataFrame) -> None:
        """A whole table."""
        self._touch()
        df.write.parquet(f"{self.folder}/{name}")
        self.tables[name] = {"": f"{self.folder}/{name}"}

    def merge(self, name: str, source: DataFrame, keys: list[str], compared: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
        """What ``Store.merge`` does, staged."""
        now = dict(self.tables.get(name, {}))
        if "" in now or _FILES in now:
            raise ValueError(f"{name} has no buckets")
        self._touch()
        buckets = int(now.get("#", buckets))
        place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {str(r[0]) for r in source.select(place).distinct().collect()}
        there = [now[b] for b in sorted(touched & now.keys())]
        target = self.store.spark.read.schema(source.schema).parquet(*there) if there else source.limit(0)
        result = merged(target, source, keys, compared).withColumn(_BUCKET, place)
        result.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        now |= {b: f"{self.folder}/{name}/{_BUCKET}={b}" for b in touched}
        self.tables[name] = now | {"#": str(buckets)}
        return changes(self.store.spark.read.parquet(f"{self.folder}/{name}"))

    def merge_ordered(self, name: str, source: DataFrame, keys: list[str], by: list[str], compared: list[str] | None = None, rows: int = FILE_ROWS) -> DataFrame:
        """What ``Store.merge_ordered`` does, staged.

        ``by`` is an order of the keys. Each source row belongs to one file by the files' least keys,
        which the driver holds, one a file; only the files found are read, joined to their rows and
        written again, those that would hold more than ``rows`` in several. Ranges stay disjoint.
        """
        entry, spark = self.tables.get(name, {}), self.store.spark
        if entry and _FILES not in entry:
            raise ValueError(f"{name} isn't in key order")
        if sorted(by) != sorted(keys):
            raise ValueError("the order must be one of the keys")
        self._touch()
        before = spark.read.parquet(entry[_FILES]).orderBy("lo").collect() if entry else []
        located = _located(source, by, [_comparable(r.lo) for r in before])
        arriving = {r[_PART]: r.n for r in located.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()}
        size = {p: n + (before[p].n if before else 0) for p, n in arriving.items()}
        for several in (False, True):
            parts = [p for p, n in size.items() if (n > rows) == several]
            if not parts:
                continue
            incoming = located if len(parts) == len(size) else located.where(F.col(_PART).isin(parts))
            if before:
                there = spark.createDataFrame([(before[p].file, p) for p in parts], f"_file string, {_PART} int")
                old = spark.read.schema(source.schema).parquet(*(before[p].file for p in parts)).select("*", F.col("_metadata.file_path").alias("_file"))
                old = old.join(F.broadcast(there), "_file").drop("_file").select(*located.columns)
            else:
                old = located.limit(0)
            result = merged(old, incoming, [*keys, _PART], compared)
            pieces = sum(-(-size[p] // rows) for p in parts)
            dealt = result.repartitionByRange(pieces, _PART, *by) if several else result.repartition(_PART)
            where = f"{self.folder}/{name}/{_SPLIT}={int(several)}"
            dealt.sortWithinPartitions(_PART, *by).write.option("maxRecordsPerFile", rows).partitionBy(_PART).parquet(where)
        if not size:
            return changes(merged(source, source, keys))
        made = spark.read.parquet(f"{self.folder}/{name}")
        key = _key(made, by)
        files = made.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
        if before:
            gone = spark.createDataFrame([(before[p].file,) for p in size], "file string")
            files = files.unionByName(spark.read.parquet(entry[_FILES]).join(F.broadcast(gone), "file", "left_anti"))
        files.coalesce(1).write.parquet(f"{self.folder}/{name}-files")
        self.tables[name] = {_FILES: f"{self.folder}/{name}-files"}
        return changes(made)

    def publish(self) -> None:
        """Makes all that was staged current at once."""
        self.store._move(self.version, self.tables)


def in_stages(store: Store, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> None:
    """Runs stages in order, each seeing the tables of those before, and publishes all or nothing."""
    made: dict[str, DataFrame] = {}
    for name, stage in stages:
        made[name] = stage(made)
    store.publish(made)

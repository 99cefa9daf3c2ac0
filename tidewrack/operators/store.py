"""Tables under a folder, in bucketed Parquet files, with one manifest that names the files of all of them.

A job works in a transaction: it reads the tables as one manifest names them,
writes new files beside the old ones and at last publishes a manifest with the
next number, which exists for everybody or for nobody. So all tables of a job
change at once, and a job that stops anywhere has changed nothing and can run
again. A manifest keeps which runs of which jobs it holds: a run that was
published isn't done twice. Of two jobs that started from one manifest the
second to publish gets Conflict, and Store.run starts it anew.

A table with keys lies in buckets by a hash of them. A merge writes its changes
once, by bucket, reads the old rows of the buckets that have changes and writes
those; all other buckets stay the files they are. In a file rows are sorted by
key, with Parquet's own minimum, maximum and Bloom filter of the keys, so a look
for a few keys reads few row groups.

A manifest is written under another name and renamed; numbers are skipped that
an empty file of some other writer holds. Driver and executors must share the
folder. What no manifest names is removed by expire().
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
RUNS_KEPT = 1000


class Conflict(RuntimeError):
    """Another transaction was published first."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="tables")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucket_of(keys: Iterable[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- manifests ----

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _list(self, *names: str) -> list:
        path = self._path(*names)
        fs = path.getFileSystem(self._conf())
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> dict[int, int]:
        """Number and size of each file that may be a manifest."""
        found = {x.getPath().getName(): x.getLen() for x in self._list("manifests")}
        return {int(k): n for k, n in found.items() if k.isdigit()}

    def head(self) -> int:
        """The number of the current manifest, 0 without one."""
        return max([0, *(k for k, n in self._numbers().items() if n)])

    def _next(self) -> int:
        """The number of the next manifest, behind all that are taken, be it by an empty file."""
        return max([0, *self._numbers()]) + 1

    def manifest(self, n: int) -> dict:
        if not n:
            return {"tables": {}, "runs": {}}
        path = self._path("manifests", str(n))
        stream = path.getFileSystem(self._conf()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, base: int, state: dict) -> int:
        """Make state the next manifest, if base is still the current one."""
        jvm, conf = self.spark._jvm, self._conf()
        n = self._next()
        if self.head() != base:
            raise Conflict(f"manifest {base} isn't the current one any more")
        made, final = self._path("manifests", f"made-{uuid.uuid4().hex}"), self._path("manifests", str(n))
        out = made.getFileSystem(conf).create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(made, final, never)
        except Py4JJavaError as e:
            made.getFileSystem(conf).delete(made, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"manifest {n} was published meanwhile") from e
            raise
        return n

    # ---- use ----

    def begin(self, dry: bool = False) -> Transaction:
        """A transaction over the tables as they are now. A dry one leaves the store's folder alone: its files go to a scratch folder that close() removes, and it can't be published."""
        return Transaction(self, dry)

    def run(self, job: str, run: str, body: Callable[[Transaction], object], dry: bool = False, tries: int = 5) -> object:
        """What body(transaction) returns, once its changes are published; None if this run of the job already was. dry: as begin().

        What body returns must not read tables lazily if it is used after files expire.
        """
        for left in reversed(range(tries)):
            tx = self.begin(dry)
            if tx.ran(job, run):
                return None
            result = body(tx)
            if dry:
                tx.close()
                return result
            try:
                tx.publish(job, run)
                return result
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a manifest, all of it or some buckets."""
        return self._frame(self.manifest(version or self.head()), name, buckets)

    def version(self, name: str) -> int:
        """The number of the manifest that changed the table last, 0 if there is no such table."""
        return self.manifest(self.head())["tables"].get(name, {}).get("since", 0)

    def write(self, name: str, df: DataFrame, keys: Iterable[str] = (), buckets: int = 1) -> int:
        """A transaction that makes df the whole table; a new one gets these keys and buckets."""
        tx = self.begin()
        if name not in tx.state["tables"]:
            tx.create(name, df.schema, keys, buckets)
        tx.put(name, df)
        return tx.publish()

    def merge(self, name: str, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        tx = self.begin()
        tx.merge(name, changes, how)
        return tx.publish()

    def apply(self, name: str, change: Callable[[DataFrame], DataFrame], dry: bool = False) -> DataFrame:
        """change is a function of the whole table; with dry its result is returned and nothing written."""
        tx = self.begin()
        if dry:
            return tx._fit(name, change(tx.read(name)))
        tx.put(name, change(tx.read(name)))
        tx.publish()
        return tx.read(name)

    def pairs(self, name: str, old: int, new: int | None = None) -> DataFrame:
        """old and new, the rows with one key that differ between two manifests, null where there is none; only buckets whose files differ are read."""
        a, b = self.manifest(old), self.manifest(new or self.head())
        x, y = a["tables"].get(name, {}).get("files", {}), b["tables"][name]["files"]
        keys, columns = b["tables"][name]["keys"], T.StructType.fromJson(b["tables"][name]["schema"]).names
        if not keys:
            raise ValueError(f"{name} has no keys to compare rows by")
        differ = [k for k in {*x, *y} if x.get(k) != y.get(k)]
        row = lambda m, side: (self._frame(m, name, differ) if name in m["tables"] else self._frame(b, name, [])).select(*[F.col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)], F.struct(*columns).alias(side))
        on = [F.col(f"_old{i}").eqNullSafe(F.col(f"_new{i}")) for i in range(len(keys))]
        return row(a, "old").join(row(b, "new"), on, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("old", "new")

    def diff(self, name: str, old: int, new: int | None = None) -> DataFrame:
        """change ("insert", "update" or "delete") and the row (of a delete, the old one) between two manifests."""
        change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
        return self.pairs(name, old, new).select(change.alias("change"), F.coalesce("new", "old").alias("row")).select("change", "row.*")

    def expire(self, keep: int = 10, hours: float = 24) -> int:
        """Remove all manifests but the last keep, and files that none of these names and that are older than so many hours, so that no running job's are. The number of folders removed."""
        numbers = sorted(k for k, size in self._numbers().items() if size)
        named = {p.rsplit("/", 1)[0] if p.rsplit("/", 1)[1].startswith(BUCKET) else p for k in numbers[-keep:] for t in self.manifest(k)["tables"].values() for p in t["files"].values()}
        fs = self._path().getFileSystem(self._conf())
        for k in numbers[:-keep]:
            fs.delete(self._path("manifests", str(k)), False)
        before, gone = (time.time() - hours * 3600) * 1000, 0
        for table in self._list("data"):
            for x in self._list("data", table.getPath().getName()):
                if f"data/{table.getPath().getName()}/{x.getPath().getName()}" not in named and x.getModificationTime() <= before:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone

    # ---- files ----

    def _frame(self, state: dict, name: str, buckets: Iterable[int | str] | None = None) -> DataFrame:
        if name not in state["tables"]:
            raise ValueError(f"{name} has no snapshot")
        t = state["tables"][name]
        schema = T.StructType.fromJson(t["schema"])
        paths = [p for b, p in sorted(t["files"].items()) if buckets is None or b in set(map(str, buckets))]
        return self._load(schema, paths) if paths else self.spark.createDataFrame([], schema)

    def _load(self, schema: T.StructType, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[p if "://" in p or p.startswith(("/", "file:")) else f"{self.folder}/{p}" for p in paths])

    def _write(self, name: str, df: DataFrame, keys: list[str], buckets: int, scratch: str | None = None, order: Iterable[str] = (), options: dict[str, str] | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str]:
        """Write rows to a new folder: the path of each bucket that has some, within the store's folder or whole in a scratch one.

        Rows are dealt by bucket and a bucket of more than Spark's advisory size to several tasks, so a task gets no more as a table grows; such a bucket has several files. dealt: as put().
        """
        folder = f"{scratch or 'data'}/{name}/{uuid.uuid4().hex}"
        place = folder if scratch else f"{self.folder}/{folder}"
        if keys:
            df = (df if dealt else df.withColumn(BUCKET, bucket_of(keys, buckets))).hint("rebalance", BUCKET)
            df = (dealt(df) if dealt else df).sortWithinPartitions(BUCKET, *keys, *order)
        writer = df.write.options(**(options or {}))
        for k in keys:
            if df.schema[k].dataType.typeName() in ("string", "integer", "long", "binary"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if not keys:
            writer.parquet(place)
            return {"": folder}
        writer.partitionBy(BUCKET).parquet(place)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        found = [x.getPath().getName() for x in path.getFileSystem(self._conf()).listStatus(path)]
        return {x.split("=")[1]: f"{folder}/{x}" for x in found if x.startswith(f"{BUCKET}=")}


class Transaction:
    """Changes to tables that nobody sees before publish()."""

    def __init__(self, store: Store, dry: bool = False):
        self.store, self.base = store, store.head()
        self.state = store.manifest(self.base)
        self._scratch = shared_folder(store.spark, "dry") if dry else None
        self._changed: set[str] = set()

    def ran(self, job: str, run: str) -> bool:
        return str(run) in self.state["runs"].get(job, [])

    def create(self, name: str, schema: T.StructType | str, keys: Iterable[str] = (), buckets: int = 1, order: Iterable[str] = (), options: dict[str, str] | None = None) -> None:
        """An empty table, if there is none of that name. order: columns to sort files by besides the keys; options: of Spark's Parquet writer."""
        if name not in self.state["tables"]:
            schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            self.state["tables"][name] = {"schema": json.loads(schema.json()), "keys": list(keys), "buckets": buckets, "order": list(order), "options": options or {}, "files": {}, "since": 0}
            self._changed.add(name)

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, with this transaction's own changes."""
        return self.store._frame(self.state, name, buckets)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that the keys of rows are in; there are no more than the table's."""
        t = self.state["tables"][name]
        return [r[0] for r in self._fit(name, rows, t["keys"]).select(bucket_of(t["keys"], t["buckets"])).distinct().collect()]

    def drop(self, name: str) -> None:
        """Take a table out of the manifest."""
        del self.state["tables"][name]
        self._changed.discard(name)

    def keys(self, name: str) -> list[str]:
        return self.state["tables"][name]["keys"]

    def _fit(self, name: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(self.state["tables"][name]["schema"])}
        return df.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in columns or list(kinds)])

    def put(self, name: str, df: DataFrame, dealt: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Make df the whole table.

        With dealt, df has rows of any kind with a bucket of the caller's own; dealt makes the table's rows and their bucket of them behind the shuffle. Such a table can't be merged into.
        """
        t = self.state["tables"][name]
        t["files"] = self.store._write(name, df if dealt else self._fit(name, df), t["keys"], t["buckets"], self._scratch, t["order"], t["options"], dealt)
        t["dealt"] = dealt is not None
        self._changed.add(name)

    def merge(self, name: str, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Make how(old rows, changes) the rows of the buckets that have changes. changes must have the table's keys, and how must leave keys of rows as they are."""
        t = self.state["tables"][name]
        if not t["keys"]:
            raise ValueError(f"{name} has no keys to merge by")
        if t.get("dealt"):
            raise ValueError(f"{name} has buckets that aren't by its keys")
        changes = self._fit(name, changes, changes.columns)
        landed = self.store._write(f"{name}-changes", changes, t["keys"], t["buckets"], self._scratch)
        if not landed:
            return
        merged = self._fit(name, how(self.store._frame(self.state, name, landed), self.store._load(changes.schema, landed.values())))
        made = self.store._write(name, merged, t["keys"], t["buckets"], self._scratch, t["order"], t["options"])
        if more := set(made) - set(landed):
            raise ValueError(f"a merge of {name} gave rows in buckets without changes: {sorted(more)[:5]}")
        t["files"] = {b: p for b, p in t["files"].items() if b not in landed} | made
        self._changed.add(name)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df written once and read back, for what several tables are made of; no manifest names it."""
        return self.store._load(df.schema, self.store._write(f"{name}-staged", df, [], 1, self._scratch).values())

    def close(self) -> None:
        """Remove the files of a dry transaction."""
        if self._scratch:
            path = self.store.spark._jvm.org.apache.hadoop.fs.Path(self._scratch)
            path.getFileSystem(self.store._conf()).delete(path, True)

    def publish(self, job: str | None = None, run: str | None = None) -> int:
        """Let everybody see the changes; the number of the manifest that has them. Without changes and without a job nothing is published."""
        if self._scratch:
            raise ValueError("a dry transaction has nothing to publish")
        if not self._changed and job is None:
            return self.base
        if job is not None:
            self.state["runs"][job] = [*self.state["runs"].get(job, []), str(run)][-RUNS_KEPT:]
        number = self.store._next()
        for name in self._changed:
            self.state["tables"][name]["since"] = number
        return self.store._publish(self.base, self.state)

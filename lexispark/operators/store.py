"""Keyed store operations as DataFrame to DataFrame functions, and stores of tables that change in part and together."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..folders import new_folder
from .dense import id_filter


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys the one with the highest ``order`` stays; of rows that are equal in that too, a new one before an old one, then by a hash of the row."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("fresh"), F.xxhash64(*old.columns)))
    return both.withColumn("newest", newest).where("newest = 1").drop("newest", "fresh")


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    gone = deleted.select(F.col(parent_key).alias("gone_key")).distinct()
    return children.join(gone, F.col(child_key) == F.col("gone_key"), "left_anti")


def counts(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """collection, chunks (0 for those without any), has_chunks."""
    own = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return collections.select("collection").distinct().join(own, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("chunks"), (F.coalesce("n", F.lit(0)) > 0).alias("has_chunks"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place (from 1) in an order; rows that are equal in it by a hash of the row.

    They are dealt by ranges of the order and written, numbered within their range; only the number of rows of each range is summed up in one task.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "numbered")
    ties = F.xxhash64(*rows.columns)
    dealt = rows.repartitionByRange(*order, ties).sortWithinPartitions(*order, ties)
    dealt.withColumn(name, F.monotonically_increasing_id()).write.parquet(folder)
    ranged = spark.read.schema(StructType([*rows.schema.fields, StructField(name, LongType())])).parquet(folder).withColumn("in_range", F.shiftright(name, 33))
    sizes = ranged.groupBy("in_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("in_range", F.coalesce(F.sum("n").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    place = F.col("rows_before") + F.col(name).bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(before), "in_range").withColumn(name, place).drop("in_range", "rows_before")


def next_ids(existing: DataFrame, new: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """New rows with ids after the largest there is, in their order."""
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top_id"))
    rows = numbered(new, order, "nth_row").crossJoin(F.broadcast(top))
    return rows.withColumn(id_column, F.col("top_id") + F.col("nth_row")).select(*[c for c in new.columns if c != id_column], id_column)


def ranks_of(wanted: DataFrame, ranking: DataFrame, order: list, id_column: str) -> DataFrame:
    """``wanted`` with the ``place`` of its rows in a whole ranking; null where the ranking doesn't have them. No place is cut off."""
    keys = [c for c in ranking.columns if c == id_column]
    return wanted.join(numbered(ranking, order, "place").select(*keys, "place"), id_column, "left")


def collection_scan(rows: DataFrame, collection: str, doc_ids: object = None) -> DataFrame:
    """The rows of one collection, of these documents where any are named; a collection that isn't there has none."""
    only = id_filter("doc_id", doc_ids)
    own = rows.where(F.col("collection") == collection)
    return own if only is None else own.where(only)


def touched(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chats with updated_at moved to their latest message."""
    latest = messages.groupBy(F.col("chat_id").alias("id")).agg(F.max("created_at").alias("latest"))
    return chats.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "latest")).drop("latest")


def model_switch(active: Column, wanted: Column, known: Column) -> Column:
    """What a change of the embedding model does to a store: rejected, written, nothing or cleared."""
    return F.when(~known, "rejected").when(active.isNull(), "written").when(active == wanted, "nothing").otherwise("cleared")


@dataclass(frozen=True)
class Spec:
    """What a table is: its schema, the keys that tell rows apart (none: rows are only replaced as a whole), the column that decides between rows of a key, and its buckets."""

    schema: str | StructType
    keys: tuple[str, ...] = ()
    order: str | None = None
    buckets: int = 16


class Conflict(RuntimeError):
    """Another writer has changed a table that this transaction has read."""


class Store:
    """Tables in one folder, of which each state is one manifest that names the files of all tables.

    A keyed table has a base and deltas, both dealt by key into buckets: an upsert or a delete writes the rows or keys it is about and
    nothing else, a read merges only buckets with deltas, and a compaction rewrites only buckets with more than ``most_deltas`` of them.
    A manifest is whole before it gets its name, and a name is given once: where two writers want the same number, one is told, looks at what the
    other did and goes on behind it, unless that changed what it has read. Readers keep the state they opened, as the files of the last ``keep`` states stay.
    A name is given by a hard link on a local disk and by a rename that doesn't overwrite elsewhere; a store without either can't hold these tables.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Spec], *, keep: int = 8, most_deltas: int = 8):
        self.spark, self.path, self.tables, self.keep, self.most_deltas = spark, path.rstrip("/"), tables, keep, most_deltas
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # Files.

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._files().globStatus(self._path(pattern))
        return sorted(f.getPath().getName() for f in found or [])

    def _put(self, name: str, text: str) -> None:
        stream = self._files().create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _give_name(self, fresh: str, name: str) -> bool:
        """Names a file, unless the name is taken; one writer at most succeeds."""
        files = self._files()
        try:
            if files.getUri().getScheme() == "file":
                local = lambda x: self.spark._jvm.java.io.File(self._path(x).toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(local(name), local(fresh))
                files.delete(self._path(fresh), False)
            else:
                no = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
                self._hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(fresh), self._path(name), no)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            files.delete(self._path(fresh), False)
            return False
        return True

    # States.

    def state(self) -> dict:
        """The newest manifest: its number, for each table its base (bucket to folder) and deltas (folder and buckets), and the last batch of each stream."""
        names = self._names("CURRENT-*")
        if not names:
            return {"number": -1, "tables": {}, "batches": {}}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/{names[-1]}").first()[1]
        return json.loads(text)

    def _commit(self, state: dict) -> bool:
        number = state["number"] + 1
        fresh = f"next-{uuid.uuid4().hex}"
        self._put(fresh, json.dumps(state | {"number": number}))
        if not self._give_name(fresh, f"CURRENT-{number:012d}"):
            return False
        self._expire(number)
        return True

    def _expire(self, number: int) -> None:
        """Deletes manifests before the last ``keep``, and the folders that only these name."""
        old = [n for n in self._names("CURRENT-*") if int(n.partition("-")[2]) <= number - self.keep]
        if not old:
            return
        said = dict(self.spark.sparkContext.wholeTextFiles(f"{self.path}/CURRENT-*").collect())
        by_name = {path.rpartition("/")[2]: _folders(json.loads(text)) for path, text in said.items()}
        kept = set().union(*(f for n, f in by_name.items() if n not in old))
        gone = set().union(*(by_name.get(n, set()) for n in old)) - kept
        for name in [*gone, *old]:
            self._files().delete(self._path(name), True)

    def _bucket(self, spec: Spec) -> Column:
        return (F.pmod(F.xxhash64(*spec.keys), F.lit(spec.buckets)) if spec.keys else F.lit(0)).cast("int")

    def _write(self, spec: Spec, rows: DataFrame, kind: str) -> tuple[str, list[str]]:
        """Writes rows by bucket; returns the folder and the buckets that have rows."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket(spec))
        if spec.keys:
            dealt = dealt.repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder, [n.partition("=")[2] for n in self._names(f"{folder}/bucket=*")]

    def _scan(self, schema: StructType, places: list[tuple[str, str]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{folder}/bucket={b}" for folder, b in places))

    def read(self, name: str, state: dict | None = None, only: set[str] | None = None) -> DataFrame:
        """A table's rows; ``only`` these buckets."""
        spec, entry = self.tables[name], (state or self.state())["tables"].get(name, _EMPTY)
        schema = _struct(spec.schema)
        wanted = lambda b: only is None or b in only
        dirty = {b for _, buckets in entry["deltas"] for b in buckets if wanted(b)}
        plain = self._scan(schema, [(folder, b) for b, folder in entry["base"].items() if wanted(b) and b not in dirty])
        if not dirty:
            return plain
        logged = StructType([*schema.fields, StructField("gone", BooleanType())])
        parts = [self._scan(schema, [(folder, b) for b, folder in entry["base"].items() if b in dirty]).withColumns({"gone": F.lit(False), "nth": F.lit(-1)})]
        for nth, (folder, buckets) in enumerate(entry["deltas"]):
            if some := [(folder, b) for b in buckets if b in dirty]:
                parts.append(self._scan(logged, some).withColumn("nth", F.lit(nth)))
        rows = reduce(DataFrame.unionByName, parts)
        of_key = Window.partitionBy(*spec.keys)
        newest = [F.desc(c) for c in ([spec.order] if spec.order else [])] + [F.desc("nth"), F.xxhash64(*schema.names)]
        alive = rows.withColumn("last_gone", F.max(F.when(F.col("gone"), F.col("nth"))).over(of_key)).where(~F.col("gone") & (F.col("nth") > F.coalesce("last_gone", F.lit(-2))))
        merged = alive.withColumn("place", F.row_number().over(of_key.orderBy(*newest))).where("place = 1").select(*schema.names)
        return plain.unionByName(merged)

    def transaction(self, stream: str | None = None, batch: int | None = None) -> Transaction:
        return Transaction(self, stream, batch)

    def table(self, name: str) -> Table:
        return Table._of(self, name)

    def compact(self, name: str, more_than: int = 0) -> list[str]:
        """Merges the deltas of buckets that have more than ``more_than`` into their base; returns these buckets."""
        spec, state = self.tables[name], self.state()
        entry = state["tables"].get(name, _EMPTY)
        n = Counter(b for _, buckets in entry["deltas"] for b in buckets)
        full = {b for b, times in n.items() if times > more_than}
        if full:
            folder, there = self._write(spec, self.read(name, state, full), "base")
            base = {b: f for b, f in entry["base"].items() if b not in full} | dict.fromkeys(there, folder)
            deltas = [[f, left] for f, buckets in entry["deltas"] if (left := [b for b in buckets if b not in full])]
            if not self._commit(state | {"tables": state["tables"] | {name: {"base": base, "deltas": deltas}}}):
                self._files().delete(self._path(folder), True)
                return []
        return sorted(full)


_EMPTY: dict = {"base": {}, "deltas": []}


def _struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _folders(state: dict) -> set[str]:
    return {f for t in state["tables"].values() for f in [*t["base"].values(), *(d[0] for d in t["deltas"])]}


class Transaction:
    """Changes to several tables of a store that become visible together, or not at all.

    What it reads is the state at its beginning. A change of that state by another writer is passed over where it is about other tables or
    where this transaction only added rows; otherwise ``Conflict`` is raised and nothing has changed.
    """

    def __init__(self, store: Store, stream: str | None, batch: int | None):
        self.store, self.stream, self.batch = store, stream, batch

    def __enter__(self) -> Transaction:
        self.before = self.store.state()
        self.replaced: dict[str, dict] = {}
        self.added: dict[str, list] = {}
        self.depends: set[str] = set()
        self.written: list[str] = []
        #: A batch of a stream that was committed before changes nothing when it is run again.
        self.done = self.batch is not None and self.before["batches"].get(self.stream, -1) >= self.batch
        return self

    def read(self, name: str) -> DataFrame:
        """A table as it was when the transaction began."""
        self.depends.add(name)
        return self.store.read(name, self.before)

    def _delta(self, name: str, rows: DataFrame) -> None:
        folder, buckets = self.store._write(self.store.tables[name], rows, "delta")
        self.written.append(folder)
        if buckets:
            self.added.setdefault(name, []).append([folder, buckets])

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Adds rows; of a key the one with the highest order column counts, then the one that was added last."""
        spec = self.store.tables[name]
        if not spec.keys:
            raise ValueError(f"{name} has no keys")
        if not self.done:
            self._delta(name, rows.select(*_struct(spec.schema).names).withColumn("gone", F.lit(False)))

    def _change(self, name: str, rows: DataFrame, gone: bool) -> None:
        schema = _struct(self.store.tables[name].schema)
        keys = self.store.tables[name].keys
        self._delta(name, rows.select(*(F.col(f.name) if not gone or f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), F.lit(gone).alias("gone")))

    def delete(self, name: str, condition: Column) -> DataFrame:
        """Deletes the rows for which the condition holds; returns them. A keyed table gets their keys as marks, another one is rewritten."""
        rows = self.read(name)
        hit = F.coalesce(condition, F.lit(False))
        if not self.done:
            if self.store.tables[name].keys:
                self._change(name, rows.where(hit), True)
            else:
                self.replace(name, rows.where(~hit))
        return rows.where(hit)

    def delete_matching(self, name: str, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
        """Deletes the rows whose ``column`` is a key of ``parents``; returns them."""
        rows = self.read(name)
        keys = parents.select(F.col(parent_key).alias("parent_key")).distinct()
        gone = rows.join(keys, F.col(column) == F.col("parent_key"), "left_semi")
        if not self.done:
            if self.store.tables[name].keys:
                self._change(name, gone, True)
            else:
                self.replace(name, rows.join(keys, F.col(column) == F.col("parent_key"), "left_anti"))
        return gone

    def update(self, name: str, condition: Column, /, **values: Column) -> None:
        """Sets columns of the rows for which the condition holds; with ``updated_at`` in the table and not in ``values``, also the time. Keys stay."""
        rows, spec = self.read(name), self.store.tables[name]
        if set(values) & set(spec.keys):
            raise ValueError("keys can't be updated")
        if "updated_at" in rows.columns:
            values = {"updated_at": F.current_timestamp()} | values
        hit = F.coalesce(condition, F.lit(False))
        if self.done:
            return
        if spec.keys:
            # The old row goes first, so that the new one counts whatever its order column says.
            self._change(name, rows.where(hit), True)
            self._change(name, rows.where(hit).withColumns(values), False)
        else:
            self.replace(name, rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns)))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table is these rows; of rows with equal keys one stays."""
        if self.done:
            return
        spec = self.store.tables[name]
        rows = rows.select(*_struct(spec.schema).names)
        if spec.keys:
            newest = [F.desc(spec.order)] if spec.order else []
            rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*spec.keys).orderBy(*newest, F.xxhash64(*rows.columns)))).where("place = 1").drop("place")
        folder, buckets = self.store._write(spec, rows, "base")
        self.written.append(folder)
        self.replaced[name] = {"base": dict.fromkeys(buckets, folder), "deltas": []}
        self.added.pop(name, None)

    def truncate(self, name: str) -> None:
        """The table stays, without rows."""
        if not self.done:
            self.replaced[name] = _EMPTY
            self.added.pop(name, None)

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None and not self.done:
                self._commit()
        except BaseException:
            kind = Conflict
            raise
        finally:
            if kind is not None:
                for folder in self.written:
                    self.store._files().delete(self.store._path(folder), True)
        if kind is None:
            for name in self.added:
                self.store.compact(name, self.store.most_deltas)

    def _commit(self) -> None:
        state = self.before
        while True:
            tables = dict(state["tables"])
            for name in {*self.replaced, *self.added}:
                entry = self.replaced.get(name) or tables.get(name, _EMPTY)
                tables[name] = {"base": entry["base"], "deltas": [*entry["deltas"], *self.added.get(name, [])]}
            batches = state["batches"] | ({self.stream: self.batch} if self.batch is not None else {})
            if self.store._commit({"number": state["number"], "tables": tables, "batches": batches}):
                return
            state = self.store.state()
            changed = {n for n in {*state["tables"], *self.before["tables"]} if state["tables"].get(n) != self.before["tables"].get(n)}
            if changed & (self.depends | set(self.replaced)):
                raise Conflict(f"another writer has changed {', '.join(sorted(changed))}")
            if self.batch is not None and state["batches"].get(self.stream, -1) >= self.batch:
                raise Conflict(f"another writer has committed batch {self.batch}")


class Table:
    """One table, in a store of its own unless it comes from ``Store.table``. Each change is a transaction."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str] | None = None, *, order: str | None = None, buckets: int = 16, **more):
        self.store, self.name = Store(spark, path, {"rows": Spec(schema, tuple(keys or ()), order, buckets)}, **more), "rows"

    @classmethod
    def _of(cls, store: Store, name: str) -> Table:
        table = cls.__new__(cls)
        table.store, table.name = store, name
        return table

    def read(self) -> DataFrame:
        return self.store.read(self.name)

    def get(self, **keys: object) -> DataFrame:
        """The row with these keys, if there is one; only its bucket is read."""
        spec = self.store.tables[self.name]
        if set(keys) != set(spec.keys):
            raise ValueError(f"the keys are {', '.join(spec.keys)}")
        types = {f.name: f.dataType for f in _struct(spec.schema).fields}
        literals = [F.lit(keys[k]).cast(types[k]).alias(k) for k in spec.keys]
        bucket = self.store.spark.range(1).select(*literals).select(self.store._bucket(spec).alias("b")).first().b
        rows = self.store.read(self.name, only={str(bucket)})
        return rows.where(reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(keys[k]).cast(types[k])) for k in spec.keys)))

    def replace(self, rows: DataFrame) -> None:
        with self.store.transaction() as change:
            change.replace(self.name, rows)

    def upsert(self, rows: DataFrame, *, stream: str | None = None, batch: int | None = None) -> None:
        with self.store.transaction(stream, batch) as change:
            change.upsert(self.name, rows)

    def delete(self, condition: Column) -> DataFrame:
        """Deletes rows; returns those that are gone, from the state before."""
        with self.store.transaction() as change:
            return change.delete(self.name, condition)

    def update(self, condition: Column, /, **values: Column) -> None:
        with self.store.transaction() as change:
            change.update(self.name, condition, **values)

    def truncate(self) -> None:
        with self.store.transaction() as change:
            change.truncate(self.name)

    def drop_collections(self) -> int:
        """Deletes all collections; returns how many there were."""
        n = self.read().agg(F.count_distinct("collection")).first()[0]
        self.truncate()
        return n


def delete_chats(store: Store, condition: Column, children: dict[str, str], parent: str = "chats", key: str = "id") -> DataFrame:
    """Deletes chats and, in the same commit, the rows of ``children`` (table to its column with the chat's key); returns the chats."""
    return delete_chats_of(store, store.read(parent).where(F.coalesce(condition, F.lit(False))).select(key), children, parent, key)


def delete_chats_of(store: Store, ids: DataFrame, children: dict[str, str], parent: str = "chats", key: str = "id") -> DataFrame:
    """Deletes the chats whose keys are in the first column of ``ids``, with the rows of ``children``, in one commit; returns the chats."""
    with store.transaction() as change:
        gone = change.delete_matching(parent, key, ids, ids.columns[0])
        for name, column in children.items():
            change.delete_matching(name, column, gone, key)
        return gone


def switch_model(spark: SparkSession, wanted: str, passport: str, chunks: Table, others: list[Table]) -> str:
    """Makes ``wanted`` the embedding model: a change of a known model clears all tables and rewrites the passport. Returns the effect."""
    from ..sources import readers

    active = readers.read_passport(spark, passport)
    if wanted not in readers.EMBEDDING_MODELS:
        return "rejected"
    if active == wanted:
        return "nothing"
    if active is not None:
        chunks.drop_collections()
        for table in others:
            table.truncate()
    readers.write_passport(spark, passport, wanted)
    return "written" if active is None else "cleared"

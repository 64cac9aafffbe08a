"""Tables as Parquet folders that Spark writes partition by partition: rows by batch, and one row a key by bucket; and notes.

A batch writes into folders of its own and can be written again after a failure: the same name replaces what it wrote. Of
the schemas that a table had, each is a row of its schema history, so reads are given one and open no footers for it.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType, TimestampType

from ..operators import schema as schemas
from .files import drop, listed, read_small, write_small

GENERATIONS = "generation long, epoch int, fingerprint string, fields array<struct<name: string, type: string>>, said string, at timestamp"
END_OF_TIME = "9999-12-31 00:00:00"
#: Types that the Parquet reader widens others to.
READ_AS = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",)}


class Stored:
    """A folder with the history of a table's schema beside its data.

    Readers widen some types. Where a type changes to one that they do not widen to, an epoch begins: later files go to a
    folder of their own and earlier ones are cast as they are read, so nothing is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[dict]:
        return [json.loads(line) for line in read_small(self.spark, f"{self.path}/_schemas")]

    def generations(self) -> DataFrame:
        """generation, epoch, fingerprint, fields, said (as JSON), at of each schema that the table had."""
        rows = [(g["generation"], g["epoch"], g["fingerprint"], [(f["name"], f["type"]) for f in g["fields"]], g["said"], datetime.fromisoformat(g["at"])) for g in self._generations()]
        return self.spark.createDataFrame(rows, GENERATIONS)

    def epochs(self) -> dict[int, StructType]:
        """The last schema of each epoch, in order: a small file for each time that the schema changed is read."""
        return {g["epoch"]: StructType.fromJson(json.loads(g["said"])) for g in self._generations()}

    def schema(self) -> StructType | None:
        return list(self.epochs().values())[-1] if self.exists() else None

    def exists(self) -> bool:
        return bool(listed(self.spark, f"{self.path}/_schemas")[1])

    def adopt(self, new: StructType, at) -> tuple[int, StructType]:
        """The epoch and the stored schema with new's further columns and wider types; a generation of its own if that changes it."""
        epochs = self.epochs()
        epoch, old = max(epochs.items(), default=(0, StructType([])))
        kinds = {f.name: f.dataType for f in new}
        said = lambda kind: kind.simpleString()
        changed = [(said(f.dataType), said(kinds[f.name]), f.name) for f in old if f.name in kinds and said(f.dataType) != said(kinds[f.name])]
        for was, now, name in changed:
            if not schemas.widens(was, now):
                raise ValueError(f"{self.path}: {name} is stored as {was}, not {now}")
        both = StructType([StructField(f.name, kinds.get(f.name, f.dataType), metadata=f.metadata) for f in old] + [f for f in new if f.name not in old.names])
        if not epochs or schemas.fingerprint(both) != schemas.fingerprint(old):
            epoch = epoch + 1 if not epochs or any(now not in READ_AS.get(was, ()) for was, now, _ in changed) else epoch
            fields, number = [{"name": f.name, "type": said(f.dataType)} for f in both], len(self._generations()) + 1
            row = {"generation": number, "epoch": epoch, "fingerprint": schemas.fingerprint(both), "fields": fields, "said": both.json(), "at": at.isoformat()}
            write_small(self.spark, f"{self.path}/_schemas/{number:06d}.json", json.dumps(row))
        return epoch, both

    def _shaped(self, df: DataFrame, said: StructType, *more: str) -> DataFrame:
        kinds = dict(df.dtypes)
        columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in kinds else F.col(f.name) if kinds[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in said]
        return df.select(*columns, *more)

    def _rows(self, name: str, partitions: list[StructField], keep: dict[int, Column] | None = None) -> DataFrame:
        """All rows of the folders name-<epoch>, in the columns of the last schema; keep: a condition on those of an epoch."""
        epochs, names = self.epochs(), [p.name for p in partitions]
        last = StructType([f for f in list(epochs.values())[-1] if f.name not in names])
        out = self.spark.createDataFrame([], StructType([*last.fields, *partitions]))
        for epoch, said in epochs.items():
            if listed(self.spark, f"{self.path}/{name}-{epoch}")[1]:
                own = self.spark.read.schema(StructType([*[f for f in said if f.name not in names], *partitions])).parquet(f"{self.path}/{name}-{epoch}")
                own = own.filter(keep[epoch]) if keep else own
                out = self._shaped(own, last, *names) if len(epochs) == 1 else out.unionByName(self._shaped(own, last, *names))
        return out


class Batches(Stored):
    """Rows by batch, in folders _batch=<number>.<name>; numbers rise with each new batch.

    A batch that failed is not seen, as Spark publishes a folder's files when its job ends, and is written again under its
    name. Writers at one time have different names, so neither replaces what the other wrote.
    """

    _PARTITIONS = [StructField("_batch", StringType())]

    def _folders(self) -> dict[str, tuple[int, int]]:
        """Number and epoch by name: one listing an epoch."""
        found = {}
        for epoch in self.epochs():
            for folder in listed(self.spark, f"{self.path}/data-{epoch}")[1]:
                if folder.isDirectory() and "=" in folder.getPath().getName():
                    number, name = unquote(folder.getPath().getName().removeprefix("_batch=")).split(".", 1)
                    found[name] = (int(number), epoch)
        return found

    def numbers(self) -> dict[str, int]:
        """Batches by name, with their numbers."""
        return {batch: number for batch, (number, _) in self._folders().items()}

    @staticmethod
    def _folder(number: int, batch: str) -> str:
        return f"{number:09d}.{batch}"

    def append(self, df: DataFrame, at: datetime, batch: str | None = None) -> int:
        """Adds a batch, or writes it anew if its name is known; makes the table on first write. Returns its number."""
        epoch, said = self.adopt(StructType([*df.schema.fields, StructField("_committed_at", TimestampType())]), at)
        known, batch = self._folders(), batch or uuid.uuid4().hex
        number, was = known.get(batch, (max((n for n, _ in known.values()), default=0) + 1, epoch))
        rows = self._shaped(df.withColumn("_committed_at", F.lit(at).cast("timestamp")), said)
        folder = "_batch=" + quote(self._folder(number, batch), safe="")
        rows.write.mode("overwrite").parquet(f"{self.path}/data-{epoch}/{folder}")
        if was != epoch:  # it was written before a type changed
            drop(self.spark, f"{self.path}/data-{was}/{folder}")
        return number

    def fields(self) -> StructType | None:
        """The stored columns as readers get them; None before the first batch."""
        return StructType([f for f in self.schema() if f.name != "_committed_at"]) if self.exists() else None

    def read(self, version: int | None = None, as_of: datetime | None = None, *, batch: str | None = None, but: str | None = None) -> DataFrame:
        """All rows, those of the batches up to a number or committed by a time, those of one batch, or of all but one."""
        if not self.exists():
            raise ValueError(f"{self.path} is no table")
        if version is not None and version not in self.numbers().values():
            raise ValueError(f"{self.path} has no snapshot {version}")
        rows, known = self._rows("data", self._PARTITIONS), self.numbers() if batch is not None or but is not None else {}
        named = lambda name: F.lit(self._folder(known.get(name, 0), name or ""))
        for wanted, value in ((F.substring("_batch", 1, 9).cast("long") <= F.lit(version), version), (F.col("_committed_at") <= F.lit(as_of), as_of), (F.col("_batch") == named(batch), batch), (F.col("_batch") != named(but), but)):
            rows = rows.filter(wanted) if value is not None else rows
        return rows.drop("_batch", "_committed_at")


class Keyed(Stored):
    """One row a key, in partitions by the hash of the key. A change rewrites the buckets that its keys fall to, no others.

    Buckets are replaced when the writing job ends (dynamic partition overwrite). Their number is fixed by the first write:
    choose it so that a bucket is about a gigabyte. Null is a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], buckets: int = 16):
        super().__init__(spark, path)
        said = self.schema() if self.exists() else None
        own = [f.metadata["buckets"] for f in said or [] if f.name == "_bucket"]
        self.key, self.buckets = key, own[0] if own else buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of df's keys: as many numbers at most as there are buckets."""
        return [r[0] for r in df.select(self.bucket()).distinct().collect()]

    def adopt(self, new: StructType, at) -> tuple[int, StructType]:
        own = StructField("_bucket", IntegerType(), metadata={"buckets": self.buckets})
        epoch, both = super().adopt(StructType([own, *new.fields]), at)
        return epoch, StructType([f for f in both if f.name != "_bucket"])

    def fields(self) -> StructType:
        return StructType([f for f in self.schema() or [] if f.name != "_bucket"])

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their partitions are read."""
        if not self.exists():
            raise ValueError(f"{self.path} is no table")
        keep, newer = {}, set()
        for epoch in sorted(self.epochs(), reverse=True):  # a bucket's rows are those of its last epoch
            own = {int(b.getPath().getName().removeprefix("_bucket=")) for b in listed(self.spark, f"{self.path}/data-{epoch}")[1] if "=" in b.getPath().getName()}
            wanted = own - newer if buckets is None else (own - newer) & set(buckets)
            keep[epoch], newer = F.col("_bucket").isin(sorted(wanted)), newer | own
        return self._rows("data", [StructField("_bucket", IntegerType())], keep).drop("_bucket")

    def replace(self, rows: DataFrame, at) -> None:
        """Writes the buckets that rows fall to; rows hold all rows of these."""
        epoch, said = self.adopt(rows.schema, at)
        own = self._shaped(rows, said).withColumn("_bucket", self.bucket()).hint("rebalance", F.col("_bucket"))
        own.write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/data-{epoch}")


class History(Keyed):
    """Type 2 history: open rows as one row a key by bucket, closed rows by batch and bucket beside them.

    A batch writes the rows that it closes, then the buckets of its keys; what other keys have is not touched. Run again
    after a failure it finishes the buckets that are left: those that are done close nothing, and their closed rows stay.
    """

    _CLOSED = [StructField("_batch", StringType()), StructField("_bucket", IntegerType())]

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        return super().read(buckets)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Open and closed rows: columns, valid_from, valid_to, is_current, version."""
        closed = self._rows("closed", self._CLOSED)
        closed = closed if buckets is None else closed.filter(F.col("_bucket").isin(buckets))
        return self.current(buckets).unionByName(closed.drop("_batch", "_bucket"))

    def merge(self, batch: DataFrame, tracked: tuple[str, ...], at, batch_id: str) -> None:
        """Takes batch (one row a key) into the history: closes the open rows of keys whose tracked columns differ, null
        included, and opens their next version; new keys begin at version 1. Columns that batch lacks become null."""
        more = {"valid_from": F.lit(at).cast("timestamp"), "valid_to": F.lit(END_OF_TIME).cast("timestamp"), "is_current": F.lit(True), "version": F.lit(1).cast("long")}
        batch = batch.persist()
        try:
            epoch, said = self.adopt(batch.withColumns(more).schema, at)
            old = self._shaped(self.current(self.touched(batch)), said)
            pairs = old.select(F.struct("*").alias("t")).join(batch.select(F.struct("*").alias("s")), reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.key]), "full_outer")
            differs = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in tracked])
            changed = F.col("t").isNotNull() & F.col("s").isNotNull() & differs
            ended = {"valid_to": F.lit(at).cast("timestamp"), "is_current": F.lit(False)}
            closed = pairs.filter(changed).select(*[ended[f.name].alias(f.name) if f.name in ended else F.col(f"t.{f.name}") for f in said])
            closed = closed.withColumns({"_batch": F.lit(batch_id), "_bucket": self.bucket()}).hint("rebalance", F.col("_bucket"))
            closed.write.partitionBy("_batch", "_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/closed-{epoch}")
            take, fresh = F.col("t").isNull() | changed, more | {"version": F.coalesce(F.col("t.version"), F.lit(0)) + F.lit(1).cast("long")}
            now = {f.name: fresh[f.name] if f.name in fresh else F.col(f"s.{f.name}") if f.name in batch.columns else F.lit(None).cast(f.dataType) for f in said}
            self.replace(pairs.select(*[F.when(take, v).otherwise(F.col(f"t.{c}")).alias(c) for c, v in now.items()]), at)
        finally:
            batch.unpersist()


class HashStore:
    """Hashes that a table holds, in partitions by their first digits and the batch that brought them."""

    _FIELDS = "row_hash string, _prefix string, _batch string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.data, self.digits = spark, path, digits

    def known(self, hashes: DataFrame, batch: str) -> DataFrame:
        """row_hash of the partitions that hashes (row_hash) fall to, but for those of the batch itself: only these are read."""
        touched = [r[0] for r in hashes.select(F.substring("row_hash", 1, self.digits)).distinct().collect()]  # 16 ** digits at most
        there = listed(self.spark, self.data)[1]
        rows = self.spark.read.schema(self._FIELDS).parquet(self.data) if there else self.spark.createDataFrame([], self._FIELDS)
        return rows.filter(F.col("_prefix").isin(touched) & (F.col("_batch") != batch)).select("row_hash")

    def add(self, hashes: DataFrame, batch: str) -> None:
        """Adds a batch's hashes; written again, they replace those of its partitions."""
        own = hashes.select("row_hash", F.substring("row_hash", 1, self.digits).alias("_prefix"), F.lit(batch).alias("_batch")).hint("rebalance", F.col("_prefix"))
        own.write.partitionBy("_prefix", "_batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.data)


def _plain(value, kind: DataType):
    """A value as JSON has it, by its Spark type."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind, value)}
    if isinstance(kind, ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    return value.isoformat(timespec="microseconds") if isinstance(value, datetime) else value


class Notes:
    """A control table of few rows: a small file of JSON lines for each mark, written by the driver that has the rows.

    Rows put again under a mark replace those before.
    """

    def __init__(self, spark: SparkSession, path: str, said: str):
        self.spark, self.path, self.said = spark, path.rstrip("/"), said

    def put(self, rows: list[tuple], mark: str) -> None:
        kind = StructType.fromDDL(self.said)
        name = f"{self.path}/notes/{quote(mark, safe='')}.json"
        drop(self.spark, name)
        write_small(self.spark, name, "".join(json.dumps(_plain(r, kind)) + "\n" for r in rows))

    def exists(self) -> bool:
        return bool(listed(self.spark, f"{self.path}/notes")[1])

    def read(self, mark: str | None = None) -> DataFrame:
        """All rows, or those of a mark."""
        if not self.exists():
            return self.spark.createDataFrame([], self.said)
        return self.spark.read.schema(self.said).json(f"{self.path}/notes" if mark is None else f"{self.path}/notes/{quote(quote(mark, safe=''), safe='')}.json")


def publish(df: DataFrame, path: str) -> None:
    """Overwrites a product table."""
    df.write.mode("overwrite").parquet(path)

"""Tables in buckets by a hash of their key: a change writes the buckets it touches, a pointer replaced last shows them all at once.

A store is a folder with one pointer and any number of tables. The pointer names, for every bucket of every table, the
folder that holds it; what a change doesn't touch stays where it is. Readers open what one pointer names and so see one
version, whatever is written beside them. A store has one writer at a time; a second one that began from the same version
is refused when it commits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import swept
from . import stores

POINTER = "pointer.json"
#: The column by which rows are dealt to folders.
AT = "_bucket"
#: The column by which a bucket's rows are dealt to tasks.
PART = "_part"
#: Versions share no file of a bucket that has changed, so files are packed well.
CODEC = "zstd"


class Outdated(Exception):
    """Another writer has committed since the store was opened."""


def opened(spark: SparkSession, path: str) -> Store:
    """The store as its pointer has it now; a new one if there is none."""
    path = path.rstrip("/")
    return Store(spark, path, _pointer(spark, path))


def _pointer(spark: SparkSession, path: str, name: str = POINTER) -> dict:
    if not stores.names(spark, path, name):
        return {"version": 0, "batch": None, "tables": {}}
    return json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()["value"])


@dataclass
class Store:
    spark: SparkSession
    path: str
    body: dict
    _folder: str = field(default="", init=False)

    @property
    def version(self) -> int:
        return self.body["version"]

    @property
    def batch(self) -> int | None:
        """The last batch that was applied."""
        return self.body["batch"]

    def has(self, name: str) -> bool:
        return name in self.body["tables"]

    def key(self, name: str) -> str:
        return self.body["tables"][name]["key"]

    def create(self, name: str, schema: StructType | str, key: str, buckets: int = 64) -> None:
        """An empty table; its rows are dealt by `key`."""
        schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.body["tables"][name] = {"key": key, "buckets": buckets, "schema": schema.json(), "folders": {}}

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of some."""
        t = self.body["tables"][name]
        schema = StructType.fromJson(json.loads(t["schema"]))
        folders = [f for b, f in t["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _at(self, name: str):
        t = self.body["tables"][name]
        return F.pmod(F.xxhash64(t["key"]), F.lit(t["buckets"])).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys: at most as many as the table has."""
        return sorted(r[0] for r in keys.select(self._at(name).alias("b")).distinct().collect())

    def _begun(self, name: str) -> str:
        """A new folder of the change under way."""
        self._folder = self._folder or f"v{self.version + 1:08d}-{uuid.uuid4().hex}"
        return f"{self._folder}/{name}-{uuid.uuid4().hex[:8]}"

    def _dealt(self, name: str, rows: DataFrame, which: int) -> DataFrame:
        """Rows by bucket, a bucket in as many parts as its share of the shuffle partitions; parts go by the key."""
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // which)
        part = F.pmod(F.shiftright(F.xxhash64(self.body["tables"][name]["key"]), 32), F.lit(parts))
        return rows.withColumn(AT, self._at(name)).withColumn(PART, part).repartition(AT, PART)

    def aside(self, rows: DataFrame) -> DataFrame:
        """Rows written once for the change under way, which no version names: the first expire() after its commit removes them."""
        at = f"{self.path}/{self._begun('aside')}/{AT}=aside"
        with swept(self.spark):
            rows.write.parquet(at, compression=CODEC)
        return self.spark.read.schema(rows.schema).parquet(at)

    def replace(self, name: str, gone: DataFrame | None, new: DataFrame | None, at: list[int] | None = None) -> list[int]:
        """Removes the rows that agree with `gone` in all columns it has, its key among them, then puts in `new`; the buckets written.

        Columns agree by equality: a row with a null in one of them stays. at: the buckets of all these keys, where they are
        known; else both are computed once more to find them.
        """
        t = self.body["tables"][name]
        sides = [d.select(t["key"]) for d in (gone, new) if d is not None]
        if not sides:
            return []
        which = self.touched(name, sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])) if at is None else at
        if not which:
            return []
        rows = self.table(name, which)
        columns = rows.columns
        if gone is not None and any(str(b) in t["folders"] for b in which):
            # both sides by bucket: what stays moves once, for the join and the writing
            rows = self._dealt(name, rows, len(which)).join(self._dealt(name, gone, len(which)), [AT, PART, *gone.columns], "left_anti").select(AT, *columns)
        else:
            rows = rows.withColumn(AT, self._at(name))
        if new is not None:
            rows = rows.unionByName(self._dealt(name, new.select(*columns), len(which)).drop(PART))
        at = self._begun(name)
        with swept(self.spark):
            rows.write.partitionBy(AT).parquet(f"{self.path}/{at}", compression=CODEC)
        there = {int(n.split("=")[1]) for n in stores.names(self.spark, f"{self.path}/{at}", f"{AT}=*")}
        for b in which:
            t["folders"].pop(str(b), None)
            if b in there:
                t["folders"][str(b)] = f"{at}/{AT}={b}"
        return which

    def upsert(self, name: str, new: DataFrame) -> list[int]:
        """New rows in place of all that have their keys."""
        return self.replace(name, new.select(self.body["tables"][name]["key"]), new)

    def delete(self, name: str, keys: DataFrame) -> list[int]:
        return self.replace(name, keys.select(self.body["tables"][name]["key"]), None)

    def add(self, name: str, delta: DataFrame) -> list[int]:
        """Adds signed numbers to a table of counts: delta has its columns, the key and numbers; rows that come to 0 go."""
        t = self.body["tables"][name]
        counts = [c for c in self.table(name).columns if c != t["key"]]
        delta = delta.groupBy(t["key"]).agg(*[F.sum(c).alias(c) for c in counts]).where(" OR ".join(f"`{c}` <> 0" for c in counts)).checkpoint()
        old = self.table(name, self.touched(name, delta)).join(delta.select(t["key"]), t["key"], "left_semi")
        now = old.unionByName(delta).groupBy(t["key"]).agg(*[F.sum(c).alias(c) for c in counts])
        return self.replace(name, delta.select(t["key"]), now.where(" OR ".join(f"`{c}` <> 0" for c in counts)))

    def commit(self, batch: int | None = None) -> None:
        """Shows all changes since the store was opened, as the work of this batch."""
        if _pointer(self.spark, self.path)["version"] != self.version:
            raise Outdated(self.path)
        self.body |= {"version": self.version + 1, "batch": self.batch if batch is None else batch}
        text = json.dumps(self.body, sort_keys=True)
        stores.put_text(self.spark, f"{self.path}/pointer-{self.version:08d}.json", text)
        stores.put_text(self.spark, f"{self.path}/{POINTER}", text)
        self._folder = ""

    def expire(self, keep: int = 2) -> int:
        """Removes folders that none of the last `keep` versions names; those of a change under way stay. How many went."""
        old = [n for n in stores.names(self.spark, self.path, "pointer-*.json") if int(n[8:16]) <= self.version]
        held = {f for n in old[:keep] for t in _pointer(self.spark, self.path, n)["tables"].values() for f in t["folders"].values()}
        held |= {f for t in _pointer(self.spark, self.path)["tables"].values() for f in t["folders"].values()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for f in system.globStatus(hadoop.Path(f"{self.path}/v*/*/{AT}=*")) or []:
            name = "/".join(f.getPath().toString().rsplit("/", 3)[1:])
            if name not in held and int(name[1:9]) <= self.version:
                gone += system.delete(f.getPath(), True)
        for n in old[keep:]:
            system.delete(hadoop.Path(f"{self.path}/{n}"), False)
        return gone

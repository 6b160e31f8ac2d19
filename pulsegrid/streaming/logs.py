"""Keyed tables as logs of batches: a snapshot by day, a tail of recent batches, merged on read.

A batch overwrites its own folder of the tail, so that a replay adds nothing. Every so many batches the days that the tail
touches are rewritten with it, and a new manifest names the folder of each day; that file appears by a rename, so readers see
the old state or the new one. A crash before the rename leaves folders that no manifest names and the next compaction
overwrites. What a manifest supersedes is deleted by the compaction after it, when its readers are gone.

    <path>/epoch=E/batch_id=N/log_day=D      the tail
    <path>_days/epoch=E/version=V/log_day=D  the days of a snapshot
    <path>_days/epoch=E/manifest/V.json      what the snapshot after batch V - 1 consists of
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators.tables import resolve

#: Batches in a tail at most, but for those that come while it is compacted.
TAIL = 50
#: The day of rows without a time, and of tables that have none.
NO_DAY = dt.date(1970, 1, 1)
_OWN = "batch_id long, log_day date"


class Folder:
    """A folder on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A file that appears whole or not at all."""
        draft = self._at(f"{name}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(draft, self._at(name)):
            raise OSError(f"{name} can't be published")

    def move(self, name: str, to: str) -> bool:
        """False where another has moved it already."""
        self._fs.mkdirs(self._jvm.org.apache.hadoop.fs.Path(to).getParent())
        return self._fs.rename(self._at(name), self._jvm.org.apache.hadoop.fs.Path(to))

    def modified(self, name: str) -> int:
        return self._fs.getFileStatus(self._at(name)).getModificationTime()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Manifest:
    """Up to which batch the snapshot goes, the version of each day, and the folders that nobody reads any more."""

    upto: int = -1
    days: dict[str, int] = field(default_factory=dict)
    garbage: tuple[str, ...] = ()


@dataclass
class KeyedLog:
    """A table of one writer. ``key`` tells its rows apart (none: every row stays), the last by ``order`` and batch wins.

    ``at`` is the time whose day a row belongs to. Where a later version of a key can be of another day, ``moves`` makes a
    compaction look for the keys of its tail in the key columns of all days, so that a snapshot holds each key once.
    """

    spark: SparkSession
    path: str
    key: Sequence[str] = ()
    at: str | None = None
    order: Sequence[str] = ()
    moves: bool = False
    epoch: int = 0
    tail: int = TAIL

    def __post_init__(self) -> None:
        self._tail = Folder(self.spark, f"{self.path}/epoch={self.epoch}")
        self._days = Folder(self.spark, f"{self.path}_days/epoch={self.epoch}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch, then compact the batches before it if there are enough: these are surely done."""
        at = F.to_date(self.at) if self.at else F.lit(None).cast("date")
        dated = batch.withColumn("log_day", F.coalesce(at, F.lit(NO_DAY)))
        dated.write.mode("overwrite").partitionBy("log_day").parquet(f"{self._tail.path}/batch_id={batch_id}")
        if len([n for n in self.batches(self.manifest()) if n < batch_id]) >= self.tail:
            self.compact(batch_id - 1, batch.schema)

    __call__ = append

    def manifest(self) -> Manifest:
        versions = [int(n[:-5]) for n in self._days.names("manifest") if n.endswith(".json")]
        if not versions:
            return Manifest()
        found = json.loads(self._days.read(f"manifest/{max(versions)}.json"))
        return Manifest(found["upto"], found["days"], tuple(found["garbage"]))

    def batches(self, manifest: Manifest) -> list[int]:
        """Those that the snapshot lacks."""
        there = [int(n.split("=")[1]) for n in self._tail.names() if n.startswith("batch_id=")]
        return sorted(n for n in there if n > manifest.upto)

    def _read(self, base: str, paths: list[str], schema: str) -> DataFrame:
        whole = self.spark.createDataFrame([], f"{schema}, {_OWN}")
        if not paths:
            return whole
        return self.spark.read.schema(whole.schema).option("basePath", base).parquet(*paths)

    def _recent(self, batches: list[int], schema: str) -> DataFrame:
        return self._read(self._tail.path, [f"{self._tail.path}/batch_id={n}" for n in batches], schema)

    def _snapshot(self, days: dict[str, int], schema: str) -> DataFrame:
        # a version is a level of the path, but not a column
        frames = [self._read(f"{self._days.path}/version={v}", [f"{self._days.path}/version={v}/log_day={d}" for d in sorted(days) if days[d] == v], schema) for v in sorted(set(days.values()))]
        out = frames[0] if frames else self._read("", [], schema)
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def _within(self, days: dict[str, int], low: dt.date | None, high: dt.date | None) -> dict[str, int]:
        return {d: v for d, v in days.items() if (low is None or d >= low.isoformat()) and (high is None or d <= high.isoformat())}

    def rows(self, schema: str, low: dt.date | None = None, high: dt.date | None = None) -> DataFrame:
        """The rows of some days, unresolved, with batch_id; only the folders of these days are read."""
        manifest = self.manifest()
        recent = self._recent(self.batches(manifest), schema)
        for bound in ([F.col("log_day") >= F.lit(low)] if low else []) + ([F.col("log_day") <= F.lit(high)] if high else []):
            recent = recent.where(bound)
        return self._snapshot(self._within(manifest.days, low, high), schema).unionByName(recent).drop("log_day")

    def table(self, schema: str, low: dt.datetime | None = None, high: dt.datetime | None = None) -> DataFrame:
        """The newest version of each key whose ``at`` is in (low, high].

        Of the snapshot only the days of that range are read. The tail is read whole, as a version there may supersede one
        of another day, and holds no more than so many batches.
        """
        manifest = self.manifest()
        days = self._within(manifest.days, low and low.date(), high and high.date())
        found = self._snapshot(days, schema).unionByName(self._recent(self.batches(manifest), schema))
        if self.key:
            found = resolve(found, self.key, (*self.order, "batch_id"))
        if low is not None:
            found = found.where(F.col(self.at) > F.lit(low))
        if high is not None:
            found = found.where(F.col(self.at) <= F.lit(high))
        return found.drop("batch_id", "log_day")

    def compact(self, upto: int, schema: StructType | str) -> None:
        """Fold the batches up to ``upto`` into the days that they touch, and switch to the new snapshot."""
        schema = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        manifest = self.manifest()
        done = [n for n in self.batches(manifest) if n <= upto]
        if not done:
            return
        fresh = self._recent(done, schema)
        touched = {r["log_day"].isoformat() for r in fresh.select("log_day").distinct().collect()}  # of a bounded tail
        if self.moves and manifest.days:
            held = self._snapshot(manifest.days, schema).select(*self.key, "log_day")
            touched |= {r["log_day"].isoformat() for r in held.join(fresh.select(*self.key), list(self.key), "left_semi").select("log_day").distinct().collect()}
        old = {d: v for d, v in manifest.days.items() if d in touched}
        rows = fresh.unionByName(self._snapshot(old, schema))
        if self.key:
            rows = resolve(rows, self.key, (*self.order, "batch_id"))
        version = upto + 1
        rows.repartition("log_day").write.mode("overwrite").partitionBy("log_day").parquet(f"{self._days.path}/version={version}")
        written = {n.split("=")[1] for n in self._days.names(f"version={version}") if n.startswith("log_day=")}
        days = {d: v for d, v in manifest.days.items() if d not in touched} | dict.fromkeys(sorted(written), version)
        garbage = [f"tail/batch_id={n}" for n in done] + [f"days/version={v}/log_day={d}" for d, v in old.items()]
        self._days.publish(f"manifest/{version}.json", json.dumps({"upto": upto, "days": days, "garbage": garbage}))
        for name in manifest.garbage:
            kind, _, rest = name.partition("/")
            (self._tail if kind == "tail" else self._days).remove(rest)
        for name in self._days.names("manifest"):
            if name.endswith(".json") and int(name[:-5]) < manifest.upto + 1:
                self._days.remove(f"manifest/{name}")

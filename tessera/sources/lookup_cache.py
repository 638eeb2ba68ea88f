"""A cache of look-ups as a versioned table: what was found and what was not, never what failed.

A folder holds `versions/<n>-<id>` (Parquet: key, value, found) and the file
`current`, the name of one of them. A new version is written beside the others,
and then `current` is replaced by a rename, which readers see as a whole or not at
all; a writer that dies before leaves the version before it. A pointer that leads
nowhere is an error: an empty cache in its place would be saved over all earlier
look-ups. One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, found boolean"
#: Versions that stay for readers that began with them.
KEPT = 2


class LookupCache:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> str | None:
        """The name of the current version; None for a cache that was never written."""
        if not self._fs.exists(self._at("current")):
            if self._fs.exists(self._at("versions")) and self._finished():
                raise ValueError(f"{self.path} has versions, but no file current; name the right one in it, or delete the cache")
            return None
        told = [r[0] for r in self.spark.read.text(f"{self.path}/current").take(2)]
        if len(told) != 1 or not self._fs.exists(self._at(f"versions/{told[0]}/_SUCCESS")):
            raise ValueError(f"{self.path}/current names no whole version; mend it, or delete the cache to start an empty one")
        return told[0]

    def _finished(self) -> list[str]:
        found = self._fs.listStatus(self._at("versions"))
        return sorted((n for s in found if self._fs.exists(self._at(f"versions/{(n := s.getPath().getName())}/_SUCCESS"))), key=lambda n: int(n.split("-")[0]))

    def read(self) -> DataFrame:
        """(key, value, found) of the current version; found is false for a key that was looked up without a result."""
        name = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/versions/{name}") if name else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, answers: DataFrame) -> str:
        """Adds answers (key, value, failed), in place of earlier ones of their keys, as a new version. A null value is a miss; failed ones are left out."""
        name = self.version()
        new = answers.where(F.col("key").isNotNull() & ~F.coalesce("failed", F.lit(False))).groupBy("key").agg(F.max("value").alias("value"))
        new = new.withColumn("found", F.col("value").isNotNull())
        rows = self.read().join(new.select("key"), "key", "left_anti").select("key", "value", "found").unionByName(new) if name else new
        fresh = f"{int(name.split('-')[0]) + 1 if name else 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/versions/{fresh}")
        self._point_to(fresh)
        for old in self._finished():
            if int(old.split("-")[0]) <= int(fresh.split("-")[0]) - KEPT:
                self._fs.delete(self._at(f"versions/{old}"), True)
        return fresh

    def _point_to(self, name: str) -> None:
        beside = self._at(f"current-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(name.encode()))
        out.close()
        over = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        over[0] = getattr(self._hadoop, "Options$Rename").OVERWRITE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(beside), self._fs.makeQualified(self._at("current")), over)

    def look_up(self, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, value, found) for the distinct keys of requests; found is null where the look-up failed.

        fetch takes the keys that the cache lacks and gives (key, value, failed);
        what it gives is saved before it is returned.
        """
        asked = requests.where("key is not null").select("key").distinct()
        lacking = asked.join(self.read().select("key"), "key", "left_anti")
        if not lacking.isEmpty():
            self.upsert(fetch(lacking))
        return asked.join(self.read(), "key", "left")

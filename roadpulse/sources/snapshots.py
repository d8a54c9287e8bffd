"""Tables that are saved key by key: written once, and named by a manifest that is swapped as a whole.

`data/version=<id>` holds what one save has written and is never changed. A manifest says which version holds each key's current
rows. A commit is one small file, created only if no other writer has created it: readers follow the last commit,
so a save that fails leaves the table as it was, and keys that a save does not hold keep their rows.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEAD_AFTER = 60.0
"""Seconds after which a commit that was begun and not ended counts as given up."""


class SaveConflict(RuntimeError):
    """Another writer has committed, or is about to, since this save began."""


@dataclass(frozen=True)
class Store:
    path: str
    keys: tuple[str, ...]

    def save(self, rows: DataFrame, files: int = 32) -> int:
        """Replace the rows of the keys that `rows` holds and keep all others. Returns the number of the commit.

        Keys must not be null. Empty `rows` commit nothing new.
        """
        spark, version = rows.sparkSession, uuid.uuid4().hex
        before = self._commits(spark)
        last = before[-1] if before else None
        spread = F.pmod(F.xxhash64(*self.keys), F.lit(files))
        rows.repartition(files, spread).write.parquet(f"{self.path}/data/version={version}")
        number = (last[0] if last else 0) + 1
        written = spark.read.schema(rows.schema).parquet(f"{self.path}/data/version={version}").select(*self.keys).distinct()
        named = written.withColumns({"version": F.lit(version), "saved_in": F.lit(number)})
        if last:
            named = named.unionByName(self._manifest(spark, last[1]).join(written, [*self.keys], "left_anti"))
        manifest = uuid.uuid4().hex
        named.write.parquet(f"{self.path}/manifests/{manifest}")
        self._commit(spark, number, manifest)
        return number

    def load(self, spark: SparkSession) -> DataFrame | None:
        """The current rows of all keys, with the number of the commit that saved them as `saved_in`; None before the first commit."""
        manifest = self.manifest(spark)
        if manifest is None:
            return None
        data = spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        return data.join(manifest, [*self.keys, "version"]).drop("version")

    def manifest(self, spark: SparkSession) -> DataFrame | None:
        """`(keys, version, saved_in)` of the last commit."""
        commits = self._commits(spark)
        return self._manifest(spark, commits[-1][1]) if commits else None

    def _manifest(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifests/{name}")

    def _commits(self, spark: SparkSession) -> list[tuple[int, str]]:
        """Numbers and manifests of the commits, in order. Raises while another writer is between begin and end."""
        folder, files = _at(spark, f"{self.path}/commits")
        if not files.exists(folder):
            return []
        out = []
        for status in sorted(files.listStatus(folder), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if not name.isdigit():
                continue
            stream = files.open(status.getPath())
            try:
                text = bytes(b % 256 for b in stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text:
                out.append((int(name), text))
            elif time.time() - status.getModificationTime() / 1000 < DEAD_AFTER:
                raise SaveConflict(f"a save to {self.path} is being committed")
            else:
                out.append((int(name), out[-1][1])) if out else None
        return out

    def _commit(self, spark: SparkSession, number: int, manifest: str) -> None:
        place, files = _at(spark, f"{self.path}/commits/{number:010d}")
        try:
            stream = files.create(place, False)
        except Py4JJavaError as error:
            if files.exists(place):
                raise SaveConflict(f"another save to {self.path} came first; save again") from error
            raise
        stream.write(bytearray(manifest.encode()))
        stream.close()


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _at(spark, path)
    return files.exists(place)

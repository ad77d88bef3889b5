"""Keyed tables in hash parts, for jobs that keep their state between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PartedTable:
    """A table under `folder` whose rows lie in `parts` hash parts of a key. A batch reads the parts that its keys fall into and
    writes only those, as version `batch_id`; a small list per batch says which version of each part counts.

    A replay of a batch reads the list of the batch before and writes its own versions again. Versions that neither of the last two
    lists names are removed. parts bounds the lists (a row per part, the only thing that comes to the driver) and should
    grow with the table: a part is read and written whole. Rows with a null key have a part like any other."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, parts: int = 256):
        self.spark, self.folder, self.key, self.schema, self.parts = spark, folder, key, schema, parts

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _list(self, batch_id: int) -> dict[int, int]:
        """part -> version after a batch."""
        if batch_id < 0 or not self._exists(f"{self.folder}/lists/{batch_id}/_SUCCESS"):
            return {}
        return dict(map(tuple, self.spark.read.schema("part int, version long").parquet(f"{self.folder}/lists/{batch_id}").collect()))

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def _remove(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def touched(self, batch: DataFrame) -> list[int]:
        """The parts that a batch's keys fall into."""
        return sorted(r[0] for r in batch.select(self._part()).distinct().collect())

    def paths(self, batch_id: int, touched: list[int]) -> list[str]:
        """The folders that hold the touched parts before a batch."""
        before = self._list(batch_id - 1)
        return [f"{self.folder}/rows/{before[p]}/part={p}" for p in touched if p in before]

    def read(self, batch_id: int, touched: list[int]) -> DataFrame:
        """The rows of the touched parts before a batch."""
        paths = self.paths(batch_id, touched)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch_id: int, touched: list[int], after: DataFrame) -> None:
        """Puts `after` in place of the touched parts and forgets versions that no replay needs."""
        target = f"{self.folder}/rows/{batch_id}"
        after.withColumn("part", self._part()).repartition("part").write.partitionBy("part").mode("overwrite").parquet(target)
        written = {r[0] for r in self.spark.read.schema(f"{self.schema}, part int").parquet(target).select("part").distinct().collect()}
        before = self._list(batch_id - 1)
        now = {p: v for p, v in before.items() if p not in touched} | dict.fromkeys(written, batch_id)
        lists = self.spark.createDataFrame(list(now.items()), "part int, version long").coalesce(1)
        lists.write.mode("overwrite").parquet(f"{self.folder}/lists/{batch_id}")
        for part, version in self._list(batch_id - 2).items():
            if before.get(part) != version:
                self._remove(f"{self.folder}/rows/{version}/part={part}")
        if batch_id >= 2:
            self._remove(f"{self.folder}/lists/{batch_id - 2}")

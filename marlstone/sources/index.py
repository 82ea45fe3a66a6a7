"""The index: two Parquet tables in versions that never change, and a pointer to each."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig

TEXT_UNITS = "unit_id string, doc_id string, text string, page int, ord int, title string, meta map<string,string>, seq long, embedding array<double>"
VISION_UNITS = (
    "unit_id string, doc_id string, image_path string, page int, row int, col int, bbox array<int>, meta map<string,string>, "
    "occurrences array<struct<seq:long,unit_id:string,doc_id:string>>, duplicate_count long, seq long, embedding array<double>"
)


class VersionedIndex:
    """``path``/v=N-.../{text_units,vision_units}, and ``path``/CURRENT.N, which names the folder of version N and holds its settings.

    A pointer is written under another name and renamed when its tables are whole, and no pointer is ever changed, so a reader sees the largest
    version that is whole, and of two writers of one version the second fails. The last two versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._fs_path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._fs_path(self.path))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT.") and n[8:].isdigit())

    def _pointer(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {"version": 0, "folder": "", "config": {}}
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT.{version}", wholetext=True).first()[0])

    @property
    def version(self) -> int:
        return max(self._versions(), default=0)

    def config(self) -> EngineConfig:
        return EngineConfig.from_dict(self._pointer()["config"])

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(text units, vision units) of one version; both are empty where there is none."""
        folder = self._pointer()["folder"]
        tables = (("text_units", TEXT_UNITS), ("vision_units", VISION_UNITS))
        return tuple(self.spark.read.schema(s).parquet(f"{self.path}/{folder}/{n}") if folder else self.spark.createDataFrame([], s) for n, s in tables)

    def write(self, text_units: DataFrame, vision_units: DataFrame, config: EngineConfig) -> int:
        new = self.version + 1
        folder = f"v={new}-{uuid.uuid4().hex}"
        text_units.write.parquet(f"{self.path}/{folder}/text_units")
        vision_units.write.parquet(f"{self.path}/{folder}/vision_units")
        text = json.dumps({"version": new, "folder": folder, "config": config.to_dict()})
        written, pointer = (self._fs_path(f"{self.path}/{n}") for n in (f"pointer-{folder}", f"CURRENT.{new}"))
        stream = self._fs.create(written, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(pointer) or not self._fs.rename(written, pointer):
            self._fs.delete(written, False)
            raise RuntimeError(f"another writer has made version {new} of {self.path}")
        for old in self._versions()[:-2]:
            gone = self._pointer(old)["folder"]
            self._fs.delete(self._fs_path(f"{self.path}/CURRENT.{old}"), False)
            self._fs.delete(self._fs_path(f"{self.path}/{gone}"), True)
        return new


def delete_docs(units: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Units of documents that are not among ``doc_ids`` (doc_id)."""
    return units.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*units.columns)


def delete_where(units: DataFrame, predicate) -> DataFrame:
    """Units for which the predicate is not true."""
    return units.where(~F.coalesce(predicate, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``old`` without the documents of ``doc_ids``, and all of ``new``."""
    return delete_docs(old, doc_ids).unionByName(new)


def doc_ids(text_units: DataFrame, vision_units: DataFrame) -> DataFrame:
    return text_units.select("doc_id").unionByName(vision_units.select("doc_id")).where("doc_id is not null").distinct()

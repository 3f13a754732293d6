"""Tables written to the shared checkpoint folder, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoint"
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, as Parquet files that survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, frame: DataFrame) -> DataFrame:
        """frame, computed once and read back."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        frame.write.option("compression", "zstd").parquet(path)
        # the schema is known; reading it from the files would cost a job
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files behind frames that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for frame in frames for f in frame.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Tables of a data folder, and tables settled in the shared folder, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset a new local one, on one machine only: other executors couldn't see its files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Settled:
    """The tables that a job has settled; ``clear`` deletes their files when nothing reads them any more."""

    paths: list[str] = []

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while cls.paths:
            path = jvm.org.apache.hadoop.fs.Path(cls.paths.pop())
            path.getFileSystem(conf).delete(path, True)

    @classmethod
    def drop(cls, df: DataFrame) -> None:
        """Delete a settled table that nothing reads any more; Spark drops shuffle files of finished steps with it, once their tables are collected."""
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if (own := next((p for p in cls.paths if p.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]), None)) is not None:
                cls.paths.remove(own)
                where = jvm.org.apache.hadoop.fs.Path(own)
                where.getFileSystem(conf).delete(where, True)
        jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, where lineage ends; a lost executor costs nothing before it.  Settled.clear deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidegraph-{uuid.uuid4().hex}"
    Settled.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet dataset for each table of a run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)

"""Result tables as Parquet, one partition per dataset and version.

Every write goes to a new version folder; an entry in the version log then makes it current. A crash between the two leaves
the earlier version in place, and nothing is ever renamed. Deleting a dataset is an entry in the log too, so a
later run of the same dataset brings it back. Folders that no entry reaches are removed by `purge_versions`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from functools import lru_cache
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyspark.sources import version_log
from tallyspark.sources.version_log import file_system


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """For sessions in one process only; removed when it ends."""
    folder = tempfile.mkdtemp(prefix="tally-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in the location that spark.checkpoint.dir names.

    A local folder serves only where driver and executors are one process; on a cluster the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/tally-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write once and continue from the written table: lineage is cut and survives lost executors."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it lives."""
    path, fs = file_system(spark, folder)
    fs.delete(path, True)


def partition_folder(root: str, table: str, dataset_id: str) -> str:
    return f"{root}/{table}/dataset_id={quote(dataset_id, safe='')}"


def version_folder(root: str, table: str, dataset_id: str, version: str) -> str:
    return f"{partition_folder(root, table, dataset_id)}/version={version}"


def current_versions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(dataset_id, version) of the last write of every dataset that has not been deleted since, and of what was appended to it."""
    return version_log.current(version_log.events(spark, root)).filter(F.col("table") == table).select("dataset_id", "version")


def prepare(df: DataFrame, root: str, table: str, dataset_id: str) -> dict:
    """Write a new version that nobody sees yet; `version_log.commit` of the returned line makes it current."""
    version = uuid.uuid4().hex
    df.write.parquet(version_folder(root, table, dataset_id, version))
    return {"event": "write", "table": table, "dataset_id": dataset_id, "version": version}


def write_tables(tables: dict[str, DataFrame], root: str, dataset_id: str, since: int | None = None) -> int:
    """Replace this dataset's rows in several tables at once: readers see all of the new versions or none.

    The last committer wins, unless `since` is given (see `version_log.commit`). Returns the number of the log entry.
    """
    lines = [prepare(df, root, name, dataset_id) for name, df in tables.items()]
    return version_log.commit(next(iter(tables.values())).sparkSession, root, lines, since)


def write_partition(df: DataFrame, root: str, table: str, dataset_id: str, since: int | None = None) -> int:
    """Replace this dataset's rows of a table and leave the others alone; an empty result replaces an earlier one too."""
    return write_tables({table: df}, root, dataset_id, since)


def append_version(df: DataFrame, root: str, table: str, dataset_id: str, version: str) -> None:
    """Add rows to a dataset under a version name that the caller chooses; a name that the log has already is not written again.

    So a batch that a stream repeats after a failure, under the same name, counts once.
    """
    spark = df.sparkSession
    known = version_log.events(spark, root).filter(
        (F.col("event") == "append") & (F.col("table") == table) & (F.col("dataset_id") == dataset_id) & (F.col("version") == version))
    if known.isEmpty():
        df.write.mode("overwrite").parquet(version_folder(root, table, dataset_id, version))
        version_log.commit(spark, root, [{"event": "append", "table": table, "dataset_id": dataset_id, "version": version}])


def read_partition(spark: SparkSession, root: str, table: str, dataset_id: str) -> DataFrame:
    """One dataset's current rows with its own columns, none if it was deleted; only its folders are listed and read."""
    current = current_versions(spark, root, table).filter(F.col("dataset_id") == dataset_id).collect()
    if not current:
        return read_table(spark, root, table).drop("dataset_id").limit(0)
    return spark.read.parquet(*[version_folder(root, table, dataset_id, r["version"]) for r in current])


def _text_ids(schema: T.StructType) -> T.StructType:
    """Ids such as 007 stay text."""
    keys = ("dataset_id", "version")
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in schema])


def _all_versions(spark: SparkSession, root: str, table: str, merge_schema: bool) -> DataFrame:
    path = f"{root}/{table}"
    found = spark.read.option("mergeSchema", merge_schema).parquet(path).schema
    return spark.read.schema(_text_ids(found)).parquet(path)


def read_table(spark: SparkSession, root: str, table: str, merge_schema: bool = False) -> DataFrame:
    """The current rows of all datasets that are not deleted; `merge_schema` for ledgers of different columns.

    Only the folders of current versions are listed and read, so earlier runs cost nothing; the driver holds their names,
    one for each dataset, as any reader of a partitioned table does.
    """
    current = current_versions(spark, root, table).collect()
    if not current:
        return _all_versions(spark, root, table, merge_schema).limit(0).drop("version")
    paths = [version_folder(root, table, r["dataset_id"], r["version"]) for r in current]
    reader = lambda: spark.read.option("basePath", f"{root}/{table}")
    found = reader().option("mergeSchema", merge_schema).parquet(*paths).schema
    return reader().schema(_text_ids(found)).parquet(*paths).drop("version")


def append_reviews(reviews: DataFrame, root: str) -> None:
    """Add review actions (dataset_id, finding_id, ...) to the current findings of their datasets.

    They belong to that version of the findings: a rerun starts without reviews, and a deleted dataset has none.
    """
    current = current_versions(reviews.sparkSession, root, "findings")
    reviews.withColumn("dataset_id", F.col("dataset_id").cast("string")).join(current, "dataset_id").write.mode("append").partitionBy(
        "dataset_id", "version"
    ).parquet(f"{root}/reviews")


def read_reviews(spark: SparkSession, root: str) -> DataFrame:
    """Review actions on the current findings."""
    rows = _all_versions(spark, root, "reviews", False)
    return rows.join(current_versions(spark, root, "findings"), ["dataset_id", "version"], "left_semi").drop("version")


def delete_datasets(dataset_ids: DataFrame, root: str) -> None:
    """Record datasets as deleted; every table read hides them until they are written again."""
    version_log.commit_deletes(dataset_ids, root)


def purge_dataset(spark: SparkSession, root: str, dataset_id: str, tables: list[str]) -> None:
    """Remove the files of one dataset, of all its versions, from the named tables; a folder each, whatever its size."""
    version_log.commit(spark, root, [{"event": "remove", "table": t, "dataset_id": dataset_id} for t in tables])
    for table in tables:
        remove_folder(spark, partition_folder(root, table, dataset_id))


def stored_versions(spark: SparkSession, root: str) -> DataFrame:
    """(table, dataset_id, version, changed_ms, current) of every version folder, one file-system listing for each level.

    Reviews are stored by the version of the findings that they belong to, and are current with it.
    """
    path, fs = file_system(spark, f"{root}/*/dataset_id=*/version=*")
    found = []
    for status in fs.globStatus(path) or []:
        *_, table, dataset, version = status.getPath().toUri().getPath().split("/")
        found.append((table, unquote(dataset).partition("=")[2], version.partition("=")[2], status.getModificationTime()))
    folders = spark.createDataFrame(found, "table string, dataset_id string, version string, changed_ms long")
    owner = F.when(F.col("table") == "reviews", "findings").otherwise(F.col("table"))
    current = version_log.current(version_log.events(spark, root)).select(
        F.col("table").alias("_owner"), "dataset_id", "version", F.lit(True).alias("_there"))
    return folders.withColumn("_owner", owner).join(current, ["_owner", "dataset_id", "version"], "left").select(
        "table", "dataset_id", "version", "changed_ms", F.col("_there").isNotNull().alias("current"))


def purge_versions(spark: SparkSession, root: str, older_than_hours: float = 24.0) -> int:
    """Remove version folders that no log entry reaches, and log entries that a checkpoint replaces; returns how many folders went.

    Folders and entries changed within the last hours stay: a run may be about to commit them, or a query be reading them.
    """
    before = int((time.time() - older_than_hours * 3600) * 1000)
    dead = stored_versions(spark, root).filter(~F.col("current") & (F.col("changed_ms") < before))
    removed = 0
    for row in dead.toLocalIterator():
        remove_folder(spark, version_folder(root, row["table"], row["dataset_id"], row["version"]))
        removed += 1
    version_log.write_checkpoint(spark, root)
    version_log.purge_entries(spark, root, before)
    return removed


def without_datasets(df: DataFrame, deleted: DataFrame) -> DataFrame:
    return df.join(deleted.select("dataset_id").distinct(), "dataset_id", "left_anti")


def cascade(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Remove deleted datasets from every table; reviews go with their findings."""
    kept = {name: without_datasets(df, deleted) for name, df in tables.items() if name != "reviews"}
    if "reviews" in tables:
        gone = tables["findings"].join(deleted.select("dataset_id").distinct(), "dataset_id", "left_semi")
        kept["reviews"] = tables["reviews"].join(gone.select("finding_id"), "finding_id", "left_anti")
    return kept


def latest_per_dataset(df: DataFrame) -> DataFrame:
    """The newest row of each dataset by created_at; ties are settled by the other columns in order.

    The latest time is a hash aggregate; only rows of that time are compared further.
    """
    others = [c for c in df.columns if c not in ("dataset_id", "created_at")]
    latest = df.groupBy("dataset_id").agg(F.max("created_at").alias("created_at"))
    tied = df.join(latest, ["dataset_id", "created_at"])
    newest = F.max(F.struct("created_at", *others)).alias("_newest")
    return tied.groupBy("dataset_id").agg(newest).select("dataset_id", "_newest.*")


def with_finding_ids(findings: DataFrame, dataset_id: str) -> DataFrame:
    """Stable ids, and PENDING as the status of a new finding."""
    digest = F.sha2(F.to_json(F.struct(F.lit(dataset_id).alias("dataset"), "finding_key")), 256)
    return findings.withColumn("finding_id", F.concat(F.lit("FND-"), digest)).withColumn("status", F.lit("PENDING"))

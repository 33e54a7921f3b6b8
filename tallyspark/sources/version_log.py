"""Which versions of the stored tables are current: a log of numbered entries, each created once and never changed.

An entry is a small JSON file with one line for each thing that it does; all of them hold from the moment the file exists.
Its number is taken by creating the file only if no other has it, so writers need no lock and no clock, and two of
them never overwrite each other: the second takes the next number. A checkpoint is a table with the writes that
are still in force up to some number; readers begin there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JJavaError

FOLDER, ENTRIES = "versions", "versions/log"
ENTRY, CHECKPOINT, BULK = ".json", ".checkpoint", "bulk"
_LINE = "event string, table string, dataset_id string, version string"
SCHEMA = f"seq long, {_LINE}"


class CommitConflict(RuntimeError):
    """Another writer has committed to the same dataset and table since the caller read them."""


def file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(number: int, ending: str) -> str:
    return f"{number:020d}{ending}"


def _numbers(spark: SparkSession, root: str) -> tuple[list[int], list[int]]:
    """Numbers of the entries and of the checkpoints."""
    path, fs = file_system(spark, f"{root}/{ENTRIES}")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return tuple(sorted(int(n.removesuffix(e)) for n in names if n.endswith(e) and n[0].isdigit()) for e in (ENTRY, CHECKPOINT))


def _move_if_absent(spark: SparkSession, fs, source, target) -> bool:
    """Give a finished file its final name unless that is taken; both at once, on local disks by a link, elsewhere by rename.

    The file system must refuse to rename onto an existing file, as HDFS does. On a store that cannot (some object
    stores), let one writer commit at a time.
    """
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark._sc._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, source)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(source, target, spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except (Py4JJavaError, CapturedException) as error:
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    return True


def create_if_absent(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """A whole file under this name, or False if there is one."""
    path, fs = file_system(spark, folder)
    fs.mkdirs(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    draft, target = jvm_path(f"{folder}/.draft-{uuid.uuid4().hex}"), jvm_path(f"{folder}/{name}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
        out.close()
        return _move_if_absent(spark, fs, draft, target)
    finally:
        fs.delete(draft, False)


def _content(spark: SparkSession, path_name: str) -> str:
    path, fs = file_system(spark, path_name)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def last_number(spark: SparkSession, root: str) -> int:
    """The number of the last entry; 0 before the first. What a reader passes on as `since`."""
    entries, checkpoints = _numbers(spark, root)
    return max([0, *entries, *checkpoints])


def commit(spark: SparkSession, root: str, lines: list[dict], since: int | None = None) -> int:
    """Add one entry and return its number. All its lines become visible at once.

    Without `since` the last committer wins. With it, the commit fails with CommitConflict if an entry after that number
    names a table and dataset of `lines`, or deletes one of these datasets.
    """
    folder, number = f"{root}/{ENTRIES}", last_number(spark, root) + 1
    content = "\n".join(json.dumps(line) for line in lines)
    while True:
        if since is not None and number > since + 1:
            _refuse_conflicts(spark, root, lines, since)
            since = number - 1
        if create_if_absent(spark, folder, _name(number, ENTRY), content):
            if max([0, *_numbers(spark, root)[1]]) < number:
                return number
            path, fs = file_system(spark, f"{folder}/{_name(number, ENTRY)}")  # a checkpoint has passed this number meanwhile
            fs.delete(path, False)
        number = max(number, last_number(spark, root)) + 1


def _refuse_conflicts(spark: SparkSession, root: str, lines: list[dict], since: int) -> None:
    mine = spark.createDataFrame([(x.get("table"), x.get("dataset_id")) for x in lines], "_table string, _dataset string")
    others = events(spark, root).filter(F.col("seq") > since)
    clash = (F.col("dataset_id") == F.col("_dataset")) & (F.col("table").isNull() | (F.col("table") == F.col("_table")))
    found = others.join(F.broadcast(mine), clash, "left_semi").first()  # as many rows as the commit has lines
    if found is not None:
        raise CommitConflict(f"{found['event']} of dataset {found['dataset_id']} in entry {found['seq']}, after {since}")


def commit_deletes(dataset_ids: DataFrame, root: str) -> int:
    """One entry that deletes any number of datasets; their ids are a table that the entry names."""
    spark, batch = dataset_ids.sparkSession, uuid.uuid4().hex
    dataset_ids.select(F.col("dataset_id").cast("string")).distinct().write.parquet(f"{root}/{FOLDER}/{BULK}/batch={batch}")
    return commit(spark, root, [{"event": "delete_all", "version": batch}])


def events(spark: SparkSession, root: str) -> DataFrame:
    """(seq, event, table, dataset_id, version): the last checkpoint and what came after it. Events are write, append, remove and delete."""
    entries, checkpoints = _numbers(spark, root)
    start = max(checkpoints, default=0)
    parts = []
    if checkpoints:
        stored = _content(spark, f"{root}/{ENTRIES}/{_name(start, CHECKPOINT)}")
        parts.append(spark.read.schema(SCHEMA).parquet(f"{root}/{FOLDER}/{stored}"))
    if newer := [n for n in entries if n > start]:
        folder = f"{root}/{ENTRIES}"
        lines = spark.read.schema(_LINE).option("pathGlobFilter", f"*{ENTRY}").json(
            folder if len(newer) == len(entries) else [f"{folder}/{_name(n, ENTRY)}" for n in newer])
        number = F.substring("_metadata.file_name", 1, 20).cast("long")
        lines = lines.select(number.alias("seq"), "event", "table", "dataset_id", "version").filter(F.col("seq").isin(newer) if len(newer) < 100 else F.col("seq") > start)
        parts.append(lines.filter("event <> 'delete_all'"))
        path, fs = file_system(spark, f"{root}/{FOLDER}/{BULK}")
        if fs.exists(path):
            ids = spark.read.schema("dataset_id string, batch string").parquet(f"{root}/{FOLDER}/{BULK}")
            bulk = lines.filter("event = 'delete_all'").select("seq", F.col("version").alias("batch")).join(ids, "batch")
            nothing = F.lit(None).cast("string")
            parts.append(bulk.select("seq", F.lit("delete").alias("event"), nothing.alias("table"), "dataset_id", nothing.alias("version")))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def current(log: DataFrame) -> DataFrame:
    """(seq, event, table, dataset_id, version): the write in force of every table and dataset, and what was appended after it."""
    deleted = log.filter("event = 'delete'").groupBy("dataset_id").agg(F.max("seq").alias("_deleted"))
    last = log.filter("event IN ('write', 'remove')").groupBy("table", "dataset_id").agg(F.max("seq").alias("_last"))
    changes = log.filter("event IN ('write', 'append')").join(deleted, "dataset_id", "left").join(last, ["table", "dataset_id"], "left")
    since = F.coalesce("_last", F.lit(0))
    in_force = F.when(F.col("event") == "append", F.col("seq") > since).otherwise(F.col("seq") == since)
    kept = changes.filter(in_force & (F.col("seq") > F.coalesce("_deleted", F.lit(0))))
    return kept.groupBy("event", "table", "dataset_id", "version").agg(F.min("seq").alias("seq")).select(
        "seq", "event", "table", "dataset_id", "version")


def write_checkpoint(spark: SparkSession, root: str) -> int:
    """Write the state of the log as a table from which readers begin; returns its number. Entries stay until they are purged."""
    entries, checkpoints = _numbers(spark, root)
    number = max([0, *entries, *checkpoints])
    if number and number not in checkpoints:
        stored = f"state-{number}-{uuid.uuid4().hex}"
        state = current(events(spark, root).filter(F.col("seq") <= number))
        state.write.parquet(f"{root}/{FOLDER}/{stored}")
        if not create_if_absent(spark, f"{root}/{ENTRIES}", _name(number, CHECKPOINT), stored):
            path, fs = file_system(spark, f"{root}/{FOLDER}/{stored}")
            fs.delete(path, True)
    return number


def purge_entries(spark: SparkSession, root: str, before_ms: int) -> int:
    """Remove entries and checkpoints that the last checkpoint replaces, if not changed since that time; returns how many."""
    entries, checkpoints = _numbers(spark, root)
    last, removed = max(checkpoints, default=0), 0
    names = [_name(n, ENTRY) for n in entries if n <= last] + [_name(n, CHECKPOINT) for n in checkpoints if n < last]
    for name in names:
        path, fs = file_system(spark, f"{root}/{ENTRIES}/{name}")
        if fs.getFileStatus(path).getModificationTime() < before_ms:
            content = _content(spark, f"{root}/{ENTRIES}/{name}")
            if name.endswith(CHECKPOINT):
                fs.delete(file_system(spark, f"{root}/{FOLDER}/{content}")[0], True)
            for line in map(json.loads, content.splitlines() if name.endswith(ENTRY) else ()):
                if line["event"] == "delete_all":
                    fs.delete(file_system(spark, f"{root}/{FOLDER}/{BULK}/batch={line['version']}")[0], True)
            removed += fs.delete(path, False)
    return removed

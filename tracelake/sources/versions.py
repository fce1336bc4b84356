"""Tables whose content is a set of folders, changed as a whole by one small file that names them.

``_versions/<number>`` lists the folders of a version as JSON; the highest number counts. A change writes new folders first and
then its version file, so a reader sees all of it or nothing, and a lost job leaves nothing but folders nobody names. Folders
that a change replaces stay for readers of the version before it and go with the next change.

Segments are keyed logs in such a table: every change adds one, by bucket of the key's hash, and a fold says what the entries of
a key come to: the newest counts, or their sums do. When ``FAN`` of a level have come together they are merged into one of the
next, so there are few at any time and an entry is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
VERSIONS = "_versions"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest version of the table, or null if there is none."""
    numbers = [name for name in children(spark, f"{path}/{VERSIONS}") if name.isdigit()]
    if not numbers:
        return None
    fs, target = _fs(spark, f"{path}/{VERSIONS}/{numbers[-1]}")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: dict, replaced: list[str]) -> None:
    """Make ``version`` the newest one. Fails if another writer has been faster."""
    number, before = version["number"], version.pop("replaced", [])
    version["replaced"] = replaced
    fs, target = _fs(spark, f"{path}/{VERSIONS}/{number:012d}")
    _, draft = _fs(spark, f"{path}/{VERSIONS}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(version), "utf-8"))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} has been written by someone else")
    for folder in before:
        delete(spark, f"{path}/{folder}")
    for whole in {"/".join(folder.split("/")[:2]) for folder in before if folder.startswith("rows/")}:
        if not any(children(spark, f"{path}/{whole}/{name}") for name in children(spark, f"{path}/{whole}") if "=" in name):
            delete(spark, f"{path}/{whole}")
    delete(spark, f"{path}/{VERSIONS}/{number - 2:012d}")


def token(number: int) -> str:
    """Name of what a change writes, its own at every attempt."""
    return f"{number}-{uuid.uuid4().hex[:8]}"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_segment(
    entries: DataFrame, path: str, kind: str, version: dict, level: int = 0, name: str | None = None, key: str = "id", dealt: bool = False
) -> list:
    """Store entries (key, ..., gone) as a segment; returns how it is listed. Rows of a bucket lie sorted by key in each file.

    Entries that a shuffle has ``dealt`` by key already are not shuffled again: every task writes what it has of each bucket.
    """
    name = name or token(version["number"])
    placed = entries
    if "version" not in entries.columns:
        own = {"version": F.lit(version["number"]).cast("long"), "bucket": bucket_of(F.col(key), version["buckets"])}
        placed = entries.withColumns(own)
    laid_out = (placed if dealt else placed.hint("rebalance", "bucket")).sortWithinPartitions("bucket", key)
    # documents are text that says much the same over and over
    laid_out.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/{kind}/level={level}/v={name}")
    return [level, name]


def folder_of(kind: str, segment: list) -> str:
    return f"{kind}/level={segment[0]}/v={segment[1]}"


def entries(spark: SparkSession, path: str, kind: str, segments: list, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """All entries of the segments, or those in ``buckets``; columns of ``schema`` and version, gone, bucket."""
    whole = f"{schema}, gone boolean, version bigint, bucket int"
    if not segments:
        return spark.createDataFrame([], whole)
    folders = [f"{path}/{folder_of(kind, s)}" for s in segments]
    found = spark.read.schema(whole).option("basePath", f"{path}/{kind}").parquet(*folders)
    found = found.select([part.split(" ")[0] for part in whole.split(", ")])
    return found if buckets is None else found.filter(F.col("bucket").isin(buckets))


def newest(found: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest entry of each key, deletions included."""
    fields = [c for c in found.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*fields), "version").alias("e"))
    return last.select(*keys, *[F.col(f"e.{f}").alias(f) for f in fields])


def merged(
    spark: SparkSession,
    path: str,
    kind: str,
    segments: list,
    schema: str,
    version: dict,
    fold: Callable[[DataFrame], DataFrame] = newest,
    key: str = "id",
) -> tuple[list, list[str]]:
    """(segments with full levels merged, folders no longer named)."""
    replaced = []
    while True:
        levels = [s[0] for s in segments]
        full = [level for level in sorted(set(levels)) if levels.count(level) >= FAN]
        if not full:
            return segments, replaced
        own = [s for s in segments if s[0] == full[0]]
        rest = [s for s in segments if s[0] != full[0]]
        last = fold(entries(spark, path, kind, own, schema))
        if not any(s[0] > full[0] for s in rest):  # nothing older that a deletion has to hide
            last = last.filter(~F.col("gone"))
        segments = [*rest, write_segment(last, path, kind, version, full[0] + 1, key=key)]
        replaced += [folder_of(kind, s) for s in own]

"""The table of trace rows and their documents: idempotent upserts by id, erasure, lookup and retention on Parquet.

``rows`` lies by date and environment and is replaced partition by partition; ``ids`` says in which partition an id is, and
``documents`` holds the whole documents, both as segments by bucket of the id's hash (see ``versions``). A change reads the ids
of the buckets its own ids fall into and rewrites the partitions these name, never the rest of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.order_stats import order_statistic
from tracelake.operators.spans import nested_waterfall
from tracelake.schema import ROW
from tracelake.session import scratch_path
from tracelake.sources import versions
from tracelake.sources.traces import align_schema, export_traces, from_stored_rows, get_traces

PARTITIONS = ["start_date", "environment"]
BUCKETS = 16
_IDS, _DOCUMENTS = "id string, start_date date, environment string", "id string, value string"
_ROW_NAMES = [part.split(" ")[0] for part in ROW.replace("map<string,bigint>", "m").replace("struct<name:string,duration_ms:double,status:string>", "s").replace("decimal(18,6)", "d").split(", ")]


def append_traces(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def latest_by_id(rows: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The last write per id. One id rewritten very often is cut down before the shuffle."""
    newest = Window.partitionBy("id").orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def upsert_traces(existing: DataFrame, incoming: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Existing rows with incoming ones put in by id; the highest ``ingest_seq`` wins."""
    return latest_by_id(append_traces(existing, incoming), order)


def dated(rows: DataFrame, period: str = "day") -> DataFrame:
    """Adds the first day of the day, month or year a trace started in."""
    return rows.withColumn("start_date", F.to_date(F.date_trunc(period, "start_time")))


def table_period(spark: SparkSession, path: str) -> str | None:
    """The period the stored table is partitioned by; null if there is no table."""
    version = versions.current(spark, path)
    return version["period"] if version else None


def _next(spark: SparkSession, path: str, period: str, buckets: int) -> dict:
    """The version after the current one, still with its content."""
    version = versions.current(spark, path) or {"number": 0, "period": period, "buckets": buckets, "rows": [], "ids": [], "documents": [], "replaced": []}
    return {**version, "number": version["number"] + 1}


def _write(table: DataFrame, path: str) -> None:
    # Rebalancing gathers a partition's rows into few files, but splits a busy day over tasks.
    laid_out = table.select(*_ROW_NAMES).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "start_time")
    laid_out.write.partitionBy(*PARTITIONS).parquet(path)


def _stored(spark: SparkSession, path: str, parts: list) -> DataFrame:
    """Rows of the listed partition folders. A given schema keeps environments text, and columns older files lack come back null."""
    if not parts:
        return spark.createDataFrame([], ROW)
    folders = [f"{path}/rows/v={name}/{folder}" for name, folder in parts]
    return spark.read.schema(ROW).option("basePath", f"{path}/rows").parquet(*folders).select(*_ROW_NAMES)


def read_trace_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; ``start_date`` tells by its metadata which period it is the first day of."""
    version = versions.current(spark, path)
    if version is None:
        raise ValueError(f"there is no table at {path}")
    return align_schema(_stored(spark, path, version["rows"])).withMetadata("start_date", {"period": version["period"]})


def _folders(spark: SparkSession, partitions: DataFrame) -> set[str]:
    """Names of the folders of some (start_date, environment); as many as the table has folders at most."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return {"/".join(f"{n}={utils.escapePathName(str(row[n]))}" for n in PARTITIONS) for row in partitions.select(*PARTITIONS).distinct().collect()}


def _buckets(ids: DataFrame, version: dict) -> list[int]:
    """The buckets some ids fall into."""
    return sorted(r[0] for r in ids.select(versions.bucket_of(F.col("id"), version["buckets"])).distinct().collect())


def _places(spark: SparkSession, path: str, version: dict, ids: DataFrame) -> DataFrame:
    """(id, start_date, environment) of those of ``ids`` that are stored; reads their buckets only."""
    listed = versions.entries(spark, path, "ids", version["ids"], _IDS, _buckets(ids, version))
    return versions.newest(listed.join(ids, "id", "left_semi")).filter(~F.col("gone")).select("id", *PARTITIONS)


def _change(spark: SparkSession, path: str, version: dict, touched: set[str], ids: DataFrame, extra: DataFrame | None, news: DataFrame) -> None:
    """Write and commit a version: the touched partitions without ``ids`` and with ``extra``; ``news`` are the entries
    (id, start_date, environment, gone) of the ids that changed."""
    name = versions.token(version["number"])
    old = [part for part in version["rows"] if part[1] in touched]
    content = extra
    if old:
        kept = _stored(spark, path, old).join(ids, "id", "left_anti")
        content = kept if extra is None else kept.unionByName(extra.select(*_ROW_NAMES))
    if content is not None:
        _write(content, f"{path}/rows/v={name}")
    _commit(spark, path, version, touched, name, news)


def _filled(spark: SparkSession, path: str) -> list[str]:
    """The partition folders in a folder of rows."""
    return [f"{d}/{e}" for d in versions.children(spark, path) if "=" in d for e in versions.children(spark, f"{path}/{d}")]


def _commit(spark: SparkSession, path: str, version: dict, touched: set[str], name: str, news: DataFrame) -> None:
    """Commit rows written under ``name`` in place of the touched partitions."""
    filled = _filled(spark, f"{path}/rows/v={name}")
    old = [part for part in version["rows"] if part[1] in touched]
    version["rows"] = [part for part in version["rows"] if part[1] not in touched] + [[name, folder] for folder in filled]
    replaced = [f"rows/v={v}/{folder}" for v, folder in old]
    version["ids"] = [*version["ids"], versions.write_segment(news, path, "ids", version)]
    for kind, schema in (("ids", _IDS), ("documents", _DOCUMENTS)):
        version[kind], gone = versions.merged(spark, path, kind, version[kind], schema, version)
        replaced += gone
    versions.commit(spark, path, version, replaced)


def _news(rows: DataFrame) -> DataFrame:
    return rows.select("id", *PARTITIONS, F.lit(False).alias("gone"))


def _gone(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("string").alias("environment"), F.lit(True).alias("gone"))


def write_trace_rows(rows: DataFrame, path: str, period: str = "day", buckets: int = BUCKETS) -> None:
    """Rows by date and environment, in time order inside files so that row groups can be skipped.

    Only the partitions present in ``rows`` are replaced. A table keeps the period it was first written by. Ids must be unique.
    """
    spark = rows.sparkSession
    version = _next(spark, path, period, buckets)
    if version["period"] != period:
        raise ValueError(f"the table is partitioned by {version['period']}")
    name = versions.token(version["number"])
    _write(dated(rows, period), f"{path}/rows/v={name}")
    # the partitions it fills are those it replaces
    touched = set(_filled(spark, f"{path}/rows/v={name}"))
    old = [part for part in version["rows"] if part[1] in touched]
    fresh = _stored(spark, path, [[name, folder] for folder in touched])
    news = _news(fresh)
    if old:
        news = news.unionByName(_gone(_stored(spark, path, old).select("id").join(fresh.select("id"), "id", "left_anti")))
    _commit(spark, path, version, touched, name, news)


def upsert_into(
    path: str, incoming: DataFrame, period: str = "day", order: str | None = None, buckets: int = BUCKETS, unique: bool = False
) -> None:
    """Put trace rows into the stored table by id, rewriting only the partitions they touch.

    A trace whose start moved to another day leaves its old partition. Of rows that share an id the one highest in
    ``order`` is stored; without an order such rows are refused, unless ids are known to be ``unique``. A column ``value`` holds the rows' documents, which are
    stored with them. ``period`` and ``buckets`` count for a new table only.
    """
    spark = incoming.sparkSession
    if order is not None:
        incoming = latest_by_id(incoming, order).drop(order)
    version = _next(spark, path, period, buckets)
    incoming = dated(incoming, version["period"])
    # Incoming rows are looked at several times; they are computed once, with their documents where these will stay.
    staged = None
    if "value" in incoming.columns:
        # ids known to be unique are so by a shuffle that has brought them together
        segment = versions.write_segment(incoming.withColumn("gone", F.lit(False)), path, "documents", version, dealt=unique)
        version["documents"] = [*version["documents"], segment]
        fresh = spark.read.schema(ROW).parquet(f"{path}/{versions.folder_of('documents', segment)}")
    else:
        staged = scratch_path(spark, "arrived-rows")
        incoming.select(*_ROW_NAMES).write.parquet(staged)
        fresh = spark.read.schema(ROW).parquet(staged)
    ids = fresh.select("id")
    try:
        if order is None and not unique and ids.groupBy("id").count().filter("count > 1").limit(1).count():
            if staged is None:
                versions.delete(spark, f"{path}/{versions.folder_of('documents', segment)}")
            raise ValueError("an id occurs twice; name the column that orders its versions")
        partitions = fresh.select(*PARTITIONS)
        if version["ids"]:
            partitions = partitions.unionByName(_places(spark, path, version, ids).select(*PARTITIONS))
        touched = _folders(spark, partitions)
        if touched:
            _change(spark, path, version, touched, ids, fresh, _news(fresh))
    finally:
        if staged is not None:
            versions.delete(spark, staged)


def erase_from(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete traces and their documents from the stored table; returns how many there were."""
    version = _next(spark, path, "day", BUCKETS)
    wanted = ids.select("id").distinct()
    staged = scratch_path(spark, "erased-ids")
    _places(spark, path, version, wanted).write.parquet(staged)
    found = spark.read.schema(_IDS).parquet(staged)
    n = found.count()
    if n:
        lost = found.select("id")
        if version["documents"]:
            tombs = lost.select("id", F.lit(None).cast("string").alias("value"), F.lit(True).alias("gone"))
            version["documents"] = [*version["documents"], versions.write_segment(tombs, path, "documents", version)]
        _change(spark, path, version, _folders(spark, found), lost, None, _gone(lost))
    versions.delete(spark, staged)
    return n


def clear_table(spark: SparkSession, path: str) -> None:
    """A version without any trace; the one before stays readable until the next change."""
    version = _next(spark, path, "day", BUCKETS)
    replaced = [f"rows/v={v}/{folder}" for v, folder in version["rows"]]
    replaced += [versions.folder_of(kind, s) for kind in ("ids", "documents") for s in version[kind]]
    versions.commit(spark, path, {**version, "rows": [], "ids": [], "documents": []}, replaced)


def stored_documents(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(id, value): the documents of stored traces as JSON text, all or those with the given ids.

    Only the ids' buckets are read. A list of ids also reaches the scan, where rows lie in order of their ids.
    """
    version = versions.current(spark, path)
    if version is None:
        raise ValueError(f"there is no table at {path}")
    if ids is None:
        found = versions.entries(spark, path, "documents", version["documents"], _DOCUMENTS)
    else:
        named = None if isinstance(ids, DataFrame) else list(ids)
        wanted = ids.select("id").distinct() if named is None else spark.createDataFrame([(i,) for i in named], "id string").distinct()
        found = versions.entries(spark, path, "documents", version["documents"], _DOCUMENTS, _buckets(wanted, version))
        found = found.join(wanted, "id", "left_semi") if named is None else found.filter(F.col("id").isin(named))
    return versions.newest(found).filter(~F.col("gone")).select("id", "value")


def get_stored_traces(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Typed documents of stored traces; ids not stored give no row."""
    return from_stored_rows(stored_documents(spark, path, ids).select("value"), "value")


def export_stored(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None, target: str, compression: str = "none") -> None:
    """Write the documents of stored traces, one a line, packed if wanted (``gzip``)."""
    export_traces(get_stored_traces(spark, path, ids), None, target, compression)


def stored_waterfall(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """``span_waterfall`` of stored traces."""
    return nested_waterfall(get_stored_traces(spark, path, ids))


def erase_traces(rows: DataFrame, ids: Sequence[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without the given ids, one-row frame with the number of ids that existed)."""
    if not isinstance(ids, DataFrame):
        ids = rows.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    wanted = ids.select("id").distinct()
    return rows.join(wanted, "id", "left_anti"), get_traces(rows, wanted).agg(F.count("*").alias("erased"))


def clear(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def retain_newest(rows: DataFrame, n: int, order: str = "ingest_seq") -> DataFrame:
    """Latest version of the n traces inserted last; updating a trace does not make it newer.

    ``ingest_seq`` numbers every write; the cut-off is the exact n-th newest first write.
    """
    versions = rows.groupBy("id").agg(F.min(order).alias("_first"), F.max(order).alias(order))
    if n <= 0:
        return rows.limit(0)
    cut = order_statistic(versions, [], "_first", lambda total: F.greatest(total - n, F.lit(0)), "_cut")
    kept = versions.join(F.broadcast(cut), F.col("_first") >= F.col("_cut"))  # the cut is one row
    return rows.join(kept.select("id", order), ["id", order], "left_semi")

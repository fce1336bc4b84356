"""Structured Streaming jobs: ingest, a rate screen, deduplication.

``assembly`` has spans and traces, ``series`` live figures, ``throttle`` exact verdicts on requests.

Every job has a batch twin with the same result on the same input.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.metrics import trace_rows
from tracelake.operators.pricing import RateCard
from tracelake.schema import RAW_TRACE
from tracelake.sources.store import latest_by_id, upsert_into
from tracelake.sources.traces import apply_defaults, document_text, split_valid


def trace_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """JSON trace documents appearing in a folder."""
    reader = spark.readStream.schema(RAW_TRACE).option("columnNameOfCorruptRecord", "_corrupt_record")
    files = reader.option("maxFilesPerTrigger", max_files).json(path)
    # files are read in any order and large ones in pieces: this is the order in which they came
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return files.select("*", arrival.alias("_arrival"))


def rows_of_documents(
    raw: DataFrame, own: RateCard | None = None, now: datetime | None = None, documents: bool = False
) -> DataFrame:
    """Raw documents to trace rows: malformed ones skipped, of documents sent again the last one kept.

    The last one is that of the file that arrived last (``trace_stream`` tells), and in it the last line. Documents
    are reduced to rows where they are read; only those narrow rows are shuffled by id, and the text of the
    ``documents`` (column ``value``) where it is wanted. A document without a start gets ``now``, else the time its file
    arrived, so that reading it again gives the same row.
    """
    known = "_arrival" in raw.columns
    place = F.monotonically_increasing_id().alias("line")
    valid, _ = split_valid(raw.withColumn("ingest_seq", F.struct(*[F.col("_arrival")] * known, place)))
    moment = F.col("_arrival.file_modification_time") if known and now is None else now
    typed = apply_defaults(valid, moment, keep=["ingest_seq"])
    keep = ["ingest_seq"]
    if documents:
        typed = typed.withColumn("value", document_text([c for c in typed.columns if c != "ingest_seq"]))
        keep.append("value")
    return latest_by_id(trace_rows(typed, own=own, keep=keep)).drop("ingest_seq")


def stream_ingest(
    source: DataFrame,
    table: str,
    checkpoint: str,
    own: RateCard | None = None,
    period: str = "day",
    trigger: dict | None = None,
    documents: bool = True,
) -> StreamingQuery:
    """Keep the stored table up to date with a stream of documents, which are stored whole unless told otherwise.

    A document sent again replaces its row, however late it comes; replaying a batch changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        upsert_into(table, rows_of_documents(batch, own, documents=documents), period, unique=True)

    writer = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _per_batch(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def rate_screen(requests: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Requests per client and ten seconds, for ``screened`` to read; ``throttle`` judges exactly.

    Each micro-batch adds its own counts under its number; a replayed batch overwrites itself. There is no state to lose
    and late requests always count. Only counts are kept, so this scales with clients, not requests.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        slot = F.window("ts", "10 seconds")["start"].alias("slot")
        counts = batch.select("client", slot).groupBy("client", "slot").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(_per_batch(path, batch_id))

    writer = requests.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def screened(counts: DataFrame, per_minute: int) -> DataFrame:
    """Clients that sent more than the limit within some minute, looked at every ten seconds, of what ``rate_screen`` has written."""
    minute = F.window("slot", "60 seconds", "10 seconds")["start"].alias("minute_start")
    # what the batches say of a slot is added up first, as each slot is in six minutes
    slots = counts.groupBy("client", "slot").agg(F.sum("n").alias("n"))
    summed = slots.select("client", minute, "n").groupBy("client", "minute_start").agg(F.sum("n").alias("requests"))
    return summed.filter(F.col("requests") > per_minute)


def dedup_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first copy of each event, however late it or a replay comes.

    The keys seen are kept for good, on disk by the state store, spread over tasks by key.
    """
    return events.dropDuplicates(keys)

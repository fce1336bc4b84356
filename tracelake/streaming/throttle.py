"""Exact verdicts on a stream of requests, however late they come.

Kept are the requests of each micro-batch, as they came, and per client and instant how many there were and how many of them
were accepted. A batch reads the instants of its own clients from a minute before its earliest request on, folds them
again together with its own (``rate``), and adds what has changed as one segment (``versions``). Nothing that is stored
is written again but by merging levels, and a request's verdict follows from its instant.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.rate import MINUTE, instants_of, judged_instants, verdicts
from tracelake.schema import REQUEST
from tracelake.sources import versions

_SCHEMA = "client string, t bigint, n bigint, accepted bigint"
_KEYS = ("client", "t")


def _newest(found: DataFrame) -> DataFrame:
    return versions.newest(found, _KEYS)


def live_rate(requests: DataFrame, per_minute: int, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 16) -> StreamingQuery:
    """Judge a stream of (request_id, client, ts) into ``path``; ``live_verdicts`` reads the verdicts.

    A late request changes the verdicts it would have changed had it come in time. A batch that runs again changes nothing.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = versions.current(spark, path) or {"number": 0, "buckets": buckets, "instants": [], "batch": -1, "replaced": []}
        if batch_id <= version["batch"]:
            return
        version = {**version, "number": version["number"] + 1, "batch": batch_id}
        folder = f"{path}/requests/batch={batch_id}"
        batch.select("request_id", "client", "ts").write.mode("overwrite").parquet(folder)
        fresh = instants_of(spark.read.schema(REQUEST).parquet(folder))
        since = fresh.groupBy("client").agg(F.min("t").alias("since"))
        touched = [r[0] for r in since.select(versions.bucket_of(F.col("client"), version["buckets"])).distinct().collect()]
        known = versions.entries(spark, path, "instants", version["instants"], _SCHEMA, touched)
        known = _newest(known.join(since, "client").filter(F.col("t") > F.col("since") - MINUTE).drop("since")).select(*_KEYS, "n", "accepted")
        old = known.select(*_KEYS, F.col("n").alias("n_before"), F.col("accepted").alias("accepted_before"))
        # of the minute before a client's earliest request only what was accepted counts
        whole = fresh.join(old, [*_KEYS], "full").join(since, "client").select(
            *_KEYS, "n_before", "accepted_before", (F.col("t") < F.col("since")).alias("lead"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("n_before", F.lit(0))).alias("n"),
        )
        told = whole.select("client", "t", F.when(F.col("lead"), F.col("accepted_before")).otherwise(F.col("n")).alias("n")).filter("n > 0")
        now = judged_instants(told, per_minute) if per_minute > 0 else told.withColumn("accepted", F.col("n"))
        same = F.col("n").eqNullSafe(F.col("n_before")) & F.col("accepted").eqNullSafe(F.col("accepted_before"))
        changed = whole.filter(~F.col("lead")).drop("n", "lead").join(now, [*_KEYS]).filter(~same)
        news = changed.select(*_KEYS, "n", "accepted", F.lit(False).alias("gone"))
        segment = versions.write_segment(news, path, "instants", version, key="client")
        kept, replaced = versions.merged(spark, path, "instants", [*version["instants"], segment], _SCHEMA, version, _newest, "client")
        versions.commit(spark, path, {**version, "instants": kept}, replaced)

    writer = requests.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live_instants(spark: SparkSession, path: str) -> DataFrame:
    """(client, t, n, accepted) of every instant judged so far."""
    version = versions.current(spark, path)
    return _newest(versions.entries(spark, path, "instants", version["instants"] if version else [], _SCHEMA)).select(*_KEYS, "n", "accepted")


def live_verdicts(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """(request_id, client, ts, rejected): the verdict on each request as it stands, of all or of those from a time on."""
    version = versions.current(spark, path)
    if version is None:
        return spark.createDataFrame([], f"{REQUEST}, rejected boolean")
    told = spark.read.schema(f"{REQUEST}, batch bigint").parquet(f"{path}/requests").filter(F.col("batch") <= version["batch"]).drop("batch")
    judged = live_instants(spark, path)
    if since is not None:
        told = told.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
        judged = judged.filter(F.col("t") >= F.unix_micros(F.lit(since).cast("timestamp")))
    return verdicts(told, judged)

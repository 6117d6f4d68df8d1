"""Analytics over operation logs, queues and providers (AGG-*, TOP-*, FN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def op_log(events: DataFrame) -> DataFrame:
    """Events as an operation log: operation, status, duration, provider, tokens."""
    return events.select(
        "event_id",
        "user_id",
        "ts",
        F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 5, "pending").otherwise("completed").alias("status"),
        F.col("value").alias("duration_ms"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"),
        (F.col("user_id") % 2 == 0).alias("reasoning"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"),
    )


def performance(log: DataFrame) -> DataFrame:
    """AGG-13."""
    return log.groupBy("operation").agg(F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def success_by_provider(log: DataFrame) -> DataFrame:
    """AGG-15."""
    ok = F.count_if(F.col("status") == "completed")
    return log.groupBy("provider").agg(F.count("*").alias("n"), ok.alias("n_ok"), F.round(100.0 * ok / F.count("*"), 2).alias("success_rate"))


def retried(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """FN-21: failed requests wait again with a higher priority while retries are left."""
    tries, priority = F.col("event_id") % 6, F.col("user_id") % 5 + 1
    again = tries <= max_retries
    return log.where("status = 'failed'").select(
        "event_id",
        tries.alias("retry_count"),
        F.when(again, "pending").otherwise("failed").alias("new_status"),
        F.when(again, F.greatest(F.lit(1), priority - 1)).otherwise(priority).cast("bigint").alias("priority"),
        F.when(~again, "MAX_RETRIES_EXCEEDED").alias("error_code"),
    )


def current_requests(chunks: DataFrame, attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """JN-01: each chunk with its current request: ``chunks(chunk_id, current)``, ``attempts(chunk_id, request_id)``."""
    now = chunks.join(attempts, "chunk_id").where("request_id = current")
    return now.join(requests, "request_id")


def attempt_numbers(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-04: the how-manieth attempt of its key each row is."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def scorer_verdict(cold: Column, warm: Column, least: float = 70) -> Column:
    """AGG-09: average of two scorings and whether it asks for another generation."""
    mean = (cold + warm) / 2
    return F.struct(mean.alias("average"), (mean < least).alias("regenerate"))


def duration_ms(start: Column, stop: Column) -> Column:
    """FN-01: whole seconds between two times, in milliseconds."""
    return (F.unix_timestamp(stop) - F.unix_timestamp(start)) * 1000


def stable_id(*parts: Column) -> Column:
    """FN-08: an id that depends on the parts only, so a repeated run gives the same."""
    return F.sha2(F.encode(F.concat_ws("\u001f", *parts), "UTF-8"), 256)


def cache_confidence(c: Column, hit: Column, age: Column, gain: float = 0.1, loss: float = 0.2, decay: float = 0.01) -> Column:
    """FN-10: confidence of a cached path after one use; callers keep what stays at or above their threshold."""
    return c + F.when(hit, gain).otherwise(-loss) - decay * age


def usage_weights(uses: DataFrame, query_class: str, item: str, rate: float = 0.1) -> DataFrame:
    """FN-11: weights that grow by ``rate`` a use, as shares of their query class."""
    raw = uses.groupBy(query_class, item).agg((F.count("*") * F.lit(rate)).alias("weight"))
    return raw.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(query_class)))


def assignment(queue: DataFrame, workers: int, slot: Column | None = None) -> DataFrame:
    """PIP-26: pending requests dealt to workers; every worker's own queue is in order of priority and arrival.

    The worker follows from the request (its number ``slot``, by default a hash of its id), so no global order is
    needed; ``place`` counts from 1 in each queue.
    """
    slot = F.xxhash64("event_id") if slot is None else slot
    mine = queue.where("status = 'pending'").withColumn("worker", F.pmod(slot, F.lit(workers)).cast("int"))
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("worker").orderBy("priority", "ts", "event_id")))


def uploads(new: DataFrame, known: DataFrame) -> DataFrame:
    """PIP-27: what happens to an upload ``new(upload_id, hash)``: a bad hash is refused, known content is reused, the
    first upload of new content is stored as pending, later ones of the same content reuse it."""
    fine = F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    first = F.min("upload_id").over(Window.partitionBy("hash")) == F.col("upload_id")
    old = known.select("hash", F.lit(True).alias("old")).distinct()
    out = F.when(~fine, "INVALID_HASH").when(F.col("old") | ~first, "REUSED").otherwise("UPLOAD_PENDING")
    return new.join(old, "hash", "left").withColumn("old", F.coalesce("old", F.lit(False))).select("upload_id", out.alias("outcome"))

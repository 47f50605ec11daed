"""At-least-once deliveries handled once, retries that wait, and the progress fold kept up by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import CHAPTER, summaries
from ..operators.records import delivery_fate, retry_cycles

DELIVERY = "routing_key string, action_id string, body string, x_death array<struct<count:int>>, died_at timestamp"


def deliveries(spark: SparkSession, path: str, routing_key: str | None = None) -> DataFrame:
    """A stream of deliveries, JSON lines as they come into a folder, for one queue or all."""
    rows = spark.readStream.schema(DELIVERY).json(path)
    return rows if routing_key is None else rows.where(F.col("routing_key") == routing_key)


def publish(messages: DataFrame, path: str, checkpoint: str):
    """Send a stream of messages to where ``deliveries`` reads them: each once, as the checkpoint says."""
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)


def handle_once(done_path: str, key: list[str], handler: Callable[[DataFrame], None], ledger: Callable[[], DataFrame] | None = None, keep_days: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: what the done table has is skipped; the rest is handled, then marked.

    With ``ledger``, which gives the recorded actions' keys, a delivery whose action is gone is skipped, too, and not
    marked. The done table is kept by day; with ``keep_days`` only so many days are asked, which must be longer than a
    delivery can come again. A crash between handling and marking handles a batch again, so a handler must bear repeats.
    """
    made = False

    def run(batch: DataFrame, batch_id: int) -> None:
        nonlocal made
        spark, new = batch.sparkSession, batch.dropDuplicates(key)
        if not made:  # so that there is a table to read
            new.select(*key, F.current_date().alias("day")).limit(0).write.mode("append").parquet(done_path)
            made = True
        done = spark.read.schema(new.select(*key, F.current_date().alias("day")).schema).parquet(done_path)
        if keep_days is not None:
            done = done.where(F.col("day") >= F.date_sub(F.current_date(), keep_days))
        new = new.join(done.select(*key), key, "left_anti")
        if ledger is not None:
            new = new.join(ledger().select(*key), key, "left_semi")
        new = new.persist()
        handler(new)
        new.select(*key, F.current_date().alias("day")).write.mode("append").parquet(done_path)
        new.unpersist()

    return run


def outbox(send: Callable[[list[dict]], list[bool]], sent_path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends recorded actions and then marks those as sent that were.

    ``send`` gets some actions as dicts, on executors, and says of each whether it went; one that did not, or an error of ``send``, is swallowed: the action
    stays recorded and not sent, and the start-up pass finds it. Marks are written by batch, so a batch that is run again, after a crash
    between sending and marking, sends again under the same ids and overwrites its marks.
    """

    def sending(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            try:
                went = list(send(rows))
            except Exception:  # the broker is away: none of these went
                went = [False] * len(rows)
            yield b.filter(pa.array(went, pa.bool_())).select(key)

    def run(batch: DataFrame, batch_id: int) -> None:
        went = batch.mapInArrow(sending, batch.select(*key).schema)
        went.withColumn("sent_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{sent_path}/batch={batch_id}")

    return run


def dispatch(handlers: dict[str, Callable[[DataFrame], None]], parked: Callable[[DataFrame], None], readable: Column, limit: int) -> Callable[[DataFrame], None]:
    """A handler that gives each action type's deliveries to its own; over the limit, unreadable and unbound ones apart.

    Too many cycles park before the body is read; an unreadable body fails, as does one without a handler park.
    """

    def run(batch: DataFrame) -> None:
        judged = batch.withColumn("fate", delivery_fate(retry_cycles(F.col("x_death")), limit, readable)).persist()
        parked(judged.where((F.col("fate") == "park") | ~F.col("routing_key").isin(*handlers)).drop("fate"))
        for kind, handler in handlers.items():
            handler(judged.where((F.col("fate") == "run") & (F.col("routing_key") == kind)).drop("fate"))
        judged.unpersist()

    return run


def fold_batches(log_path: str, out_path: str, chapter: list[str] = CHAPTER, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """Append each batch to the event log, by batch so that a repeat overwrites, and refold its chapters.

    The log lies in ``buckets`` by the hash of the chapter, and only the buckets that a batch touches are read.
    """
    bucket = F.pmod(F.xxhash64(*chapter), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={batch_id}")
        log = spark.read.option("basePath", log_path).parquet(log_path).drop("batch")
        new = spark.read.parquet(f"{log_path}/batch={batch_id}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # of a fixed number
        again = log.where(F.col("bucket").isin(touched)).join(new.select(*chapter).distinct(), chapter, "left_semi").drop("bucket")
        summaries(again, chapter).withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run


def current(table: DataFrame, chapter: list[str] = CHAPTER) -> DataFrame:
    """The newest version of each chapter's summary."""
    rest = [c for c in table.columns if c not in (*chapter, "version", "batch")]
    return table.groupBy(*chapter).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*chapter, "r.*")

"""Comment moderation as a stream: user histories carried from trigger to trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.moderation import carried
from ..plans import jobs
from ..session import delete_shared
from ..sources.sinks import KeyedTable, LineTable, stream_table

STATE = "user_id string, sensitive_count bigint, last_two struct<latest: double, before: double>"


class ModerationStream:
    """Judges each trigger's comments after those of the triggers before it.

    Inside a trigger a user's comments count in time order, triggers in the order
    of their arrival. ``root`` holds what is carried: a keyed table with one
    row per user. A trigger reads it as it was before that trigger, so one
    that is repeated after a failure gives the same lines and the same table. Comments
    pass as DataFrames, so a busy user is spread over slices here too.
    """

    def __init__(self, spark: SparkSession, lexicon: DataFrame, users: DataFrame | None, sink: LineTable, root: str,
                 key: str = "comment_id", origin: dict[str, str] | None = None, most_batches: int = 20):
        self.lexicon, self.users, self.sink, self.root = lexicon, users, sink, root.rstrip("/")
        self.key, self.origin = key, origin
        self.past = KeyedTable(f"{self.root}/users", ["user_id"], most_batches=most_batches)
        self.nobody = spark.createDataFrame([], STATE)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        detected_at = f"{self.root}/detected/batch={batch_id}"
        detected = jobs.detect(batch, self.lexicon, self.key)
        schema = detected.schema
        detected.write.mode("overwrite").parquet(detected_at)
        detected = spark.read.schema(schema).parquet(detected_at)
        earlier = self.past.read(spark, before=batch_id) if batch_id else self.nobody
        history = jobs.user_history(detected, self.key, earlier)
        self.sink.write(jobs.judge(batch, detected, history, self.users, self.key, self.origin), batch_id)
        self.past.upsert(carried(history, self.key), batch_id)
        self.past.vacuum(spark)
        delete_shared(spark, detected_at)

    def start_on(self, comments: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream_table(comments, self.write, checkpoint, "append")

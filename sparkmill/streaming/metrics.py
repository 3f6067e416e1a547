"""Training-metric stream: messages, per-run view, persisted metrics, progress, control.

The trainer publishes two payloads on a run's channel: a *log* message
(run_id, step, loss, learning_rate, epoch, elapsed_seconds) and an
*evaluation* message (run_id, step, val_loss, type='evaluation').  Only log
messages are persisted as metric rows.  Here the channel is a column of the
stream and the payload is parsed JVM-side with ``from_json`` against the
union schema; text that is not JSON is forwarded untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.registry import run_current_state
from .runner import latest_per_key, run_batches, write_batch_partition

MESSAGE_SCHEMA = StructType([
    StructField("run_id", LongType()), StructField("step", LongType()),
    StructField("loss", DoubleType()), StructField("learning_rate", DoubleType()),
    StructField("epoch", DoubleType()), StructField("elapsed_seconds", DoubleType()),
    StructField("val_loss", DoubleType()), StructField("type", StringType()),
    StructField("total_steps", LongType()),
])
ENVELOPE_SCHEMA = StructType([StructField("channel", StringType()), StructField("seq", LongType()),
                              StructField("payload", StringType())])


def channel_of(run_id) -> F.Column:
    return F.concat(F.lit("training:"), run_id.cast("string"), F.lit(":metrics"))


def run_of(channel) -> F.Column:
    """The run id a channel is named by (the inverse of ``channel_of``); null where no run has that channel."""
    run_id = F.regexp_extract(channel, r"^training:(-?[0-9]{1,19}):metrics$", 1).try_cast("bigint")
    return F.when(channel_of(run_id) == channel, run_id)


def message_columns(metrics: DataFrame, *, learning_rate: float = 2e-4) -> list[F.Column]:
    """What the trainer would publish for a metric row, ``struct(seq, payload)`` each: a log message, and an
    evaluation message where ``val_loss`` is set (else null)."""
    total = F.col("total_steps").cast("bigint") if "total_steps" in metrics.columns else F.lit(None).cast("bigint")
    log = F.to_json(F.struct(F.col("run_id"), F.col("step").cast("bigint").alias("step"), F.col("loss"),
                             F.lit(learning_rate).alias("learning_rate"), (F.col("step") / 70.0).alias("epoch"),
                             F.col("throughput").alias("elapsed_seconds"), total.alias("total_steps")),
                    {"ignoreNullFields": "false"})
    ev = F.to_json(F.struct(F.col("run_id"), F.col("step").cast("bigint").alias("step"), F.col("val_loss"),
                            F.lit("evaluation").alias("type")))
    return [message(F.col("step") * 2, log), F.when(F.col("val_loss").isNotNull(), message(F.col("step") * 2 + 1, ev))]


def message(seq, payload) -> F.Column:
    return F.struct(seq.cast("bigint").alias("seq"), payload.alias("payload"))


def publish(metrics: DataFrame, messages: list[F.Column]) -> DataFrame:
    """The messages of every metric row that are not null, as ``(channel, seq, payload)``; each row is read once."""
    each = metrics.select(channel_of(F.col("run_id")).alias("channel"), F.explode(F.array_compact(F.array(*messages))).alias("__e"))
    return each.select("channel", "__e.seq", "__e.payload")


def metric_messages(metrics: DataFrame, *, learning_rate: float = 2e-4) -> DataFrame:
    """What the trainer would publish for these metric rows: ``(channel, seq, payload)``.

    One log message per row and an evaluation message where ``val_loss`` is set.
    """
    return publish(metrics, message_columns(metrics, learning_rate=learning_rate))


def parse_messages(envelopes: DataFrame) -> DataFrame:
    """``(channel, seq, payload)`` → typed fields + ``kind`` (log / evaluation / text)."""
    m = F.from_json(F.col("payload"), MESSAGE_SCHEMA)
    parsed = envelopes.withColumn("__m", F.when(F.col("payload").startswith("{"), m))
    kind = (F.when(F.col("__m").isNull(), "text")
            .when(F.col("__m.type") == "evaluation", "evaluation").otherwise("log"))
    return parsed.select("channel", "seq", "payload", kind.alias("kind"),
                         *[F.col(f"__m.{f.name}").alias(f.name) for f in MESSAGE_SCHEMA.fields if f.name != "type"])


def per_run(messages: DataFrame, run_id: int) -> DataFrame:
    """A subscriber of one run's channel: everything on it, text included."""
    return messages.filter(F.col("channel") == f"training:{run_id}:metrics")


def persist_log_metrics(messages: DataFrame, name: str = "metric-sink") -> str:
    """Persist *log* messages as metric rows, idempotently per micro-batch."""
    logs = messages.filter(F.col("kind") == "log").select("run_id", "step", "loss", "learning_rate")
    return run_batches(logs, name, write_batch_partition)


def run_progress(messages: DataFrame, name: str = "run-progress") -> DataFrame:
    """current_step (latest log step) and total_steps (only if > 0) per run, update mode.

    Each micro-batch's updated rows land in their own batch partition; the
    current view is the latest batch's row per run.
    """
    logs = messages.filter(F.col("kind") == "log")
    agg = logs.groupBy("run_id").agg(
        F.max("step").alias("current_step"),
        F.max_by(F.col("total_steps"), F.when(F.col("total_steps") > 0, F.col("step"))).alias("total_steps"))
    out = run_batches(agg, name, write_batch_partition, output_mode="update")
    spark = messages.sparkSession
    return latest_per_key(spark.read.parquet(out), ["run_id"])


# Control actions and the run status each one requests.
CONTROL_STATUS = {"pause": "paused", "resume": "training", "cancel": "cancelled"}


def control_to_status_events(controls: DataFrame) -> DataFrame:
    """Control messages ``(run_id, seq, action, ts)`` as status updates for the run fold."""
    m = F.create_map(*[x for k, v in CONTROL_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return controls.select("run_id", F.col("seq").alias("ord"), "ts", F.try_element_at(m, F.col("action")).alias("status"),
                           F.lit(None).cast("string").alias("error_message"),
                           F.lit(None).cast("int").alias("current_step"), F.lit(None).cast("int").alias("total_steps"))


def control_state_stream(controls: DataFrame, name: str = "control-state") -> DataFrame:
    """Fold a control stream into each run's status (update mode, latest batch wins)."""
    folded = run_current_state(control_to_status_events(controls))
    out = run_batches(folded, name, write_batch_partition, output_mode="update")
    return latest_per_key(controls.sparkSession.read.parquet(out), ["run_id"])

"""The dataset flows end to end: ingest, clean, format.

Each flow writes its output dataset (JSONL, like the reference's stored files) and
returns small statistics, counted from what is stored and never by collecting records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import formatting, tokens
from ..sources import readers, sinks, stored
from .pipeline import marked_report, run_marked


def ingest(spark: SparkSession, path: str, source_format: str, dest: str) -> DataFrame:
    """Upload → JSONL at ``dest``; returns ``(row_count, schema_json, rejected_lines)``.

    Records are stored as they stood, rejects go to ``dest + ".rejects"`` as {reason, line}, by
    one job; both are then counted from what is stored.  ``rejected_lines`` counts the rejects and
    CSV rows with cells beyond the header (kept, under ``null``).  ``schema_json`` is
    ``{key: python type name}`` of the first record, as text ('{}' without records).
    """
    recs = readers.convert_records(spark, path, source_format)
    stored.write_dataset(recs.select("raw", "reason"), dest, "raw", rejects=dest + ".rejects")
    rejected = spark.read.schema("value string").text(dest + ".rejects").count()
    if source_format == "csv":
        extra = readers.read_csv(spark, path, flag_extra_cells=True).filter("_extra_cells")
        rejected += extra.count()
    kv = readers.first_record_schema(_first_file(recs)).agg(F.map_from_entries(F.collect_list(F.struct("key", "type_name"))).alias("m"))
    return kv.select(F.lit(stored.total_rows(spark, dest)).cast("bigint").alias("row_count"),
                     F.lit(rejected).cast("bigint").alias("rejected_lines"), F.to_json("m").alias("schema_json"))


def _first_file(recs: DataFrame) -> DataFrame:
    """The records of the first file that has any; only its name and ordinals reach the driver and the aggregate."""
    good = recs.filter(F.col("reason").isNull()).select("ord", "record")
    first = good.agg(F.min("ord.file").alias("file")).first()["file"]
    return good.filter(F.col("ord.file") == F.lit(first)) if first is not None else good.limit(0)


def clean(spark: SparkSession, path: str, nodes: list[dict], dest: str) -> DataFrame:
    """JSONL dataset → cleaned JSONL at ``dest``; returns the per-node row counts.

    Records are typed by the fields the nodes touch (all as text) plus the whole record, so
    unknown keys survive.  Every record is written once with the node that removed it; the
    stored dataset and the counts both read that.
    """
    recs = readers.read_jsonl(spark, path)
    fields = sorted({n.get("params", {}).get(k) for n in nodes for k in ("field", "key")
                     if n.get("params", {}).get(k)} | {"text"}
                    | {f for n in nodes for f in (n.get("params", {}).get("fields") or [])})
    typed = readers.records_as_columns(recs, {f: "string" for f in fields}, keep_record=True)
    marked = run_marked(typed, nodes, order_col="ord")
    # A redaction rewrites string fields: put the new text back into the record.
    sinks.write_jsonl(marked.filter("dropped is null").select(_patch_record("record", fields).alias("record")), dest)
    return marked_report(marked, nodes)


def _as_variant(c):
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("v")))), "$.v", "variant")


def _patch_record(record_col: str, fields: list[str]):
    """Replace the listed top-level fields of a VARIANT object, where they hold text."""
    m = F.expr(f"try_cast(`{record_col}` AS map<string, variant>)")
    entries = [F.when(F.col(f"`{f}`").isNotNull()
                      & (F.schema_of_variant(F.try_element_at(m, F.lit(f))) == "STRING"),
                      F.struct(F.lit(f).alias("key"), _as_variant(F.col(f"`{f}`")).alias("value")))
               for f in fields]
    patch = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    kept = F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.to_variant_object(F.map_concat(kept, patch))


def format_dataset(spark: SparkSession, path: str, dest: str, *, user_column: str, assistant_column: str,
                   system_column: str | None = None, tokenizer: str = "estimate") -> DataFrame:
    """JSONL → instruction rows at ``dest``; returns ``(formatted_rows, total_tokens)``.

    ``tokenizer="estimate"`` counts ``len // 4`` per value; any other name is a
    BPE encoder from the registry.  One estimator per run (never a mix).
    """
    cols = [c for c in (system_column, user_column, assistant_column) if c]
    recs = readers.records_as_columns(readers.read_jsonl(spark, path), {c: "string" for c in cols})
    rows = formatting.instruction_format(recs, user_column=user_column, assistant_column=assistant_column,
                                         system_column=system_column)
    values = ["system", "user", "assistant"]
    per_row = (sum((tokens.value_estimate(c) for c in values), F.lit(0).cast("bigint")) if tokenizer == "estimate"
               else tokens.bpe_count_row(values, tokenizer))
    stats = Observation("format")
    counted = rows.withColumn("__tokens", per_row)
    observed = counted.observe(stats, F.count(F.lit(1)).alias("n"), F.sum("__tokens").alias("t"))
    present = [F.col(c) for c in values if c != "system" or system_column]
    # A row without a system prompt has no "system" key, as in the reference's output.
    sinks.write_jsonl(observed.select(*present), dest, keep_nulls=False)
    got = stats.get
    return spark.createDataFrame([(int(got["n"]), int(got["t"] or 0))], "formatted_rows bigint, total_tokens bigint")

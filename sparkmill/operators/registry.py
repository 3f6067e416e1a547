"""Registry reads: datasets, runs, checkpoints, metrics, models, endpoints, keys.

Every lookup the reference does row by row in Python (nested loops over ORM
objects) is a declarative join, aggregate or window here, evaluated for all
requests at once.  Ties on timestamps are always broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fmt import fixed4, iso_timestamp
from .ordinal import dense_ordinal

# Credits per GPU-hour by GPU type, and the price of an unknown type.
GPU_CREDITS_PER_HOUR = {"T4": 5, "L4": 8, "A10G": 10, "A100_40GB": 20, "A100_80GB": 35}
DEFAULT_GPU_CREDITS = 20
STEPS_PER_HOUR = 500

# Status enumerations.
DATASET_STATUSES = ["uploading", "processing", "cleaning", "ready", "failed"]
RUN_STATUSES = ["queued", "provisioning", "downloading", "training", "saving", "paused", "completed",
                "failed", "cancelled"]
ENDPOINT_STATUSES = ["starting", "running", "stopping", "stopped", "failed"]
TERMINAL_RUN_STATUSES = ["completed", "failed", "cancelled"]


def _literal_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# ---------------------------------------------------------------- projections


def estimate_cost(runs: DataFrame, *, gpu_type: str = "gpu_type", gpu_count: str = "gpu_count",
                  max_steps: str = "max_steps", num_epochs: str = "num_epochs") -> DataFrame:
    """Credits = price(GPU) × hours × GPUs, rounded to 2 decimals.

    The price table is a five-entry literal map: a lookup expression, not a join.
    """
    price = F.coalesce(F.try_element_at(_literal_map(GPU_CREDITS_PER_HOUR), F.col(gpu_type)),
                       F.lit(DEFAULT_GPU_CREDITS)).cast("double")
    hours = F.when(F.col(max_steps) == -1, (F.col(num_epochs) * 2).cast("double")) \
        .otherwise(F.col(max_steps).cast("double") / STEPS_PER_HOUR)
    return runs.withColumn("estimated_cost", F.round(price * hours * F.col(gpu_count).cast("double"), 2))


def effective_batch_size(per_device: Column, accumulation: Column, gpus: Column) -> Column:
    return (per_device * accumulation * gpus).cast("bigint")


def run_log_lines(metrics: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """``Step N — loss: x.xxxx[, val_loss: y.yyyy]``; val_loss only when truthy (non-zero)."""
    keep = keep or ["run_id", "step"]
    val = F.when(F.col("val_loss").isNotNull() & (F.col("val_loss") != 0),
                 F.concat(F.lit(", val_loss: "), fixed4("val_loss"))).otherwise(F.lit(""))
    msg = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(" — loss: "), fixed4("loss"), val)
    at = [iso_timestamp("recorded_at").alias("timestamp")] if "recorded_at" in metrics.columns and "timestamp" not in keep else []
    return metrics.filter(F.col("loss").isNotNull()).select(*keep, msg.alias("message"), *at)


def model_register(runs: DataFrame) -> DataFrame:
    """A model row per completed run: name ``{experiment or 'model'}-{id[:8]}``."""
    rid = F.col("id").cast("string")
    exp = F.when(F.coalesce(F.length("experiment_name"), F.lit(0)) > 0, F.col("experiment_name")).otherwise("model")
    return runs.filter(F.col("status") == "completed").select(
        F.col("id").alias("run_id"), F.col("project_id"),
        F.concat(exp, F.lit("-"), F.substring(rid, 1, 8)).alias("name"),
        F.col("base_model"),
        F.coalesce(F.col("method"), F.lit("lora")).alias("training_method"),
        F.concat_ws("/", F.lit("models"), F.col("project_id").cast("string"), rid, F.lit("final")).alias("s3_path"))


MODEL_CONFIG_FIELDS = ["base_model", "method", "lora_config"]
TRAINING_CONFIG_FIELDS = ["learning_rate", "scheduler", "batch_size", "gradient_accumulation_steps",
                          "warmup_steps", "weight_decay", "max_steps", "num_epochs", "context_length",
                          "mixed_precision", "checkpoint_steps", "max_checkpoints", "resume_from_checkpoint"]


def run_config_split(runs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flat configuration → ``model_config`` and ``training_config`` structs (absent fields null)."""
    keep = keep or ["id"]
    cols = set(runs.columns)

    def field(name):
        return (F.col(name) if name in cols else F.lit(None)).alias(name)

    return runs.select(*keep, F.struct(*[field(n) for n in MODEL_CONFIG_FIELDS]).alias("model_config"),
                       F.struct(*[field(n) for n in TRAINING_CONFIG_FIELDS]).alias("training_config"))


def resume_config(split: DataFrame, checkpoint_path: str = "checkpoint_path", keep: list[str] | None = None) -> DataFrame:
    """Merge the two structs back for a resume: training values win, plus the checkpoint path."""
    keep = keep or ["id"]
    m = [f for f in MODEL_CONFIG_FIELDS if f not in TRAINING_CONFIG_FIELDS]
    return split.select(*keep, F.struct(*[F.col(f"model_config.{f}").alias(f) for f in m],
                                        *[F.col(f"training_config.{f}").alias(f) for f in TRAINING_CONFIG_FIELDS],
                                        F.col(checkpoint_path).alias("resume_checkpoint_path")).alias("config"))


def client_key(auth: Column, forwarded: Column, host: Column) -> Column:
    """Limiter identity: bearer-key prefix, else first forwarded address, else host."""
    a = F.coalesce(auth, F.lit(""))
    fwd = F.coalesce(forwarded, F.lit(""))
    from ..functions.text import py_strip
    return (F.when(a.startswith("Bearer "), F.substring(a, 8, 13))
            .when(fwd != "", py_strip(F.split(fwd, ",", 2).getItem(0)))
            .otherwise(F.coalesce(host, F.lit("unknown"))))


def dataset_register(uploads: DataFrame, *, id_col: str = "id", project_col: str = "project_id",
                     filename_col: str = "original_filename") -> DataFrame:
    """Name, format and storage key ``datasets/{project}/{id}/{filename}``; status ``uploading``."""
    from ..sources.readers import route_by_extension
    r = route_by_extension(uploads, filename_col)
    return r.select(F.col(id_col).alias("id"), F.col(project_col).alias("project_id"),
                    F.col("base_name").alias("name"), F.col(filename_col).alias("original_filename"),
                    "file_format",
                    F.concat_ws("/", F.lit("datasets"), F.col(project_col).cast("string"),
                                F.col(id_col).cast("string"), F.col(filename_col)).alias("storage_key"),
                    F.lit("uploading").alias("status"))


# ---------------------------------------------------------------- gates and guards


def dataset_ready_gate(runs: DataFrame, datasets: DataFrame, *, run_id: str = "id",
                       dataset_fk: str = "dataset_id") -> DataFrame:
    """``ok`` / ``not_found`` / ``not_ready`` per run request (null dataset status passes)."""
    d = datasets.select(F.col("id").alias("__did"), F.col("status").alias("__dstatus"))
    j = runs.join(d, runs[dataset_fk] == d["__did"], "left")
    verdict = (F.when(F.col("__did").isNull(), "not_found")
               .when(F.col("__dstatus").isNotNull() & (F.col("__dstatus") != "ready"), "not_ready")
               .otherwise("ok"))
    return j.select(F.col(run_id).alias("run_id"), F.col(dataset_fk).alias("dataset_id"), verdict.alias("verdict"))


def action_allowed(action: Column, status: Column) -> Column:
    """Transition rules: pause needs training, resume needs paused, cancel not after the
    end, stop (endpoints) not when already stopped or failed."""
    return (F.when(action == "pause", status == "training")
            .when(action == "resume", status == "paused")
            .when(action == "cancel", ~status.isin("completed", "cancelled", "failed"))
            .when(action == "stop", ~status.isin("stopped", "failed"))
            .otherwise(F.lit(False)))


def status_transition_guard(requests: DataFrame, current: DataFrame, *, key: str = "id") -> DataFrame:
    """Requests ``(key, action)`` joined to current ``(key, status)``: ``allowed``, ``verdict``."""
    j = requests.join(current.select(key, "status"), key, "left")
    ok = action_allowed(F.col("action"), F.col("status"))
    verdict = F.when(F.col("status").isNull(), "not_found").when(ok, "ok").otherwise("bad_status")
    return j.select(key, "action", "status", F.coalesce(ok, F.lit(False)).alias("allowed"), verdict.alias("verdict"))


# ---------------------------------------------------------------- metrics


def metrics_step_range(metrics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Metrics of each requested run with ``from_step <= step [<= to_step]``.

    An equi-join on run id with the step range as a join filter.
    """
    r = ranges.select(F.col("run_id").alias("__rid"), "from_step", "to_step")
    cond = ((metrics["run_id"] == r["__rid"]) & (metrics["step"] >= r["from_step"]) &
            (r["to_step"].isNull() | (metrics["step"] <= r["to_step"])))
    return metrics.join(r, cond).drop("__rid", "from_step", "to_step")


# ---------------------------------------------------------------- state folds


def open_fold(changes: DataFrame, *, key: str, ord_col: str, changes_col: str = "changes") -> DataFrame:
    """``(key, field, value)``: the last value each field of an entity was given, null if it was set to null.

    ``changes_col`` is a map of the fields a change gives; a field that is not in the map is left
    as it is.  Any field may come up, none is named here.  One aggregate with
    partial steps per (entity, field): a hot entity is folded before the shuffle.
    """
    given = changes.select(F.col(key), F.col(ord_col).alias("__ord"), F.explode(changes_col).alias("field", "__value"))
    return given.groupBy(key, "field").agg(F.max_by("__value", "__ord").alias("value"))


def pivot_fields(folded: DataFrame, schema: dict[str, str], *, key: str) -> DataFrame:
    """One typed row for each entity of ``open_fold``; fields it was never given are null, fields outside ``schema`` left out."""
    return folded.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).cast(kind).alias(f) for f, kind in schema.items()])


RUN_FIELDS = ("error_message", "current_step", "total_steps", "worker_id", "cost_credits", "gpu_seconds")


def run_current_state(events: DataFrame, *, key: str = "run_id", ord_col: str = "ord", ts_col: str = "ts") -> DataFrame:
    """Fold status updates per run: the last status wins (a null status leaves it
    unchanged), the RUN_FIELDS that ``events`` has overwrite only when given, ``started_at`` is the
    first ``training`` update, ``finished_at`` the latest terminal one.

    One aggregate with partial steps: a hot run is folded map-side first.
    """
    def last_given(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col)))

    return events.groupBy(key).agg(
        last_given("status").alias("status"),
        *[last_given(c).alias(c) for c in RUN_FIELDS if c in events.columns],
        F.min(F.when(F.col("status") == "training", F.col(ts_col))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL_RUN_STATUSES), F.col(ts_col))).alias("finished_at"),
        F.max(ts_col).alias("updated_at"))


def dataset_current_state(updates: DataFrame, *, key: str = "dataset_id", ord_col: str = "ord",
                          ts_col: str = "ts") -> DataFrame:
    """Field-wise last write wins; a status update (``kind='status'``) always
    overwrites ``error_message``, null included.  (``open_fold`` folds any field.)"""
    def last_given(c, also: Column | None = None):
        cond = F.col(c).isNotNull() if also is None else (F.col(c).isNotNull() | also)
        return F.max_by(F.col(c), F.when(cond, F.col(ord_col)))

    return updates.groupBy(key).agg(
        last_given("status").alias("status"),
        last_given("row_count").alias("row_count"),
        last_given("error_message", F.col("kind") == "status").alias("error_message"),
        F.max(ts_col).alias("updated_at"))


# ---------------------------------------------------------------- checkpoints


def _ckpt_rank(desc_best: bool = True) -> Window:
    order = [F.col("is_best").desc(), F.col("step").desc(), F.col("id").desc()] if desc_best else \
        [F.col("step").desc(), F.col("id").desc()]
    return Window.partitionBy("run_id").orderBy(*order)


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Per run: the best-flagged checkpoint, else the highest step (top-1 per group).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so a run with very many checkpoints costs one row per partition.
    """
    return (checkpoints.withColumn("__rn", F.row_number().over(_ckpt_rank(True)))
            .filter(F.col("__rn") == 1).drop("__rn"))


def checkpoint_retention(checkpoints: DataFrame, max_checkpoints: int = 3) -> DataFrame:
    """The newest ``max_checkpoints`` checkpoints per run (top-k per group)."""
    return (checkpoints.withColumn("__rn", F.row_number().over(_ckpt_rank(False)))
            .filter(F.col("__rn") <= max_checkpoints).drop("__rn"))


def best_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The first best-flagged checkpoint per run (deterministic: lowest step, then id)."""
    w = Window.partitionBy("run_id").orderBy("step", "id")
    return (checkpoints.filter(F.col("is_best"))
            .withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn"))


CHECKPOINT_FIELDS = ("step", "epoch", "val_loss", "is_best", "created_at")


def run_detail(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Each run with its checkpoints in step order, one row per checkpoint, with the CHECKPOINT_FIELDS it has.

    A run without checkpoints keeps one row with null checkpoint columns (the
    empty list).  Rows, not a collected list: a run's checkpoints never have to
    fit in one value.  Written as inner join ∪ anti join rather than a left
    join: AQE can split a skewed partition on either side of an inner join,
    while a left join cannot split its right side (a run holding a third of
    all checkpoints).  The anti join meets each run's key once.
    """
    fields = [c for c in CHECKPOINT_FIELDS if c in checkpoints.columns]
    c = checkpoints.select(F.col("run_id").alias("__rid"), F.col("id").alias("checkpoint_id"), *[F.col(f).alias(f"checkpoint_{f}") for f in fields])
    with_ckpt = runs.join(c, runs["id"] == c["__rid"]).drop("__rid")
    have = checkpoints.select(F.col("run_id").alias("__rid")).distinct()
    without = runs.join(have, runs["id"] == have["__rid"], "left_anti")
    return with_ckpt.unionByName(without, allowMissingColumns=True)


# ---------------------------------------------------------------- endpoints


def newest(df: DataFrame, n: int, ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """The ``n`` newest rows (global top-k: each partition keeps its own top n)."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def resolve_endpoint(requests: DataFrame, endpoints: DataFrame, models: DataFrame, *,
                     search_limit: int | None = None) -> DataFrame:
    """Requested model string → newest running endpoint whose model's name, id or
    base model equals it.

    The OR becomes an equi-join: each candidate model is exploded into its
    distinct match keys, and each key keeps only its best (newest) endpoint
    (``max_by`` combines before the shuffle), so each request meets at most one row.
    ``search_limit`` searches the newest so many endpoints only, running or not;
    the key table then has at most ``search_limit`` × 3 rows and is broadcast.
    """
    some = endpoints if search_limit is None else newest(endpoints, search_limit)
    m = models.select(F.col("id").alias("__mid"), "name", "base_model")
    cand = some.filter(F.col("status") == "running") \
        .select(F.col("id").alias("endpoint_id"), F.col("model_id"), F.col("created_at").alias("__ts")) \
        .join(m, F.col("model_id") == F.col("__mid"))
    keys = cand.select("endpoint_id", "model_id", "__ts", F.explode(F.array_distinct(F.array(
        F.col("name").cast("string"), F.col("__mid").cast("string"), F.col("base_model").cast("string")))).alias("__key"))
    best = F.max_by(F.struct("endpoint_id", "model_id"), F.struct("__ts", "endpoint_id"))
    keys = keys.filter(F.col("__key").isNotNull()).groupBy("__key").agg(best.alias("__best")).select("__key", "__best.*")
    j = requests.join(keys if search_limit is None else F.broadcast(keys), requests["model"] == keys["__key"], "left")
    return j.select("request_id", "model", "endpoint_id", "model_id")


def model_endpoint_lookup(endpoints: DataFrame, *, search_limit: int | None = None) -> DataFrame:
    """For each model with an endpoint (among the newest ``search_limit``, if given): the newest one."""
    some = endpoints if search_limit is None else newest(endpoints, search_limit)
    return some.groupBy("model_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("endpoint_id"))


def verify_api_key(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """``valid`` iff a non-revoked ``(endpoint_id, sha256(key))`` row exists.

    The key table is reduced to distinct live pairs (partial aggregate), then
    one left join; no request is duplicated by repeated keys.
    """
    live = (api_keys.filter(F.col("revoked_at").isNull())
            .groupBy("endpoint_id", "key_hash").agg(F.lit(True).alias("__hit")))
    hashed = requests.withColumn("__h", F.sha2(F.col("api_key"), 256))
    j = hashed.join(live, (hashed["endpoint_id"] == live["endpoint_id"]) & (hashed["__h"] == live["key_hash"]), "left")
    return j.select(hashed["request_id"], hashed["endpoint_id"], F.coalesce(F.col("__hit"), F.lit(False)).alias("valid"))


def bearer_key(header: Column) -> Column:
    """The key of an ``Authorization`` header: what follows ``Bearer ``, stripped; null where there is none."""
    from ..functions.text import py_strip
    key = py_strip(F.substring(header, 8, F.length(header)))
    return F.when(header.startswith("Bearer ") & (key != ""), key)


def verify_header(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """``(request_id, endpoint_id, verdict)`` by the requests' ``auth_header``: ``missing_header``, ``missing_key``, ``invalid`` or ``ok``."""
    header = F.coalesce("auth_header", F.lit(""))
    keyed = requests.withColumn("api_key", bearer_key(header))
    known = verify_api_key(keyed, api_keys).select("request_id", "endpoint_id", "valid")
    heads = requests.select("request_id", header.startswith("Bearer ").alias("__bearer"), bearer_key(header).isNotNull().alias("__key"))
    verdict = F.when(~F.col("__bearer"), "missing_header").when(~F.col("__key"), "missing_key").when(F.col("valid"), "ok").otherwise("invalid")
    return known.join(heads, "request_id").select("request_id", "endpoint_id", verdict.alias("verdict"))


# ---------------------------------------------------------------- deletes and upserts


def cascade_delete(children: DataFrame, deleted_parents: DataFrame, *, fk: str, parent_key: str = "id") -> DataFrame:
    """Child rows that survive deleting the parents (anti-join on the foreign key)."""
    p = deleted_parents.select(F.col(parent_key).alias("__pk"))
    return children.join(p, children[fk] == p["__pk"], "left_anti")


def delete_restrict(deleted_parents: DataFrame, referencing: DataFrame, *, fk: str, parent_key: str = "id") -> DataFrame:
    """Parents that cannot be deleted because rows still reference them (semi-join).

    The referencing keys are de-duplicated first (partial aggregate), so a
    parent referenced by a third of all rows is one row before the join.
    """
    r = referencing.select(F.col(fk).alias("__fk")).distinct()
    return deleted_parents.join(r, deleted_parents[parent_key] == r["__fk"], "left_semi")


def upsert_registry(current: DataFrame, changes: DataFrame, *, key: str = "id", order: str | None = None) -> DataFrame:
    """Apply a change set: rows whose key is in ``changes`` are replaced, new keys added.

    The last change of a key by ``order`` (ties, and without ``order`` all, by the whole
    row) is the one that counts, so keys stay unique.  ``current`` minus changed keys
    (anti-join) union the reduced change set; never row at a time.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in current.columns])
    rank = F.struct(F.col(order), row) if order else row
    last = changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, rank).alias("__row")).select("__row.*")
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.unionByName(last)


# ---------------------------------------------------------------- listings


def page_by_group(df: DataFrame, group_col: str | None, *, ts: str = "created_at", id_col: str = "id",
                  offset: int = 0, limit: int | None = 50, newest_first: bool = True) -> DataFrame:
    """Page ``(offset, offset + limit]`` of each group, newest first, ties by id.

    With no group it is a global top-k.  Per group it is ``row_number() <= k``,
    planned with a partial WindowGroupLimit so a huge group keeps only k rows
    per partition before the shuffle.
    """
    order = [F.col(ts).desc(), F.col(id_col).desc()] if newest_first else [F.col(ts).asc(), F.col(id_col).asc()]
    if group_col is None:
        if limit is None:  # ranking a whole table would run in one task
            raise ValueError("a listing without a group needs a limit")
        w = Window.orderBy(*order)
        top = df.orderBy(*order).limit(offset + limit)
        return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") > offset)
    if limit is None:  # whole groups in order: positions in one order of all rows, less the group's first
        key = F.struct(*[F.col(c) for c in (group_col, ts, id_col)])
        placed = dense_ordinal(df.withColumn("__key", key), "__key", out="__at").drop("__key")
        ends = placed.groupBy(F.col(group_col).alias("__g")).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
        ranked = placed.join(ends, F.col(group_col).eqNullSafe(F.col("__g")))
        rank = F.col("__hi") - F.col("__at") if newest_first else F.col("__at") - F.col("__lo")
        return ranked.withColumn("rank", rank + 1).filter(F.col("rank") > offset).drop("__g", "__lo", "__hi", "__at")
    w = Window.partitionBy(group_col).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= offset + limit).filter(F.col("rank") > offset)

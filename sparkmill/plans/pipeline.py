"""Cleaning pipeline: a node list compiled into one lazy DataFrame plan.

``run_pipeline(df, [{"node_type": ..., "params": {...}}, ...])`` appends each
node's transform to the plan; nothing runs until the caller's action.  Catalyst
then merges adjacent filters and projections and pushes row filters that only
touch grouping columns below a full-row dedup (the only reordering that is
valid; a keyed dedup or a redaction must stay where the user put it).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning

NodeFn = Callable[..., DataFrame]

NODE_REGISTRY: dict[str, NodeFn] = {
    "dedup": cleaning.dedup,
    "length_filter": cleaning.length_filter,
    "regex_filter": cleaning.regex_filter,
    "pii_redact": cleaning.pii_redact,
    "language_filter": cleaning.language_filter,
}


def register_node(name: str, fn: NodeFn) -> None:
    """Add a ``(DataFrame, **params) -> DataFrame`` node under ``name``."""
    NODE_REGISTRY[name] = fn


def _resolve(node: dict) -> tuple[NodeFn, dict]:
    node_type = node.get("node_type", "")
    fn = NODE_REGISTRY.get(node_type)
    if fn is None:
        raise ValueError(f"Unknown cleaning node type: {node_type}")
    return fn, dict(node.get("params") or {})


# Nodes whose output columns are expensive to recompute.  Catalyst pushes a
# later row filter through a projection by inlining the projected expression,
# so a language filter after redaction would run the whole regex chain once per
# reference (three times per row).  A non-deterministic marker column stops
# that pushdown: later filters then read the redacted text as a computed
# column.  The marker never reaches a dedup (it would join the row identity)
# and is dropped at the end.
EXPENSIVE_NODES = {"pii_redact"}
_FENCE = "__fence"


def _fence(df: DataFrame) -> DataFrame:
    return df if _FENCE in df.columns else df.withColumn(_FENCE, F.spark_partition_id())


def _unfence(df: DataFrame) -> DataFrame:
    # The marker must stay referenced up to here, or column pruning removes
    # it before predicate pushdown runs; the partition id is never negative.
    return df.filter(F.col(_FENCE) >= 0).drop(_FENCE) if _FENCE in df.columns else df


# Nodes that only drop rows by one field (``field``, default ``text``), by their predicate over the columns' names.
ROW_FILTERS = {cleaning.length_filter: cleaning.length_keep, cleaning.regex_filter: cleaning.regex_keep, cleaning.language_filter: cleaning.language_keep}


def _filter_field(fn: NodeFn, params: dict) -> str | None:
    """The field such a node reads; a node registered anew under its name is another function and none of them."""
    return params.get("field", "text") if fn in ROW_FILTERS else None


def hoist_filters(steps: list[tuple[str, NodeFn, dict]]) -> list[tuple[str, NodeFn, dict]]:
    """Move row filters that directly follow a dedup in front of it when valid.

    Valid when every row of a dedup group gets the same verdict: for a keyed
    dedup, a filter that reads only the key field (a group shares its key
    value; key-less rows form full-row groups whose key is null in every row);
    for a full-row dedup, any such filter (copies are identical).  Filtering
    first shrinks the dedup's shuffle.  A redaction in between stops the move
    (it rewrites the field), so only an unbroken run of filters moves.
    """
    out = list(steps)
    i = 0
    while i < len(out):
        node_type, _fn, params = out[i]
        if node_type != "dedup" or NODE_REGISTRY["dedup"] is not cleaning.dedup:
            i += 1
            continue
        key = params.get("key")
        j = i + 1
        moved = []
        while j < len(out):
            field = _filter_field(out[j][1], out[j][2])
            if field is None or (key and field != key):
                break
            moved.append(out[j])
            j += 1
        out[i:j] = moved + [out[i]]
        i += len(moved) + 1
    return out


def run_pipeline(df: DataFrame, nodes: list[dict], *, order_col: str = "ord", optimize: bool = True,
                 dedup: NodeFn | None = None) -> DataFrame:
    """Apply the nodes in order; unknown node types raise, extra params are ignored.

    With ``optimize`` the result is the same but key-only filters run before
    the dedup they follow (``hoist_filters``).  ``dedup`` replaces the dedup
    node's implementation (the streaming form keeps state across batches).
    """
    steps = [(n.get("node_type", ""),) + _resolve(n) for n in nodes]  # validate everything before building
    if dedup is not None:
        steps = [(t, dedup if t == "dedup" else fn, p) for t, fn, p in steps]
    if optimize:
        steps = hoist_filters(steps)
    out = df
    for node_type, fn, params in steps:
        if node_type == "dedup":
            out = _unfence(out)
        out = fn(out, order_col=order_col, **params)
        if node_type in EXPENSIVE_NODES:
            out = _fence(out)
    return _unfence(out)


def pipeline_stages(df: DataFrame, nodes: list[dict], *, order_col: str = "ord") -> list[DataFrame]:
    """The frame after each node (index 0 is the input)."""
    return [run_pipeline(df, nodes[:i], order_col=order_col, optimize=False) for i in range(len(nodes) + 1)]


def cleaning_report(df: DataFrame, nodes: list[dict], *, order_col: str = "ord") -> DataFrame:
    """Rows before the pipeline and after each node, as one DataFrame.

    Each stage count is a global aggregate with map-side partial counts; the
    stages share their scan and prefix plan, so AQE reuses exchanges where the
    plans coincide.  Nothing is collected to the driver.
    """
    stages = pipeline_stages(df, nodes, order_col=order_col)
    names = ["input"] + [n.get("node_type", "") for n in nodes]
    parts = [s.agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(i).alias("stage"), F.lit(names[i]).alias("node_type"), "rows")
             for i, s in enumerate(stages)]
    return reduce(DataFrame.unionByName, parts)


def mark_pipeline(df: DataFrame, nodes: list[dict], *, order_col: str = "ord") -> DataFrame:
    """Every row of ``df`` with ``dropped``: the 1-based node that removed it, null where it stays.

    Rows that stay have the values the pipeline gives them; of the others only the
    ordinal is kept.  One plan: filters become marks, a dedup marks the rows that are not
    the first of their identity among those still alive, any other node is run on
    the rows alive and those it does not give back are marked.  ``order_col`` is unique.
    """
    out = df.withColumn("dropped", F.lit(None).cast("int"))
    alive = F.col("dropped").isNull()
    for i, node in enumerate(nodes, 1):
        fn, params = _resolve(node)
        data = [c for c in out.columns if c != "dropped"]
        if fn in ROW_FILTERS:
            keep = F.coalesce(ROW_FILTERS[fn](data, **params), F.lit(False))
            out = out.withColumn("dropped", F.when(alive & ~keep, F.lit(i)).otherwise(F.col("dropped")))
        elif fn is cleaning.pii_redact:
            done = cleaning.redactions(out, **params)
            out = out.withColumns({c: F.when(alive, x).otherwise(F.col(f"`{c}`")) for c, x in done.items()})
        else:
            living = out.filter(alive).drop("dropped")
            if fn is cleaning.dedup:
                firsts = cleaning.first_ordinals(living, params.get("key"), order_col).select(F.col("__ord").alias("__first"))
                out = out.join(firsts, out[order_col] == F.col("__first"), "left")
                out = out.withColumn("dropped", F.when(alive & F.col("__first").isNull(), F.lit(i)).otherwise(F.col("dropped"))).drop("__first")
            else:
                kept = fn(living, order_col=order_col, **params)
                gone = living.select(order_col).join(kept.select(order_col), order_col, "left_anti").select(order_col, F.lit(i).alias("dropped"))
                before = out.filter(~alive).select(order_col, "dropped")
                out = (kept.withColumn("dropped", F.lit(None).cast("int")).unionByName(gone.unionByName(before), allowMissingColumns=True))
    return out.select(order_col, *[F.when(alive, F.col(f"`{c}`")).alias(c) for c in out.columns if c not in (order_col, "dropped")], "dropped")


def run_marked(df: DataFrame, nodes: list[dict], *, order_col: str = "ord") -> DataFrame:
    """``mark_pipeline`` written once under the shared folder: what stays and what is counted are the same rows, also after a lost task."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, "marked")
    marked = mark_pipeline(df, nodes, order_col=order_col)
    marked.write.parquet(path)
    return df.sparkSession.read.schema(marked.schema).parquet(path)


def marked_report(marked: DataFrame, nodes: list[dict]) -> DataFrame:
    """Rows at the input and after each node, from the written result: one aggregate over its ``dropped`` column."""
    names = ["input"] + [n.get("node_type", "") for n in nodes]
    after = [F.count_if(F.col("dropped").isNull() | (F.col("dropped") > i)).alias(f"s{i}") for i in range(len(names))]
    counts = marked.agg(*after)
    stages = F.array(*[F.struct(F.lit(i).cast("bigint").alias("stage"), F.lit(n).alias("node_type"), F.col(f"s{i}").alias("rows")) for i, n in enumerate(names)])
    return counts.select(F.explode(stages).alias("s")).select("s.*")


def run_pipeline_observed(df: DataFrame, nodes: list[dict], *, order_col: str = "ord"
                          ) -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """The pipeline with a row count observed after the input and after every node.

    The counts are filled in by whatever single action runs the returned plan: one
    pass, but a stage that runs again counts again.  Counts that are kept come from
    ``run_marked``.
    """
    steps = [(n.get("node_type", ""),) + _resolve(n) for n in nodes]
    observed: list[tuple[str, Observation]] = []

    def watch(d: DataFrame, name: str) -> DataFrame:
        o = Observation(f"stage_{len(observed)}")
        observed.append((name, o))
        return d.observe(o, F.count(F.lit(1)).alias("rows"))

    out = watch(df, "input")
    for node_type, fn, params in steps:
        if node_type == "dedup":
            out = _unfence(out)
        out = fn(out, order_col=order_col, **params)
        if node_type in EXPENSIVE_NODES:
            out = _fence(out)
        out = watch(out, node_type)
    return _unfence(out), observed


def observed_report(spark: SparkSession, observed: list[tuple[str, Observation]]) -> DataFrame:
    """Per-stage counts of a finished observed run (one small row per node)."""
    rows = [(i, name, int(o.get["rows"])) for i, (name, o) in enumerate(observed)]
    return spark.createDataFrame(rows, "stage bigint, node_type string, rows bigint")

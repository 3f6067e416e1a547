"""DuckDB spellings of our derived tables and column helpers, for the oracle SQL.

Each CTE mirrors a derivation in ``fixtures.py``; each helper mirrors a Spark
column expression.  Regex classes are written so that RE2 and Java read them
the same way (``\\x{HH}``, ``\\p{L}``), and Python's whitespace set comes from
the same rule as on the Spark side.
"""

from __future__ import annotations

from ..functions.pii import DEFAULT_REPLACEMENT, PII_PATTERNS
from ..functions.text import DIGIT_CLASS, WORD_CLASS, WS_CLASS, duck_ws_chars
from .fixtures import (BASE_MODEL_IDS, DATASET_LINE_STATUS, ENDPOINT_STATUS_CYCLE, FILE_EXTENSIONS, LINE_STATUS,
                       ORDER_STATUS_BASE, PRIORITY_GPU, RUN_STATUS_GRID, SEGMENT_STATUS)

WS = duck_ws_chars()


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values: list) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case_map(col: str, d: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}"
                                          for k, v in d.items()) + " END"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def redact(x: str) -> str:
    out = x
    for _n, pat in PII_PATTERNS:
        out = f"regexp_replace({out}, {q(pat)}, {q(DEFAULT_REPLACEMENT)}, 'g')"
    return out


def ascii_ratio(x: str) -> str:
    return (f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE "
            f"length(regexp_replace({x}, '[^\\x{{00}}-\\x{{7F}}]', '', 'g'))::DOUBLE / length({x}) END")


def page_cleanup(x: str) -> str:
    t = f"regexp_replace({x}, {q(f'({WORD_CLASS})-' + chr(10) + f'({WORD_CLASS})')}, '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = f"regexp_replace({t}, {q(chr(10) + '{3,}')}, {q(chr(10) * 2)}, 'g')"
    t = f"regexp_replace({t}, {q(f'(?m)^{WS_CLASS}*{DIGIT_CLASS}+{WS_CLASS}*$')}, '', 'g')"
    return strip(t)


def ts_after_2024(seconds: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST({seconds} AS BIGINT)))"


def fixed4(x: str) -> str:
    return f"printf('%.4f', {x})"


def lines_of(text: str) -> str:
    return f"string_split({text}, chr(10))"


# ---------------------------------------------------------------- derived tables

DATASETS = f"""datasets_t AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, c_name AS name,
         c_name || {lst(FILE_EXTENSIONS)}[c_custkey % 6 + 1] AS original_filename,
         CAST(1024 * (1 + c_custkey % 100) AS BIGINT) AS file_size_bytes,
         {case_map('c_mktsegment', SEGMENT_STATUS)} AS status,
         {ts_after_2024('c_custkey * 60')} AS created_at
  FROM customer)"""

RUNS = f"""runs_t AS (
  SELECT o_orderkey AS id, o_custkey % 25 AS project_id,
         CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS dataset_id,
         {lst(RUN_STATUS_GRID)}[{case_map('o_orderstatus', ORDER_STATUS_BASE)} + o_orderkey % 3 + 1] AS status,
         {case_map('o_orderpriority', PRIORITY_GPU)} AS gpu_type,
         CAST(1 + o_orderkey % 4 AS INTEGER) AS gpu_count,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE o_orderkey % 5000 END AS INTEGER) AS max_steps,
         CAST(1 + o_orderkey % 3 AS INTEGER) AS num_epochs,
         CAST(1 + o_orderkey % 8 AS INTEGER) AS batch_size,
         CAST(1 + o_custkey % 4 AS INTEGER) AS gradient_accumulation_steps,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'exp' || CAST(o_custkey % 10 AS VARCHAR) END AS experiment_name,
         {lst(BASE_MODEL_IDS)}[o_custkey % 6 + 1] AS base_model,
         CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'qlora' WHEN 2 THEN 'sft' ELSE 'lora' END AS method,
         o_orderdate AS created_at
  FROM orders)"""

LINE_GROUPS = """line_g AS (
  SELECT l_orderkey, l_linenumber, min(l_discount) AS min_discount, min(l_tax) AS min_tax,
         min(l_quantity) AS min_quantity, min(l_returnflag) AS min_flag, min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

METRICS = LINE_GROUPS + """,
metrics_t AS (
  SELECT l_orderkey AS run_id, l_linenumber * 10 AS step,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE min_discount END AS loss,
         min_tax AS val_loss, min_quantity AS throughput, first_ship AS recorded_at
  FROM line_g)"""

CHECKPOINTS = LINE_GROUPS + """,
ckpt_t AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id, l_linenumber * 500 AS step,
         coalesce(l_linenumber = min(CASE WHEN min_flag = 'R' THEN l_linenumber END)
                  OVER (PARTITION BY l_orderkey), false) AS is_best,
         'checkpoints/' || CAST(l_orderkey AS VARCHAR) || '/checkpoint-' || CAST(l_linenumber * 500 AS VARCHAR) AS s3_path,
         first_ship AS created_at
  FROM line_g)"""

RUN_EVENTS = f"""rse_s AS (
  SELECT l_orderkey AS run_id,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
         l_shipdate AS ts, l_linenumber, l_partkey,
         (l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber > 3) AS failed,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber > 3 THEN 'failed'
              WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN NULL
              ELSE {lst(LINE_STATUS)}[l_linenumber] END AS status
  FROM lineitem),
rse_t AS (
  SELECT run_id, ord, ts, status,
         CASE WHEN failed THEN 'error at part ' || CAST(l_partkey AS VARCHAR) END AS error_message,
         CASE WHEN status IS NULL OR status = 'training' THEN l_linenumber * 100 END AS current_step,
         CASE WHEN l_linenumber = 3 THEN 700 END AS total_steps
  FROM rse_s)"""

DATASET_EVENTS = f"""dsu_t AS (
  SELECT o_custkey AS dataset_id,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
         l_shipdate AS ts,
         CASE WHEN l_linenumber % 2 = 1 THEN 'status' ELSE 'update' END AS kind,
         CASE WHEN l_linenumber % 2 = 1 THEN {lst(DATASET_LINE_STATUS)}[l_linenumber] END AS status,
         CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS row_count,
         CASE WHEN l_returnflag = 'R' THEN 'bad rows ' || CAST(l_partkey AS VARCHAR) END AS error_message
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MODELS = f"""models_t AS (
  SELECT p_partkey AS id, p_size % 25 AS project_id, p_name AS name, p_type AS base_model,
         p_partkey AS run_id, {ts_after_2024('p_partkey * 60')} AS created_at
  FROM part)"""

ENDPOINTS = f"""endpoints_t AS (
  SELECT s_suppkey AS id, s_suppkey * 20 AS model_id,
         {lst(ENDPOINT_STATUS_CYCLE)}[s_suppkey % 5 + 1] AS status,
         {ts_after_2024('s_suppkey * 3600')} AS created_at
  FROM supplier)"""

API_KEYS = f"""api_keys_t AS (
  SELECT s_suppkey AS endpoint_id, sha256(s_name) AS key_hash,
         CASE WHEN s_suppkey % 4 = 0 THEN {ts_after_2024('s_suppkey * 3600')} END AS revoked_at
  FROM supplier)"""

REQUESTS = """requests_t AS (
  SELECT event_id, user_id AS client, epoch_us(ts) AS us, ts, event_type,
         CASE WHEN event_type = 'click' THEN 'Bearer sk-' || lpad(CAST(user_id AS VARCHAR), 16, '0') END AS auth_header,
         CASE WHEN event_type IN ('view', 'purchase') THEN ' 10.0.' || CAST(user_id AS VARCHAR) || '.' ||
              CAST(event_id % 256 AS VARCHAR) || ' , 192.168.0.1' END AS forwarded_for,
         CASE WHEN event_type <> 'error' THEN '172.16.0.' || CAST(user_id AS VARCHAR) END AS host
  FROM events)"""

PAIRS = """pairs_t AS (
  SELECT u.conv_id, u.turn, s.text AS system, u.text AS "user", a.text AS assistant
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, text FROM conversations WHERE role = 'system' AND turn = 0) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

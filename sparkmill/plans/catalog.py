"""Registered queries: one per operator ID of the survey inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables (or
tables Spark derives from them), plus, where SQL can say the same thing, a
DuckDB oracle over the same tables.  Integer outputs are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from ..functions.fmt import iso_timestamp, sha256_hex
from ..functions.text import WS_CLASS, py_search
from ..operators import cleaning, formatting, limits, ordinal, registry, sections, tokens
from ..sources import readers, registry_store, sinks, stored
from ..sources.tables import table
from . import duck as D
from . import fixtures as FX
from . import lifecycle
from .pipeline import marked_report, run_marked, run_pipeline

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _bigint_ints(df: DataFrame) -> DataFrame:
    small = (ByteType, ShortType, IntegerType)
    if not any(isinstance(f.dataType, small) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _run(fn: QueryFn, spark: SparkSession, sf: str) -> DataFrame:
    from ..session import ship_package
    # Timestamps in the test data are zone-less; they are read as UTC instants.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return _bigint_ints(fn(spark, sf))


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf, _fn=fn: _run(_fn, spark, sf)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_DERIVED: dict[tuple[str, str, str], str] = {}


def derived_files(spark: SparkSession, name: str, sf: str, build: Callable[[], str]) -> str:
    """Files Spark derives from the tables (stream inputs, document files), built once per
    application and table folder, then shared by the queries that read them."""
    key = (spark.conf.get("spark.app.id", ""), name, sf)
    if key not in _DERIVED:
        _DERIVED[key] = build()
    return _DERIVED[key]


def docs(spark: SparkSession, sf: str, narrow: bool = False) -> DataFrame:
    """The documents table; ``narrow`` for queries whose first stage is per-row text work."""
    return table(spark, sf, "documents", narrow_work=narrow)


# ================================================================ cleaning pipeline

LICENCE_PATTERN = "licen[cs]e"
FLAGSHIP_NODES = [
    {"node_type": "dedup", "params": {"key": "text"}},
    {"node_type": "length_filter", "params": {"min_length": 20, "max_length": 100_000}},
    {"node_type": "regex_filter", "params": {"pattern": LICENCE_PATTERN, "mode": "exclude"}},
    {"node_type": "pii_redact", "params": {"fields": ["text"]}},
    {"node_type": "language_filter", "params": {"languages": ["en"]}},
]

_FLAGSHIP_SQL = D.with_(
    "d AS (SELECT doc_id, lang, text FROM documents)",
    "dd AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)",
    f"f AS (SELECT * FROM dd WHERE length(text) BETWEEN 20 AND 100000 "
    f"AND NOT regexp_matches(text, {D.q(LICENCE_PATTERN)}, 'i'))",
    f"r AS (SELECT doc_id, lang, {D.redact('text')} AS text FROM f)",
)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", "text")
    return run_pipeline(d, FLAGSHIP_NODES, order_col="doc_id")


query("run_pipeline", _FLAGSHIP_SQL + f"SELECT doc_id, lang, text FROM r WHERE {D.ascii_ratio('text')} > 0.85")(flagship)


@query("cleaning_report", D.with_(
    "d AS (SELECT doc_id, lang, text FROM documents)",
    "s1 AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)",
    "s2 AS (SELECT * FROM s1 WHERE length(text) BETWEEN 20 AND 100000)",
    f"s3 AS (SELECT * FROM s2 WHERE NOT regexp_matches(text, {D.q(LICENCE_PATTERN)}, 'i'))",
    f"s4 AS (SELECT doc_id, lang, {D.redact('text')} AS text FROM s3)",
    f"s5 AS (SELECT * FROM s4 WHERE {D.ascii_ratio('text')} > 0.85)")
    + "SELECT 0::BIGINT AS stage, 'input' AS node_type, count(*) AS rows FROM d UNION ALL "
      "SELECT 1, 'dedup', count(*) FROM s1 UNION ALL SELECT 2, 'length_filter', count(*) FROM s2 UNION ALL "
      "SELECT 3, 'regex_filter', count(*) FROM s3 UNION ALL SELECT 4, 'pii_redact', count(*) FROM s4 UNION ALL "
      "SELECT 5, 'language_filter', count(*) FROM s5")
def q_cleaning_report(spark, sf):
    # Every row is written once with the node that removed it; the counts read that column.
    marked = run_marked(docs(spark, sf).select("doc_id", "lang", "text"), FLAGSHIP_NODES, order_col="doc_id")
    return marked_report(marked, FLAGSHIP_NODES)


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, text")
def q_dedup_exact(spark, sf):
    return cleaning.dedup(docs(spark, sf).select("doc_id", "lang", "text"), order_col="doc_id").select("doc_id", "lang")


@query("dedup_by_key", "SELECT doc_id, source FROM documents "
                       "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q_dedup_by_key(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "lang", "text")
    return cleaning.dedup(d, key="text", order_col="doc_id").select("doc_id", "source")


@query("length_filter", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 5000")
def q_length_filter(spark, sf):
    return cleaning.length_filter(docs(spark, sf, narrow=True), min_length=200, max_length=5000).select("doc_id")


INCLUDE_PATTERN = "licen[cs]e|token"
EXCLUDE_PATTERN = "(mit|apache) license"


@query("regex_filter_include",
       f"SELECT doc_id FROM documents WHERE regexp_matches(text, {D.q(INCLUDE_PATTERN)}, 'i')")
def q_regex_include(spark, sf):
    return cleaning.regex_filter(docs(spark, sf, narrow=True), pattern=INCLUDE_PATTERN, mode="include").select("doc_id")


@query("regex_filter_exclude",
       f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, {D.q(EXCLUDE_PATTERN)}, 'i')")
def q_regex_exclude(spark, sf):
    return cleaning.regex_filter(docs(spark, sf, narrow=True), pattern=EXCLUDE_PATTERN, mode="exclude").select("doc_id")


# Python patterns that Java reads differently or not at all, each beside the same pattern as RE2 spells it.
_DIALECT = {"bracket": (r"[^[]b", r"[^\[]b"), "up_to": (r" er{,2}s ", r" er{0,2}s "), "named": (r"(?P<first_word>lic)(?:en|ens)", r"(?:lic)(?:en|ens)"),
            "both": (r"[&&|]\s", r"[&|]\s")}


@query("regex_python_dialect", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, {D.q(re2)}, 'i') AS {name}" for name, (_, re2) in _DIALECT.items()) + " FROM documents")
def q_regex_dialect(spark, sf):
    return docs(spark, sf, narrow=True).select("doc_id", *[py_search("text", py).alias(name) for name, (py, _) in _DIALECT.items()])


@query("language_filter_en", f"SELECT doc_id, lang FROM documents WHERE {D.ascii_ratio('text')} > 0.85")
def q_language_en(spark, sf):
    return cleaning.language_filter(docs(spark, sf, narrow=True), languages=["en"]).select("doc_id", "lang")


@query("language_filter_passthrough", "SELECT doc_id FROM documents")
def q_language_passthrough(spark, sf):
    return cleaning.language_filter(docs(spark, sf, narrow=True), languages=["fr", "de"]).select("doc_id")


@query("pii_redact", f"SELECT doc_id, {D.redact('text')} AS text FROM documents")
def q_pii(spark, sf):
    return cleaning.pii_redact(docs(spark, sf, narrow=True).select("doc_id", "text"), fields=["text"])


# ================================================================ sections

_LINES_SQL = ("SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, x AS raw FROM documents, "
              "unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i)")


@query("page_text_cleanup", f"SELECT doc_id, {D.page_cleanup('text')} AS text FROM documents")
def q_page_cleanup(spark, sf):
    return docs(spark, sf, narrow=True).select("doc_id", sections.page_text_cleanup("text").alias("text"))


def _chunk_sql(sep_regex: str, size: int) -> str:
    return f"""WITH RECURSIVE raw AS (
  SELECT doc_id, i, {D.strip('x')} AS p
  FROM documents, unnest(regexp_split_to_array(text, {D.q(sep_regex)})) WITH ORDINALITY AS t(x, i)),
paras AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pi FROM raw WHERE p <> ''),
walk(doc_id, pi, chunk, cur) AS (
  SELECT doc_id, pi, 0, length(p) FROM paras WHERE pi = 0
  UNION ALL
  SELECT w.doc_id, n.pi,
         CASE WHEN w.cur + length(n.p) > {size} THEN w.chunk + 1 ELSE w.chunk END,
         CASE WHEN w.cur + length(n.p) > {size} THEN length(n.p) ELSE w.cur + length(n.p) END
  FROM walk w JOIN paras n ON n.doc_id = w.doc_id AND n.pi = w.pi + 1),
agg AS (SELECT w.doc_id, w.chunk, string_agg(p.p, chr(10) || chr(10) ORDER BY p.pi) AS text
        FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.pi = w.pi GROUP BY w.doc_id, w.chunk)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, text, length(text) AS char_count FROM agg"""


@query("paragraph_chunk", _chunk_sql("\n" + WS_CLASS + "*\n", 1000))
def q_chunk(spark, sf):
    return sections.paragraph_chunk(docs(spark, sf, narrow=True).select("doc_id", "text"), chunk_size=1000)


_BLANK_LINE = "\n" + WS_CLASS + "*\n"


@query("parse_text", f"SELECT x.text, d.source, x.chunk, x.char_count, 'text' AS format FROM ({_chunk_sql(_BLANK_LINE, 1000)}) x "
                     "JOIN documents d ON d.doc_id = x.doc_id")
def q_parse_text(spark, sf):
    return sections.parse_text(docs(spark, sf, narrow=True)).select("text", "source", "metadata.*")


@query("paragraph_chunk_lines", _chunk_sql("\n", 200))
def q_chunk_lines(spark, sf):
    return sections.paragraph_chunk(docs(spark, sf, narrow=True).select("doc_id", "text"), chunk_size=200, separator="\n")


@query("heading_sections", f"""WITH l AS ({_LINES_SQL}),
ne AS (SELECT doc_id, {D.strip('raw')} AS line, line_no FROM l),
g AS (SELECT doc_id, line, line_no, length(line) < 20 AS is_head,
             sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp
      FROM ne WHERE line <> ''),
heads AS (SELECT doc_id, grp, line AS heading FROM g WHERE is_head),
bodies AS (SELECT doc_id, grp, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g WHERE NOT is_head
           GROUP BY doc_id, grp)
SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY b.grp) - 1 AS BIGINT) AS section,
       coalesce(h.heading, 'Document') AS heading, b.text, length(b.text) AS char_count
FROM bodies b LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.grp = b.grp""")
def q_headings(spark, sf):
    return sections.heading_sections(docs(spark, sf, narrow=True).select("doc_id", "text"))


@query("table_rows_to_text", f"""WITH l AS ({_LINES_SQL}),
f AS (SELECT doc_id, line_no, raw, contains(raw, '|') AS is_row,
             lag(contains(raw, '|'), 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_row FROM l),
r AS (SELECT doc_id, line_no, raw,
             sum(CASE WHEN is_row AND NOT prev_row THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS tbl
      FROM f WHERE TRUE QUALIFY is_row),
cells AS (SELECT doc_id, tbl, line_no,
                 array_to_string(list_transform(string_split(raw, '|'), lambda c: {D.strip('c')}), ' | ') AS row_text
          FROM r),
t AS (SELECT doc_id, tbl, string_agg(row_text, chr(10) ORDER BY line_no) AS text, count(*) AS row_count
      FROM cells GROUP BY doc_id, tbl)
SELECT doc_id, CAST(tbl - 1 AS BIGINT) AS table_index, text, row_count, length(text) AS char_count FROM t""")
def q_tables(spark, sf):
    return sections.table_rows_to_text(docs(spark, sf, narrow=True).select("doc_id", "text"))


@query("page_records", f"""WITH l AS ({_LINES_SQL}),
n AS (SELECT doc_id, count(*) AS total_pages FROM l GROUP BY doc_id)
SELECT l.doc_id, l.line_no + 1 AS page, n.total_pages, {D.page_cleanup(D.strip('l.raw'))} AS text,
       length({D.page_cleanup(D.strip('l.raw'))}) AS char_count
FROM l JOIN n ON n.doc_id = l.doc_id WHERE {D.strip('l.raw')} <> ''""")
def q_pages(spark, sf):
    pages = sections.lines_as_pages(docs(spark, sf, narrow=True), "doc_id")
    return sections.page_records(pages, "doc_id", "page", "text", total_col="total_pages")


# ================================================================ sources and sinks


@query("read_txt_lines", f"""WITH l AS ({_LINES_SQL})
SELECT doc_id, line_no, {D.strip('raw')} AS text FROM l WHERE {D.strip('raw')} <> ''""")
def q_txt_lines(spark, sf):
    return readers.text_lines(docs(spark, sf, narrow=True).select("doc_id", "text"))


def _json_lines(spark, sf) -> DataFrame:
    """JSON text from events (one object per line) mixed with document lines (not JSON)."""
    ev = table(spark, sf, "events").select(F.lit("event").alias("src"), F.col("event_id").alias("ord"),
                                           F.lit(0).cast("bigint").alias("line_no"), F.col("props").alias("line"))
    dl = docs(spark, sf, narrow=True).select(F.lit("doc").alias("src"), F.col("doc_id").alias("ord"),
                                F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return ev.unionByName(dl.withColumn("line_no", F.col("line_no").cast("bigint")))


_JSON_LINES_SQL = f"""WITH l AS (
  SELECT 'event' AS src, event_id AS ord, CAST(0 AS BIGINT) AS line_no, props AS line FROM events
  UNION ALL
  SELECT 'doc', doc_id, CAST(i - 1 AS BIGINT), x FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, i)),
s AS (SELECT src, ord, line_no, {D.strip('line')} AS s FROM l)
"""


@query("read_jsonl", _JSON_LINES_SQL +
       "SELECT src, ord, line_no, CAST(json_extract(s, '$.k') AS BIGINT) AS k FROM s "
       "WHERE starts_with(s, '{') AND json_valid(s)")
def q_read_jsonl(spark, sf):
    recs = readers.parse_json_lines(_json_lines(spark, sf))
    return readers.records_as_columns(recs, {"k": "bigint"})


@query("read_json_array_lines", """WITH l AS (
  SELECT event_id AS ord,
         CASE WHEN event_type = 'click' THEN '[' || props || ', {"e": ' || CAST(event_id AS VARCHAR) || '}]'
              ELSE props END AS line FROM events),
objs AS (
  SELECT ord, CAST(0 AS BIGINT) AS elem, line AS j FROM l WHERE starts_with(line, '{') AND json_valid(line)
  UNION ALL
  SELECT ord, CAST(i - 1 AS BIGINT), x FROM l, unnest(CAST(json_extract(line, '$[*]') AS VARCHAR[])) WITH ORDINALITY AS t(x, i)
  WHERE starts_with(line, '[') AND json_valid(line))
SELECT ord, elem, CAST(json_extract(j, '$.k') AS BIGINT) AS k, CAST(json_extract(j, '$.e') AS BIGINT) AS e
FROM objs WHERE json_type(j) = 'OBJECT'""")
def q_read_json_array_lines(spark, sf):
    ev = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "click",
                  F.concat(F.lit("["), F.col("props"), F.lit(', {"e": '), F.col("event_id").cast("string"), F.lit("}]"))
                  ).otherwise(F.col("props"))
    recs = readers.parse_json_lines(ev.select(F.col("event_id").alias("ord"), line.alias("line")), flatten_arrays=True)
    return readers.records_as_columns(recs, {"k": "bigint", "e": "bigint"}).select(
        "ord", F.col("elem").cast("bigint").alias("elem"), "k", "e")


@query("write_jsonl", "SELECT doc_id, lang, text FROM documents")
def q_write_jsonl(spark, sf):
    from ..session import scratch_path
    path = scratch_path(spark, "docs-jsonl")
    sinks.write_jsonl(docs(spark, sf, narrow=True).select("doc_id", "lang", "text"), path)
    recs = readers.read_jsonl(spark, path)
    return readers.records_as_columns(recs, {"doc_id": "bigint", "lang": "string", "text": "string"}).drop("ord")


@query("read_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents")
def q_read_csv(spark, sf):
    from ..session import scratch_path
    path = scratch_path(spark, "docs-csv")
    sinks.write_csv(docs(spark, sf, narrow=True).select("doc_id", "lang", "text"), path)
    return readers.read_csv(spark, path).drop("ord")


_CONVERT_INPUTS = ("csv", "jsonl", "json", "txt", "bin")


def _convert_inputs(spark, sf) -> dict[str, str]:
    """One upload of each format, written by Spark from the tables."""
    from ..session import scratch_path
    paths = {fmt: scratch_path(spark, f"convert-{fmt}") for fmt in _CONVERT_INPUTS}
    d = docs(spark, sf).select("doc_id", "lang", "text")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    sinks.write_csv(d, paths["csv"])
    d.select(line.alias("value")).write.text(paths["jsonl"])
    d.select(F.concat(F.lit("["), line, F.lit(', {"doc_id": null, "text": "second"}, 5]')).alias("value")).write.text(paths["json"])
    d.select("text").write.text(paths["txt"])
    # One file for each supplier: the lines of a key are one value, and every value becomes a file of one flat folder.
    lines = F.collect_list(F.coalesce("s_name", F.lit("")))  # a null name is an empty line, as the text writer has it
    names = table(spark, sf, "supplier").groupBy("s_suppkey").agg(F.array_join(lines, "\n").alias("value")).select("value")
    sinks.write_file_per_row(names, paths["bin"])
    return paths


@query("convert_format", f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT 'csv' AS format, CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents
UNION ALL SELECT 'jsonl', CAST(doc_id AS VARCHAR), lang, text FROM documents
UNION ALL SELECT 'json', CAST(doc_id AS VARCHAR), lang, text FROM documents
UNION ALL SELECT 'json', NULL, NULL, 'second' FROM documents
UNION ALL SELECT 'txt', NULL, NULL, {D.strip('raw')} FROM l WHERE {D.strip('raw')} <> ''
UNION ALL SELECT 'bin', NULL, NULL, s_name || chr(10) FROM supplier""")
def q_convert_format(spark, sf):
    fields = {"doc_id": "string", "lang": "string", "text": "string"}
    parts = [readers.records_as_columns(readers.convert_format(spark, path, fmt).select("record"), fields).select(F.lit(fmt).alias("format"), *fields)
             for fmt, path in _convert_inputs(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("convert_schema", """SELECT * FROM (VALUES ('csv', 'doc_id', 'str'), ('csv', 'lang', 'str'), ('csv', 'text', 'str'),
  ('jsonl', 'doc_id', 'int'), ('jsonl', 'lang', 'str'), ('jsonl', 'text', 'str'),
  ('json', 'doc_id', 'int'), ('json', 'lang', 'str'), ('json', 'text', 'str'), ('txt', 'text', 'str'), ('bin', 'text', 'str')) AS t(format, key, type_name)""")
def q_convert_schema(spark, sf):
    parts = [readers.first_record_schema(readers.convert_format(spark, path, fmt)).select(F.lit(fmt).alias("format"), "key", "type_name")
             for fmt, path in _convert_inputs(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("json_rejects", _JSON_LINES_SQL + """SELECT src, ord, line_no, s AS raw, CASE WHEN json_valid(s) THEN 'not_object' ELSE 'malformed' END AS reason
FROM s WHERE s <> '' AND NOT (starts_with(s, '{') AND json_valid(s))""")
def q_json_rejects(spark, sf):
    return readers.json_rejects(_json_lines(spark, sf)).select("src", "ord", "line_no", "raw", "reason")


@query("first_record_schema", """WITH f AS (SELECT to_json(struct_pack(doc_id := doc_id, lang := lang, n_chars := n_chars, text := text)) AS j
                 FROM documents ORDER BY doc_id LIMIT 1)
SELECT k AS key, CASE json_type(j, '$.' || k) WHEN 'VARCHAR' THEN 'str' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int'
  WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict'
  WHEN 'NULL' THEN 'NoneType' END AS type_name
FROM f, unnest(json_keys(j)) AS t(k)""")
def q_first_record_schema(spark, sf):
    d = docs(spark, sf, narrow=True)
    lines = d.select(F.col("doc_id").alias("ord"),
                     F.to_json(F.struct("doc_id", "lang", "n_chars", "text")).alias("line"))
    return readers.first_record_schema(readers.parse_json_lines(lines))


@query("route_by_extension", D.with_(D.DATASETS) + """SELECT id,
  CASE WHEN contains(original_filename, '.') THEN lower(split_part(original_filename, '.', -1)) ELSE 'unknown' END AS file_format,
  CASE WHEN contains(original_filename, '.') THEN original_filename[1:length(original_filename) - length(split_part(original_filename, '.', -1)) - 1]
       ELSE original_filename END AS base_name
FROM datasets_t""")
def q_route(spark, sf):
    return readers.route_by_extension(FX.datasets(spark, sf), "original_filename").select("id", "file_format", "base_name")


@query("dataset_register", D.with_(D.DATASETS) + """SELECT id, project_id,
  CASE WHEN contains(original_filename, '.') THEN original_filename[1:length(original_filename) - length(split_part(original_filename, '.', -1)) - 1]
       ELSE original_filename END AS name, original_filename,
  CASE WHEN contains(original_filename, '.') THEN lower(split_part(original_filename, '.', -1)) ELSE 'unknown' END AS file_format,
  'datasets/' || CAST(project_id AS VARCHAR) || '/' || CAST(id AS VARCHAR) || '/' || original_filename AS storage_key,
  'uploading' AS status
FROM datasets_t""")
def q_register(spark, sf):
    d = FX.datasets(spark, sf)
    return registry.dataset_register(d.select("id", "project_id", "original_filename"))


@query("registry_scan", D.with_(D.DATASETS) +
       "SELECT id, project_id, name, original_filename, file_size_bytes, status FROM datasets_t")
def q_registry_scan(spark, sf):
    return FX.datasets(spark, sf).select("id", "project_id", "name", "original_filename", "file_size_bytes", "status")


_LOOKUP = [1, 7, 320, 4000, 30001, 123456789]


@query("registry_lookup", D.with_(D.DATASETS, D.RUNS, D.CHECKPOINTS, D.MODELS, D.ENDPOINTS, D.API_KEYS) + f"""SELECT 'datasets' AS entity, id, status AS detail FROM datasets_t WHERE id IN ({', '.join(map(str, _LOOKUP))})
UNION ALL SELECT 'training_runs', id, gpu_type FROM runs_t WHERE id IN ({', '.join(map(str, _LOOKUP))})
UNION ALL SELECT 'checkpoints', id, s3_path FROM ckpt_t WHERE id IN ({', '.join(map(str, _LOOKUP))})
UNION ALL SELECT 'models', id, name FROM models_t WHERE id IN ({', '.join(map(str, _LOOKUP))})
UNION ALL SELECT 'endpoints', id, status FROM endpoints_t WHERE id IN ({', '.join(map(str, _LOOKUP))})
UNION ALL SELECT 'api_keys', endpoint_id, key_hash FROM api_keys_t WHERE endpoint_id IN ({', '.join(map(str, _LOOKUP))})""")
def q_registry_lookup(spark, sf):
    # Six whole tables are stored for lookups; each lookup reads the row groups of its ids.
    from ..session import scratch_path
    keys = FX.api_keys(spark, sf).withColumnRenamed("endpoint_id", "id")
    out = None
    for entity, df, detail in (("datasets", FX.datasets(spark, sf), "status"), ("training_runs", FX.training_runs(spark, sf), "gpu_type"),
                               ("checkpoints", FX.checkpoints(spark, sf), "s3_path"), ("models", FX.models(spark, sf), "name"),
                               ("endpoints", FX.endpoints(spark, sf), "status"), ("api_keys", keys, "key_hash")):
        path = scratch_path(spark, f"registry-{entity}")
        registry_store.write_table(df, path)
        part = registry_store.lookup(spark, path, _LOOKUP).select(F.lit(entity).alias("entity"), "id", F.col(detail).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query("list_runs_rows", D.with_(D.RUNS) + """SELECT CAST(project_id AS BIGINT) AS project_id, id, dataset_id, experiment_name, status, gpu_type, base_model, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM runs_t) WHERE rank <= 20""")
def q_list_runs_rows(spark, sf):
    page = registry.page_by_group(FX.training_runs(spark, sf), "project_id", offset=0, limit=20)
    return page.select("project_id", "id", "dataset_id", "experiment_name", "status", "gpu_type", "base_model", "rank")


@query("list_models_rows", D.with_(D.MODELS) + """SELECT CAST(project_id AS BIGINT) AS project_id, id, run_id, name, base_model, epoch_us(created_at) AS created_us, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM models_t) WHERE rank <= 50""")
def q_list_models_rows(spark, sf):
    page = registry.page_by_group(FX.models(spark, sf), "project_id", offset=0, limit=50)
    return page.select("project_id", "id", "run_id", "name", "base_model", F.unix_micros("created_at").alias("created_us"), "rank")


@query("run_detail_rows", D.with_(D.RUNS, D.CHECKPOINTS) + """SELECT r.id, r.status, c.id AS checkpoint_id, CAST(c.step AS BIGINT) AS checkpoint_step,
  c.is_best AS checkpoint_is_best, epoch_us(c.created_at) AS checkpoint_us FROM runs_t r LEFT JOIN ckpt_t c ON c.run_id = r.id""")
def q_run_detail_rows(spark, sf):
    d = registry.run_detail(FX.training_runs(spark, sf).select("id", "status"), FX.checkpoints(spark, sf))
    return d.select("id", "status", "checkpoint_id", "checkpoint_step", "checkpoint_is_best", F.unix_micros("checkpoint_created_at").alias("checkpoint_us"))


# ================================================================ registry: projections and gates


@query("estimate_cost", D.with_(D.RUNS) + f"""SELECT id, round(
  CAST(coalesce({D.case_map('gpu_type', registry.GPU_CREDITS_PER_HOUR)}, {registry.DEFAULT_GPU_CREDITS}) AS DOUBLE)
  * CASE WHEN max_steps = -1 THEN CAST(num_epochs * 2 AS DOUBLE) ELSE CAST(max_steps AS DOUBLE) / 500 END
  * CAST(gpu_count AS DOUBLE), 2) AS estimated_cost FROM runs_t""")
def q_cost(spark, sf):
    return registry.estimate_cost(FX.training_runs(spark, sf)).select("id", "estimated_cost")


@query("effective_batch_size", D.with_(D.RUNS) +
       "SELECT id, CAST(batch_size * gradient_accumulation_steps * gpu_count AS BIGINT) AS effective_batch_size FROM runs_t")
def q_batch(spark, sf):
    r = FX.training_runs(spark, sf)
    return r.select("id", registry.effective_batch_size(F.col("batch_size"), F.col("gradient_accumulation_steps"),
                                                        F.col("gpu_count")).alias("effective_batch_size"))


@query("model_register", D.with_(D.RUNS) + """SELECT id AS run_id, CAST(project_id AS BIGINT) AS project_id,
  CASE WHEN length(experiment_name) > 0 THEN experiment_name ELSE 'model' END || '-' || CAST(id AS VARCHAR)[1:8] AS name,
  base_model, coalesce(method, 'lora') AS training_method,
  'models/' || CAST(project_id AS VARCHAR) || '/' || CAST(id AS VARCHAR) || '/final' AS s3_path
FROM runs_t WHERE status = 'completed'""")
def q_model_register(spark, sf):
    return registry.model_register(FX.training_runs(spark, sf))


@query("run_config_split", D.with_(D.RUNS) + """SELECT id,
  to_json(struct_pack(base_model := base_model, method := method, lora_config := NULL)) AS model_config_json,
  to_json(struct_pack(learning_rate := NULL, scheduler := NULL, batch_size := batch_size,
     gradient_accumulation_steps := gradient_accumulation_steps, warmup_steps := NULL, weight_decay := NULL,
     max_steps := max_steps, num_epochs := num_epochs, context_length := NULL, mixed_precision := NULL,
     checkpoint_steps := NULL, max_checkpoints := NULL, resume_from_checkpoint := NULL)) AS training_config_json
FROM runs_t""")
def q_config_split(spark, sf):
    s = registry.run_config_split(FX.training_runs(spark, sf))
    opts = {"ignoreNullFields": "false"}
    return s.select("id", F.to_json("model_config", opts).alias("model_config_json"),
                    F.to_json("training_config", opts).alias("training_config_json"))


@query("resume_config", D.with_(D.RUNS, D.CHECKPOINTS) + """, latest AS (
  SELECT run_id, s3_path FROM ckpt_t
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY is_best DESC, step DESC, id DESC) = 1)
SELECT r.id, r.base_model, r.method, r.max_steps, r.num_epochs, l.s3_path AS resume_checkpoint_path
FROM runs_t r JOIN latest l ON l.run_id = r.id WHERE r.status IN ('paused', 'failed')""")
def q_resume(spark, sf):
    runs = FX.training_runs(spark, sf).filter(F.col("status").isin("paused", "failed"))
    latest = registry.latest_checkpoint(FX.checkpoints(spark, sf)).select(
        F.col("run_id").alias("id"), F.col("s3_path").alias("checkpoint_path"))
    merged = registry.resume_config(registry.run_config_split(runs, keep=["id"]).join(latest, "id"))
    return merged.select("id", "config.base_model", "config.method", "config.max_steps", "config.num_epochs",
                         "config.resume_checkpoint_path")


@query("iso_timestamps", """SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_iso FROM events""")
def q_iso(spark, sf):
    return table(spark, sf, "events").select("event_id", iso_timestamp("ts").alias("ts_iso"))


@query("client_key", D.with_(D.REQUESTS) + f"""SELECT event_id,
  CASE WHEN starts_with(coalesce(auth_header, ''), 'Bearer ') THEN substring(auth_header, 8, 13)
       WHEN coalesce(forwarded_for, '') <> '' THEN {D.strip("split_part(forwarded_for, ',', 1)")}
       ELSE coalesce(host, 'unknown') END AS client_key FROM requests_t""")
def q_client_key(spark, sf):
    r = FX.requests(spark, sf)
    return r.select("event_id", registry.client_key(F.col("auth_header"), F.col("forwarded_for"),
                                                    F.col("host")).alias("client_key"))


@query("api_key_hash", "SELECT s_suppkey AS endpoint_id, sha256(s_name) AS key_hash FROM supplier")
def q_api_key_hash(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("endpoint_id"),
                                               sha256_hex("s_name").alias("key_hash"))


@query("dataset_ready_gate", D.with_(D.RUNS, D.DATASETS) + """SELECT r.id AS run_id, r.dataset_id,
  CASE WHEN d.id IS NULL THEN 'not_found' WHEN d.status IS NOT NULL AND d.status <> 'ready' THEN 'not_ready'
       ELSE 'ok' END AS verdict
FROM runs_t r LEFT JOIN datasets_t d ON d.id = r.dataset_id""")
def q_gate(spark, sf):
    return registry.dataset_ready_gate(FX.training_runs(spark, sf), FX.datasets(spark, sf))


_ACTIONS = ["pause", "resume", "cancel"]


@query("status_transition_guard", D.with_(D.RUNS, D.ENDPOINTS) + f"""SELECT id, action, status,
  CASE action WHEN 'pause' THEN status = 'training' WHEN 'resume' THEN status = 'paused'
    WHEN 'cancel' THEN status NOT IN ('completed', 'cancelled', 'failed')
    WHEN 'stop' THEN status NOT IN ('stopped', 'failed') ELSE false END AS allowed,
  CASE WHEN CASE action WHEN 'pause' THEN status = 'training' WHEN 'resume' THEN status = 'paused'
    WHEN 'cancel' THEN status NOT IN ('completed', 'cancelled', 'failed')
    WHEN 'stop' THEN status NOT IN ('stopped', 'failed') ELSE false END THEN 'ok' ELSE 'bad_status' END AS verdict
FROM (SELECT 'run' AS kind, id, {D.lst(_ACTIONS)}[project_id % 3 + 1] AS action, status FROM runs_t
      UNION ALL SELECT 'endpoint', id, 'stop', status FROM endpoints_t)""")
def q_guard(spark, sf):
    runs = FX.training_runs(spark, sf)
    run_req = runs.select("id", F.get(F.array(*[F.lit(a) for a in _ACTIONS]), (F.col("project_id") % 3).cast("int"))
                          .alias("action"))
    eps = FX.endpoints(spark, sf)
    ep_req = eps.select("id", F.lit("stop").alias("action"))
    a = registry.status_transition_guard(run_req, runs.select("id", "status"))
    b = registry.status_transition_guard(ep_req, eps.select("id", "status"))
    return a.unionByName(b)


# ================================================================ metrics and logs


@query("metrics_step_range", D.with_(D.RUNS, D.METRICS) + """SELECT m.run_id, CAST(m.step AS BIGINT) AS step, m.loss, m.val_loss
FROM metrics_t m JOIN runs_t r ON r.id = m.run_id
WHERE m.step >= 20 + (r.id % 3) * 10 AND (r.id % 2 = 0 OR m.step <= 60)""")
def q_metric_range(spark, sf):
    runs = FX.training_runs(spark, sf)
    ranges = runs.select(F.col("id").alias("run_id"), (20 + (F.col("id") % 3) * 10).alias("from_step"),
                         F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(60)).alias("to_step"))
    m = FX.run_metrics(spark, sf)
    return registry.metrics_step_range(m, ranges).select("run_id", "step", "loss", "val_loss")


@query("run_log_lines", D.with_(D.METRICS) + f"""SELECT run_id, CAST(step AS BIGINT) AS step,
  'Step ' || CAST(step AS VARCHAR) || ' — loss: ' || {D.fixed4('loss')} ||
  CASE WHEN val_loss IS NOT NULL AND val_loss <> 0 THEN ', val_loss: ' || {D.fixed4('val_loss')} ELSE '' END AS message
FROM metrics_t WHERE loss IS NOT NULL""")
def q_log_lines(spark, sf):
    return registry.run_log_lines(FX.run_metrics(spark, sf)).select("run_id", "step", "message")


@query("run_log_rows", D.with_(D.METRICS) + f"""SELECT run_id, CAST(step AS BIGINT) AS step,
  'Step ' || CAST(step AS VARCHAR) || ' — loss: ' || {D.fixed4('loss')} ||
  CASE WHEN val_loss IS NOT NULL AND val_loss <> 0 THEN ', val_loss: ' || {D.fixed4('val_loss')} ELSE '' END AS message,
  strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM metrics_t WHERE loss IS NOT NULL""")
def q_log_rows(spark, sf):
    return registry.run_log_lines(FX.run_metrics(spark, sf))


# ================================================================ joins


#: The reference's listing default, which the SQL of the two queries repeats; the operators have no cap of their own.
ENDPOINTS_LISTED = 50


@query("resolve_endpoint", D.with_(D.ENDPOINTS, D.MODELS) + """, top AS (
  SELECT * FROM endpoints_t ORDER BY created_at DESC, id DESC LIMIT 50),
cand AS (SELECT t.id AS endpoint_id, t.model_id, t.created_at AS ts, m.name, CAST(m.id AS VARCHAR) AS mid, m.base_model
         FROM top t JOIN models_t m ON m.id = t.model_id WHERE t.status = 'running'),
keys AS (SELECT DISTINCT endpoint_id, model_id, ts, k FROM (
           SELECT endpoint_id, model_id, ts, name AS k FROM cand UNION ALL
           SELECT endpoint_id, model_id, ts, mid FROM cand UNION ALL
           SELECT endpoint_id, model_id, ts, base_model FROM cand) WHERE k IS NOT NULL),
req AS (SELECT p_partkey AS request_id,
          CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE CAST(p_partkey AS VARCHAR) END AS model
        FROM part)
SELECT request_id, model, endpoint_id, model_id FROM (
  SELECT r.request_id, r.model, k.endpoint_id, k.model_id,
         row_number() OVER (PARTITION BY r.request_id ORDER BY k.ts DESC NULLS LAST, k.endpoint_id DESC NULLS LAST) AS rn
  FROM req r LEFT JOIN keys k ON k.k = r.model) WHERE rn = 1""")
def q_resolve(spark, sf):
    p = table(spark, sf, "part")
    req = p.select(F.col("p_partkey").alias("request_id"),
                   F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
                   .otherwise(F.col("p_partkey").cast("string")).alias("model"))
    return registry.resolve_endpoint(req, FX.endpoints(spark, sf), FX.models(spark, sf), search_limit=ENDPOINTS_LISTED)


@query("model_endpoint_lookup", D.with_(D.ENDPOINTS) + """SELECT model_id, id AS endpoint_id FROM (
  SELECT * FROM endpoints_t ORDER BY created_at DESC, id DESC LIMIT 50)
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, id DESC) = 1""")
def q_model_endpoint(spark, sf):
    return registry.model_endpoint_lookup(FX.endpoints(spark, sf), search_limit=ENDPOINTS_LISTED)


@query("verify_api_key", D.with_(D.API_KEYS) + """, req AS (
  SELECT s_suppkey AS request_id, s_suppkey AS endpoint_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'wrong-' || s_name ELSE s_name END AS api_key FROM supplier)
SELECT r.request_id, r.endpoint_id, EXISTS (SELECT 1 FROM api_keys_t k WHERE k.endpoint_id = r.endpoint_id
  AND k.key_hash = sha256(r.api_key) AND k.revoked_at IS NULL) AS valid FROM req r""")
def q_verify(spark, sf):
    s = table(spark, sf, "supplier")
    req = s.select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("endpoint_id"),
                   F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("wrong-"), F.col("s_name")))
                   .otherwise(F.col("s_name")).alias("api_key"))
    return registry.verify_api_key(req, FX.api_keys(spark, sf))


@query("verify_header", D.with_(D.API_KEYS) + """, req AS (
  SELECT s_suppkey AS request_id, s_suppkey AS endpoint_id,
         CASE s_suppkey % 5 WHEN 0 THEN 'Basic ' || s_name WHEN 1 THEN 'Bearer   ' WHEN 2 THEN 'Bearer wrong' WHEN 3 THEN NULL ELSE 'Bearer  ' || s_name || ' ' END AS h
  FROM supplier)
SELECT r.request_id, r.endpoint_id, CASE WHEN h IS NULL OR NOT starts_with(h, 'Bearer ') THEN 'missing_header' WHEN trim(substr(h, 8)) = '' THEN 'missing_key'
  WHEN EXISTS (SELECT 1 FROM api_keys_t k WHERE k.endpoint_id = r.endpoint_id AND k.key_hash = sha256(trim(substr(r.h, 8))) AND k.revoked_at IS NULL)
  THEN 'ok' ELSE 'invalid' END AS verdict FROM req r""")
def q_verify_header(spark, sf):
    k, name = F.col("s_suppkey"), F.col("s_name")
    header = (F.when(k % 5 == 0, F.concat(F.lit("Basic "), name)).when(k % 5 == 1, "Bearer   ").when(k % 5 == 2, "Bearer wrong")
              .when(k % 5 == 4, F.concat(F.lit("Bearer  "), name, F.lit(" "))))
    req = table(spark, sf, "supplier").select(k.alias("request_id"), k.alias("endpoint_id"), header.alias("auth_header"))
    return registry.verify_header(req, FX.api_keys(spark, sf))


@query("run_detail", D.with_(D.RUNS, D.CHECKPOINTS) + """SELECT r.id, r.status, c.id AS checkpoint_id,
  CAST(c.step AS BIGINT) AS checkpoint_step FROM runs_t r LEFT JOIN ckpt_t c ON c.run_id = r.id""")
def q_run_detail(spark, sf):
    return registry.run_detail(FX.training_runs(spark, sf), FX.checkpoints(spark, sf)).select(
        "id", "status", "checkpoint_id", "checkpoint_step")


@query("cascade_delete", D.with_(D.RUNS, D.CHECKPOINTS) + """SELECT c.id, c.run_id, CAST(c.step AS BIGINT) AS step
FROM ckpt_t c WHERE c.run_id NOT IN (SELECT id FROM runs_t WHERE status = 'failed')""")
def q_cascade(spark, sf):
    deleted = FX.training_runs(spark, sf).filter(F.col("status") == "failed")
    return registry.cascade_delete(FX.checkpoints(spark, sf), deleted, fk="run_id").select("id", "run_id", "step")


@query("cascade_delete_metrics", D.with_(D.RUNS, D.METRICS) + """SELECT m.run_id, CAST(m.step AS BIGINT) AS step
FROM metrics_t m WHERE m.run_id NOT IN (SELECT id FROM runs_t WHERE status = 'failed')""")
def q_cascade_metrics(spark, sf):
    deleted = FX.training_runs(spark, sf).filter(F.col("status") == "failed")
    return registry.cascade_delete(FX.run_metrics(spark, sf), deleted, fk="run_id").select("run_id", "step")


@query("cascade_delete_endpoints", D.with_(D.MODELS, D.ENDPOINTS) + """SELECT e.id, e.model_id FROM endpoints_t e
WHERE e.model_id NOT IN (SELECT id FROM models_t WHERE project_id = 3)""")
def q_cascade_endpoints(spark, sf):
    deleted = FX.models(spark, sf).filter("project_id = 3")
    return registry.cascade_delete(FX.endpoints(spark, sf), deleted, fk="model_id").select("id", "model_id")


@query("delete_restrict_models", D.with_(D.RUNS, D.MODELS) + """SELECT r.id FROM runs_t r
WHERE r.status = 'completed' AND EXISTS (SELECT 1 FROM models_t m WHERE m.run_id = r.id)""")
def q_restrict_models(spark, sf):
    deleted = FX.training_runs(spark, sf).filter(F.col("status") == "completed")
    return registry.delete_restrict(deleted, FX.models(spark, sf), fk="run_id").select("id")


@query("status_check", D.with_(D.DATASETS, D.RUNS, D.ENDPOINTS) + """SELECT 'datasets' AS entity, id, status,
  status IS NULL OR status IN ('uploading', 'processing', 'cleaning', 'ready', 'failed') AS allowed FROM datasets_t
UNION ALL SELECT 'training_runs', id, status, status IS NULL OR status IN ('queued', 'provisioning', 'downloading', 'training', 'saving',
  'paused', 'completed', 'failed', 'cancelled') FROM runs_t
UNION ALL SELECT 'endpoints', id, status, status IS NULL OR status IN ('starting', 'running', 'stopping', 'stopped', 'failed') FROM endpoints_t
UNION ALL SELECT 'orders', o_orderkey, o_orderstatus, false FROM orders""")
def q_status_check(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    parts = [(FX.datasets(spark, sf), "datasets", registry.DATASET_STATUSES), (FX.training_runs(spark, sf), "training_runs", registry.RUN_STATUSES),
             (FX.endpoints(spark, sf), "endpoints", registry.ENDPOINT_STATUSES), (orders, "orders", registry.RUN_STATUSES)]
    out = None
    for df, entity, allowed in parts:
        part = df.select(F.lit(entity).alias("entity"), "id", "status", registry_store.status_allowed(F.col("status"), allowed).alias("allowed"))
        out = part if out is None else out.unionByName(part)
    return out


@query("delete_restrict", D.with_(D.RUNS, D.DATASETS) + """SELECT d.id FROM datasets_t d
WHERE d.status = 'failed' AND EXISTS (SELECT 1 FROM runs_t r WHERE r.dataset_id = d.id)""")
def q_restrict(spark, sf):
    deleted = FX.datasets(spark, sf).filter(F.col("status") == "failed")
    return registry.delete_restrict(deleted, FX.training_runs(spark, sf), fk="dataset_id").select("id")


@query("upsert_registry", D.with_(D.DATASETS) + """, changes AS (
  SELECT id, project_id, name, 'ready' AS status FROM datasets_t WHERE status = 'failed'
  UNION ALL SELECT 1000000000 + s_suppkey, CAST(s_nationkey AS BIGINT), s_name, 'uploading' FROM supplier)
SELECT id, project_id, name, status FROM datasets_t WHERE id NOT IN (SELECT id FROM changes)
UNION ALL SELECT * FROM changes""")
def q_upsert(spark, sf):
    cur = FX.datasets(spark, sf).select("id", F.col("project_id").cast("bigint").alias("project_id"), "name", "status")
    fixed = cur.filter(F.col("status") == "failed").withColumn("status", F.lit("ready"))
    s = table(spark, sf, "supplier")
    new = s.select((F.lit(1_000_000_000) + F.col("s_suppkey")).alias("id"),
                   F.col("s_nationkey").cast("bigint").alias("project_id"), F.col("s_name").alias("name"),
                   F.lit("uploading").alias("status"))
    return registry.upsert_registry(cur, fixed.unionByName(new))


# ================================================================ state folds


@query("run_current_state", D.with_(D.RUN_EVENTS) + """SELECT run_id,
  arg_max(status, ord) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(error_message, ord) FILTER (WHERE error_message IS NOT NULL) AS error_message,
  CAST(arg_max(current_step, ord) FILTER (WHERE current_step IS NOT NULL) AS BIGINT) AS current_step,
  CAST(arg_max(total_steps, ord) FILTER (WHERE total_steps IS NOT NULL) AS BIGINT) AS total_steps,
  epoch_us(min(ts) FILTER (WHERE status = 'training')) AS started_us,
  epoch_us(max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled'))) AS finished_us,
  epoch_us(max(ts)) AS updated_us
FROM rse_t GROUP BY run_id""")
def q_run_state(spark, sf):
    s = registry.run_current_state(FX.run_status_events(spark, sf))
    return s.select("run_id", "status", "error_message", "current_step", "total_steps",
                    F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"),
                    F.unix_micros("updated_at").alias("updated_us"))


@query("dataset_current_state", D.with_(D.DATASET_EVENTS) + """SELECT dataset_id,
  arg_max(status, ord) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(row_count, ord) FILTER (WHERE row_count IS NOT NULL) AS row_count,
  arg_max_null(error_message, ord) FILTER (WHERE error_message IS NOT NULL OR kind = 'status') AS error_message,
  epoch_us(max(ts)) AS updated_us
FROM dsu_t GROUP BY dataset_id""")
def q_dataset_state(spark, sf):
    s = registry.dataset_current_state(FX.dataset_updates(spark, sf))
    return s.select("dataset_id", "status", "row_count", "error_message", F.unix_micros("updated_at").alias("updated_us"))


# Changes of any field, null included: each event gives one or two fields of its user.
_CHANGES_CTE = """c AS (
  SELECT user_id, event_id, event_id % 5 AS m, 'w' || CAST(event_id % 7 AS VARCHAR) AS w, CAST(event_id % 100 AS VARCHAR) || '.25' AS cost,
         CAST(event_id % 50 AS VARCHAR) AS secs, 'e' || CAST(event_id AS VARCHAR) AS e FROM events),
given AS (
  SELECT user_id, event_id, 'worker_id' AS field, CASE WHEN m = 0 THEN w END AS value FROM c WHERE m IN (0, 3)
  UNION ALL SELECT user_id, event_id, 'cost_credits', cost FROM c WHERE m = 1
  UNION ALL SELECT user_id, event_id, 'gpu_seconds', secs FROM c WHERE m = 2
  UNION ALL SELECT user_id, event_id, 'error_message', CASE WHEN m = 3 THEN e END FROM c WHERE m IN (3, 4)),
last AS (SELECT user_id, field, value FROM given QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY event_id DESC) = 1)
"""


def _field_changes(spark, sf) -> DataFrame:
    e, text = F.col("event_id"), lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    changes = (F.when(e % 5 == 0, F.create_map(F.lit("worker_id"), F.concat(F.lit("w"), text(e % 7))))
               .when(e % 5 == 1, F.create_map(F.lit("cost_credits"), F.concat(text(e % 100), F.lit(".25"))))
               .when(e % 5 == 2, F.create_map(F.lit("gpu_seconds"), text(e % 50)))
               .when(e % 5 == 3, F.create_map(F.lit("worker_id"), none, F.lit("error_message"), F.concat(F.lit("e"), text(e))))
               .otherwise(F.create_map(F.lit("error_message"), none)))
    return table(spark, sf, "events").select("user_id", "event_id", changes.alias("changes"))


@query("open_field_fold", D.with_(_CHANGES_CTE) + "SELECT user_id, field, value FROM last")
def q_open_fold(spark, sf):
    return registry.open_fold(_field_changes(spark, sf), key="user_id", ord_col="event_id")


@query("run_field_state", D.with_(_CHANGES_CTE) + """SELECT user_id, max(value) FILTER (field = 'worker_id') AS worker_id,
  CAST(max(value) FILTER (field = 'cost_credits') AS DOUBLE) AS cost_credits, CAST(max(value) FILTER (field = 'gpu_seconds') AS BIGINT) AS gpu_seconds,
  max(value) FILTER (field = 'error_message') AS error_message FROM last GROUP BY user_id""")
def q_run_field_state(spark, sf):
    folded = registry.open_fold(_field_changes(spark, sf), key="user_id", ord_col="event_id")
    return registry.pivot_fields(folded, {"worker_id": "string", "cost_credits": "double", "gpu_seconds": "bigint", "error_message": "string"}, key="user_id")


# ================================================================ checkpoints and listings


@query("latest_checkpoint", D.with_(D.CHECKPOINTS) + """SELECT run_id, id, CAST(step AS BIGINT) AS step, is_best FROM ckpt_t
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY is_best DESC, step DESC, id DESC) = 1""")
def q_latest_ckpt(spark, sf):
    return registry.latest_checkpoint(FX.checkpoints(spark, sf)).select("run_id", "id", "step", "is_best")


@query("checkpoint_retention", D.with_(D.CHECKPOINTS) + """SELECT run_id, id, CAST(step AS BIGINT) AS step FROM ckpt_t
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC, id DESC) <= 3""")
def q_retention(spark, sf):
    return registry.checkpoint_retention(FX.checkpoints(spark, sf), 3).select("run_id", "id", "step")


@query("best_checkpoint", D.with_(D.CHECKPOINTS) + """SELECT run_id, id, CAST(step AS BIGINT) AS step FROM ckpt_t
WHERE is_best QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step, id) = 1""")
def q_best(spark, sf):
    return registry.best_checkpoint(FX.checkpoints(spark, sf)).select("run_id", "id", "step")


@query("list_checkpoints", D.with_(D.CHECKPOINTS) + """SELECT run_id, id, CAST(step AS BIGINT) AS step,
  row_number() OVER (PARTITION BY run_id ORDER BY step, id) AS rank FROM ckpt_t""")
def q_list_ckpt(spark, sf):
    c = FX.checkpoints(spark, sf)
    return registry.page_by_group(c, "run_id", ts="step", offset=0, limit=None, newest_first=False).select(
        "run_id", "id", "step", "rank")


@query("list_datasets", D.with_(D.DATASETS) + """SELECT project_id, id, rank FROM (
  SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank
  FROM datasets_t) WHERE rank <= 50""")
def q_list_datasets(spark, sf):
    return registry.page_by_group(FX.datasets(spark, sf), "project_id", offset=0, limit=50).select(
        "project_id", "id", "rank")


@query("list_training_runs", D.with_(D.RUNS) + """SELECT CAST(project_id AS BIGINT) AS project_id, id, rank FROM (
  SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank
  FROM runs_t WHERE status = 'completed') WHERE rank > 20 AND rank <= 40""")
def q_list_runs(spark, sf):
    runs = FX.training_runs(spark, sf).filter(F.col("status") == "completed")
    page, limit = 2, 20
    return registry.page_by_group(runs, "project_id", offset=(page - 1) * limit, limit=limit).select(
        "project_id", "id", "rank")


@query("list_models", D.with_(D.MODELS) + """SELECT CAST(project_id AS BIGINT) AS project_id, id, rank FROM (
  SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank
  FROM models_t) WHERE rank <= 50""")
def q_list_models(spark, sf):
    return registry.page_by_group(FX.models(spark, sf), "project_id", offset=0, limit=50).select(
        "project_id", "id", "rank")


@query("list_endpoints", D.with_(D.ENDPOINTS) + """SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank
FROM endpoints_t ORDER BY created_at DESC, id DESC LIMIT 50""")
def q_list_endpoints(spark, sf):
    return registry.page_by_group(FX.endpoints(spark, sf), None, offset=0, limit=50).select("id", "rank")


# ================================================================ rate limits

# Test-scale limits (the real 30/min never triggers on this data): 2 per 6 h, then 4 per 48 h.
W1_US, W1_MAX = 6 * 3600 * 1_000_000, 2
W2_US, W2_MAX = 48 * 3600 * 1_000_000, 4

_RL_SQL = D.with_(D.REQUESTS) + f""", m AS (
  SELECT event_id, client, us,
         count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W1_US - 1} PRECEDING AND CURRENT ROW) - 1 AS m_prior,
         min(us) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W1_US - 1} PRECEDING AND CURRENT ROW) AS m_oldest
  FROM requests_t),
h AS (
  SELECT event_id, client, us,
         count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W2_US - 1} PRECEDING AND CURRENT ROW) - 1 AS h_prior,
         min(us) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W2_US - 1} PRECEDING AND CURRENT ROW) AS h_oldest
  FROM m WHERE m_prior < {W1_MAX}),
v AS (
  SELECT event_id, 'minute' AS verdict, greatest(CAST(floor(({W1_US} - (us - m_oldest)) / 1000000) AS BIGINT), 1) AS retry_after
  FROM m WHERE m_prior >= {W1_MAX}
  UNION ALL
  SELECT event_id, CASE WHEN h_prior < {W2_MAX} THEN 'ok' ELSE 'hour' END,
         CASE WHEN h_prior >= {W2_MAX} THEN greatest(CAST(floor(({W2_US} - (us - h_oldest)) / 1000000) AS BIGINT), 1) END
  FROM h)
"""


def _two_tier(spark, sf):
    r = FX.requests(spark, sf).select("event_id", "client", "us")
    return limits.rate_limit_two_tier(r, minute_us=W1_US, per_minute=W1_MAX, hour_us=W2_US, per_hour=W2_MAX)


@query("rate_limit_window", D.with_(D.REQUESTS) + f"""SELECT event_id,
  count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W1_US - 1} PRECEDING AND CURRENT ROW) - 1 AS prior_count,
  count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {W1_US - 1} PRECEDING AND CURRENT ROW) - 1 < {W1_MAX} AS allowed
FROM requests_t""")
def q_rl_window(spark, sf):
    r = FX.requests(spark, sf).select("event_id", "client", "us")
    return limits.rate_limit_window(r, window_us=W1_US, max_requests=W1_MAX).select("event_id", "prior_count", "allowed")


# Times cut to hours, so that a client has several requests at an instant; few clients, so that windows are full.
_TIED_CTE = f"""t AS (
  SELECT event_id, client % 4 AS client, us - us % 3600000000 AS us FROM requests_t),
members AS (SELECT DISTINCT client, us FROM t),
seen AS (
  SELECT client, us, count(*) OVER w - 1 AS before, min(us) OVER w AS oldest FROM members
  WINDOW w AS (PARTITION BY client ORDER BY us RANGE BETWEEN {W1_US - 1} PRECEDING AND CURRENT ROW)),
judged AS (
  SELECT event_id, us, oldest, before + least(row_number() OVER (PARTITION BY client, us ORDER BY event_id) - 1, 1) AS prior_count
  FROM t JOIN seen USING (client, us))
"""


@query("rate_limit_ties", D.with_(D.REQUESTS, _TIED_CTE) + f"""SELECT event_id, CAST(prior_count AS BIGINT) AS prior_count, prior_count < 5 AS allowed,
  CASE WHEN prior_count >= 5 THEN greatest(CAST(floor(({W1_US} - (us - oldest)) / 1000000) AS BIGINT), 1) END AS retry_after FROM judged""")
def q_rl_ties(spark, sf):
    r = FX.requests(spark, sf).select("event_id", (F.col("client") % 4).alias("client"), (F.col("us") - F.col("us") % 3_600_000_000).alias("us"))
    return limits.rate_limit_window(r, window_us=W1_US, max_requests=5).select("event_id", "prior_count", "allowed", "retry_after")


@query("rate_limit_two_tier", _RL_SQL + "SELECT event_id, verdict FROM v")
def q_rl_two_tier(spark, sf):
    return _two_tier(spark, sf).select("event_id", "verdict")


@query("rate_limit_retry_after", _RL_SQL + "SELECT event_id, verdict, retry_after FROM v WHERE verdict <> 'ok'")
def q_rl_retry(spark, sf):
    return _two_tier(spark, sf).filter(F.col("verdict") != "ok").select("event_id", "verdict", "retry_after")


# ================================================================ formatting and tokens


@query("instruction_format", D.with_(D.PAIRS) + """SELECT conv_id, turn, system, "user", assistant FROM pairs_t
WHERE length("user") > 0 AND length(assistant) > 0""")
def q_instruction(spark, sf):
    pairs = FX.instruction_rows(spark, sf)
    return formatting.instruction_format(pairs, system_column="system", user_column="user",
                                         assistant_column="assistant", keep=["conv_id", "turn"])


@query("chat_template_render", D.with_(D.PAIRS) + """SELECT conv_id, turn,
  concat_ws(chr(10), CASE WHEN system IS NOT NULL THEN '<|system|>' || chr(10) || system END,
            '<|user|>' || chr(10) || "user", '<|assistant|>' || chr(10) || assistant || '<|end|>') AS text
FROM pairs_t WHERE length("user") > 0 AND length(assistant) > 0""")
def q_render(spark, sf):
    rows = formatting.instruction_format(FX.instruction_rows(spark, sf), system_column="system",
                                         user_column="user", assistant_column="assistant", keep=["conv_id", "turn"])
    return formatting.chat_template_render(rows, keep=["conv_id", "turn"])


@query("token_estimate_dataset", """SELECT CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS total_chars,
  CAST(floor((sum(length(text)) + count(*) - 1) / 4) AS BIGINT) AS est_tokens FROM documents""")
def q_tok_dataset(spark, sf):
    return tokens.token_estimate_dataset(docs(spark, sf), "text")


@query("token_estimate_values", D.with_(D.PAIRS) + """SELECT CAST(sum(coalesce(floor(length(system) / 4), 0)
  + floor(length("user") / 4) + floor(length(assistant) / 4)) AS BIGINT) AS est_tokens
FROM pairs_t WHERE length("user") > 0 AND length(assistant) > 0""")
def q_tok_values(spark, sf):
    rows = formatting.instruction_format(FX.instruction_rows(spark, sf), system_column="system",
                                         user_column="user", assistant_column="assistant")
    return tokens.token_estimate_values(rows, ["system", "user", "assistant"])


@query("token_count_bpe")
def q_tok_bpe(spark, sf):
    rows = formatting.instruction_format(FX.instruction_rows(spark, sf), system_column="system",
                                         user_column="user", assistant_column="assistant")
    return tokens.token_count_bpe(rows, ["system", "user", "assistant"], encoder="byte_bpe_50k")


# ================================================================ packing and preview


@query("sequence_packing", """WITH t AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n_tokens FROM documents),
c AS (SELECT doc_id, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS token_end FROM t)
SELECT doc_id, n_tokens, token_end - n_tokens AS token_start, token_end,
  CAST(floor((token_end - n_tokens) / 2048) AS BIGINT) AS first_pack,
  CAST(CASE WHEN n_tokens > 0 THEN floor((token_end - 1) / 2048) ELSE floor((token_end - n_tokens) / 2048) END AS BIGINT) AS last_pack
FROM c""")
def q_packing(spark, sf):
    d = docs(spark, sf).select("doc_id", tokens.value_estimate("text").alias("n_tokens"))
    return ordinal.sequence_packing(d, "doc_id", "n_tokens", context_length=2048).select(
        "doc_id", "n_tokens", "token_start", "token_end", "first_pack", "last_pack")


@query("pack_summary", """WITH t AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n_tokens FROM documents),
c AS (SELECT doc_id, n_tokens, sum(n_tokens) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS s FROM t WHERE TRUE),
seg AS (SELECT s, s + n_tokens AS e, p FROM c, range(CAST(floor(s / 2048) AS BIGINT), CAST(floor((s + n_tokens - 1) / 2048) AS BIGINT) + 1) r(p)
        WHERE n_tokens > 0)
SELECT p AS pack_id, CAST(sum(least(e, (p + 1) * 2048) - greatest(s, p * 2048)) AS BIGINT) AS n_tokens,
       count(*) AS n_segments FROM seg GROUP BY p""")
def q_pack_summary(spark, sf):
    d = docs(spark, sf).select("doc_id", tokens.value_estimate("text").alias("n_tokens"))
    packed = ordinal.sequence_packing(d, "doc_id", "n_tokens", context_length=2048)
    return ordinal.pack_summary(packed, "n_tokens", context_length=2048)


PREVIEW_PAGE, PREVIEW_SIZE = 2, 50


@query("preview_page", _FLAGSHIP_SQL + f""", cleaned AS (SELECT doc_id FROM r WHERE {D.ascii_ratio('text')} > 0.85),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_ord, count(*) OVER () AS total FROM cleaned)
SELECT row_ord, doc_id, total FROM o WHERE row_ord >= {(PREVIEW_PAGE - 1) * PREVIEW_SIZE} AND row_ord < {PREVIEW_PAGE * PREVIEW_SIZE}""")
def q_preview(spark, sf):
    # As in the reference, the preview reads the stored (cleaned) dataset: the
    # pipeline output is written once to the shared folder, then paged.
    from ..session import scratch_path
    path = scratch_path(spark, "cleaned")
    flagship(spark, sf).write.parquet(path)
    cleaned = spark.read.parquet(path).select("doc_id")
    return ordinal.preview_page(cleaned, "doc_id", page=PREVIEW_PAGE, page_size=PREVIEW_SIZE)


@query("preview_rows", f"""WITH o AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_ord, count(*) OVER () AS total FROM documents)
SELECT row_ord, doc_id, lang, text, total FROM o WHERE row_ord >= {(PREVIEW_PAGE + 1) * PREVIEW_SIZE} AND row_ord < {(PREVIEW_PAGE + 2) * PREVIEW_SIZE}""")
def q_preview_rows(spark, sf):
    # A page in the middle of a stored dataset: whole rows, from the files the page overlaps.
    from ..session import scratch_path
    path = scratch_path(spark, "preview-rows")
    d = docs(spark, sf).select("doc_id", "lang", "text").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    stored.write_dataset(d.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("line")), path)
    page = stored.preview_page(spark, path, page=PREVIEW_PAGE + 2, page_size=PREVIEW_SIZE)
    row = F.from_json("line", "doc_id bigint, lang string, text string")
    return page.select("row_ord", row.alias("r"), "total").select("row_ord", "r.*", "total")


# ================================================================ the flows: ingest, clean, format


@query("ingest", _JSON_LINES_SQL + "SELECT s AS line FROM s WHERE starts_with(s, '{') AND json_valid(s)")
def q_ingest(spark, sf):
    # Untouched records are stored byte for byte.
    from ..session import scratch_path
    src, dest = scratch_path(spark, "upload"), scratch_path(spark, "ingested")
    _json_lines(spark, sf).select(F.col("line").alias("value")).write.text(src)
    lifecycle.ingest(spark, src, "jsonl", dest)
    return readers.read_lines(spark, dest).select("line")


@query("ingest_stats", _JSON_LINES_SQL + """SELECT count(*) FILTER (starts_with(s, '{') AND json_valid(s)) AS row_count,
  count(*) FILTER (s <> '' AND NOT (starts_with(s, '{') AND json_valid(s))) AS rejected_lines FROM s""")
def q_ingest_stats(spark, sf):
    from ..session import scratch_path
    src, dest = scratch_path(spark, "upload"), scratch_path(spark, "ingested")
    _json_lines(spark, sf).select(F.col("line").alias("value")).write.text(src)
    return lifecycle.ingest(spark, src, "jsonl", dest).select("row_count", "rejected_lines")


def _stored_docs(spark, sf) -> str:
    from ..session import scratch_path
    src = scratch_path(spark, "stored-docs")
    d = docs(spark, sf).select("doc_id", "lang", "text").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    sinks.write_jsonl(d, src)
    return src


@query("clean", _FLAGSHIP_SQL + f"SELECT doc_id, lang, text FROM r WHERE {D.ascii_ratio('text')} > 0.85")
def q_clean(spark, sf):
    from ..session import scratch_path
    dest = scratch_path(spark, "cleaned-jsonl")
    lifecycle.clean(spark, _stored_docs(spark, sf), FLAGSHIP_NODES, dest)
    return readers.records_as_columns(readers.read_jsonl(spark, dest), {"doc_id": "bigint", "lang": "string", "text": "string"}).drop("ord")


@query("format_dataset", """SELECT lang AS system, text AS "user", CAST(doc_id AS VARCHAR) AS assistant FROM documents WHERE text <> ''""")
def q_format_dataset(spark, sf):
    from ..session import scratch_path
    dest = scratch_path(spark, "formatted")
    lifecycle.format_dataset(spark, _stored_docs(spark, sf), dest, user_column="text", assistant_column="doc_id", system_column="lang")
    return readers.records_as_columns(readers.read_jsonl(spark, dest), {"system": "string", "user": "string", "assistant": "string"}).drop("ord")


# ================================================================ streaming
# Inputs are written by Spark from the tables into the shared scratch folder
# as several files; streams read them one file per micro-batch.

from ..streaming import cleaning as stream_cleaning  # noqa: E402
from ..streaming import limiter as stream_limiter  # noqa: E402
from ..streaming import metrics as stream_metrics  # noqa: E402
from ..streaming.runner import parallel_files, read_stream, run_append, write_stream_files  # noqa: E402


def _envelopes(metrics: DataFrame) -> DataFrame:
    """Published messages: log/evaluation JSON, plus a plain-text note where a step logged no loss."""
    note = F.concat(F.lit("step "), F.col("step").cast("string"), F.lit(" produced no loss"))
    return stream_metrics.publish(metrics, [*stream_metrics.message_columns(metrics), F.when(
        F.col("loss").isNull(), stream_metrics.message(F.col("step") * 2 + 1000, note))])


def _metric_stream(spark, sf) -> DataFrame:
    def build():
        m = FX.run_metrics(spark, sf).select("run_id", "step", "loss", "val_loss", "throughput").withColumn(
            "total_steps", F.when(F.col("run_id") % 2 == 0, F.lit(70)).otherwise(F.lit(0)))
        return write_stream_files(m, "metric-msgs", batches=5, files_per_batch=parallel_files(spark), key=["run_id", "step"], made=_envelopes)

    path = derived_files(spark, "metric-msgs", sf, build)
    return stream_metrics.parse_messages(read_stream(spark, path, stream_metrics.ENVELOPE_SCHEMA, files_per_trigger=parallel_files(spark)))


_MSG_SQL = D.with_(D.METRICS) + """, msgs AS (
  SELECT 'training:' || CAST(run_id AS VARCHAR) || ':metrics' AS channel, CAST(step * 2 AS BIGINT) AS seq, 'log' AS kind,
         run_id, CAST(step AS BIGINT) AS step, loss, CAST(NULL AS DOUBLE) AS val_loss FROM metrics_t
  UNION ALL
  SELECT 'training:' || CAST(run_id AS VARCHAR) || ':metrics', CAST(step * 2 + 1 AS BIGINT), 'evaluation',
         run_id, CAST(step AS BIGINT), NULL, val_loss FROM metrics_t WHERE val_loss IS NOT NULL
  UNION ALL
  SELECT 'training:' || CAST(run_id AS VARCHAR) || ':metrics', CAST(step * 2 + 1000 AS BIGINT), 'text',
         NULL, NULL, NULL, NULL FROM metrics_t WHERE loss IS NULL)
"""


@query("metric_stream", _MSG_SQL + "SELECT channel, seq, kind, run_id, step, loss, val_loss FROM msgs")
def q_metric_stream(spark, sf):
    out = run_append(_metric_stream(spark, sf), "metric-stream-out")
    return out.select("channel", "seq", "kind", "run_id", "step", "loss", "val_loss")


@query("metric_stream_per_run", D.with_(D.RUNS) + "," + _MSG_SQL.removeprefix("WITH ") + """SELECT r.id AS subscriber, m.seq, m.kind
FROM msgs m JOIN runs_t r ON m.channel = 'training:' || CAST(r.id AS VARCHAR) || ':metrics'""")
def q_metric_per_run(spark, sf):
    # Every run has a watcher; each sees exactly its own channel, text messages included.
    subs = FX.training_runs(spark, sf).select(F.col("id").cast("bigint").alias("subscriber"))
    sent = _metric_stream(spark, sf).select(stream_metrics.run_of(F.col("channel")).alias("subscriber"), "seq", "kind")
    # Stream-static equi-join by the run that the channel names; the runs are shuffled, never broadcast whole through the driver.
    routed = sent.join(subs.hint("merge"), "subscriber")
    return run_append(routed.select("subscriber", "seq", "kind"), "metric-per-run-out")


@query("metric_sink", D.with_(D.METRICS) + "SELECT run_id, CAST(step AS BIGINT) AS step, loss FROM metrics_t")
def q_metric_sink(spark, sf):
    out = stream_metrics.persist_log_metrics(_metric_stream(spark, sf), "metric-sink")
    return spark.read.parquet(out).select("run_id", "step", "loss")


@query("run_progress_stream", D.with_(D.METRICS) + """SELECT run_id, CAST(max(step) AS BIGINT) AS current_step,
  CAST(CASE WHEN run_id % 2 = 0 THEN 70 END AS BIGINT) AS total_steps FROM metrics_t GROUP BY run_id""")
def q_run_progress(spark, sf):
    return stream_metrics.run_progress(_metric_stream(spark, sf), "run-progress").select(
        "run_id", "current_step", "total_steps")


def _controls(spark, sf) -> DataFrame:
    runs = FX.training_runs(spark, sf).filter(F.col("status").isin("training", "paused", "cancelled"))
    first = runs.select(F.col("id").alias("run_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("pause").alias("action"))
    second = runs.filter(F.col("status") != "paused").select(
        F.col("id").alias("run_id"), F.lit(2).cast("bigint").alias("seq"),
        F.when(F.col("status") == "cancelled", "cancel").otherwise("resume").alias("action"))
    both = first.unionByName(second)
    return both.withColumn("ts", F.timestamp_seconds(F.lit(FX.EPOCH_2024) + F.col("run_id") * 10 + F.col("seq")))


@query("control_events", D.with_(D.RUNS) + """SELECT id AS run_id,
  CASE status WHEN 'training' THEN 'training' WHEN 'paused' THEN 'paused' ELSE 'cancelled' END AS status
FROM runs_t WHERE status IN ('training', 'paused', 'cancelled')""")
def q_control(spark, sf):
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType
    schema = StructType([StructField("run_id", LongType()), StructField("seq", LongType()),
                         StructField("action", StringType()), StructField("ts", TimestampType())])
    path = write_stream_files(_controls(spark, sf), "controls", batches=2, order_col="seq", in_order=True)
    state = stream_metrics.control_state_stream(read_stream(spark, path, schema), "control-state")
    return state.select("run_id", "status")


@query("rate_limit_stream", _RL_SQL + "SELECT event_id, verdict, retry_after FROM v")
def q_rl_stream(spark, sf):
    from pyspark.sql.types import LongType, StructField, StructType
    r = FX.requests(spark, sf).select("event_id", "client", "us")
    schema = StructType([StructField("event_id", LongType()), StructField("client", LongType()),
                         StructField("us", LongType())])
    # Requests arrive up to eight minutes late, each by its own delay.
    late = F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(480)) * 1_000_000
    arrived = stream_limiter.with_heartbeat(r).withColumn("arrived", F.when(F.col("event_id").isNull(), F.col("us")).otherwise(late))
    path = write_stream_files(arrived, "requests", batches=5, order_col="arrived", in_order=True)
    s = stream_limiter.rate_limit_stream(read_stream(spark, path, schema), minute_us=W1_US, per_minute=W1_MAX,
                                         hour_us=W2_US, per_hour=W2_MAX)
    return run_append(s, "rate-limit-out", conf=stream_limiter.QUERY_CONF).select("event_id", "verdict", "retry_after")


@query("cleaning_stream", _FLAGSHIP_SQL + f"SELECT doc_id, text FROM r WHERE {D.ascii_ratio('text')} > 0.85")
def q_cleaning_stream(spark, sf):
    # Copies arrive out of order (a document is late by up to 1,000 places); the smallest doc_id of each text stays all the same.
    d = docs(spark, sf).select("doc_id", "lang", "text", F.timestamp_millis("doc_id").alias("ts"))
    end = d.agg(F.max("ts").alias("ts")).filter("ts is not null").select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("lang"),
                                                 F.lit("").alias("text"), (F.col("ts") + F.expr("interval 40000 days")).alias("ts"))
    arrived = d.withColumn("at", F.col("doc_id") + F.pmod(F.xxhash64("doc_id"), F.lit(1000))).unionByName(
        end.withColumn("at", F.lit((1 << 62) - 1).cast("bigint")))  # the last record moves the watermark behind all others
    path = write_stream_files(arrived, "docs-stream", batches=5, order_col="at", in_order=True)
    stream = read_stream(spark, path, arrived.schema).drop("at")
    out = stream_cleaning.run_stream_pipeline(stream, FLAGSHIP_NODES, order_col="doc_id", event_time="ts", within="20000 days", lateness="10 seconds")
    return run_append(out, "cleaning-stream-out", conf=stream_limiter.QUERY_CONF).select("doc_id", "text")


# ================================================================ whole files and inventories


#: Documents of a file at most, and bytes above which a document is long.  A file holds no more than their
#: product (1 GB) or one document, however large its source is, so its whole-file value stays below Spark's limit.
DOCS_PER_FILE, LONG_DOC = 10_000, 100_000


def _docs_as_files(spark, sf) -> str:
    """Spark writes the documents as text files: a folder per source, in it the files of every task that holds some of it."""
    from ..session import scratch_path

    def build():
        path = scratch_path(spark, "doc-files")
        d, size = docs(spark, sf).select("source", "text"), F.coalesce(F.octet_length("text"), F.lit(0))

        def write(some, most):
            some.write.mode("append").partitionBy("source").option("maxRecordsPerFile", most).option("lineSep", "\n").text(path)

        write(d.filter(size <= LONG_DOC), DOCS_PER_FILE)
        longest = d.agg(F.max(size)).first()[0] or 0
        if longest > LONG_DOC:
            write(d.filter(size > LONG_DOC), max(1, DOCS_PER_FILE * LONG_DOC // longest))
        return path
    return derived_files(spark, "doc-files", sf, build)


def _source_of_path(c: str) -> F.Column:
    return F.regexp_extract(F.col(c), r"/source=([^/]+)/", 1)


@query("read_whole_text", "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars "
                          "FROM documents GROUP BY source")
def q_whole_text(spark, sf):
    whole = readers.read_whole_text(spark, _docs_as_files(spark, sf), with_path=True)
    # A file holds its source's documents, each followed by the writer's line separator.
    return whole.groupBy(_source_of_path("path").alias("source")).agg(
        F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("read_document_text", "SELECT source, CAST(sum(length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) + 1) "
                             "AS BIGINT) AS n_chars FROM documents GROUP BY source")
def q_document_text(spark, sf):
    d = readers.read_document_text(spark, _docs_as_files(spark, sf), with_path=True)
    return d.groupBy(_source_of_path("path").alias("source")).agg(
        F.sum(F.length("content")).cast("bigint").alias("n_chars"))


@query("artifact_inventory", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def q_inventory(spark, sf):
    inv = readers.artifact_inventory(spark, _docs_as_files(spark, sf))
    return inv.groupBy(F.regexp_extract("relative_path", r"^source=([^/]+)/", 1).alias("source")).agg(
        F.sum("size").cast("bigint").alias("n_bytes"))


@query("resume_checkpoint", D.with_(D.RUNS, D.CHECKPOINTS) + """SELECT r.id AS run_id, c.s3_path AS resume_from FROM runs_t r
LEFT JOIN (SELECT run_id, s3_path FROM ckpt_t
           QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY is_best DESC, step DESC, id DESC) = 1) c
  ON c.run_id = r.id
WHERE r.status = 'paused'""")
def q_resume_ckpt(spark, sf):
    paused = FX.training_runs(spark, sf).filter(F.col("status") == "paused").select(F.col("id").alias("run_id"))
    latest = registry.latest_checkpoint(FX.checkpoints(spark, sf)).select("run_id", F.col("s3_path").alias("resume_from"))
    return paused.join(latest, "run_id", "left")


@query("row_count", _FLAGSHIP_SQL + f"SELECT count(*) AS row_count FROM r WHERE {D.ascii_ratio('text')} > 0.85")
def q_row_count(spark, sf):
    return flagship(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))

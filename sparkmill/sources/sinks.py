"""Writers: JSONL and CSV.  Spark writes a directory of part files per path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

#: Tasks that create the files of ``write_file_per_row``; a task creates a million at most (Spark's limit).
FILE_TASKS = 96


def derived_key(key: str, suffix: str = "") -> str:
    """``x.csv`` → ``x{suffix}.jsonl`` (text before the last dot, as the reference names outputs)."""
    base = key.rsplit(".", 1)[0]
    return f"{base}{suffix}.jsonl"


def to_json_line(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """One JSON object per row; a single VARIANT column is written as is.

    ``keep_nulls`` writes null fields as ``null``; otherwise they are left out
    (for records whose keys are optional, like an absent system prompt).
    """
    fields = df.schema.fields
    if len(fields) == 1 and isinstance(fields[0].dataType, VariantType):
        return df.select(F.to_json(F.col(fields[0].name)).alias("value"))
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", keep_nulls: bool = True) -> None:
    """Write JSONL.  Never point ``path`` at the input being read."""
    to_json_line(df, keep_nulls).write.mode(mode).option("lineSep", "\n").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV with doubled quotes; values keep their surrounding blanks."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(path))


def write_file_per_row(df: DataFrame, path: str, value_col: str = "value") -> None:
    """Every row as a text file of its own, all in one folder.

    The rows are spread first, since creating a file takes longer than the row: without
    it small rows would all be in one task.  Each task moves its files to the folder itself (the
    committer's second algorithm), where the driver would move them one by one.
    """
    spread = df.select(F.col(value_col).alias("value")).repartition(FILE_TASKS, F.xxhash64(value_col))
    (spread.write.option("maxRecordsPerFile", 1).option("lineSep", "\n")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))

"""Where a corpus lies, and how the result of one request is printed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Rows that one printed result may have.
MAX_PRINTED = 10_000


def first_folder(spark: SparkSession, candidates: list[str]) -> str:
    """The first of some folders that exists, in any store that Spark reads; an error where none does."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for candidate in candidates:
        path = hadoop.Path(candidate)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path) and files.getFileStatus(path).isDirectory():
            return candidate
    raise FileNotFoundError(f"none of these folders exists: {', '.join(candidates)}")


def printed(rows: DataFrame) -> str:
    """The result of one request, as an indented JSON array with a line end; nulls stay. More than MAX_PRINTED rows are an error: such results are written."""
    found = rows.limit(MAX_PRINTED + 1).collect()
    if len(found) > MAX_PRINTED:
        raise ValueError(f"more than {MAX_PRINTED} rows to print")
    return json.dumps([r.asDict(recursive=True) for r in found], indent=2, ensure_ascii=False) + "\n"


def without_keys(value, *names: str):
    """A parsed JSON value without the fields of some names, at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(v, *names) for k, v in value.items() if k not in names}
    if isinstance(value, list):
        return [without_keys(v, *names) for v in value]
    return value

"""The parser and the tools as table functions that SQL can call by name; inputs are checked when a query is analyzed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import markup
from ..operators.resolve import flag_index

#: Tools as SQL: name, parameters, columns, and what they return over the views `glossa_records` and `glossa_flags`.
SQL_TOOLS = {
    "glossa_describe": ("category STRING, id STRING", "display STRING, markdown STRING", "SELECT r.display, r.markdown FROM glossa_records r WHERE r.category = glossa_describe.category AND r.id = glossa_describe.id"),
    "glossa_option": (
        "raw STRING", "id STRING, display STRING, negated BOOLEAN",
        # As written first; without a leading no only where that finds nothing.
        """SELECT max_by(t.id, t.pri), max_by(t.display, t.pri), max_by(t.pri = 0, t.pri) FROM (
            SELECT r.id, r.display, 1 AS pri FROM glossa_records r WHERE r.category = 'option' AND r.id = lower(replace(trim(glossa_option.raw), '_', ''))
            UNION ALL SELECT r.id, r.display, 0 FROM glossa_records r WHERE r.category = 'option' AND concat('no', r.id) = lower(replace(trim(glossa_option.raw), '_', ''))) t""",
    ),
    "glossa_flag": ("flag STRING", "id STRING", "SELECT f.id FROM glossa_flags f WHERE f.flag = glossa_flag.flag"),
}


def _schema() -> StructType:
    """The entries' columns; made without a session, which the process that analyzes does not have."""
    token = ArrayType(StructType().add("kind", StringType()).add("text", StringType()))
    kinds = {"string": StringType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType(), markup.TOKENS: token}
    columns = [f.split(" ", 1) for f in markup.SCHEMA.replace(markup.TOKENS, "tokens").split(", ")]
    out = StructType()
    for name, kind in columns:
        out = out.add(name, kinds[markup.TOKENS if kind == "tokens" else kind])
    return out


class Entries:
    """`SELECT * FROM glossa_entries(TABLE(files))`: the entries of manual files; the table has `file` and `value`, and may have `manual`, all texts."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("glossa_entries takes a table: glossa_entries(TABLE(...))")
        kinds = {f.name: f.dataType for f in files.dataType.fields}
        for name in ("file", "value"):
            if name not in kinds:
                raise ValueError(f"glossa_entries needs a column {name}")
        for name in ("manual", "file", "value"):
            if name in kinds and not isinstance(kinds[name], StringType):
                raise ValueError(f"glossa_entries takes {name} as text, not {kinds[name].simpleString()}")
        return AnalyzeResult(_schema())

    def eval(self, row) -> Iterator[tuple]:
        given = row.asDict()
        for e in markup.entries_of(given["file"], given["value"] or "", given.get("manual") or ""):
            tokens = {c: None if e[c] is None else [{"kind": k, "text": t} for k, t in e[c]] for c in ("header_tokens", "body_tokens")}
            yield tuple((e | tokens).values())


def register(spark: SparkSession, records: DataFrame | None = None, flags: DataFrame | None = None) -> list[str]:
    """Register the functions in a session; the names that SQL may call. records: (category, id, display, markdown); flags: (id, flags) of the options."""
    spark.udtf.register("glossa_entries", udtf(Entries))
    names = ["glossa_entries"]
    if records is not None:
        records.select("category", "id", "display", "markdown").createOrReplaceTempView("glossa_records")
        empty = spark.createDataFrame([], "flag string, id string")
        (empty if flags is None else flag_index(flags).selectExpr("concat(on, char) AS flag", "id")).createOrReplaceTempView("glossa_flags")
        for name, (takes, gives, body) in SQL_TOOLS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({gives}) RETURN {body}")
            names.append(name)
    return names

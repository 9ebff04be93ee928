"""Named tools over a corpus, each from a table of inputs to a table of results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import corpus as C
from ..operators import resolve as R
from ..operators import search as S


@dataclass(frozen=True)
class Tool:
    """A tool's name, what it says of itself, the columns its inputs need, and what it does with (inputs, corpus, dim)."""

    name: str
    brief: str
    inputs: str
    run: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

    def __call__(self, inputs: DataFrame, corpus: DataFrame, dim: DataFrame) -> DataFrame:
        need = {f.split(" ")[0] for f in self.inputs.split(", ")}
        if missing := need - set(inputs.columns):
            raise ValueError(f"{self.name} needs {sorted(missing)}")
        return self.run(inputs, corpus, dim)


def _lookup(inputs: DataFrame, corpus: DataFrame, dim: DataFrame) -> DataFrame:
    return R.lookup_negated(inputs, corpus.where("category = 'option'").select("id", "display"))


def _search(inputs: DataFrame, corpus: DataFrame, dim: DataFrame) -> DataFrame:
    limit = F.least(F.greatest(F.floor(F.coalesce(F.col("limit"), F.lit(S.DEFAULT_LIMIT))), F.lit(1)), F.lit(S.MAX_LIMIT))
    asked = inputs.select("query_id", F.coalesce("query", F.lit("")).alias("query"), limit.alias("limit"))
    return S.search_many(C.pool(corpus, dim), asked)


TOOLS = {
    t.name: t
    for t in (
        Tool("classify", "Which category a raw token belongs to.", "raw string", R.classify),
        Tool("lookup_option", "An option by any spelling, negated or not.", "raw string", _lookup),
        Tool("search", "Names by equality, beginning, and likeness.", "query_id int, query string, limit double", _search),
        Tool("describe", "A record's markdown by category and id.", "category string, id string", lambda inputs, corpus, dim: R.describe(inputs, corpus)),
        Tool("info", "Counts by category.", "", lambda inputs, corpus, dim: C.info(corpus, dim)),
    )
}


def dispatch(name: str, inputs: DataFrame, corpus: DataFrame, dim: DataFrame) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    tool = TOOLS[name]
    return tool.run(inputs, corpus, dim) if not tool.inputs else tool(inputs, corpus, dim)


def definitions() -> list[dict]:
    """The tools' metadata, without what they do."""
    return [{"name": t.name, "brief": t.brief, "input": StructType.fromDDL(t.inputs).jsonValue() if t.inputs else {}} for t in TOOLS.values()]

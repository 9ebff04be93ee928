"""Resolving tokens to records: classify, look up, describe, and the resolvers they share.

Tokens are the large side. The corpus is a manual's index; its size is checked by the planner, which broadcasts it
below spark.sql.autoBroadcastJoinThreshold and shuffles both sides by key above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def resolve_prefix(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(tokens.*, sig): redirections by the longest operator that starts the token, then by what follows it.

    groups: (sig, group_op); what a signature has after its operator is the kind of tail it takes: number, word, - or p. A theta join on prefixes is an equi-join here: each distinct token probes with its prefixes, up
    to the operators' greatest length.
    """
    ops = groups.groupBy("group_op").agg(F.collect_list(F.struct("sig", F.ltrim(F.expr("substring(sig, length(group_op) + 1)")).alias("kind"))).alias("docs"))
    longest = F.broadcast(groups.agg(F.max(F.length("group_op")).alias("_longest")))  # one row
    asked = tokens.select(F.col("raw").alias("_raw")).where("_raw IS NOT NULL").distinct().withColumn("_body", X.without_fd("_raw")).where(F.length("_body") > 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.col("_longest"), F.length("_body"))), lambda n: F.substring("_body", F.lit(1), n))
    hit = asked.crossJoin(longest).where("_longest > 0").select("_raw", "_body", F.explode(prefixes).alias("group_op")).join(ops, "group_op")
    best = hit.groupBy("_raw").agg(F.max_by(F.struct("_body", "group_op", "docs"), F.length("group_op")).alias("b"))
    rest = X.tail_kind(F.expr("substring(b._body, length(b.group_op) + 1)"))
    same = F.filter("b.docs", lambda d: d["kind"] == F.col("_rest"))
    best = best.withColumn("_rest", rest).select("_raw", F.when(F.size("b.docs") == 1, F.col("b.docs")[0]["sig"]).when(F.size(same) == 1, F.get(same, F.lit(0))["sig"]).alias("sig"))
    return tokens.join(best, tokens["raw"] == best["_raw"], "left").drop("_raw")


def resolve(tokens: DataFrame, corpus: DataFrame) -> DataFrame:
    """(tokens.*, id): each token (category, raw) in its own category, by the keys it may have there; distinct tokens are resolved once.

    Options may lack a leading no that the token has; redirections go by operator and tail where the corpus has `group_op`.
    """
    asked = tokens.select(F.col("category").alias("_category"), F.col("raw").alias("_raw")).where("_category IS NOT NULL AND _raw IS NOT NULL").distinct()
    by_op = "group_op" in corpus.columns
    plain = asked.where(F.col("_category") != "redir") if by_op else asked
    keys = plain.select("_category", "_raw", F.explode(X.candidate_keys("_category", "_raw")).alias("k")).select("_category", "_raw", "k.pri", F.col("k.key").alias("_key"))
    ids = corpus.select(F.col("category").alias("_category"), F.col("id").alias("_key"), "id")
    hit = keys.join(ids, ["_category", "_key"]).groupBy("_category", "_raw").agg(F.min_by("id", "pri").alias("id"))
    if by_op:
        groups = corpus.where("category = 'redir'").select(F.col("id").alias("sig"), "group_op")
        redir = resolve_prefix(asked.where("_category = 'redir'").select(F.col("_raw").alias("raw")), groups).where("sig IS NOT NULL")
        hit = hit.unionByName(redir.select(F.lit("redir").alias("_category"), F.col("raw").alias("_raw"), F.col("sig").alias("id")))
    return tokens.join(hit, (tokens["category"] == hit["_category"]) & (tokens["raw"] == hit["_raw"]), "left").drop("_category", "_raw")


def lookup_negated(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """(tokens.*, id, display, negated): names as they are first, then without a leading no."""
    names = ids.select(F.col("id").alias("_key"), "id", "display")
    plain = names.select(F.col("_key"), F.struct("id", "display").alias("_plain"))
    other = names.select(F.col("_key").alias("_other_key"), F.struct("id", "display").alias("_other"))
    t = tokens.withColumn("_key", X.option_name("raw")).withColumn("_other_key", F.when(X.has_no("raw"), X.option_name(X.without_no("raw"))))
    t = t.join(plain, "_key", "left").join(other, "_other_key", "left")
    hit = F.coalesce("_plain", "_other")
    return t.select(*tokens.columns, hit["id"].alias("id"), hit["display"].alias("display"), F.when(hit.isNotNull(), F.col("_plain").isNull()).alias("negated"))


def classify(tokens: DataFrame, corpus: DataFrame, dim: DataFrame, negated_category: str = "option", prefix_category: str = "redir") -> DataFrame:
    """(tokens.*, category, id, display): the first category, in classify order, that knows the token.

    Options also match without a leading no, and redirections by operator; one join finds all other hits, since the keys a token may have do
    not depend on the corpus.
    """
    t = tokens.select("raw").where("raw IS NOT NULL").distinct()
    plain = corpus.join(dim, "category").select("category", "id", "display", "classify_ord")
    asked = t.select("raw", F.explode(_all_keys("raw")).alias("k")).select("raw", "k.class", "k.pri", "k.key")
    classed = plain.withColumn("class", _class(F.col("category"), negated_category))
    hits = asked.join(classed.withColumn("key", F.when(F.col("category") == negated_category, X.option_name("id")).otherwise(F.col("id"))), ["class", "key"])
    hits = hits.where(F.col("category") != prefix_category).select("raw", "classify_ord", "pri", "category", "id", "display")
    redir = corpus.where(F.col("category") == prefix_category)
    if "group_op" in corpus.columns:
        by_op = resolve_prefix(t, redir.select(F.col("id").alias("sig"), "group_op")).where("sig IS NOT NULL")
        of = plain.where(F.col("category") == prefix_category).select(F.col("id").alias("sig"), "classify_ord", "category", "id", "display")
        hits = hits.unionByName(by_op.join(of, "sig").select("raw", "classify_ord", F.lit(0).alias("pri"), "category", "id", "display"))
    first = hits.groupBy(F.col("raw").alias("_raw")).agg(F.min(F.struct("classify_ord", "pri", "category", "id", "display")).alias("_first"))
    rows = tokens.join(first, tokens["raw"] == first["_raw"], "left")
    return rows.select(*[tokens[c] for c in tokens.columns], "_first.category", "_first.id", "_first.display")


#: Categories whose tokens have keys of their own; all others share the trimmed token.
_OWN_KEYS = ("history", "job_spec", "special_function", "subscript_flag", "param_flag", "glob_flag", "glob_qualifier")


def _class(category, negated_category: str):
    return F.when(category == negated_category, "negated").when(category.isin(*_OWN_KEYS), category).otherwise("plain")


def _all_keys(raw: str):
    """array<struct<class,pri,key>>: the keys of a token in every class of categories."""
    name = lambda c, pri, key: F.struct(F.lit(c).alias("class"), pri.cast("int").alias("pri"), key.alias("key"))
    of = lambda c: F.transform(X.candidate_keys(F.lit(c), raw), lambda k: name(c, k["pri"], k["key"]))
    own = [of(c) for c in _OWN_KEYS]
    option = F.array(name("negated", F.lit(0), X.option_name(raw)), name("negated", F.lit(1), F.when(X.has_no(raw), X.option_name(X.without_no(raw)))))
    plain = F.array(name("plain", F.lit(0), X.trim(raw)))
    return F.filter(F.concat(plain, option, *own), lambda k: k["key"].isNotNull() & (k["key"] != ""))


def describe(keys: DataFrame, corpus: DataFrame) -> DataFrame:
    """(category, id, display, markdown) of each asked key, exactly as written; nulls where there is none."""
    facts = corpus.select("category", "id", "display", "markdown")
    return keys.join(facts, ["category", "id"], "left")


def flag_index(options: DataFrame) -> DataFrame:
    """(char, on, id) of the single-letter flags that name exactly one option. options: (id, flags)."""
    flags = options.select("id", F.explode("flags").alias("f")).select("f.char", "f.on", "id")
    return flags.groupBy("char", "on").agg(F.count(F.lit(1)).alias("_n"), F.first("id").alias("id")).where("_n = 1").drop("_n")


def begun(rows: DataFrame, column: str, typed: DataFrame) -> DataFrame:
    """`rows` with `key`: each beginning of `column` that is as long as some key of `typed`, so that beginnings meet keys by equality."""
    lengths = F.broadcast(typed.select(F.length("key").alias("n")).where("n > 0").distinct().agg(F.collect_list("n").alias("_lengths")))  # one row, of as many numbers as keys have lengths
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length(column)), lambda n: F.substring(column, F.lit(1), n))
    return rows.crossJoin(lengths).withColumn("key", F.explode(heads)).drop("_lengths")


def match_completions(ids: DataFrame, typed: DataFrame) -> DataFrame:
    """(typed, ord, label, canonical): names that what was typed begins, then, after a typed no, those of the rest, negated."""
    base = typed.select("typed", F.lit(0).alias("ord"), X.option_name("typed").alias("key"))
    rest = X.option_name(X.without_no("typed"))
    negative = typed.where(X.has_no("typed") & (rest != "")).select("typed", F.lit(1).alias("ord"), rest.alias("key"))
    index = begun(ids.select("id"), "id", base.unionByName(negative))
    hit = base.unionByName(negative).where("key <> ''").join(index, "key")
    return hit.select("typed", "ord", F.when(F.col("ord") == 1, F.concat(F.lit("no_"), F.col("id"))).otherwise(F.col("id")).alias("label"), F.col("id").alias("canonical"))

"""JSON artifacts of a corpus, its index and schemas, and commented JSON files."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pyspark.sql import Column, Window
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType

from ..operators.corpus import CATEGORIES, CLASSIFY_ORDER, united
from .stored import stored

CORPUS = "category string, id string, seq long, display string, sub_kind string, group_op string, payload string, markdown string"


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Records as JSON lines, a folder a category, so that a category's readers touch its files alone."""
    corpus.write.mode("overwrite").partitionBy("category").json(path)


def read_corpus(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Records back, under a fixed schema; a category prunes the folders that are read."""
    rows = spark.read.schema(CORPUS).json(path)
    return rows.where(F.col("category") == category) if category else rows


#: The file of each category's records, and the name of its count.
FILES = {
    "option": ("options.json", "options"), "cond_op": ("cond-ops.json", "condOps"), "builtin": ("builtins.json", "builtins"), "precmd": ("precmds.json", "precmds"), "shell_param": ("shell-params.json", "shellParams"),
    "complex_command": ("complex-commands.json", "complexCommands"), "reserved_word": ("reserved-words.json", "reservedWords"), "redir": ("redirections.json", "redirections"), "process_subst": ("process-substs.json", "processSubsts"),
    "param_expn": ("param-expns.json", "paramExpns"), "subscript_flag": ("subscript-flags.json", "subscriptFlags"), "param_flag": ("param-flags.json", "paramFlags"), "history": ("history.json", "history"), "glob_op": ("glob-operators.json", "globOperators"),
    "glob_flag": ("glob-flags.json", "globFlags"), "glob_qualifier": ("glob-qualifiers.json", "globQualifiers"), "prompt_escape": ("prompt-escapes.json", "promptEscapes"), "zle_widget": ("zle-widgets.json", "zleWidgets"),
    "keymap": ("keymaps.json", "keymaps"), "job_spec": ("job-specs.json", "jobSpecs"), "arith_op": ("arith-ops.json", "arithOps"), "special_function": ("special-functions.json", "specialFunctions"),
}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def json_text(value: Column, kind: DataType, indent: int = 0, keep: frozenset[str] = frozenset()) -> Column:
    """A value as indented JSON, two blanks a level, keys in camel case and in the order of the fields. Null fields are left out but for those in `keep`, which say null."""
    pad, end = " " * (indent + 2), " " * indent
    joined = lambda parts, a, b: F.concat(F.lit(f"{a}\n{pad}"), F.array_join(parts, f",\n{pad}"), F.lit(f"\n{end}{b}"))
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            field = F.concat(F.lit(f'"{camel(f.name)}": '), json_text(value[f.name], f.dataType, indent + 2, keep))
            parts.append(field if f.name in keep else F.when(value[f.name].isNotNull(), field))
        fields = F.array_compact(F.array(*parts))
        out = F.when(F.size(fields) == 0, "{}").otherwise(joined(fields, "{", "}"))
    elif isinstance(kind, ArrayType):
        out = F.when(F.size(value) == 0, "[]").otherwise(joined(F.transform(value, lambda x: json_text(x, kind.elementType, indent + 2, keep)), "[", "]"))
    elif isinstance(kind, StringType):
        whole = F.to_json(F.struct(value.alias("v")))  # {"v":...}, whose escapes are those of JSON
        out = F.substring(whole, F.lit(6), F.length(whole) - 6)
    elif isinstance(kind, (BooleanType, LongType, IntegerType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def artifact_lines(entries: DataFrame) -> DataFrame:
    """(manual, file, seq, value): the lines that make the files: a record each with its markdown joined in, brackets and commas where they belong, and files of categories without records."""
    from ..operators.extract import EXTRACTORS
    from ..operators.render import rendered

    shown = stored(rendered(entries).select("manual", "category", "seq", "markdown"), "rendered")
    parts = []
    for category, (extract, _, _) in EXTRACTORS.items():
        records = extract(entries)
        own = records.schema
        fields = StructType([f for f in own.fields if f.name not in ("manual", "seq")])
        body = json_text(F.struct(*fields.names), fields, 2)
        parts.append(records.select("manual", F.lit(category).alias("category"), "seq", body.alias("body")))
    rows = united(parts).join(shown, ["manual", "category", "seq"])
    said = json_text(F.struct("markdown"), StructType().add("markdown", "string"), 2)
    # The markdown is the last field: the record's closing brace goes behind it.
    both = F.concat(F.lit("  "), F.expr("left(body, length(body) - 4)"), F.lit(",\n"), F.expr("substring(said, 3)"))
    own = Window.partitionBy("manual", "category").orderBy("seq")
    rows = rows.withColumn("said", said).withColumn("nth", F.row_number().over(own)).withColumn("after", F.lead("seq").over(own))
    value = F.concat(F.when(F.col("nth") == 1, "[\n").otherwise(""), both, F.when(F.col("after").isNull(), "\n]").otherwise(","))
    names = F.create_map(*[F.lit(x) for c, (file, _) in FILES.items() for x in (c, file)])
    rows = rows.select("manual", names[F.col("category")].alias("file"), "seq", value.alias("value"))
    every = entries.select("manual").distinct().select("manual", F.explode(F.array(*[F.lit(f) for f, _ in FILES.values()])).alias("file"))
    none = every.join(rows.select("manual", "file").distinct(), ["manual", "file"], "left_anti")
    return rows.unionByName(none.select("manual", "file", F.lit(0).cast("long").alias("seq"), F.lit("[]").alias("value")))


def write_artifacts(entries: DataFrame, path: str, version: str, upstream: str) -> None:
    """A folder for each manual (or `path` itself for entries of none) with a JSON array a category and, last, `index.json`.

    Tasks write to a folder aside under Spark's own commit, each file's lines in order by one task, as a stream; retried tasks leave nothing. The driver then only renames: the old index goes first and the
    new one comes last, so that an index always stands beside a whole set of files.
    """
    spark = entries.sparkSession
    lines = artifact_lines(entries)
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    lines.repartition("manual", "file").sortWithinPartitions("manual", "file", "seq").select("manual", "file", "value").write.partitionBy("manual", "file").text(aside)
    done = spark.read.schema("value string, manual string, file string").text(aside)
    counts: dict[str, dict[str, int]] = {}
    # As many rows as there are files; every record has one line of its own indent.
    for r in done.groupBy("manual", "file").agg(F.count_if(F.col("value") == "  {").alias("n")).collect():
        counts.setdefault(r.manual or "", {})[r.file] = r.n
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f for f, _ in FILES.values())
    for manual, found in counts.items():
        folder = hadoop.Path(root, manual) if manual else root
        fs.mkdirs(folder)
        index = hadoop.Path(folder, "index.json")
        fs.delete(index, False)
        part_of = f"{aside}/manual={quote(manual) or '__HIVE_DEFAULT_PARTITION__'}"
        for file in files:
            status = fs.globStatus(hadoop.Path(f"{part_of}/file={file}/part-*"))
            target = hadoop.Path(folder, file)
            fs.delete(target, False)
            if len(status) != 1 or not fs.rename(status[0].getPath(), target):
                raise OSError(f"{target} could not be put in place")
        body = {
            "version": 1, "packageVersion": version, "zshUpstream": upstream, "files": files, "counts": {name: found[file] for file, name in FILES.values()},
            "docCategories": list(CATEGORIES), "classifyOrder": list(CLASSIFY_ORDER),
        }
        out = fs.create(index, True)
        out.write(bytearray((json.dumps(body, indent=2, ensure_ascii=False) + "\n").encode()))
        out.close()
    fs.delete(hadoop.Path(aside), True)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(manual, file, nth, record) of the arrays in the folders at a path or pattern, each record a VARIANT, in order."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file")).where("file <> 'index.json'")
    rows = rows.select(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("manual"), "file", F.parse_json("value").alias("_v"))
    return rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("manual", "file", F.col("pos").cast("long").alias("nth"), F.col("value").alias("record"))


def text_field(record: Column, name: str) -> Column:
    """A field of a VARIANT as loose readers take it: its text, or empty where it is absent, null or no text."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)), F.try_variant_get(record, f"$.{name}", "string")).otherwise("")


def field_state(record: Column, name: str) -> Column:
    """absent, null or there."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(value.isNull(), "absent").when(F.is_variant_null(value), "null").otherwise("there")


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold an array of records each, as other tools write them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def index_row(corpus: DataFrame, version: str, upstream: str) -> DataFrame:
    """One row: version, upstream, counts by category, and both orders."""
    counts = corpus.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))
    lit = lambda names: F.array(*[F.lit(x) for x in names])
    return counts.agg(F.map_from_entries(entries).alias("counts")).select(F.lit(version).alias("version"), F.lit(upstream).alias("upstream"), "counts", lit(CATEGORIES).alias("categories"), lit(CLASSIFY_ORDER).alias("classify_order"))


def version_text(corpus: DataFrame, version: str, tag: str, date: str, commit: str = "") -> DataFrame:
    """One row `text`: what a version command prints: the version, what manual of which commit, and how many records in how many categories."""
    upstream = f"zsh upstream: {tag} ({commit[:8]}, {date})" if commit else f"zsh upstream: {tag} ({date})"
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit(f"{version}\n{upstream}\n"), F.col("n").cast("string"), F.lit(f" records across {len(CATEGORIES)} categories")).alias("text"))


def schema_json(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()), indent=2) + "\n"


def read_commented(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file with comments and commas before closing brackets, strictly under a schema."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace("value", r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    bare = F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*")|,(\s*[\]}])', "$1$2")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    rows = whole.select(F.from_json(bare, f"array<{kind}>", {"mode": "FAILFAST"}).alias("rows"))
    return rows.select(F.inline("rows"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of markdown files without white space at the end."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.regexp_replace("value", r"\s+$", "").alias("text"))


def snippet_map(snippets: DataFrame) -> DataFrame:
    """One row: snippets (place, name, prefix, body, description) as a map by name; of a name, the one with the last place stays."""
    rows = snippets.groupBy("name").agg(F.max_by(F.struct("prefix", "body", "description"), "place").alias("s"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "s")))).alias("snippets"))


def bullet_list(rows: DataFrame, title: str, text: str) -> DataFrame:
    """One row `md`: a bullet a row, in order of the title."""
    line = F.concat(F.lit("- `"), F.col(title), F.lit("`: "), F.col(text))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(title).alias("k"), line.alias("s")))), lambda x: x["s"]), "\n").alias("md"))


def write_files(files: DataFrame, path: str) -> None:
    """Files (file, text), a folder each, as text."""
    files.select(F.regexp_replace("file", r"[^A-Za-z0-9._-]", "_").alias("file"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def artifact_schema_name(file: str) -> str:
    return re.sub(r"\.json$", ".schema.json", file)

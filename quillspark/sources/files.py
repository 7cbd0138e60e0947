"""Readers and writers: text folders, CSV and JSON lines with type inference, front matter, table export and import."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "txt", "html", "rst", "org", "tex", "adoc")) -> DataFrame:
    """(path, title, content, modified) of every text file below a folder; hidden folders are skipped. One row per file, whole."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return df.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[-_]", " ").alias("title"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified")).where(~F.col("path").rlike(r"/\.[^/]+/"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with a header, all columns as text; the delimiter is the one of comma and tab that the header holds more of."""
    head = spark.read.text(path).first()
    sep = "\t" if head and head[0].count("\t") > head[0].count(",") else ","
    return spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object per line, union of all columns; lines that are no objects are left out."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type, nulls) of text columns in one aggregation: integer, float, boolean, string or null; integers with floats are floats,
    any other mixture is string. Empty text counts as null."""
    aggs = []
    for c in df.columns:
        v = F.trim(F.col(f"`{c}`").cast("string"))
        given = v.isNotNull() & (v != "")
        is_int, is_float, is_bool = v.rlike(r"^-?\d+$"), v.rlike(r"^-?\d*\.\d+$"), F.lower(v).isin("true", "false")
        has = lambda x: F.coalesce(F.max((given & x).cast("int")), F.lit(0))  # noqa: E731, B023
        aggs.append(F.struct(F.lit(c).alias("column"), has(is_int).alias("i"), has(is_float).alias("f"), has(is_bool).alias("b"), has(~(is_int | is_float | is_bool)).alias("s"), F.coalesce(F.sum((~F.coalesce(given, F.lit(False))).cast("long")), F.lit(0)).alias("nulls")).alias(f"c{len(aggs)}"))
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])).alias("x")).select("x.*")
    kinds = F.col("i") + F.col("f") + F.col("b") + F.col("s")
    t = F.when(kinds == 0, "null").when(F.col("s") == 1, "string").when((F.col("b") == 1) & (kinds > 1), "string").when(F.col("b") == 1, "boolean").when(F.col("f") == 1, "float").otherwise("integer")
    return rows.select("column", t.alias("type"), "nulls")


def parse_front_matter(text: str) -> tuple[dict[str, list[str]], str]:
    """Scalars, inline lists and block lists of a leading '---' block, and the rest of the text."""
    m = re.match(r"\A---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    if not m:
        return {}, text
    out: dict[str, list[str]] = {}
    key = None
    for line in m[1].splitlines():
        item, pair = re.match(r"\s+-\s+(.*)", line) or re.match(r"-\s+(.*)", line), re.match(r"([\w-]+):\s*(.*)$", line)
        strip = lambda v: v.strip().strip("\"'")
        if pair:
            key, v = pair[1], pair[2].strip()
            out[key] = [strip(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") and v.endswith("]") else [strip(v)] if v else []
        elif item and key:
            out[key].append(strip(item[1]))
    return out, text[m.end() :]


def export_json_lines(tables: dict[str, DataFrame], path: str) -> None:
    """All rows of the tables as objects with a `_table` field, one per line."""
    out = None
    for name, df in tables.items():
        one = df.select(F.to_json(F.struct(F.lit(name).alias("_table"), *[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").text(path)


def import_json_lines(spark: SparkSession, path: str, table: str, schema: str, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """The rows of one table of an export, of several with a key the last line; merged into `base`, an imported row replaces the one with
    its key. Unreadable lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i")).where(F.get_json_object("value", "$._table") == table)
    rows = lines.select(F.from_json("value", schema).alias("x"), F.struct("_f", "_s", "_i").alias("o")).where("x is not null")
    new = rows.groupBy(*[F.col(f"x.`{k}`").alias(k) for k in keys]).agg(F.max_by("x", "o").alias("x")).select("x.*")
    return new if base is None else new.unionByName(base.join(new.select(*keys), keys, "left_anti").select(new.columns))


def export_sql(name: str, df: DataFrame) -> DataFrame:
    """(line) an INSERT OR REPLACE statement for every row."""
    plain = ("bigint", "int", "double")
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(f"`{c}`").cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    value = lambda c, t: F.when(F.col(f"`{c}`").isNull(), "NULL").otherwise(F.col(f"`{c}`").cast("string") if t in plain else quoted(c))
    return df.select(F.concat(F.lit(f"INSERT OR REPLACE INTO {name} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *[value(c, t) for c, t in df.dtypes]), F.lit(");")).alias("line"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A data file by its extension: csv and tsv, jsonl and ndjson, parquet; one without rows is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    df = read_delimited(spark, path) if kind in ("csv", "tsv") else read_json_lines(spark, path) if kind in ("jsonl", "ndjson") else spark.read.parquet(path) if kind == "parquet" else None
    if df is None or df.isEmpty():
        raise ValueError(f"no rows, or no data file: {path}")
    return df


#: Colours of the communities, and the lines around a graph.
COLOURS = ("#FF6B6B", "#4ECDC4", "#45B7D1", "#FFA07A", "#98D8C8", "#F7DC6F", "#BB8FCE", "#85C1E2", "#F8B88B", "#52C41A")
DOT_HEAD, DOT_TAIL = ("digraph knowledge_graph {", "  rankdir=LR;", "  node [shape=box, style=filled];", ""), ("}",)


def graph_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph: (part, line), head, nodes (slug, name, community), an empty line, edges (from_slug, to_slug, relation, weight), tail;
    part is their order."""
    spark = nodes.sparkSession
    esc = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("community") % len(COLOURS) + 1).cast("int"))
    n = nodes.select(F.lit(10).alias("part"), F.format_string('  "%s" [label="%s", fillcolor="%s"];', "slug", esc("name"), colour).alias("line"))
    e = edges.select(F.lit(30).alias("part"), F.format_string('  "%s" -> "%s" [label="%s", weight=%s];', "from_slug", "to_slug", esc("relation"), F.col("weight").cast("string")).alias("line"))
    fixed = spark.createDataFrame([(i, x) for i, x in enumerate(DOT_HEAD)] + [(20, ""), *[(40, x) for x in DOT_TAIL]], "part int, line string")
    return fixed.unionByName(n).unionByName(e)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a JSON object for every node and edge."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("slug", "name", "community")).alias("line"))
    return n.unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("from_slug", "to_slug", "relation", "weight")).alias("line")))


def front_matter(df: DataFrame, column: str = "content") -> DataFrame:
    """df with `fields`, a map of names to lists, and `body`, the text behind the front matter of `column`; null text has no fields."""
    schema = StructType(df.schema.fields[:]).add("fields", MapType(StringType(), ArrayType(StringType()))).add("body", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_front_matter(t) if t else ({}, t) for t in b[column]]
            yield b.assign(fields=[f for f, _ in parsed], body=[t for _, t in parsed])

    return df.mapInPandas(run, schema)


def vault_items(notes: DataFrame) -> DataFrame:
    """(path, title, url, date, tags, content) of notes(path, fields, body): the title of the fields, else the first heading, else the file's
    name; url or source; date or created; tags, those in the text too."""
    f = lambda *ks: F.coalesce(*[F.get(F.try_element_at("fields", F.lit(k)), F.lit(0)) for k in ks])
    head = F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", ""), "[-_]", " ")
    tags = F.array_distinct(F.concat(F.coalesce(F.try_element_at("fields", F.lit("tags")), F.array().cast("array<string>")), F.regexp_extract_all("body", F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1))))
    return notes.select("path", F.coalesce(f("title"), F.when(head != "", head), name).alias("title"), f("url", "source").alias("url"), f("date", "created").alias("date"), tags.alias("tags"), F.col("body").alias("content"))


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet file or folder as a stream; a stream watches folders, so a single file is taken by its name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)

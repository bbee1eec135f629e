"""Readers. Each takes a session and a path and gives a DataFrame with the mapped columns; schemas are explicit, so no
file is read twice to infer one. Missing fields are null."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X

RAW = "raw_id string, author string, text string, lang string, source string, genre string, metadata map<string,string>"


@dataclass
class Dataset:
    """One entry of a manifest: where rows come from and which field is which."""

    name: str
    loader: str
    path: str | None = None
    text_field: str = "text"
    author_field: str = "author"
    lang_field: str | None = None
    genre_field: str | None = None
    raw_id_field: str | None = None
    static_lang: str | None = None
    preprocess: str | None = None
    max_documents: int | None = None
    extra: dict = field(default_factory=dict)


def manifest(text: str) -> list[Dataset]:
    """A JSON list, or an object with a list under ``datasets``; anything else, and an unknown loader, is an error."""
    data = json.loads(text)
    rows = data.get("datasets") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise ValueError("a manifest is a list of datasets, or an object with one")
    known = Dataset.__dataclass_fields__
    out = [Dataset(**{k: v for k, v in r.items() if k in known}) for r in rows]
    for d in out:
        if d.loader not in LOADERS:
            raise ValueError(f"unknown loader {d.loader!r} in dataset {d.name!r}")
    return out


def _strings(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def jsonl(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """JSON lines below ``path``, recursively; blank lines are skipped, broken ones give rows of nulls."""
    return spark.read.schema(_strings(fields)).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Whole files, each a list of rows or an object whose values are the rows; other files are read as lines."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    row = _strings(fields)
    listed = F.from_json("value", T.ArrayType(row))
    mapped = F.map_values(F.from_json("value", T.MapType(T.StringType(), row)))
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, row))
    start = F.substring(F.ltrim("value"), 1, 1)
    one_line = ~F.col("value").rlike(r"(?s)^\s*\{.*\}\s*\n\s*\{")
    rows = F.when(start == "[", listed).when((start == "{") & one_line, mapped).otherwise(lines)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def delimited(spark: SparkSession, path: str, fields: list[str], sep: str | None = None) -> DataFrame:
    """CSV with a header; the separator is a comma for .csv files, a tab otherwise. Quoted line ends are kept. The
    header's columns are all read by position and then picked by name, without case."""
    sep = sep or ("," if path.endswith(".csv") else "\t")
    raw = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[f.lower()]}`") if f.lower() in have else F.lit(None).cast("string")).alias(f) for f in fields])


def nul_guarded(df: DataFrame, text: str) -> DataFrame:
    """Without rows that hold a NUL character."""
    return df.where(X.drop_nul(text))


def xml_rows(spark: SparkSession, path: str, tag: str, attributes: list[str]) -> DataFrame:
    """Attributes of every ``tag`` element."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes])
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(*[F.col(f"_{a}").alias(a) for a in attributes])


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump (bz2 or plain): title, namespace, redirect, page and revision id, text."""
    schema = "title string, ns string, id string, redirect struct<_title:string>, revision struct<id:string, text:struct<_VALUE:string>>"
    p = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return p.select("title", "ns", F.col("redirect").isNotNull().alias("is_redirect"), F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), F.col("revision.text._VALUE").alias("text"))


def parquet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    p = spark.read.parquet(path)
    return p.select(*[(F.col(f) if f in p.columns else F.lit(None)).cast("string").alias(f) for f in fields])


_BLOG_NAME = re.compile(r"([^/\\]+)\.xml$")


def blog_zip(spark: SparkSession, path: str) -> DataFrame:
    """A zip of blog files named author.gender.age.job.sign.xml: every text line is a row with the last date before it.

    Archives are read by workers, one at a time; lines and their order come back as rows, and the running date is a
    window over the lines of a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for name in z.namelist():
                        m = _BLOG_NAME.search(name)
                        if not m:
                            continue
                        parts = (m[1].split(".") + [""] * 5)[:5]
                        rows = z.read(name).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"file": name, "line_no": range(len(rows)), "line": [r.strip() for r in rows], **{k: v for k, v in zip(("author", "gender", "age", "job", "sign"), parts)}})

    raw = files.mapInPandas(lines, "file string, line_no bigint, line string, author string, gender string, age string, job string, sign string")
    date = F.regexp_extract("line", r"^<date>(.*)</date>$", 1)
    dated = raw.withColumn("date", F.last(F.when(date != "", date), ignorenulls=True).over(W.partitionBy("file").orderBy("line_no")))
    return dated.where(~F.col("line").rlike(r"^<[^>]*>") & (F.col("line") != "")).select("author", F.col("line").alias("text"), "gender", "age", "job", "sign", "date", "file", "line_no")


def map_fields(rows: DataFrame, d: Dataset) -> DataFrame:
    """To the raw schema: rows without text or author go, a missing language is ``unknown``, a missing id is made from
    the source and a hash of author and text (an order number would depend on how files are split)."""
    have = set(rows.columns)
    pick = lambda name: F.col(name) if name and name in have else F.lit(None).cast("string")
    text, author = pick(d.text_field), pick(d.author_field)
    lang = F.lit(d.static_lang) if d.static_lang else F.coalesce(F.nullif(F.lower(F.trim(pick(d.lang_field))), F.lit("")), F.lit("unknown"))
    made = F.concat(F.lit(f"{d.name}:"), F.substring(F.md5(F.concat_ws("\x01", author, text)), 1, 16))
    out = rows.where(text.isNotNull() & author.isNotNull()).select(
        F.coalesce(pick(d.raw_id_field), made).alias("raw_id"), author.alias("author"), text.alias("text"), lang.alias("lang"), F.lit(d.name).alias("source"), pick(d.genre_field).alias("genre"), F.create_map(F.lit("dataset"), F.lit(d.name)).alias("metadata")
    )
    return out


def _fields(d: Dataset) -> list[str]:
    return [f for f in dict.fromkeys([d.text_field, d.author_field, d.lang_field, d.genre_field, d.raw_id_field]) if f]


LOADERS: dict[str, Callable[[SparkSession, Dataset], DataFrame]] = {
    "jsonl": lambda s, d: jsonl(s, d.path, _fields(d)),
    "json": lambda s, d: json_document(s, d.path, _fields(d)),
    "csv": lambda s, d: delimited(s, d.path, _fields(d), d.extra.get("delimiter")),
    "tsv": lambda s, d: delimited(s, d.path, _fields(d), d.extra.get("delimiter", "\t")),
    "parquet": lambda s, d: parquet(s, d.path, _fields(d)),
    "blog_zip": lambda s, d: blog_zip(s, d.path),
    "xml": lambda s, d: xml_rows(s, d.path, d.extra.get("tag", "row"), _fields(d)),
}
#: Row preprocessors by name: DataFrame to DataFrame.
PREPROCESS: dict[str, Callable[[DataFrame, Dataset], DataFrame]] = {
    "first_author": lambda df, d: df.withColumn(d.author_field, X.first_author(d.author_field)),
    "story_author": lambda df, d: df.withColumn(d.author_field, F.concat(F.lit("story_"), F.col(d.author_field))),
    "unescape": lambda df, d: df.withColumn(d.text_field, X.html_clean(d.text_field)),
}


def load(spark: SparkSession, d: Dataset) -> DataFrame:
    """A dataset in the raw schema, with its preprocessing and cap. The cap takes the rows of smallest hash."""
    if not d.path:
        raise ValueError(f"dataset {d.name!r} needs a path")
    rows = LOADERS[d.loader](spark, d)
    if d.preprocess:
        rows = PREPROCESS[d.preprocess](rows, d)
    out = map_fields(rows, d)
    return out.orderBy(F.md5(F.concat_ws(":", "raw_id", F.md5("text")))).limit(d.max_documents) if d.max_documents else out


def pick_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first of ``wanted`` that is there, without regard to case."""
    have = {c.lower(): c for c in columns}
    return next((have[w.lower()] for w in wanted if w.lower() in have), None)


def split_documents(documents: DataFrame | None, queries: DataFrame | None = None, candidates: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """A split's documents: the documents table if there is one, else candidates and queries, the queries' authors from
    the ground truth; the first row of an id wins (candidates before queries)."""
    if documents is not None:
        return documents.dropDuplicates(["doc_id"])
    authors = truth.groupBy("query_id").agg(F.min("author_id").alias("author_id"))
    q = queries.drop("author_id").join(authors, "query_id", "left").withColumnRenamed("query_id", "doc_id").withColumn("retrieval_role", F.lit("query")).withColumn("__o", F.lit(1))
    c = candidates.withColumnRenamed("candidate_id", "doc_id").withColumn("retrieval_role", F.lit("candidate")).withColumn("__o", F.lit(0))
    both = c.unionByName(q, allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("__o"))
    return both.withColumn("__r", first).where("__r = 1").drop("__r", "__o")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of models, flattened to (model, path, value): each file an object with one model; a model in two
    files is an error for the caller to find with ``duplicate_models``."""
    whole = spark.read.option("wholetext", "true").text(path)

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []

            def walk(model: str, at: str, x) -> None:
                if isinstance(x, dict):
                    for k, v in x.items():
                        walk(model, f"{at}/{k}" if at else k, v)
                elif isinstance(x, int | float) and not isinstance(x, bool):
                    rows.append((model, at, float(x)))

            for text in b.value:
                for model, body in json.loads(text).items():
                    walk(model, "", body)
            yield pd.DataFrame(rows, columns=["model", "path", "value"])

    return whole.mapInPandas(flat, "model string, path string, value double")


def duplicate_models(long: DataFrame) -> DataFrame:
    return long.groupBy("model", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("model").distinct()

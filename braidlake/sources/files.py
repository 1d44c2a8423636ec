"""Readers of text files and evaluation sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions import text as T

EVAL_SCHEMA = "corpus_name string, context string, questions array<struct<id string, question string, question_type string, answer string, evidence string>>"


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(path, source, text) of all text files below a folder; bytes that aren't UTF-8 become replacement marks.

    source is the file name without its suffix. Blank files are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = raw.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "replace"))

    name = F.element_at(F.split("path", "/"), -1)
    return kept.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("source"), decode("content").alias("text")).where(T.strip("text") != "")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, page, text): the pages with text of all PDF files below a folder; needs the optional pypdf."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                rows = [(p, p.rsplit("/", 1)[-1], i, t) for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1) if (t := (page.extract_text() or "").strip())]
                yield pd.DataFrame(rows, columns=["path", "source", "page", "text"])

    return raw.select("path", "content").mapInPandas(pages, "path string, source string, page int, text string")


def read_eval_set(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Corpora (corpus_name, context) and questions (corpus_name, id, question, question_type, answer, evidence).

    Sets without a corpus name or context are left out.
    """
    sets = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(paths).where("trim(corpus_name) <> '' and trim(context) <> ''")
    return sets.select("corpus_name", "context"), sets.select("corpus_name", F.explode("questions").alias("q")).select("corpus_name", "q.*")


# Columns of a predictions file.
PREDICTION_SCHEMA = "id string, question string, source string, context string, evidence string, question_type string, generated_answer string, gold_answer string, error string"


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Writes predictions as JSON, one object a line; columns that are missing are left out, null fields too."""
    names = [f.split(" ")[0] for f in PREDICTION_SCHEMA.split(", ")]
    predictions.select(*[n for n in names if n in predictions.columns]).write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Predictions from JSON lines, or from files of one JSON array each; a path that doesn't exist gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PREDICTION_SCHEMA).option("multiLine", array).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PREDICTION_SCHEMA)


REPORT_SCHEMA = "map<string, map<string, map<string, double>>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(section, question_type, metric, mean) of a report file; none if it doesn't exist."""
    from pyspark.errors import AnalysisException

    schema = "section string, question_type string, metric string, mean double"
    try:
        raw = spark.read.option("wholetext", True).text(path)
        raw.limit(1).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    one = raw.select(F.explode(F.from_json("value", REPORT_SCHEMA)).alias("section", "_types"))
    two = one.select("section", F.explode("_types").alias("question_type", "_metrics"))
    return two.select("section", "question_type", F.explode("_metrics").alias("metric", "mean"))


def update_report(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Merges scores (section, question_type, metric, mean) into the report file and writes it as one JSON object.

    A report has a row per section, question type and metric, so it is small whatever was evaluated.
    """
    from braidlake.operators.evaluation import merged_report
    from braidlake.runtime import checkpointed

    rows = checkpointed(merged_report(read_report(spark, path), new))
    metrics = rows.groupBy("section", "question_type").agg(F.map_from_entries(F.collect_list(F.struct("metric", "mean"))).alias("_m"))
    types = metrics.groupBy("section").agg(F.map_from_entries(F.collect_list(F.struct("question_type", "_m"))).alias("_t"))
    whole = types.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "_t")))).alias("value"))
    whole.write.mode("overwrite").text(path)

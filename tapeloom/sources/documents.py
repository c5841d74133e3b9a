"""Assessment files, listings of log pairs, JSON and JSON-lines contracts, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.code import without_fence
from tapeloom.operators.contracts import duplicate_keys, require_none
from tapeloom.shared import drop_path


def assessments(files: DataFrame) -> DataFrame:
    """(path, class_id, assessment_id, title, exercises, reason) of assessment files (path, value)."""
    names = F.regexp_extract_all("value", F.lit(r"(?m)^---- exercise \d+:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    title = F.regexp_extract("value", r"(?m)^---- assessment title:[ \t]*(.*?)[ \t]*$", 1)
    parts = F.split("path", "/")
    row = files.select(
        "path", F.try_element_at(parts, F.lit(-3)).alias("class_id"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("assessment_id"), title.alias("title"), names.alias("exercises"),
    )
    reason = F.when(F.col("title") == "", "no_title").when(F.size("exercises") == 0, "no_exercises").when(F.array_contains("exercises", ""), "empty_exercise_id")
    return row.withColumn("reason", reason)


def read_assessments(spark: SparkSession, path: str, titles: list[str] | None = None) -> DataFrame:
    """`assessments` of all files of a path, those of `titles` only if given."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = assessments(files)
    return found.where(F.col("title").isin(*titles)) if titles else found


def log_files(listing: DataFrame, kind: str) -> DataFrame:
    """(class_id, student_id, assessment_id, exercise_id, path) of paths `class/users/student/kind/assessment_exercise.log`."""
    pattern = rf"([^/]+)/users/([^/]+)/{kind}/([^/_]+)_([^/_]+)\.log$"
    at = lambda k: F.regexp_extract("path", pattern, k)
    return listing.where(F.col("path").rlike(pattern)).select(
        at(1).alias("class_id"), at(2).alias("student_id"), at(3).alias("assessment_id"), at(4).alias("exercise_id"), "path"
    )


def log_pairs(executions: DataFrame, editors: DataFrame) -> DataFrame:
    """Both logs of each (class, student, assessment, exercise), and which one is missing."""
    keys = ["class_id", "student_id", "assessment_id", "exercise_id"]
    both = executions.withColumnRenamed("path", "execution_path").join(editors.withColumnRenamed("path", "editor_path"), keys, "full_outer")
    missing = F.concat_ws("+", F.when(F.col("execution_path").isNull(), "execution_log_missing"), F.when(F.col("editor_path").isNull(), "codemirror_log_missing"))
    return both.withColumn("reason", F.when(missing != "", missing))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files below a path, by their metadata only."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def read_contract(spark: SparkSession, path: str, schema: T.StructType | str, key: list[str] | None = None, lines: bool = True) -> DataFrame:
    """JSON documents or lines by an explicit schema; the first malformed one fails the read, as do repeated keys."""
    rows = spark.read.schema(schema).option("multiLine", str(not lines)).option("mode", "FAILFAST").json(path)
    if key:
        require_none(duplicate_keys(rows, key), "repeated key")
    return rows


def response_text(body: Column) -> Column:
    """The text of a JSON response body: output_text, else the texts of output[].content[], else those of content[]."""
    texts = "array<struct<text:string>>"
    nested = F.from_json(F.get_json_object(body, "$.output"), f"array<struct<content:{texts}>>")
    parts = F.flatten(F.transform(nested, lambda o: F.coalesce(o["content"], F.array().cast(texts))))
    flat = F.from_json(F.get_json_object(body, "$.content"), texts)
    joined = lambda a: F.nullif(F.array_join(F.transform(a, lambda x: x["text"]), ""), F.lit(""))
    return F.coalesce(F.nullif(F.trim(F.get_json_object(body, "$.output_text")), F.lit("")), joined(parts), joined(flat))


def batch_item(item: Column, schema: str) -> Column:
    """Struct (custom_id, response, stage, reason) of one line of a batch output: the text of its body as `schema`."""
    body = F.get_json_object(item, "$.response.body")
    status = F.get_json_object(item, "$.response.status_code").try_cast("int")
    text = without_fence(response_text(body))
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    stage = (
        F.when(F.get_json_object(item, "$.custom_id").isNull(), "batch_output")
        .when(F.get_json_object(item, "$.error").isNotNull() | F.coalesce(status != 200, F.lit(True)), "http")
        .when(F.coalesce(F.get_json_object(body, "$.status"), F.lit("completed")) != "completed", "incomplete")
        .when(text.isNull(), "empty").when(parsed.isNull(), "parse")
    )
    return F.struct(F.get_json_object(item, "$.custom_id").alias("custom_id"), F.when(stage.isNull(), parsed).alias("response"), stage.alias("stage"))


def hydrated(requests: DataFrame, outputs: DataFrame, errors: DataFrame | None = None, key: str = "custom_id") -> DataFrame:
    """Requests in their order with outputs and the stage at which each failed: missing_output, batch_error_file,
    duplicate_output, or the output's own; outputs without a request come last with unexpected_output."""
    n = outputs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("response").alias("response"), F.first("stage").alias("_s"))
    both = requests.withColumn("_req", F.lit(True)).join(n, key, "full_outer")
    if errors is not None:
        both = both.join(errors.select(key).distinct().withColumn("_err", F.lit(True)), key, "left")
    else:
        both = both.withColumn("_err", F.lit(None).cast("boolean"))
    stage = (
        F.when(F.col("_req").isNull(), "unexpected_output").when(F.col("_n") > 1, "duplicate_output")
        .when(F.col("_n").isNull() & F.col("_err"), "batch_error_file").when(F.col("_n").isNull(), "missing_output").otherwise(F.col("_s"))
    )
    return both.withColumn("stage", stage).drop("_n", "_s", "_req", "_err")


def write_json_document(row: DataFrame, path: str) -> None:
    """One row as one JSON document; the committed directory replaces what was there only when the job has succeeded."""
    row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_bundles(rows: DataFrame, keys: list[str], path: str) -> None:
    """Rows as JSON, a directory for each key; all or nothing: a failed job leaves no directory behind."""
    spark = rows.sparkSession
    try:
        rows.write.partitionBy(*keys).mode("errorifexists").json(path)
    except Exception as problem:
        if "already exists" not in str(problem).lower() and "PATH_ALREADY_EXISTS" not in str(problem):
            drop_path(spark, path)
        raise


def markdown_table(rows: DataFrame, limit: int = 500) -> str:
    """A small report table as Markdown; more than `limit` rows are an error."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError("too many rows for a report")
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in found])


def metric_pivot(values: DataFrame, key: list[str], condition: str, value: str, conditions: list[str]) -> DataFrame:
    """Metrics by condition: a column for each of `conditions`."""
    return values.groupBy(*key).pivot(condition, conditions).agg(F.first(value))


def by_priority(listing: DataFrame, patterns: list[str]) -> DataFrame:
    """Of each directory the file that matches the first of `patterns` that any does, of several the last by name:
    (directory, path)."""
    rank = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(k)) for k, p in enumerate(patterns)])
    rows = listing.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), rank.alias("rank")).where("rank IS NOT NULL")
    return rows.groupBy("directory").agg(F.max_by("path", F.struct((-F.col("rank")).alias("r"), "path")).alias("path"))


def examples(predictions: DataFrame, observed: DataFrame, key: str = "custom_id") -> DataFrame:
    """Predictions (key, hyps) with their observed events (key, events), and a reason where one is missing."""
    both = predictions.join(observed, key, "full_outer")
    reason = F.when(F.col("hyps").isNull(), "no_prediction").when(F.col("events").isNull(), "no_observed_events")
    return both.withColumn("reason", reason)

"""Editor logs: lines `time#type#payload`, with the output of local runs between them, as event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "saida_testar"


def event_time(text: Column) -> Column:
    """A time to the second or with a fraction; null for anything else."""
    whole = text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?$")
    return F.when(whole, F.try_to_timestamp(text))


def events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of log lines (log, line_no, value).

    An event is a line with a time and a type; the lines after a local run that aren't events are its output, and its
    line_number is that of the last of them, own_line its own. Blank lines don't count. Other lines that aren't
    events, and changes whose payload is no JSON, are rejects with a reason.
    """
    text = F.trim(F.regexp_replace("value", r"[\r\n\t ]+$", ""))
    parts = F.split(text, "#", 3)
    row = lines.where(F.trim("value") != "").select(
        "log", "line_no", F.col("value").alias("line"), event_time(F.get(parts, 0)).alias("ts"),
        F.get(parts, 1).alias("raw_type"), F.coalesce(F.get(parts, 2), F.lit("")).alias("payload"),
    )
    is_event = F.col("ts").isNotNull() & F.col("raw_type").isNotNull()
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = row.withColumn("is_event", is_event).withColumn("island", F.sum(is_event.cast("int")).over(w))
    held = held.withColumn("owner", F.last(F.when(is_event, F.col("raw_type")), ignorenulls=True).over(w))
    output = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_event"), F.struct("line_no", "line")))), lambda x: x["line"])
    own = lambda c: F.max(F.when(F.col("is_event"), F.col(c)))
    kept = held.where(F.col("is_event") | (F.col("owner") == RUN)).groupBy("log", "island").agg(
        own("ts").alias("ts"), own("raw_type").alias("raw_type"), own("payload").alias("payload"), own("line_no").alias("own_line"),
        F.max("line_no").alias("line_number"), output.alias("output_lines"),
    )
    bad_json = (F.col("raw_type") == "change") & F.expr("try_parse_json(payload)").isNull()
    stray = held.where(~F.col("is_event") & (F.coalesce("owner", F.lit("")) != RUN)).select("log", "line_no", F.lit("malformed_line").alias("reason"))
    rejects = stray.unionByName(kept.where(bad_json).select("log", F.col("own_line").alias("line_no"), F.lit("malformed_change").alias("reason")))
    return kept.where(~F.coalesce(bad_json, F.lit(False))).drop("island"), rejects


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, value) of all log files of a path; lines count from 1."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), "value")
    return files.select("log", F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")).select("log", (F.col("at") + 1).alias("line_no"), "value")


def key_name(payload: Column) -> Column:
    """The name of a handled key: the payload as a JSON string, else as it is."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"k":'), payload, F.lit("}")), "$.k"), payload)

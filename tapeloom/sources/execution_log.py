"""Execution logs: sections of submissions with code, grade and test cases, as rows; errors are data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.shared import tasks

_HEADER = re.compile(r"^== (SUBMITION|TEST) \((\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\)\s*$", re.M)
_CASE = re.compile(r"^-- TEST CASE (\d+):?\s*$")
_FIELDS = {"---- input:": "input", "---- correct output:": "expected", "---- user output:": "actual"}
_TESTS = "array<struct<idx int, passed boolean, input string, expected string, actual string>>"


def _output(text: str) -> str:
    return "\n".join(line.rstrip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()


def parse_body(body: str, first_case: int = 1) -> tuple[str | None, float | None, list[dict], str | None]:
    """(code, grade, tests, reason) of a submission body; the last code and grade block counts. A test case needs
    all three fields; test numbers count from `first_case`. The reason is null if nothing is wrong."""
    code = grade = reason = None
    tests: list[dict] = []
    block: list[str] | None = None  # where the current lines go
    kind, case = "", None

    def close() -> None:
        nonlocal code, grade, reason
        text = "\n".join(block or []).rstrip("\n")
        if kind == "code":
            code = text
        elif kind == "grade":
            found = re.search(r"\d+(?:\.\d+)?", text)
            if found:
                grade = float(found.group())
            else:
                reason = reason or "bad_grade"
        elif kind in _FIELDS.values() and case is not None:
            case[kind] = text

    def finish_case() -> None:
        nonlocal reason, case
        if case is not None:
            if {"input", "expected", "actual"} <= case.keys():
                tests.append({"idx": case["idx"], "passed": _output(case["expected"]) == _output(case["actual"]), "input": case["input"], "expected": case["expected"], "actual": case["actual"]})
            else:
                reason = reason or "incomplete_test_case"
        case = None

    for line in body.splitlines():
        head = _CASE.match(line)
        code_line = kind == "code" and not line.startswith(("-- EXECUTION TIME:", "-- TEST CASE ", "-- GRADE:", "-- OUTPUT:", "-- ERROR:", "*-*-"))
        if code_line:
            block.append(line)
        elif line.startswith(("-- ", "*-*-")):
            close()
            block, kind = None, ""
            finish_case()
            if head:
                n = int(head.group(1)) - first_case
                if n < 0:
                    reason = reason or "bad_test_number"
                else:
                    case = {"idx": n}
            elif line == "-- CODE:":
                block, kind = [], "code"
            elif line == "-- GRADE:":
                block, kind = [], "grade"
        elif line.startswith("---- ") and case is not None:
            close()
            kind = _FIELDS.get(line, "")
            block = [] if kind else None
        elif block is not None:
            block.append(line)
    close()
    finish_case()
    reason = reason or ("no_code" if code is None else "no_grade" if grade is None else "no_tests" if not tests else None)
    return code, grade, tests, reason


def parse_log(text: str) -> list[tuple]:
    """(position, time, code, grade, tests, reason) of each submission section; sections of other kinds only end them."""
    heads = list(_HEADER.finditer(text))
    out = []
    for k, head in enumerate(heads):
        if head.group(1) == "SUBMITION":
            end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
            out.append((k, head.group(2), *parse_body(text[head.end() : end])))
    return out


_SCHEMA = f"log string, position int, ts_text string, code string, grade double, tests {_TESTS}, reason string"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["log", "position", "ts_text", "code", "grade", "tests", "reason"]
    for batch in batches:
        rows = []
        for log, text in zip(batch["log"], batch["value"]):
            found = parse_log(text or "")
            rows += [(log, *r) for r in found] or [(log, 0, None, None, None, [], "no_sections")]
        yield pd.DataFrame(rows, columns=names)


def attempts(logs: DataFrame) -> DataFrame:
    """(log, attempt, ts, code, grade, tests, reason) of logs (log, value): submissions in order of time, counted
    from 0, of equal times in order of the file. A log without sections is one row with a reason."""
    parsed = logs.select("log", "value").mapInPandas(_run, _SCHEMA)
    ts = F.try_to_timestamp("ts_text", F.lit("yyyy-MM-dd HH:mm:ss"))
    w = Window.partitionBy("log").orderBy("ts", "position")
    return parsed.withColumn("ts", ts).withColumn("attempt", F.row_number().over(w) - 1).select("log", "attempt", "ts", "code", "grade", "tests", "reason")


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """`attempts` of all log files of a path; `log` is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), "value")
    return attempts(files.repartition(tasks(spark)))

"""Frequency of every distinct value or term.

An external sort: (term, record) pairs, counted within each batch of rows, are range
partitioned and sorted on both columns, so that a very common term is spread over as many
partitions as its pairs need. Each partition is then read once in order and its runs are
measured; only one partial row per term and partition is left to add up.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.shared import stripped, tasks, written

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores of the NFC-normalised, lower-cased text."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def whole_value(text: str) -> list[str]:
    """The text as one term: NFC-normalised, lower-cased, trimmed, each run of white space one space; blank ones give none."""
    value = " ".join(unicodedata.normalize("NFC", text).lower().split())
    return [value] if value else []


def _pairs(terms_of: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a record of very many rows is reduced here: its pairs must meet in one partition later
            by: dict[str, Counter] = {}
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(record, Counter()).update(terms_of(text))
            term = pa.array([t for found in by.values() for t in found], pa.string())
            times = pa.array([n for found in by.values() for n in found.values()], pa.int64())
            of = np.repeat(np.arange(len(by)), [len(found) for found in by.values()])
            rec = pa.array(list(by), pa.string()).take(pa.array(of))
            whole = pa.RecordBatch.from_arrays([term, rec, times], names=["term", "rec", "n"])
            for lo in range(0, len(of), 50_000):
                yield whole.slice(lo, 50_000)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over sorted (term, rec, n): a row (term, occurrences, records) per run and batch."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        term, rec, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        new_term = np.ones(len(n), dtype=bool)
        new_pair = np.ones(len(n), dtype=bool)
        if len(n) > 1:
            new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            new_pair[1:] = new_term[1:] | pc.not_equal(rec[1:], rec[:-1]).to_numpy(zero_copy_only=False)
        if last == (term[0].as_py(), rec[0].as_py()):
            new_pair[0] = False  # its record was counted with the batch before
        start = np.flatnonzero(new_term)
        last = (term[-1].as_py(), rec[-1].as_py())
        yield pa.RecordBatch.from_arrays(
            [
                term.take(pa.array(start)),
                pa.array(np.add.reduceat(n, start)),
                pa.array(np.add.reduceat(new_pair.astype(np.int64), start)),
            ],
            names=["term", "occurrences", "records"],
        )


def term_frequencies(
    rows: DataFrame, record: str, text: str, terms_of: Callable[[str], list[str]], partitions: int | None = None
) -> DataFrame:
    """(term, occurrences, records) of every distinct term of `text`.

    `record` is a string column that identifies the record; several rows may belong to one
    record, which counts once for a term. Rows with a null record or text are left out;
    texts without terms and empty tables give no rows; other columns are ignored.
    """
    taken = rows.select(F.col(record).cast("string").alias("r"), F.col(text).cast("string").alias("x")).where(
        F.col("r").isNotNull() & F.col("x").isNotNull()
    )
    # written, so that the texts aren't cut again for the sample that the ranges are taken from
    pairs = written(taken.mapInArrow(_pairs(terms_of), "term string, rec string, n bigint"), "term-pairs")
    ordered = pairs.repartitionByRange(partitions or tasks(rows.sparkSession), "term", "rec").sortWithinPartitions(
        "term", "rec"
    )
    runs = ordered.mapInArrow(_scan, "term string, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, n_records: int, rare_at_most: int = 2, common_above: float = 0.4) -> DataFrame:
    """`frequencies` with the share of the `n_records` records, and `mark`: rare, common, or null between them."""
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(
        F.col("records") > common_above * n_records, "common"
    )
    share = F.col("records") / F.lit(max(n_records, 1))
    return frequencies.select("term", "occurrences", "records", share.alias("record_share"), mark.alias("mark"))


def field_terms(
    rows: DataFrame,
    field: str,
    terms_of: Callable[[str], list[str]],
    common_above: float,
    rare_at_most: int = 2,
    record: str = "custom_id",
) -> DataFrame:
    """field_name, term, occurrences, records, record_share and mark of one text column.

    Records are compared without surrounding white space; null ones are ignored; rows with
    a null text still count for the number of records.
    """
    keyed = rows.select(stripped(F.col(record)).alias("r"), F.col(field).alias("x")).where(F.col("r").isNotNull())
    total = keyed.agg(F.count_distinct("r")).first()[0]  # one number
    found = marked(term_frequencies(keyed, "r", "x", terms_of), total, rare_at_most, common_above)
    return found.select(F.lit(field).alias("field_name"), *found.columns)

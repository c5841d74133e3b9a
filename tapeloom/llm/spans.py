"""Long exact spans shared between records, by a log-structured index of window hashes.

Every stretch of `min_chars` characters is represented by the least hash among the shorter
windows inside it (winnowing), so that two equal stretches, wherever they stand, choose the
same window. The index holds, for each chosen window's hash, the least and the greatest
record that has it, which is all it takes to know whether two different records share it.

The index is kept as immutable runs sorted by hash. A new batch becomes a sorted run of its
own and is merge-joined with each historical run; a hash is shared if the two rows or either
of them name different records. When enough runs of a level are there, they are merged into
one of the next. Runs are bucketed tables: neither the merge-join nor the compaction
shuffles history. An index with a folder of its own is kept: its manifest names the runs of
each level, and a later session opens it and goes on, without a look at the texts before.

A shared window is a candidate. Verification compares whole stretches of `min_chars`
characters between different records, by two hashes of unlike kinds over all their characters:
64 bits of a polynomial modulo 2^64, and 62 bits of polynomials modulo two primes. For existence
the stretches that start at a chosen window come first: a shared span of min_chars + w
characters or more holds one. Only records they don't settle have all their stretches compared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.shared import drop_path, shared_path, stripped, tasks, written

MIN_CHARS = 160
FANOUT = 2
_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2^64
_PRIMES = ((2**31 - 1, 1_220_703_125), (2**31 - 19, 1_732_050_807))  # moduli and bases of the second hash
_PIECE_CHARS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64 or a prime below 2^31, as many as asked for."""

    def __init__(self, base: int, modulus: int = 1 << 64):
        self.base, self.modulus = base, modulus
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = pow(self.base, -1, self.modulus)
            for name, b in (("up", self.base), ("down", inverse)):
                out = np.ones(n, dtype=np.uint64)
                have = 1
                while have < n:
                    more = min(have, n - have)
                    out[have : have + more] = self.reduced(out[:more] * np.uint64(pow(b, have, self.modulus)))
                    have += more
                setattr(self, name, out)
        return self.up[:n], self.down[:n]

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return x if self.modulus == 1 << 64 else x % np.uint64(self.modulus)


class Windows:
    """Hashes of the windows of a batch of texts, laid out one after another."""

    _powers = [_Powers(_BASE), *[_Powers(b, p) for p, b in _PRIMES]]

    def __init__(self, texts: list[str], min_chars: int):
        self.length = min_chars
        self.k = min_chars // 2 + 1
        self.w = min_chars - self.k + 1
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.text = np.repeat(np.arange(len(texts)), size)
        end = self.start[1:][self.text] if len(texts) else np.empty(0, dtype=np.int64)
        at = np.arange(len(self.codes))
        self.whole = at + min_chars <= end  # a stretch starts here
        self._sums: dict[int, np.ndarray] = {}
        grams = self.hashes(0, self.k, at)
        n = len(self.codes)
        least = self._slide(grams, np.minimum, n)
        #: The least hash of the stretch that starts at each place; 0 where none does.
        self.least = np.where(self.whole, least, np.uint64(0))
        most = self._slide(np.concatenate([np.zeros(self.w - 1, dtype=np.uint64), self.least]), np.maximum, n)
        self.grams = grams
        self.chosen = np.flatnonzero((most[:n] == grams) & (most[:n] > 0))

    def _polynomial(self, which: int, length: int, at: np.ndarray) -> np.ndarray:
        powers, n = self._powers[which], len(self.codes)
        up, down = powers(n + 1)
        if which not in self._sums:
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(powers.reduced((self.codes.astype(np.uint64) + np.uint64(1)) * up[:n]), out=sums[1:])
            self._sums[which] = sums
        sums = self._sums[which]
        total = powers.reduced(sums[np.minimum(at + length, n)] - sums[at])
        return powers.reduced(total * down[at])

    def hashes(self, which: int, length: int, at: np.ndarray) -> np.ndarray:
        """Hash of the window of `length` at each of the places (meaningless where it goes past the end of its text):
        0 is the polynomial modulo 2^64, 1 those modulo the primes."""
        if which == 0:
            return _mix(self._polynomial(0, length, at))
        return _mix((self._polynomial(1, length, at) << np.uint64(31)) + self._polynomial(2, length, at))

    def _slide(self, x: np.ndarray, best, n: int) -> np.ndarray:
        """`best` over x[i : i + w] for each i < n, short at the end."""
        reach = 1
        out = x
        while reach * 2 <= self.w:
            out = np.concatenate([best(out[:-reach], out[reach:]), out[-reach:]]) if len(out) > reach else out
            reach *= 2
        rest = self.w - reach
        if rest and len(out) > rest:
            out = np.concatenate([best(out[:-rest], out[rest:]), out[-rest:]])
        return out[:n]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pieces(batches: Iterator[pa.RecordBatch], min_chars: int, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with texts of at least `min_chars`, in pieces of bounded size. No shorter text can hold a span."""
    for batch in batches:
        texts = batch.column(at).to_pylist()
        keep = [k for k, t in enumerate(texts) if len(t) >= min_chars]
        lo = 0
        while lo < len(keep):
            hi, chars = lo, 0
            while hi < len(keep) and (hi == lo or chars < _PIECE_CHARS):
                chars += len(texts[keep[hi]])
                hi += 1
            yield batch.take(pa.array(keep[lo:hi])), [texts[k] for k in keep[lo:hi]]
            lo = hi


def _records(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()], dtype=np.uint64)


def _index_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, min_chars, 1):
            found = Windows(texts, min_chars)
            c = _records(rows.column(0))
            yield pa.RecordBatch.from_arrays(
                [_signed(found.grams[found.chosen]), _signed(c[found.text[found.chosen]])], names=["h", "c"]
            )

    return run


def _aligned_rows(min_chars: int):
    """Chosen windows with the 128 bits of the stretch that starts there, if one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, min_chars, 2):
            found = Windows(texts, min_chars)
            at = found.chosen
            c, ids = _records(rows.column(1)), rows.column(0).to_numpy()
            none = ~found.whole[at]
            stretch = [pa.array(found.hashes(k, min_chars, at).view(np.int64), mask=none) for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [_signed(found.grams[at]), *stretch, pa.array(ids[found.text[at]]), _signed(c[found.text[at]])],
                names=["h", "s1", "s2", "id", "c"],
            )

    return run


def _stretch_rows(min_chars: int):
    """All stretches of a text whose least hash is among the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _pieces(batches, min_chars, 2):
            found = Windows(texts, min_chars)
            c, ids = _records(rows.column(1)), rows.column(0).to_numpy()
            wanted = rows.column(3)
            of = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
            asked = _mix(wanted.flatten().to_numpy().view(np.uint64) + _mix(of.astype(np.uint64)))
            at = np.flatnonzero(found.whole)
            have = _mix(found.least[at] + _mix(found.text[at].astype(np.uint64)))
            at = at[np.isin(have, asked)]
            text = found.text[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *[_signed(found.hashes(k, min_chars, at)) for k in range(2)],
                    pa.array(ids[text]),
                    _signed(c[text]),
                    pa.array((at - found.start[text]).astype(np.int32)),
                ],
                names=["s1", "s2", "id", "c", "at"],
            )

    return run


class SpanIndex:
    """Sorted runs of window hashes; `add` returns what a batch shares with all before it.

    Without a `path` the index lives in the shared folder until `close`. With one it is kept there: each step writes a new
    manifest before the runs it replaces are dropped, so that a lost driver leaves the last state behind. `open` goes on with it.
    """

    def __init__(
        self, spark: SparkSession, min_chars: int = MIN_CHARS, fanout: int = FANOUT, buckets: int | None = None, path: str | None = None, opened: bool = False
    ):
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.buckets = buckets or tasks(spark)
        self.kept = path is not None
        if path and not opened and _files(spark, f"{path}/manifest"):
            raise ValueError(f"there is an index at {path}: open it")
        self.path = path or shared_path(spark, "span-index")
        self.levels: list[list[str]] = []
        self.version = 0
        self.shared: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpanIndex:
        """The index that was kept at `path`, as its last manifest has it."""
        names = [f.getPath().getName() for f in _files(spark, f"{path}/manifest")]
        if not names:
            raise ValueError(f"no index at {path}")
        last = max(int(n.split(".")[0]) for n in names)
        text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest/{last:08d}.json").collect())  # one small document
        state = json.loads(text)
        index = cls(spark, state["min_chars"], state["fanout"], state["buckets"], path, opened=True)
        index.levels, index.version = state["levels"], last
        for name in index.runs():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, lo BIGINT, hi BIGINT) USING parquet OPTIONS (path '{path}/{name}') "
                f"CLUSTERED BY (h) SORTED BY (h) INTO {index.buckets} BUCKETS"
            )
        return index

    def runs(self) -> list[str]:
        """The names of all runs."""
        return [r for level in self.levels for r in level]

    def _write(self, run: DataFrame) -> str:
        name = f"span_run_{uuid.uuid4().hex}"
        try:
            run.select("h", "lo", "hi").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        except Exception:
            self._drop(name)
            raise
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.path}/{name}")

    def _commit(self, replaced: list[str]) -> None:
        self.version += 1
        state = {"min_chars": self.min_chars, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels}
        _put(self.spark, f"{self.path}/manifest/{self.version:08d}.json", json.dumps(state))
        for name in replaced:
            self._drop(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of (record, text), no nulls; returns the hashes (h) that it makes known as shared."""
        return self.add_windows(batch.select("record", "text").mapInArrow(_index_rows(self.min_chars), "h bigint, c bigint"))

    def add_windows(self, windows: DataFrame) -> DataFrame:
        """The same for the chosen windows (h, c) of a batch: their hashes and their records' hashes."""
        name = self._write(windows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")))
        new = self.spark.table(name)
        hits = new.where("lo <> hi").select("h")
        for run in self.runs():
            old = self.spark.table(run).select("h", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
            met = new.join(old.hint("merge"), "h").where("least(lo, old_lo) <> greatest(hi, old_hi)")
            hits = hits.union(met.select("h"))
        hits = written(hits.distinct(), "shared-windows")
        self.shared.append(hits)
        replaced: list[str] = []
        self._place(name, 0, replaced)
        self._commit(replaced)
        return hits

    def _place(self, name: str, level: int, replaced: list[str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        runs = self.levels[level]
        runs.append(name)
        if len(runs) >= self.fanout:
            self.levels[level] = []
            replaced += runs
            self._place(self._merge(runs), level + 1, replaced)

    def _merge(self, runs: list[str]) -> str:
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).select("h", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            merged = merged.join(other.hint("merge"), "h", "full_outer").select(
                "h", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")
            )
        return self._write(merged)

    def shared_hashes(self) -> DataFrame:
        """The distinct hashes known as shared since the index was made or opened."""
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.union(more)
        return out.distinct()

    def close(self) -> None:
        """Forget the index; its runs are removed unless it is kept."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not self.kept:
            drop_path(self.spark, self.path)
        self.levels = []


def _files(spark: SparkSession, path: str) -> list:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(at)) if fs.exists(at) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and moved to its place as a whole."""
    jvm = spark.sparkContext._jvm
    at, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, at):
        raise OSError(f"could not write {path}")


def _taken(rows: DataFrame, row_id: str, record: str, text: str) -> DataFrame:
    return rows.select(
        F.col(row_id).cast("bigint").alias("id"), stripped(F.col(record)).alias("record"), F.col(text).alias("text")
    ).where(F.col("id").isNotNull() & F.col("record").isNotNull() & F.col("text").isNotNull())


def _indexed(windows: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """The shared hashes of the windows (h, id, c) of all rows, added to an index batch by batch."""
    index = SpanIndex(windows.sparkSession, min_chars)
    for k in range(batches):
        index.add_windows(windows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select("h", "c"))
    shared = written(index.shared_hashes(), "shared")
    index.close()
    return shared


def _between_records(stretches: DataFrame) -> DataFrame:
    """The stretches (s1, s2) that different records have."""
    return (
        stretches.groupBy("s1", "s2").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s1", "s2")
    )


def _stretches(taken: DataFrame, asked: DataFrame, min_chars: int) -> DataFrame:
    """(s1, s2, id, c, at) of all stretches of the texts of `asked` (id, h) whose least hash is an h asked for."""
    wanted = asked.groupBy("id").agg(F.collect_set("h").alias("wanted"))  # at most one h for each character of the text
    return taken.join(wanted, "id").select("id", "record", "text", "wanted").mapInArrow(
        _stretch_rows(min_chars), "s1 bigint, s2 bigint, id bigint, c bigint, at int"
    )


def _candidates(taken: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(h, s1, s2, id, c): the chosen windows whose hash is shared. The texts are hashed once, for index and candidates."""
    windows = written(taken.mapInArrow(_aligned_rows(min_chars), "h bigint, s1 bigint, s2 bigint, id bigint, c bigint"), "windows")
    return written(windows.join(_indexed(windows.select("h", "id", "c"), min_chars, batches), "h", "left_semi"), "candidates")


def sharing_rows(
    rows: DataFrame, row_id: str, record: str, text: str, min_chars: int = MIN_CHARS, batches: int = 3
) -> DataFrame:
    """(id) of the rows whose text has a span of at least `min_chars` characters, letter for letter, that also
    stands in a text of a different record.

    Records are compared without surrounding white space. `row_id` is a unique integer. Rows with
    a null id, record or text are left out, and texts shorter than `min_chars` share nothing. Spans
    that only repeat within a record don't count. An empty table gives no rows.
    """
    taken = _taken(rows, row_id, record, text)
    hot = _candidates(taken, min_chars, batches)
    starts = hot.where("s1 IS NOT NULL")
    settled = written(starts.join(_between_records(starts), ["s1", "s2"], "left_semi").select("id").distinct(), "settled")
    open_rows = hot.join(settled, "id", "left_anti")
    asked = hot.select("id", "h").join(open_rows.select("h").distinct(), "h", "left_semi")
    every = written(_stretches(taken, asked, min_chars), "stretches")
    late = every.join(_between_records(every), ["s1", "s2"], "left_semi").select("id")
    return settled.union(late).distinct()


def shared_characters(
    rows: DataFrame, row_id: str, record: str, text: str, min_chars: int = MIN_CHARS, batches: int = 3
) -> DataFrame:
    """(record, n_texts, n_chars, shared_chars, shared_spans) of every record: how many characters of its texts
    lie in spans of at least `min_chars` that stand in a text of a different record, and how many such
    separate stretches there are. Nulls, short and empty texts as in `sharing_rows`: rows without a text
    share nothing but still count their record; rows without a record don't come out.
    """
    taken = _taken(rows, row_id, record, text)
    hot = _candidates(taken, min_chars, batches)
    every = written(_stretches(taken, hot.select("id", "h"), min_chars), "stretches")
    found = every.join(_between_records(every), ["s1", "s2"], "left_semi").select("id", "at")
    # starts of one text, at most one for each of its characters: the length of their union
    starts = found.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("at"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("at")), lambda i: F.element_at("at", i) - F.element_at("at", i - 1))
    gaps = F.when(F.size("at") > 1, gaps).otherwise(F.array().cast("array<int>"))
    covered = starts.select("id", gaps.alias("gaps")).select(
        "id",
        (
            F.aggregate("gaps", F.lit(0).cast("bigint"), lambda acc, g: acc + F.least(g, F.lit(min_chars)))
            + F.lit(min_chars)
        ).alias("chars"),
        (F.size(F.filter("gaps", lambda g: g > min_chars)) + 1).cast("bigint").alias("spans"),
    )
    every_row = rows.select(
        F.col(row_id).cast("bigint").alias("id"),
        stripped(F.col(record)).alias("record"),
        F.length(F.col(text)).alias("n"),
    ).where(F.col("record").isNotNull())
    return (
        every_row.join(covered, "id", "left")
        .groupBy("record")
        .agg(
            F.count("n").alias("n_texts"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"),
            F.coalesce(F.sum("chars"), F.lit(0)).alias("shared_chars"),
            F.coalesce(F.sum("spans"), F.lit(0)).alias("shared_spans"),
        )
    )

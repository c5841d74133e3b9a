"""Replay of editor logs and alignment of attempts with the snapshots.

A replay is sequential within a log. Events are hash partitioned by log and sorted, and stream
through a fold that holds one log's buffer, never its events. Where programs are asked for, that
fold only cuts logs into parts, each with the buffer that it begins with, and the programs are made
part by part in other tasks.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.code import normalize_code
from tapeloom.functions.diff import Shared, coarse_steps
from tapeloom.shared import tasks, written


def change_of(payload: str | None) -> dict | None:
    """The change of a payload, or None."""
    try:
        c = json.loads(payload or "")
        return {"span": (int(c["from"]["line"]), int(c["from"]["ch"]), int(c["to"]["line"]), int(c["to"]["ch"])), "text": [str(t) for t in c["text"]]}
    except (ValueError, KeyError, TypeError):
        return None


def why_not(lines: list[str], change: dict | None) -> str | None:
    """Why a change can't be applied to the buffer, or None."""
    if change is None or not change["text"]:
        return "malformed_change"
    a, x, b, y = change["span"]
    if min(a, x, b, y) < 0:
        return "negative_position"
    if (a, x) > (b, y):
        return "reversed_range"
    if b >= len(lines):
        return "line_out_of_bounds"
    if x > len(lines[a]) or y > len(lines[b]):
        return "character_out_of_bounds"
    return None


def put_in(lines: list[str], change: dict) -> None:
    """Replace a range of the buffer in place."""
    a, x, b, y = change["span"]
    new = list(change["text"])
    new[0] = lines[a][:x] + new[0]
    new[-1] += lines[b][y:]
    lines[a : b + 1] = new


def apply_change(lines: list[str], change: dict | None) -> str | None:
    """Replace a range of the buffer in place; the reason if it can't be, with the buffer as it was."""
    why = why_not(lines, change)
    if why is None:
        put_in(lines, change)
    return why


def removed_text(lines: list[str], span: tuple[int, int, int, int]) -> str:
    """The text of a range of the buffer."""
    a, x, b, y = span
    if a == b:
        return lines[a][x:y]
    return "\n".join([lines[a][x:], *lines[a + 1 : b], lines[b][:y]])


_BLOCK = (
    "log_id bigint, submit_index int, start_code string, code string, n_changes int, n_runs int, n_rejected int, "
    "first_line int, first_reason string, chars_in bigint, chars_out bigint, submit_ts timestamp, "
    "steps array<struct<action string, start int, end int>>, steps_reason string"
)
#: Characters of programs after which the rows made so far are handed over.
FRAME_CHARS = 4_000_000
#: Characters of programs after which a log's next part begins; and those of a buffer up to which its growth begins no part.
PART_CHARS, NARROW_CHARS = 64_000_000, 16_000
#: Most events in a row of a part.
PACK_EVENTS = 1_000
_PACK = "log_id bigint, part int, place int, width bigint, chars bigint, first_index int, state binary, seed string, events binary"


class _Log:
    """One log's buffer and its open block. The programs of a block differ only between the first `pre` and the last `suf` lines,
    which no change of it has touched: anchors hold what stands between them, and a change costs no more than the lines it touches."""

    def __init__(self, log_id: int, seed: str, programs: bool = True, paths: bool = True):
        self.id, self.seed, self.programs, self.paths = log_id, seed, programs, paths
        self.lines, self.submits, self.begun, self.code = [""], 0, False, ""
        self.size = 0  # of the buffer in characters
        self.odd = False  # whether a line of the buffer holds a line end, as changes may put in
        self.times = Counter(self.lines)
        self.open_block()

    def open_block(self) -> None:
        self.start = self.code
        self.changes = self.runs = self.rejected = self.put = self.cut = 0
        self.edited, self.anchors, self.first_line, self.reason = False, [], None, None
        self.pre = self.suf = None
        self.first: list[str] = []  # the start between pre and suf
        self.whole = self.odd or not self.begun and bool(self.seed)  # whether anchors hold their whole program

    def resume(self, lines: list[str], submits: int) -> None:
        """Go on from the buffer that an earlier part of the log ended with."""
        self.lines, self.submits, self.begun = lines, submits, True
        self.odd, self.times, self.code = any("\n" in t for t in lines), Counter(lines), self.text()
        self.size = len(self.code)
        self.open_block()

    def text(self) -> str:
        return "\n".join(self.lines)

    def seeded(self) -> None:
        self.begun = True
        self.lines = self.seed.split("\n")
        self.start, self.times, self.size = self.seed, Counter(self.lines), len(self.seed)

    def as_whole(self) -> None:
        """From here on anchors hold whole programs, those already there too."""
        if not self.whole:
            head, tail = self.around()
            full = lambda mid: "\n".join([*head, *mid, *tail])
            self.anchors = [(kind, full(mid), edited) for kind, mid, edited in self.anchors]
            self.start = full(self.first)
        self.whole = True

    def around(self) -> tuple[list[str], list[str]]:
        if self.pre is None:
            return self.lines, []
        return self.lines[: self.pre], self.lines[len(self.lines) - self.suf :]

    def touch(self, a: int, b: int) -> None:
        """Lines a to b are about to change: what stands between pre and suf grows to them in all programs of the block."""
        last = len(self.lines) - 1
        if self.pre is None:
            self.pre, self.suf, mid = a, last - b, self.lines[a : b + 1]
            self.first = mid
            self.anchors = [(kind, mid, edited) for kind, _, edited in self.anchors]
            return
        head = self.lines[a : self.pre]
        tail = self.lines[len(self.lines) - self.suf : b + 1]
        if head or tail:
            self.first = [*head, *self.first, *tail]
            self.anchors = [(kind, [*head, *mid, *tail], edited) for kind, mid, edited in self.anchors]
            self.pre, self.suf = min(self.pre, a), min(self.suf, last - b)

    def take(self, kind: str, payload: str | None, ts) -> tuple | None:
        if kind == "change":
            change = change_of(payload)
            if not self.begun:
                # a first change at the very start means an empty buffer
                if self.seed and (change is None or change["span"] != (0, 0, 0, 0)):
                    self.seeded()
                self.begun = True
            why = why_not(self.lines, change)
            if why:
                self.rejected += 1
                self.reason = self.reason or why
                return None
            a, _, b, _ = change["span"]
            text = change["text"]
            if self.paths:
                if not self.odd and any("\n" in t for t in text):
                    self.as_whole()
                    self.odd = True
                if not self.whole:
                    self.touch(a, b)
                self.times.subtract(self.lines[a : b + 1])
            cut, put = len(removed_text(self.lines, change["span"])), sum(map(len, text)) + len(text) - 1
            put_in(self.lines, change)
            if self.paths:
                self.times.update(self.lines[a : a + len(text)])
            self.changes += 1
            self.edited = True
            self.first_line = a if self.first_line is None else self.first_line
            self.cut, self.put, self.size = self.cut + cut, self.put + put, self.size + put - cut
        elif kind in ("saida_testar", "submit"):
            if not self.begun and kind == "submit":
                self.seeded()
            if self.paths:
                mid = self.text() if self.whole else self.lines[self.pre : len(self.lines) - self.suf] if self.pre is not None else []
                self.anchors.append((kind, mid, self.edited))
            self.edited = False
            self.runs += kind == "saida_testar"
            if kind == "submit":
                return self.close(ts)
        return None

    def close(self, ts) -> tuple:
        steps, why = None, None
        if self.paths:
            steps, why = coarse_steps(self.start, self.anchors) if self.whole else self.steps()
        if self.programs or self.odd:
            self.code = self.text()
        code = (self.start, self.code) if self.programs else ()
        row = (self.id, self.submits, *code, self.changes, self.runs, self.rejected, self.first_line, self.reason, self.put, self.cut, ts, *((steps, why) if self.paths else ()))
        if len(self.times) > 2 * len(self.lines) + 1_000:
            self.times = +self.times  # lines that are gone
        self.submits += 1
        self.open_block()
        return row

    def steps(self) -> tuple[list[dict], str | None]:
        """`coarse_steps` of the block from what its programs don't share."""
        shared = Shared(self.lines, len(self.lines) if self.pre is None else self.pre, self.suf or 0, self.times)
        now, out, final = self.first, [], self.anchors[-1][1]
        for kind, mid, edited in self.anchors:
            if edited:
                span = shared.changed_span(now, mid)
                if span is None:
                    return [], "no_net_change"
                span = shared.projected_span(mid, final, span)
                if span is None:
                    return [], "edit_not_in_final_code"
                out.append({"action": "edit", "start": span[0], "end": span[1]})
            out.append({"action": "submit" if kind == "submit" else "local_run", "start": None, "end": None})
            now = mid
        return out, None


def _handed_over(rows: Iterator[tuple], names: list[str], chars: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows as frames: programs of a long log are large, so that few of them are held at a time."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += chars(row)
        if held > FRAME_CHARS:
            yield _frame(out, names)
            out, held = [], 0
    if out:
        yield _frame(out, names)


def _row_chars(row: tuple) -> int:
    return len(row[2]) + len(row[3])


def _fold(names: list[str], programs: bool, paths: bool):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log: _Log | None = None

        def taken(batch: pd.DataFrame) -> Iterator[tuple]:
            nonlocal log
            for log_id, kind, payload, ts, seed in zip(batch["log_id"], batch["kind"], batch["payload"], batch["ts"], batch["seed"]):
                if log is None or log.id != log_id:
                    log = _Log(log_id, seed or "", programs, paths)
                if row := log.take(kind, payload, ts):
                    yield row

        for batch in batches:
            yield from _handed_over(taken(batch), names, _row_chars if programs else lambda row: 0)

    return fold


def _packed(value: list) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 1)


def _unpacked(value: bytes) -> list:
    return json.loads(zlib.decompress(value))


class _Parts:
    """Cuts one log into parts of whole blocks: one ends with the block that takes it over `most` characters of programs, or its
    buffer over twice its width, the size that it begins with."""

    def __init__(self, log_id: int, seed: str, most: int):
        self.log, self.seed, self.most = _Log(log_id, seed, programs=False, paths=False), seed, most
        self.part = 0
        self.begin(None, len(seed))

    def begin(self, state: bytes | None, width: int) -> None:
        self.state, self.width, self.first = state, width, self.log.submits
        self.place, self.made, self.told, self.events = 0, 0, 0, []

    def pack(self) -> tuple:
        head = (self.state, self.seed if not self.part else None) if not self.place else (None, None)
        row = (self.log.id, self.part, self.place, self.width, self.made - self.told, self.first, *head, _packed(self.events))
        self.place, self.told, self.events = self.place + 1, self.made, []
        return row

    def take(self, kind: str, payload: str | None, ts: str | None) -> Iterator[tuple]:
        self.events.append((kind, payload, ts))
        if block := self.log.take(kind, payload, ts):
            put, cut = block[7:9]
            self.made += 2 * self.log.size - put + cut
            if self.made > self.most or self.log.size > 2 * max(self.width, NARROW_CHARS):
                yield self.pack()
                self.part += 1
                self.begin(_packed(self.log.lines), self.log.size)
        if len(self.events) >= PACK_EVENTS:
            yield self.pack()

    def end(self) -> Iterator[tuple]:
        if self.events:
            yield self.pack()


def _cut(names: list[str], most: int):
    """Events in the order of their logs as packs of the parts of these."""

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        parts: _Parts | None = None
        for batch in batches:
            for log_id, kind, payload, ts, seed in zip(batch["log_id"], batch["kind"], batch["payload"], batch["ts"], batch["seed"]):
                if parts is None or parts.log.id != log_id:
                    if parts:
                        yield from parts.end()
                    parts = _Parts(log_id, seed or "", most)
                yield from parts.take(kind, payload, ts)
        if parts:
            yield from parts.end()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _handed_over(packs(batches), names, lambda row: sum(len(x) for x in row[6:] if x))

    return cut


def _replayed_parts(names: list[str], paths: bool):
    """Packs in the order of their parts as blocks with their programs."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, key = None, None

        def taken(batch: pd.DataFrame) -> Iterator[tuple]:
            nonlocal log, key
            for log_id, part, first, state, seed, events in zip(batch["log_id"], batch["part"], batch["first_index"], batch["state"], batch["seed"], batch["events"]):
                if key != (log_id, part):
                    log, key = _Log(log_id, seed if isinstance(seed, str) else "", True, paths), (log_id, part)
                    if isinstance(state, bytes):
                        log.resume(_unpacked(state), first)
                for event in _unpacked(events):
                    if row := log.take(*event):
                        yield row

        for batch in batches:
            yield from _handed_over(taken(batch), names, _row_chars)

    return fold


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    if "first_line" in names:
        frame["first_line"] = frame["first_line"].astype("Int32")
    return frame


def replayed_blocks(events: DataFrame, order: list[str], seed: Column | None = None, programs: bool = True, paths: bool = True) -> DataFrame:
    """One row per submit-bounded block: programs before and after, counts, and the path of its coarse steps.

    `events` has log_id, kind, payload, ts and the columns of `order`. A change that can't be applied leaves the
    buffer as it is and counts in n_rejected with the first reason. `seed` is the program a log starts from where
    its first change isn't at the very start. Events after the last submit give no row. All changes are replayed whatever
    is asked for; without `programs` there are no columns start_code and code, without `paths` no steps and steps_reason.
    With programs the parts of logs are written to the shared folder, and there are as many tasks as these parts' programs ask
    for: a writer may hold all rows of a task, as one that judges the size of rows by those before does where programs grow.
    """
    rows = events.where("log_id IS NOT NULL").select(
        "log_id", "kind", "payload", F.col("ts").cast("timestamp").alias("ts"), *[c for c in order if c not in ("log_id", "kind", "payload", "ts")],
        (seed if seed is not None else F.lit("")).alias("seed"),
    )
    laid = rows.where(F.col("kind").isin("change", "saida_testar", "submit")).repartition(tasks(events.sparkSession), "log_id").sortWithinPartitions("log_id", *order)
    left_out = {*(() if programs else ("start_code", "code")), *(() if paths else ("steps", "steps_reason"))}
    fields = [f for f in T._parse_datatype_string(_BLOCK).fields if f.name not in left_out]
    laid = laid.select("log_id", "kind", "payload", "ts", "seed")
    if not programs:
        return laid.mapInPandas(_fold([f.name for f in fields], programs, paths), T.StructType(fields))
    pack = T._parse_datatype_string(_PACK)
    packs = written(laid.withColumn("ts", F.unix_micros("ts").cast("string")).mapInPandas(_cut(pack.names, PART_CHARS), pack), "parts")
    n = max(tasks(events.sparkSession), (packs.agg(F.sum("chars")).first()[0] or 0) // PART_CHARS + 1)
    place = F.pmod(F.pmod(F.xxhash64("log_id"), F.lit(n)) + F.col("part"), F.lit(n)).cast("int")  # another task for each part of a log
    packs = packs.repartitionById(n, place).sortWithinPartitions(F.desc("width"), "log_id", "part", "place")
    micros = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "submit_ts" else f for f in fields])
    done = packs.mapInPandas(_replayed_parts([f.name for f in fields], paths), micros)
    return done.withColumn("submit_ts", F.timestamp_micros(F.col("submit_ts").cast("bigint")))


def snapshot_candidates(attempts: DataFrame, snapshots: DataFrame, keys: list[str], mode: str = "narrow") -> DataFrame:
    """(keys, attempt, candidates): for each attempt the sorted indexes of the snapshots with an equal program.

    `attempts` has attempt and code, `snapshots` submit_index and code; an attempt without any has an empty array.
    """
    a = attempts.select(*keys, "attempt", F.sha2(normalize_code(F.col("code"), mode), 256).alias("h"))
    s = snapshots.select(*keys, "submit_index", F.sha2(normalize_code(F.col("code"), mode), 256).alias("h"))
    return a.join(s, [*keys, "h"], "left").groupBy(*keys, "attempt").agg(F.array_sort(F.collect_list("submit_index")).alias("candidates"))


def monotonic_counts(candidates: list[list[int]], limit: int = 2) -> list[int]:
    """For each prefix of the lists the number of strictly increasing choices of one index from each list, at most `limit`."""
    ways: dict[int, int] = {-1: 1}
    out = []
    for options in candidates:
        before, k, total = sorted(ways.items()), 0, 0
        ways = {}
        for c in sorted(set(options)):
            while k < len(before) and before[k][0] < c:
                total += before[k][1]
                k += 1
            if total:
                ways[c] = min(limit, total)
        out.append(min(limit, sum(ways.values())))
    return out


def monotonic_count(candidates: list[list[int]], limit: int = 2) -> int:
    """`monotonic_counts` of all lists; 1 for none."""
    return monotonic_counts(candidates, limit)[-1] if candidates else 1


def unique_alignment(candidates: list[list[int]]) -> list[int] | None:
    """The only strictly increasing choice: the earliest and the latest one are the same; None if there is none or several."""
    early, last = [], -1
    for options in candidates:
        last = next((c for c in options if c > last), None)
        if last is None:
            return None
        early.append(last)
    late, first = [], None
    for options in reversed(candidates):
        first = next((c for c in reversed(options) if first is None or c < first), None)
        late.append(first)
    return early if early == late[::-1] else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unique_alignment_udf(candidates: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else unique_alignment([list(x) for x in c]) for c in candidates])


@F.pandas_udf(T.IntegerType())
def monotonic_count_udf(candidates: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else monotonic_count([list(x) for x in c]) for c in candidates], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def monotonic_counts_udf(candidates: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else monotonic_counts([list(x) for x in c]) for c in candidates])


def aligned(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alignment, status) of all attempts of the keys in order: matched, no_match or ambiguous."""
    per = candidates.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "candidates"))), lambda x: x["candidates"]).alias("c"))
    done = per.withColumn("alignment", unique_alignment_udf("c")).withColumn("n", monotonic_count_udf("c"))
    status = F.when(F.col("alignment").isNotNull(), "matched").when(F.col("n") == 0, "no_match").otherwise("ambiguous")
    return done.select(*keys, "alignment", status.alias("status"))


def prefix_alignments(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_attempts, status) for every prefix of the attempts, from one pass over them."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "candidates"))), lambda x: x["candidates"])
    per = candidates.groupBy(*keys).agg(rows.alias("c"))
    n = per.select(*keys, F.posexplode(monotonic_counts_udf("c")).alias("_k", "n")).withColumn("n_attempts", F.col("_k") + 1)
    return n.select(*keys, "n_attempts", F.when(F.col("n") == 1, "matched").when(F.col("n") == 0, "no_match").otherwise("ambiguous").alias("status"))


def transition_alignment(attempts: DataFrame, snapshots: DataFrame, keys: list[str], mode: str = "blank") -> DataFrame:
    """(keys, attempt, status, snap_n, snap_n1): pairs of snapshots i < j with the programs of attempts n and n + 1.

    `snapshots` has changes, the text of the edits that led to each; the edits between i and j are the signature.
    matched if all pairs with edits have one signature, else ambiguous; no_match_n or no_match_n1 without a pair.
    """
    a = attempts.select(*keys, "attempt", F.sha2(normalize_code(F.col("code_n"), mode), 256).alias("hn"), F.sha2(normalize_code(F.col("code_n1"), mode), 256).alias("hn1"))
    s = snapshots.select(*keys, "submit_index", "changes", F.sha2(normalize_code(F.col("code"), mode), 256).alias("h"))
    n = s.select(*keys, F.col("submit_index").alias("i"), F.col("h").alias("hn"))
    n1 = s.select(*keys, F.col("submit_index").alias("j"), F.col("h").alias("hn1"))
    every = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("submit_index", "changes"))).alias("all"))
    met = a.join(n, [*keys, "hn"], "left").join(n1, [*keys, "hn1"], "left").join(every, keys, "left")
    between = F.filter("all", lambda x: (x["submit_index"] > F.col("i")) & (x["submit_index"] <= F.col("j")))
    text = F.array_join(F.transform(between, lambda x: x["changes"]), "")
    met = met.withColumn("sig", F.when((F.col("j") > F.col("i")) & (text != ""), F.sha2(text, 256)))
    out = met.groupBy(*keys, "attempt").agg(
        F.count_distinct("sig").alias("n"), F.max(F.col("i").isNotNull().cast("int")).alias("any_n"),
        F.min(F.when(F.col("sig").isNotNull(), F.struct("i", "j"))).alias("first"),
    )
    status = F.when(F.col("any_n") == 0, "no_match_n").when(F.col("n") == 0, "no_match_n1").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return out.select(*keys, "attempt", status.alias("status"), F.when(F.col("n") == 1, F.col("first.i")).alias("snap_n"), F.when(F.col("n") == 1, F.col("first.j")).alias("snap_n1"))

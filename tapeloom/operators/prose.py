"""Collections of short texts: TF-IDF similarity, templates, n-grams, entropy, terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import words as W
from tapeloom.shared import first_rows, tasks, written


def weights(docs: DataFrame, doc: list[str], text: str) -> DataFrame:
    """(doc, token, w): L2-normalised TF-IDF with idf ln((1 + N) / (1 + df)) + 1; texts without words have no row."""
    tokens = docs.select(*doc, F.explode(W.word_list(F.col(text))).alias("token"))
    tf = tokens.groupBy(*doc, "token").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.where(F.col(text).isNotNull()).count()  # one number
    raw = tf.join(df, "token").withColumn("x", F.col("n") * (F.log((1.0 + total) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(*doc).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, doc).select(*doc, "token", (F.col("x") / F.col("norm")).alias("w"))


def mean_similarity(w: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_docs, n_pairs, sum_similarity, mean_similarity) over all unordered pairs of texts of a group.

    The square of the summed vectors holds the cosine of every pair twice and each text's own once, so that no pair
    is ever made: the work is linear in the words. `w` is `weights` with the columns `keys` and `doc`.
    """
    keyed = w.withColumn("_all", F.lit(1))
    k = keys or ["_all"]
    sums = keyed.groupBy(*k, "token").agg(F.sum("w").alias("s")).groupBy(*k).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = keyed.groupBy(*k).agg(F.count_distinct("doc").alias("n_docs"))
    both = sums.join(n, k).withColumn("n_pairs", (F.col("n_docs") * (F.col("n_docs") - 1) / 2).cast("bigint"))
    total = (F.col("q") - F.col("n_docs")) / 2
    out = both.select(*k, "n_docs", "n_pairs", total.alias("sum_similarity"), F.when(F.col("n_pairs") > 0, total / F.col("n_pairs")).alias("mean_similarity"))
    return out if keys else out.drop("_all")


def word_lists(docs: DataFrame, keys: list[str], doc: str, text: str) -> DataFrame:
    """(keys, doc, words, weights): the `weights` of each text with words as two arrays, written once. Words are numbers;
    those of one text alone meet nothing and are left out, but count in its length. `doc` is unique."""
    texts = docs.where(F.col(text).isNotNull()).select(*keys, doc, text).withColumn("_id", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    total = texts.count()  # one number
    # texts are sent to their group before they are cut, as words they are many times as long
    tf = texts.repartition("_id").select("_id", F.explode(W.word_list(F.col(text))).alias("token")).groupBy("_id", "token").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = written(df.withColumn("word", F.monotonically_increasing_id()), "words")
    idf = F.log((1.0 + total) / (1 + F.coalesce("df", F.lit(1)))) + 1
    raw = tf.join(shared, "token", "left").select("_id", "word", (F.col("n") * idf).alias("x"))
    some = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "x")))
    per = raw.groupBy("_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), some.alias("e"))
    lists = texts.select("_id", *keys, doc).join(per, "_id")
    norm = F.transform("e", lambda e: e["x"] / F.col("norm"))
    return written(lists.select(*keys, doc, F.col("e.word").alias("words"), norm.alias("weights")), "lists")


#: Texts, and words of texts, on each side of a tile, about; queries at a time; bytes of their table of weights.
TILE, TILE_WORDS, WIDTH, TABLE = 2_048, 1 << 17, 256, 1 << 26


def _tiles(queries: DataFrame, lists: DataFrame, keys: list[str], size: int = 1) -> DataFrame:
    """Shards of the queries beside shards of the texts, by (keys, _d, _q): rows (doc, words, weights, query). Each text is
    sent once for each shard of queries, and each query once for each shard of texts; `size` times `TILE` texts are a shard."""
    words = F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")
    n = lambda x: max(1, -(-x["n"] // (size * TILE)), -(-x["words"] // (size * TILE_WORDS)))
    n_d, n_q = (n(x.agg(F.count(F.lit(1)).alias("n"), words).first()) for x in (lists, queries))
    shard = lambda n: F.pmod(F.xxhash64("doc"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    take = [*keys, "doc", "words", "weights"]
    d = lists.select(*take, F.lit(False).alias("query"), shard(n_d).alias("_d"), every(n_q).alias("_q"))
    q = queries.select(*take, F.lit(True).alias("query"), every(n_d).alias("_d"), shard(n_q).alias("_q"))
    # a tile is small but long: tiles aren't put together by bytes
    return d.unionByName(q).repartition(4 * tasks(lists.sparkSession), *keys, "_d", "_q")


def _side(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of the texts in their order, where each one's words begin, words and weights."""
    rows = rows.sort_by("doc")
    words, weights = (rows[c].combine_chunks() for c in ("words", "weights"))
    starts = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return rows["doc"].to_pylist(), starts, words.flatten().to_numpy(), weights.flatten().to_numpy()


def _similarities(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The similarities of a tile's texts, one a row, with some queries at a time: the first one's place and a table; 0 where
    no word is shared and for a text with itself. A word's weights in the queries are a row that the texts add up."""
    asked = rows["query"].combine_chunks()
    (q, q_at, q_word, q_w), (d, d_at, d_word, d_w) = _side(rows.filter(asked)), _side(rows.filter(pc.invert(asked)))
    row = {doc: k for k, doc in enumerate(d)}
    first = 0
    while first < len(q):
        width = min(WIDTH, len(q) - first)
        while width > 1 and (q_at[first + width] - q_at[first]) * width * 8 > TABLE:
            width //= 2
        part = slice(q_at[first], q_at[first + width])
        known, at = np.unique(q_word[part], return_inverse=True)
        table = np.zeros((len(known), width))
        table[at, np.repeat(np.arange(width), np.diff(q_at[first : first + width + 1]))] = q_w[part]
        out = np.zeros((len(d), width))
        if len(known):
            place = np.minimum(np.searchsorted(known, d_word), len(known) - 1)
            hit = known[place] == d_word
            starts = np.concatenate(([0], np.cumsum(hit)))[d_at]
            place, w = place[hit], d_w[hit]
            for k in range(len(d)):
                a, b = starts[k], starts[k + 1]
                if a < b:
                    np.dot(w[a:b], table[place[a:b]], out=out[k])
        for k in range(width):
            if q[first + k] in row:
                out[row[q[first + k]], k] = 0.0
        yield first, out
        first += width


def similarity_to(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(query, doc, similarity) of a stated set of queries with all texts they share a word with, themselves left out.

    Both are rows of `word_lists`. Shards of both sides meet in tiles, whose similarities are added up where they are:
    a row is made for each pair, not for each word that a pair shares.
    """

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        d = rows.filter(pc.invert(rows["query"])).sort_by("doc")["doc"].combine_chunks()
        parts = [out for _, out in _similarities(rows)]
        out = np.hstack(parts) if parts else np.zeros((len(d), 0))
        starts = pa.array(np.arange(len(d) + 1, dtype=np.int32) * out.shape[1], pa.int32())
        return pa.table({"_q": pa.array([key[1].as_py()] * len(d), pa.int64()), "doc": d, "s": pa.ListArray.from_arrays(starts, pa.array(out.ravel()))})

    tiles = _tiles(queries, lists, [])
    names = tiles.where("query AND _d = 0").groupBy("_q").agg(F.array_sort(F.collect_list("doc")).alias("names"))
    met = tiles.groupBy("_d", "_q").applyInArrow(tile, "_q bigint, doc string, s array<double>").join(F.broadcast(names), "_q")
    each = met.select("doc", F.explode(F.arrays_zip("names", "s")).alias("x"))
    return each.select(F.col("x.names").alias("query"), "doc", F.col("x.s").alias("similarity")).where("similarity > 0")


#: Parts into which [0, 1] is cut to find where a median lies.
BINS = 1 << 16


def similarity_statistics(queries: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, median, sd) of the similarities that `similarity_to` has within each group of `keys`, without its rows.

    A first pass adds up each tile's moments and numbers per bin, a second one counts the values in the bins that hold the
    middle ones: all are exact. Rows with a null key are in no group.
    """
    live = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    tiles = _tiles(queries.where(live), lists.where(live), keys, 4)
    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in keys)
    named = lambda key, n: {c: pa.array([v.as_py()] * n) for c, v in zip(keys, key)}

    def moments(key: tuple, rows: pa.Table) -> pa.Table:
        counts, parts = np.zeros(BINS, dtype=np.int64), []
        for _, out in _similarities(rows):
            s = out[out > 0]
            if len(s):
                counts += np.bincount(np.minimum((s * BINS).astype(np.int64), BINS - 1), minlength=BINS)
                parts.append((len(s), s.mean(), s.var() * len(s)))
        n, mean, rest = (np.array([p[k] for p in parts], dtype=float) for k in range(3))
        total = n.sum()
        middle = (n * mean).sum() / max(total, 1)
        full = np.flatnonzero(counts)
        lists_of = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        return pa.table({**named(key, 1), "n": pa.array([int(total)], pa.int64()), "mean": pa.array([float(middle)]),
                         "m2": pa.array([float(rest.sum() + (n * (mean - middle) ** 2).sum())]), "bins": lists_of(full), "counts": lists_of(counts[full])})

    first = written(tiles.groupBy(*keys, "_d", "_q").applyInArrow(moments, f"{kinds}, n bigint, mean double, m2 double, bins array<bigint>, counts array<bigint>"), "moments").where("n > 0")
    whole = first.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = first.select(*keys, "m2", F.col("mean").alias("m"), F.col("n").alias("k")).join(whole, keys).groupBy(*keys, "n", "mean")
    whole = spread.agg(F.sqrt(F.sum(F.col("m2") + F.col("k") * F.pow(F.col("m") - F.col("mean"), F.lit(2))) / F.col("n")).alias("sd"))
    per_bin = first.select(*keys, F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy(*keys, "x.bins").agg(F.sum("x.counts").alias("k"))
    up_to = per_bin.withColumn("upto", F.sum("k").over(Window.partitionBy(*keys).orderBy("bins"))).join(whole, keys)
    middle = lambda add: F.floor((F.col("n") + add) / 2)  # noqa: E731  the places of the two middle ones, from 1
    within = up_to.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= middle(k), F.col("bins"))).alias(c) for k, c in ((1, "low"), (2, "high"))])
    # a row for each group; some more than the bins, since a sum of another order may lie beside its bin
    spans = {tuple(r[c] for c in keys): (r["low"] / BINS - 1e-9, (r["high"] + 1) / BINS + 1e-9) for r in within.collect()}

    def values(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = spans.get(tuple(v.as_py() for v in key[: len(keys)]), (2.0, 2.0))
        if high > 1:
            high = np.inf  # the last bin holds all above it, too
        below, found = 0, [np.zeros(0)]
        for _, out in _similarities(rows):
            below += int(((out > 0) & (out < low)).sum())
            found.append(out[(out > 0) & (out >= low) & (out <= high)])
        s, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({**named(key, len(s) + 1), "s": pa.array([None, *s.tolist()], pa.float64()), "k": pa.array([below, *n.tolist()], pa.int64())})

    second = tiles.groupBy(*keys, "_d", "_q").applyInArrow(values, f"{kinds}, s double, k bigint").groupBy(*keys, "s").agg(F.sum("k").alias("k"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("s"))
    ranked = second.withColumn("upto", F.sum("k").over(order)).where("s IS NOT NULL").join(whole, keys)
    half = [F.min(F.when(F.col("upto") >= middle(k), F.col("s"))) for k in (1, 2)]
    return ranked.groupBy(*keys, "n", "mean", "sd").agg(((half[0] + half[1]) / 2).alias("median")).select(*keys, "n", "mean", "median", "sd")


def top_terms(docs: DataFrame, keys: list[str], terms: Column, k: int = 25) -> DataFrame:
    """(keys, term, n, place) of the k commonest elements of an array column, ties by the term."""
    counts = docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, keys, [F.desc("n"), "term"], k)


def document_frequency(docs: DataFrame, keys: list[str], doc: str, terms: Column) -> DataFrame:
    """(keys, term, df) of the distinct elements of an array column."""
    return docs.select(*keys, doc, F.explode(F.array_distinct(terms)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def template_phrases(docs: DataFrame, group: list[str], doc: str, text: str, low: int = 3, high: int = 6, least: int = 3, share: float = 0.5) -> DataFrame:
    """(group, term, df): n-grams in at least `share` of a group's texts, in groups of `least` texts or more, without
    those that stand inside a longer one of the group."""
    sized = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)
    df = document_frequency(docs, group, doc, W.distinct_ngrams(W.word_list(F.col(text)), low, high))
    common = df.join(sized, group).where(F.col("df") >= share * F.col("n_docs"))
    # a phrase inside a longer one of n words is inside one of its parts of n - 1 words: all parts are marked
    words = F.split("term", " ")
    inner = F.array_except(F.concat(*[W.ngrams(words, n) for n in range(low, high + 1)]), F.array("term"))
    covered = common.select(*group, F.explode(inner).alias("term")).distinct()
    return common.join(covered, [*group, "term"], "left_anti").select(*group, "term", "df", "n_docs")


def template_coverage(docs: DataFrame, group: list[str], doc: str, text: str, phrases: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """(doc, n_words, covered): how many words of each text lie in one of the phrases (group, term) of its group, of low to
    high words. Texts of groups without phrases, null ones and ones without words included.

    Every n-gram of a text meets the phrases by an equi-join, so that the work is linear in the words.
    """
    words = docs.select(*group, doc, W.word_list(F.col(text)).alias("w"))

    def placed(t: Column, n: int) -> Column:
        return F.transform(W.ngrams(t, n), lambda g, i: F.struct(g.alias("term"), i.alias("at"), F.lit(n).alias("n")))

    grams = W.bound(F.col("w"), lambda t: F.concat(*[placed(t, n) for n in range(low, high + 1)]))
    spots = words.select(*group, doc, F.explode(grams).alias("x")).select(*group, doc, "x.*")
    hit = spots.join(phrases.select(*group, "term").distinct(), [*group, "term"], "left_semi")
    places = hit.select(doc, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("place")).distinct()
    covered = places.groupBy(doc).agg(F.count(F.lit(1)).alias("covered"))
    size = F.coalesce(F.size("w"), F.lit(0)).cast("bigint")
    return words.select(doc, size.alias("n_words")).join(covered, doc, "left").select(doc, "n_words", F.coalesce("covered", F.lit(0)).alias("covered"))


def only_in(left: DataFrame, right: DataFrame, doc: str, text: str, least: int = 5) -> DataFrame:
    """(term, df): phrases in at least `least` texts of the left side and in none of the right."""
    a = document_frequency(left, [], doc, W.phrase_candidates(W.word_list(F.col(text)))).where(F.col("df") >= least)
    b = right.select(F.explode(W.phrase_candidates(W.word_list(F.col(text)))).alias("term")).distinct()
    return a.join(b, "term", "left_anti")


def overlap_with(docs: DataFrame, doc: list[str], text: str, reference: DataFrame, reference_text: str, low: int = 3, high: int = 6) -> DataFrame:
    """(doc, n_ngrams, n_shared, share): how many distinct n-grams of a text stand in a reference collection."""
    grams = lambda c: W.distinct_ngrams(W.word_list(F.col(c)), low, high)
    mine = docs.select(*doc, F.explode(grams(text)).alias("g"))
    theirs = reference.select(F.explode(grams(reference_text)).alias("g")).distinct().withColumn("hit", F.lit(1))
    return mine.join(theirs, "g", "left").groupBy(*doc).agg(F.count(F.lit(1)).alias("n_ngrams"), F.count("hit").alias("n_shared")).withColumn(
        "share", F.col("n_shared") / F.col("n_ngrams"))


def next_word_counts(docs: DataFrame, keys: list[str], text: str, opening: Sequence[str]) -> DataFrame:
    """(keys, word, n): the words after a fixed opening of a text."""
    t = W.word_list(F.col(text))
    fits = F.slice(t, 1, len(opening)) == F.array(*map(F.lit, opening))
    return docs.where(fits).select(*keys, F.get(t, len(opening)).alias("word")).where("word IS NOT NULL").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def term_rates(docs: DataFrame, keys: list[str], text: str, families: dict[str, str]) -> DataFrame:
    """(keys, family, hits, docs_with_any, per_1000): regex families over all texts of a group."""
    t = F.size(W.word_list(F.col(text)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.regexp_count(text, F.lit(W.bounded(p))).alias("h")) for k, p in families.items()]))
    rows = docs.where(F.col(text).isNotNull()).select(*keys, t.alias("n"), each.alias("x"))
    return rows.groupBy(*keys, "x.family").agg(
        F.sum("x.h").alias("hits"), F.count_if(F.col("x.h") > 0).alias("docs_with_any"), W.terms_per_thousand(F.sum("x.h"), F.sum("n")).alias("per_1000")
    )


def weight_maps(w: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, weights): the weights of each text's tokens as a map in the order of the tokens. `w` is `weights`; a text's tokens are held together."""
    return w.groupBy(*doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "w")))).alias("weights"))

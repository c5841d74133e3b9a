import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import abuse, bpe, neardup, packing, runs, spans, terms
from tapeloom.shared import shared_path

START = datetime(2024, 3, 4, 8)


# 1: frequencies
def test_terms_against_counting(spark):
    rng = random.Random(2)
    words = ["a", "b_1", "É", "é", "x" * 300, "été", "日本", "½"]
    rows = [(f" r{rng.randrange(40)} ", " ".join(rng.choices(words, k=rng.randrange(8)))) for _ in range(300)]
    rows += [(None, "a a"), ("r1", None), ("r2", ""), ("hot", "a " * 5000)]
    df = spark.createDataFrame(rows, "custom_id string, summary string").withColumn("term", F.lit(1)).withColumn("r", F.lit("z"))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.field_terms(df, "summary", terms.words, 0.4).collect()}
    occ, rec, ids = Counter(), {}, set()
    for r, x in rows:
        if r is not None:
            ids.add(r.strip())
            for w in terms.words(x or ""):
                occ[w] += 1
                rec.setdefault(w, set()).add(r.strip())
    want = {w: (occ[w], len(rec[w]), "rare" if len(rec[w]) <= 2 else "common" if len(rec[w]) > 0.4 * len(ids) else None) for w in occ}
    assert got == want


def test_values_and_empty_tables(spark):
    assert terms.whole_value("  Fix  the\tLOOP ") == ["fix the loop"] and terms.whole_value("  ") == []
    df = spark.createDataFrame([], "custom_id string, label string")
    assert terms.field_terms(df, "label", terms.whole_value, 0.1).count() == 0


def test_a_term_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("r"), F.lit("a b").alias("x"))
    got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, "r", "x", terms.words, partitions=7).collect()}
    assert got == {"a": (5000, 1000), "b": (5000, 1000)}


# 2: spans
def shared_brute(rows, n):
    first, shared = {}, set()
    clean = [(r.strip(), x) for _, r, x in rows if r is not None and x is not None]
    for r, x in clean:
        for i in range(len(x) - n + 1):
            if first.setdefault(x[i : i + n], r) != r:
                shared.add(x[i : i + n])
    out = {}
    for r, x in clean:
        covered = set()
        for i in range(len(x) - n + 1):
            if x[i : i + n] in shared:
                covered |= set(range(i, i + n))
        out[r] = out.get(r, 0) + len(covered)
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 20), (2, 21), (3, 33)])
def test_spans_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    draw = lambda k: "".join(rng.choices("abcdeé😀 ", k=k))
    pool = [draw(rng.choice([n - 1, n, n + 1, 2 * n, 5 * n])) for _ in range(12)]
    rows = []
    for k in range(60):
        text = "".join(rng.choice([draw(rng.randrange(40)), rng.choice(pool)]) for _ in range(rng.randrange(4)))
        rows.append((k, f" c{rng.randrange(30)}", text))
    rows += [(90, None, pool[-1] * 3), (91, "n", None), (92, "e", ""), (93, "same", "z" * 500), (94, "same ", "z" * 500), (95, "zz", "z" * (n - 1))]
    df = spark.createDataFrame(rows, "delivery_id bigint, custom_id string, summary string").withColumn("h", F.lit(0)).withColumn("id", F.lit("q"))
    want = shared_brute(rows, n)
    got = {r.record: r.shared_chars for r in spans.shared_characters(df, "delivery_id", "custom_id", "summary", n).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    ids = {r.id for r in spans.sharing_rows(df, "delivery_id", "custom_id", "summary", n).collect()}
    assert {r.strip() for i, r, _ in rows if i in ids} == {k for k, v in want.items() if v}


def test_a_third_of_all_rows_with_one_passage(spark):
    passage = "".join(chr(97 + k * k % 26) for k in range(200))
    rows = [(k, f"c{k}", f"{k} " * 30 + passage if k % 3 == 0 else f"{k} nothing " * 40) for k in range(900)]
    df = spark.createDataFrame(rows, "i bigint, c string, t string")
    assert {r.id for r in spans.sharing_rows(df, "i", "c", "t").collect()} == set(range(0, 900, 3))


def test_index_is_incremental_and_compacted(spark):
    text = "".join(chr(97 + k * 7 % 25) for k in range(90)) + "#" + "".join(chr(97 + k * k % 23) for k in range(90))
    batch = lambda *rows: spark.createDataFrame(rows, "record string, text string")
    index = spans.SpanIndex(spark, 40, fanout=2)
    assert index.add(batch(("a", text))).count() == 0
    assert index.add(batch(("a", text))).count() == 0
    assert [len(x) for x in index.levels] == [0, 1]
    assert index.add(batch(("b", text[30:120]))).count() > 0
    index.close()
    assert not index.runs() and not spans._files(spark, index.path)


def test_a_kept_index_goes_on_in_another_session(spark):
    text = "".join(chr(97 + k * 7 % 25) for k in range(90)) + "#" + "".join(chr(97 + k * k % 23) for k in range(90))
    batch = lambda s, *rows: s.createDataFrame(rows, "record string, text string")
    path = shared_path(spark, "kept-index")
    first = spans.SpanIndex(spark, 40, fanout=2, path=path)
    first.add(batch(spark, ("a", text), ("x", "nothing of it " * 9)))
    first.add(batch(spark, ("q", "other words " * 12)))
    first.add(batch(spark, ("r", "more of them " * 12)))
    first.close()
    other = spark.newSession()
    again = spans.SpanIndex.open(other, path)
    assert [len(x) for x in again.levels] == [1, 1] and again.min_chars == 40
    found = again.add(batch(other, ("b", text[20:130])))
    plans = [other.table(r)._jdf.queryExecution().toString() for r in again.runs()]
    assert found.count() > 0 and all("kept-index" in p for p in plans)
    assert again.add(batch(other, ("c", "new text entirely, seen nowhere " * 4))).count() == 0
    assert [len(x) for x in spans.SpanIndex.open(other, path).levels] == [len(x) for x in again.levels]
    again.close()
    with pytest.raises(ValueError):
        spans.SpanIndex.open(other, path + "-none")
    with pytest.raises(ValueError):
        spans.SpanIndex(other, 40, path=path)


def test_no_texts(spark):
    df = spark.createDataFrame([], "i bigint, c string, t string")
    assert spans.sharing_rows(df, "i", "c", "t").count() == 0 and spans.shared_characters(df, "i", "c", "t").count() == 0


# 3: runs
def runs_brute(rows, gap):
    out, by = [], {}
    for ent, sym, t, o, i in rows:
        if ent is not None and t is not None:
            by.setdefault(ent, []).append((t, -1 if o is None else o, i, sym))
    for ent, events in by.items():
        events.sort()
        run = []
        for e in events:
            if run and (e[3] is None or e[3] != run[-1][3] or e[0] - run[-1][0] > gap):
                out.append((str(ent), run[0][3], run[0][2], run[-1][2], len(run)))
                run = []
            run.append(e)
        out.append((str(ent), run[0][3], run[0][2], run[-1][2], len(run)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(700):
        t += rng.choice([0, 0, 1_000_000, 2_000_000, 2_000_001])
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["a", "a", "a", "b", "", None]), None if rng.random() < 0.02 else t, rng.choice([1, 2, None]), i))
    df = spark.createDataFrame(rows, "e int, s string, us bigint, o int, event_id bigint").withColumn("part", F.lit(3)).withColumn("sym", F.lit(""))
    got = runs.collapsed_runs(df, F.col("e"), F.col("s"), F.col("us"), F.col("o"), "event_id", partitions=6)
    assert sorted((tuple(r) for r in got.select("entity", "symbol", "first_event_id", "last_event_id", "n_events").collect()), key=str) == runs_brute(rows, 2_000_000)


def test_one_run_over_all_partitions_and_no_events(spark):
    df = spark.range(5000).select(F.lit(1).alias("e"), F.lit("k").alias("s"), (F.col("id") * 1000).alias("us"), F.col("id").alias("event_id"))
    args = (F.col("e"), F.col("s"), F.col("us"), F.lit(0), "event_id")
    got = runs.collapsed_runs(df, *args, min_run=5, partitions=9).collect()
    assert [(r.first_event_id, r.last_event_id, r.n_events) for r in got] == [(0, 4999, 5000)]
    assert runs.collapsed_runs(df.limit(0), *args).count() == 0


def test_spelling_repeats_and_time_formats(spark):
    times = ["2024-03-04T08:00:00", "2024-03-04 08:00:01.5", "1709539203", "2024-03-04T08:00:05Z", "never", None]
    us = [r.t for r in spark.createDataFrame([(t,) for t in times], "x string").select(runs.event_time_us(F.col("x")).alias("t")).collect()]
    base = 1709539200_000_000
    assert us == [base, base + 1_500_000, base + 3_000_000, base + 5_000_000, None, None]
    rows = [(1, 7, " Run ", START), (1, 7, "run", START), (2, 7, "RUN", START + timedelta(seconds=2)), (3, 7, None, START + timedelta(seconds=3))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "event_id bigint, log_id bigint, raw_type string, event_ts timestamp, line_number bigint")
    assert sorted((r.first_event_id, r.last_event_id, r.n_events) for r in runs.raw_type_runs(df).collect()) == [(1, 2, 2), (3, 3, 1)]


# 4: near-duplicates
def similar(a, b):
    x, y = (Counter(re.findall(r"\w+", t.lower())) for t in (a, b))
    s = sum((x & y).values())
    return s / (x.total() + y.total() - s)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["for", "in", "print"] * 5
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 20, 60]))
        for _ in range(rng.randrange(1, 4)):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", ", "]).join(copy))
    texts += [None, "", " \n", "?!", texts[0], texts[0].upper(), "long " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "cid bigint, code string").withColumn("id", F.lit("x")).withColumn("block", F.lit(1))
    got = {tuple(r) for r in neardup.near_duplicate_rows(df, "cid", "code").collect()}
    live = [(k, t) for k, t in enumerate(texts) if t and re.search(r"\w", t)]
    want = {(i, j) for i, a in live for j, b in live if i < j and similar(a, b) >= 0.75}
    assert got == want
    links = {r.id: (r.class_id, r.copies) for r in neardup.near_duplicate_links(df, "cid", "code").collect()}
    assert set(links) == {k for k, _ in live} and links[len(texts) - 2] == links[0]


@pytest.mark.parametrize(("n", "copies"), [(120, 12), (600, 12), (1_500, 12), (2_000, 12), (12_000, 10), (50_000, 4)])
def test_no_close_pair_of_long_texts_is_lost(spark, n, copies):
    rng = random.Random(n)
    texts = []
    for k in range(copies):
        words = [f"{k}_{j}" for j in range(n)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        same = int(0.86 * n)  # similarity 0.86 / 1.14 = 0.754: as far apart as may be, the differences spread evenly
        swapped = [f"z{k}_{j}" if j * (n - same) // n != (j + 1) * (n - same) // n else w for j, w in enumerate(words)]
        texts.append(" ".join(swapped))
        longer = words + [f"y{k}_{j}" for j in range(int(n / 0.751) - n)]  # the same by insertions only
        texts.append(" ".join(longer))
    df = spark.createDataFrame(list(enumerate(texts)), "cid bigint, code string").repartition(8)
    got = {tuple(r) for r in neardup.near_duplicate_rows(df, "cid", "code").collect()}
    want = {(3 * k, 3 * k + d) for k in range(copies) for d in (1, 2)}
    print(f"{n} words: recall {len(got & want) / len(want)}")
    assert got == want


def test_texts_with_too_few_blocks_meet_on_elements(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):
        words = [f"{k}_{j}" for j in range(rng.choice([3, 7, 30, 90]))]
        texts += [" ".join(words), " ".join(words[1:] + ["new"])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "class_id bigint, x string")
    got = {(r.class_a, r.class_b) for r in neardup.close_classes(df, 0.75, blocks=8).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similar(a, b) >= 0.75}


def test_no_programs(spark):
    assert neardup.near_duplicate_rows(spark.createDataFrame([], "i bigint, c string"), "i", "c").count() == 0


# 7: encoding
TEXTS = ["", None, "Hello, world! it's 2024", " \n\t  x ", "<|endoftext|> is text", "é" * 50, "日本語のテキスト", "😀" * 20, "a" * 30_000, "=-" * 5_000, " " * 9_000 + "end", "don't  'll x"]


def test_ids_are_those_of_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{bpe.tokenizer_folder()}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: (r.ids, r.n_tokens) for r in bpe.encoded(rows).collect()}
    for k, t in enumerate(TEXTS):
        want = public.encode(t, add_special_tokens=False).ids if t else []
        assert got[k] == (want, len(want))
    assert bpe.encoded(rows.limit(0)).count() == 0


def test_round_trip():
    ranks = bpe.read_ranks(bpe.vocabulary_file())
    back = {v: k for k, v in ranks.items()}
    encoder = bpe.Encoder(ranks)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(chr(rng.choice([32, 97, 98, 101, 233, 10, 0x4E2D, 0x1F600, 48])) for _ in range(rng.randrange(60)))
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == text


def test_rank_queue_order():
    q = bpe.RankQueue(50_000)
    for rank, at in [(40_000, 5), (3, 9), (40_000, 1), (300, 2), (3, 4)]:
        q.push(rank, at)
    assert [q.pop() for _ in range(3)] == [(3, [4, 9]), (300, [2]), (40_000, [1, 5])] and not q


# 8: packing
def test_best_filling_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        used = packing.best_filling(counts, room)
        sums = {0}
        for s, c in counts.items():
            sums = {x + k * s for x in sums for k in range(c + 1) if x + k * s <= room}
        assert sum(s * k for s, k in used.items()) == max(sums) and all(k <= counts[s] for s, k in used.items())


def test_containers_hold_everything(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 5, 100, 100, 100, 333, 512, 2048, 2049, 5000]) for _ in range(3000)] + [None, -1]
    df = spark.createDataFrame([(k, s, 0) for k, s in enumerate(sizes)], "doc_id bigint, n_tokens int, shard int")
    rows = packing.packed(df).collect()
    filled, parts = Counter(), Counter()
    for r in rows:
        filled[r.container_id] += r.n_tokens
        parts[r.doc_id] += r.n_tokens
        assert r.part_no == 0 or sizes[r.doc_id] > 2048
    total = sum(s for s in sizes if s and s > 0)
    assert max(filled.values()) <= 2048 and parts == Counter({k: s for k, s in enumerate(sizes) if s and s > 0})
    assert sorted(filled) == list(range(len(filled))) and len(filled) <= 1.01 * total / 2048 + 1
    assert packing.packed(df.limit(0)).count() == 0


# 9: abuse
GOOD = ["The loop in line {} never ends.", "Case {} fails on my laptop.", "I think the counter {} starts too late.", "This loop {} is useless, drop it.", "Kill process {} before the run."]
BAD = ["You are a worthless idiot and group {} knows it.", "Shut up, you filthy moron of row {}.", "Go home to your cage, people like you ruin lab {}."]


def made(rng, bad):
    parts = [rng.choice(GOOD).format(rng.randrange(99)) for _ in range(rng.randrange(2, 6))]
    if bad:
        parts.insert(rng.randrange(len(parts)), rng.choice(BAD).format(rng.randrange(99)))
    return " ".join(parts)


def labelled_corpus(spark, rng, n_bad=120, n_clean=200, n_other=600):
    texts = [(made(rng, True), 1) for _ in range(n_bad)] + [(made(rng, False), 0) for _ in range(n_clean)] + [(made(rng, rng.random() < 0.05), None) for _ in range(n_other)]
    return [t for t, _ in texts], [(k, y) for k, (_, y) in enumerate(texts) if y is not None]


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    seen, labels = labelled_corpus(spark, rng)
    truth = [rng.random() < 0.3 for _ in range(300)]
    texts = [made(rng, t) for t in truth] + [None, "", " \n", "x " * 50_000, "YOU ARE A W0RTHLESS IDI\u200bOT AND GROUP 7 KNOWS IT"]
    docs = spark.createDataFrame([(k, t, "s", 1.0) for k, t in enumerate(seen + texts)], "doc_id bigint, text string, source string, shard double")
    cut = abuse.prepared(docs, shard_texts=300)
    assert cut.select("shard").distinct().count() > 2
    model = abuse.trained(cut, spark.createDataFrame(labels, "doc_id bigint, abusive int").withColumn("words", F.lit(1)), rounds=3)
    got = {r.doc_id - len(seen): r for r in abuse.scored(cut, model).collect()}
    print("held-out accuracy", np.mean([got[k].flagged == t for k, t in enumerate(truth)]), model.notes)
    assert np.mean([got[k].flagged == t for k, t in enumerate(truth)]) > 0.97
    assert not any(got[k].flagged for k in range(300, 304)) and got[304].flagged
    rate = abuse.rates(docs, abuse.scored(cut, model)).first()
    assert rate.n_documents == len(seen) + len(texts) and rate.n_flagged == sum(r.flagged for r in got.values())
    path = shared_path(spark, "abuse-model")
    abuse.save(spark, model, path)
    again = {r.doc_id - len(seen): r for r in abuse.scored(cut, abuse.load(spark, path)).collect()}
    assert again == got


def test_no_labels_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "x"), (None, "y z"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 1)], "doc_id bigint, abusive int")
    cut = abuse.prepared(docs)
    assert [r.flagged for r in abuse.scored(cut, abuse.trained(cut, labels)).collect()] == [False] * 3
    none = abuse.prepared(docs.limit(0))
    assert abuse.scored(none, abuse.trained(none, labels)).count() == 0
    assert abuse.scored(cut, abuse.trained(cut, labels.limit(0))).count() == 3


def test_windows_scores_and_gradients():
    rng = np.random.default_rng(3)
    forms = abuse._Forms()
    texts = ["a b c. d", "", " ".join(f"w{k}" for k in range(40)) + "! " + " ".join("xyz" * 1 for _ in range(16)), "one two " * 30, "?"]
    cut = abuse.Cut(*abuse.numbered(texts, forms))
    spelled = [[abuse._Forms()[w] for w in re.findall(r"\w+", p)] for t in texts for p in re.split(r"[.!?]+", t)]
    assert cut.words.tolist() == [x for p in spelled if p for x in (1, *p, 2)] and cut.parts_of_text.tolist() == [2, 0, 2, 1, 0]
    words = [b - a - int(cut.mark[a]) - int(cut.mark[b - 1]) for a, b in zip(cut.start, cut.stop)]
    assert max(words) <= abuse.WINDOW + abuse.STRIDE // 2 and set(np.concatenate([np.arange(a, b) for a, b in zip(cut.start, cut.stop)])) == set(range(len(cut.words)))
    w, g = rng.normal(size=1 << abuse.FEATURE_BITS), rng.normal(size=len(cut.start))
    rows = abuse._Rows(*cut.expanded(np.arange(len(cut.start))))
    ratio = np.sqrt(rows.size) * cut.scale  # windows at an end count their marks' words too
    every = np.arange(len(cut.start))
    summed = lambda f, x: np.bincount(f, weights=x, minlength=1 << abuse.FEATURE_BITS)
    assert np.allclose(cut.scores(w, 0.5) - 0.5, (rows.scores(every, w, 0.5) - 0.5) * ratio)
    assert np.allclose(cut.gradient(g, 0, len(g)), summed(*rows.slopes(every, g * ratio)))
    part = slice(2, 6)
    assert np.allclose(cut.scores(w, 0.5, 2, 6), cut.scores(w, 0.5)[part]) and np.allclose(cut.gradient(g[part], 2, 6), summed(*rows.slopes(every[part], (g * ratio)[part])))
    want = np.zeros(1 << abuse.FEATURE_BITS)
    for t in range(len(texts)):
        of = np.flatnonzero(cut.text == t)
        want[np.unique(cut.expanded(of)[0])] += 1
    assert np.array_equal(cut.text_counts(), want)
    odds = w.astype(np.float32)
    assert np.allclose(cut.hints(every, odds), [np.sort(odds[cut.expanded(np.array([r]))[0]])[-8:].mean() for r in every])
    seen = [(t, sorted(cut.words[a:b])) for t, a, b in zip(cut.text, cut.start, cut.stop)]
    assert cut.fresh().tolist() == [x not in seen[:k] for k, x in enumerate(seen)] and not cut.fresh().all()


def test_share_and_threshold_from_unlabelled_scores():
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(-6, 1, 9_500), rng.normal(3, 1, 500)])
    histogram, _ = np.histogram(score, abuse._EDGES)
    held = rng.normal(3, 1, 200)
    assert abs(abuse.share_of_positives(histogram, held) - 0.05) < 0.01
    assert -4 < abuse.best_threshold(histogram, held) < 1.5
    assert abuse.share_of_positives(histogram * 0, held) == 0 and abuse.share_of_positives(histogram, held[:0]) == 0


def test_plain_text():
    assert abuse.plain("ALGUÃ‰M nÃ£o") == "alguem nao" and abuse.plain("j a c k a s s") == "jackass" and abuse.plain("w-o-r-t-h") == "worth"
    assert abuse.word("wor7hle$$") == "worthles" and abuse.word("ret*rd") == "*" and abuse.plain("bіtсh") == "bitch"

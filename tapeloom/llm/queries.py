"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import abuse, bpe, neardup, packing, runs, spans, terms
from tapeloom.shared import stripped, table, written

SUMMARY_COMMON = 0.4
LABEL_COMMON = 0.1
RARE = 2


def p1_terms(spark: SparkSession, root: str) -> DataFrame:
    """Every term of the summaries and every label, with occurrences, records and mark."""
    summary = terms.field_terms(table(spark, root, "summary_record"), "summary", terms.words, SUMMARY_COMMON, RARE)
    label = terms.field_terms(table(spark, root, "next_move_hypothesis"), "label", terms.whole_value, LABEL_COMMON, RARE)
    return summary.unionByName(label).drop("record_share")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The terms and labels that are too rare or too common."""
    return p1_terms(spark, root).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


SPAN_FIELDS = (
    ("summary", "summary_record", "delivery_id"),
    ("attempt_n_code", "validated_candidate", "candidate_id"),
)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Records with a span of at least 160 characters that stands in another record's text."""
    parts = []
    for field, source, row_id in SPAN_FIELDS:
        rows = table(spark, root, source)
        sharing = spans.sharing_rows(rows, row_id, "custom_id", field)
        ids = rows.select(F.col(row_id).cast("bigint").alias("id"), stripped(F.col("custom_id")).alias("custom_id"))
        parts.append(
            ids.join(sharing, "id", "left_semi").select(F.lit(field).alias("field_name"), "custom_id").distinct()
        )
    return parts[0].unionByName(parts[1])


def p2_shared_chars(spark: SparkSession, root: str) -> DataFrame:
    """Every record's number of characters, and of those in spans shared with other records."""
    parts = [
        spans.shared_characters(table(spark, root, source), row_id, "custom_id", field).select(
            F.lit(field).alias("field_name"),
            F.col("record").alias("custom_id"),
            "n_texts", "n_chars", "shared_chars", "shared_spans",
        )
        for field, source, row_id in SPAN_FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Runs of at least 5 events of one raw_type, and of at least 3 equal inserted texts."""
    raw = runs.raw_type_runs(table(spark, root, "raw_trace_event"), min_run=5)
    text = runs.inserted_text_runs(table(spark, root, "change_micro_event"), min_run=3)
    ends = ["first_event_id", "last_event_id"]
    return raw.select(F.lit("raw_type").alias("seq_kind"), *ends).unionByName(
        text.select(F.lit("inserted_text").alias("seq_kind"), *ends)
    )


def p3_collapsed_types(spark: SparkSession, root: str) -> DataFrame:
    """The raw_type sequence of every log with each run as one event."""
    return runs.raw_type_runs(table(spark, root, "raw_trace_event")).select(
        F.col("entity").cast("bigint").alias("log_id"), "symbol", "first_event_id", "last_event_id",
        F.round("duration_seconds", 6).alias("duration_seconds"), "n_events",
    )


def p3_collapsed_texts(spark: SparkSession, root: str) -> DataFrame:
    """The inserted texts of every interval with each run as one event."""
    return runs.inserted_text_runs(table(spark, root, "change_micro_event")).select(
        "entity", "symbol", "first_event_id", "last_event_id",
        F.round("duration_seconds", 6).alias("duration_seconds"), "n_events",
    )


CODE_FIELDS = ("attempt_n_code", "attempt_n1_code")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of candidates whose programs share three quarters of their words."""
    candidates = table(spark, root, "validated_candidate")
    parts = [
        neardup.near_duplicate_rows(candidates, "candidate_id", field).select(
            F.lit(field).alias("field_name"),
            F.col("id_a").alias("candidate_id_a"),
            F.col("id_b").alias("candidate_id_b"),
        )
        for field in CODE_FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p4_links(spark: SparkSession, root: str) -> DataFrame:
    """Every program's class of copies and the number of classes that differ from it by small edits."""
    candidates = table(spark, root, "validated_candidate")
    parts = [
        neardup.near_duplicate_links(candidates, "candidate_id", field).select(
            F.lit(field).alias("field_name"), F.col("id").alias("candidate_id"), "class_id", "copies", "links"
        )
        for field in CODE_FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encoded(table(spark, root, "documents")).select("doc_id", "ids")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every non-empty text, in parts where it is longer than a container."""
    return packing.packed_documents(table(spark, root, "documents"))


def p8_unused_room(spark: SparkSession, root: str) -> DataFrame:
    """How well the containers are filled: their number, the least that could hold all tokens, those too full, tokens lost or
    cut without need, and the share of room that is left."""
    documents = table(spark, root, "documents")
    placed = written(packing.packed_documents(documents), "containers")
    return packing.filling(bpe.encoded(documents, with_ids=False), placed)


def _scores(spark: SparkSession, root: str) -> DataFrame:
    texts = abuse.prepared(table(spark, root, "documents"))
    return abuse.scored(texts, abuse.trained(texts, table(spark, root, "review_label")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scores(spark, root).where("flagged").select("doc_id")


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document's score for such content."""
    return _scores(spark, root).select("doc_id", "score", "flagged")


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    """Every source's rate of such content."""
    return abuse.rates(table(spark, root, "documents"), _scores(spark, root))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_terms, p2_found, p2_shared_chars, p3_found, p3_collapsed_types, p3_collapsed_texts,
        p4_found, p4_links, p7_ids, p8_containers, p8_unused_room, p9_found, p9_scores, p9_rates,
    )
}

_STRIP = r"regexp_replace({}, '^[\s\x{{A0}}\x{{85}}]+|[\s\x{{A0}}\x{{85}}]+$', '', 'g')"


def _marks(field: str, source: str, term: str, common: float) -> str:
    return f"""SELECT '{field}' AS field_name, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records,
      CASE WHEN count(*) <= {RARE} THEN 'rare'
           WHEN count(*) > {common} * (SELECT count(DISTINCT {_STRIP.format('custom_id')}) FROM {source}) THEN 'common' END AS mark
      FROM (SELECT term, c, count(*) AS n FROM (
              SELECT {_STRIP.format('custom_id')} AS c, {term} AS term FROM {source}
              WHERE custom_id IS NOT NULL AND {field} IS NOT NULL)
            WHERE term <> '' GROUP BY term, c)
      GROUP BY term"""


_TERMS = (
    _marks("summary", "summary_record", r"unnest(regexp_extract_all(lower(nfc_normalize(summary)), '[\p{L}\p{N}_]+'))", SUMMARY_COMMON)
    + " UNION ALL "
    + _marks(
        "label",
        "next_move_hypothesis",
        r"trim(regexp_replace(lower(nfc_normalize(label)), '[\s\x{A0}\x{85}\p{Z}]+', ' ', 'g'))",
        LABEL_COMMON,
    )
)


def _islands(keys: str, order: str, sym: str, t: str, source: str) -> str:
    return f"""SELECT {keys}, {sym} AS symbol, arg_min(event_id, pos) AS first_event_id,
        arg_max(event_id, pos) AS last_event_id,
        round(date_diff('microsecond', min({t}), max({t})) / 1e6, 6) AS duration_seconds, count(*) AS n_events
      FROM (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY pos) AS island
            FROM (SELECT *, CASE WHEN lag({sym}) OVER w = {sym}
                      AND date_diff('microsecond', lag({t}) OVER w, {t}) <= 2000000 THEN 0 ELSE 1 END AS brk,
                    row_number() OVER w AS pos
                  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order}, event_id)))
      GROUP BY {keys}, {sym}, island"""


_RAW = _islands(
    "log_id", "t, line_number NULLS FIRST", "sym", "t",
    f"""(SELECT event_id, min(log_id) AS log_id, min(event_ts) AS t, min(line_number) AS line_number,
         min(lower({_STRIP.format('raw_type')})) AS sym FROM raw_trace_event WHERE event_id IS NOT NULL
         GROUP BY event_id HAVING min(event_ts) IS NOT NULL)""",
)
_TEXT = _islands(
    "entity", "t, o NULLS FIRST", "sym", "t",
    r"""(SELECT event_id, min(log_id) || ':' || coalesce(CAST(min(submit_index_0idx) AS VARCHAR), '-') AS entity,
         min(try_cast(event_timestamp AS TIMESTAMP)) AS t, min(ordinal_in_interval_1idx) AS o,
         min(lower(regexp_replace(inserted_text, '[\s\x{A0}\x{85}\p{Z}]+', '', 'g'))) AS sym
         FROM change_micro_event WHERE event_id IS NOT NULL
         GROUP BY event_id HAVING min(try_cast(event_timestamp AS TIMESTAMP)) IS NOT NULL)""",
)

_SPANS = f"""WITH t AS (
      SELECT 'summary' AS field_name, {_STRIP.format('custom_id')} AS custom_id, summary AS x FROM summary_record
      UNION ALL SELECT 'attempt_n_code', {_STRIP.format('custom_id')}, attempt_n_code FROM validated_candidate),
    w AS (SELECT field_name, custom_id, substr(x, i, 160) AS s FROM
      (SELECT *, unnest(range(1, length(x) - 158)) AS i FROM t WHERE custom_id IS NOT NULL AND length(x) >= 160)),
    g AS (SELECT field_name, s FROM w GROUP BY field_name, s HAVING count(DISTINCT custom_id) > 1)
    SELECT DISTINCT field_name, custom_id FROM w JOIN g USING (field_name, s)"""


# every stretch of 160 characters by its place; a text's shared ones overlap or stand apart
_SHARED_CHARS = f"""WITH t AS (
      SELECT 'summary' AS field_name, delivery_id AS id, {_STRIP.format('custom_id')} AS custom_id, summary AS x FROM summary_record
      UNION ALL SELECT 'attempt_n_code', candidate_id, {_STRIP.format('custom_id')}, attempt_n_code FROM validated_candidate),
    w AS (SELECT field_name, custom_id, id, i, md5(substr(x, i, 160)) AS s FROM
      (SELECT *, unnest(range(1, length(x) - 158)) AS i FROM t WHERE custom_id IS NOT NULL AND length(x) >= 160)),
    g AS (SELECT field_name, s FROM w GROUP BY field_name, s HAVING count(DISTINCT custom_id) > 1),
    d AS (SELECT field_name, id, i, i - lag(i) OVER (PARTITION BY field_name, id ORDER BY i) AS gap FROM w JOIN g USING (field_name, s)),
    c AS (SELECT field_name, id, sum(least(coalesce(gap, 160), 160)) AS chars, count(*) FILTER (gap IS NULL OR gap > 160) AS spans FROM d GROUP BY ALL)
    SELECT field_name, custom_id, count(x) AS n_texts, CAST(coalesce(sum(length(x)), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(chars), 0) AS BIGINT) AS shared_chars,
      CAST(coalesce(sum(spans), 0) AS BIGINT) AS shared_spans FROM t LEFT JOIN c USING (field_name, id) WHERE custom_id IS NOT NULL GROUP BY field_name, custom_id"""


def _close(field: str) -> str:
    return f"""SELECT '{field}' AS field_name, a AS candidate_id_a, b AS candidate_id_b FROM (
      SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS s, any_value(x.total) AS na, any_value(y.total) AS nb
      FROM {field}_w x JOIN {field}_w y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id)
      WHERE s / (na + nb - s) >= 0.75"""


def _counted(field: str) -> str:
    return f"""{field}_w AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total FROM (SELECT id, word, count(*) AS n FROM (
      SELECT candidate_id AS id, unnest(regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}_]+')) AS word
      FROM validated_candidate WHERE {field} IS NOT NULL) GROUP BY id, word))"""


def _linked(field: str) -> str:
    return f"""SELECT '{field}' AS field_name, m.id AS candidate_id, m.class_id, m.copies, coalesce(l.links, 0) AS links FROM {field}_m m
      LEFT JOIN (SELECT id, count(*) AS links FROM (SELECT unnest([candidate_id_a, candidate_id_b]) AS id FROM ({_close(field)}) WHERE candidate_id_a IN (SELECT class_id FROM {field}_m) AND candidate_id_b IN (SELECT class_id FROM {field}_m)) GROUP BY id) l ON l.id = m.class_id"""


def _classes(field: str) -> str:
    return f"""{field}_m AS (SELECT id, min(id) OVER (PARTITION BY words) AS class_id, count(*) OVER (PARTITION BY words) AS copies FROM (
      SELECT candidate_id AS id, list_sort(regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM validated_candidate WHERE {field} IS NOT NULL) WHERE len(words) > 0)"""


ORACLE = {
    "p2_found": _SPANS,
    "p2_shared_chars": _SHARED_CHARS,
    "p4_links": "WITH " + ", ".join([*map(_counted, CODE_FIELDS), *map(_classes, CODE_FIELDS)]) + " SELECT * FROM (" + " UNION ALL ".join(map(_linked, CODE_FIELDS)) + ")",
    "p4_found": "WITH " + ", ".join(map(_counted, CODE_FIELDS)) + " " + " UNION ALL ".join(map(_close, CODE_FIELDS)),
    "p1_terms": _TERMS,
    "p1_found": f"SELECT field_name, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p3_found": f"""SELECT 'raw_type' AS seq_kind, first_event_id, last_event_id FROM ({_RAW})
      WHERE n_events >= 5 AND symbol IS NOT NULL
      UNION ALL SELECT 'inserted_text', first_event_id, last_event_id FROM ({_TEXT})
      WHERE n_events >= 3 AND symbol IS NOT NULL""",
    "p3_collapsed_types": _RAW,
    "p3_collapsed_texts": _TEXT,
}

"""Queries on single rows: normal forms, tokens, distances, buckets, texts (survey C, J, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import code as C
from tapeloom.functions import words as W
from tapeloom.plans.inputs import PROGRAMS_SQL, SUMMARIES_SQL, ascii_sql, programs, strip_sql, summaries
from tapeloom.shared import SPACES, UNI_SPACE, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NARROW = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\n\z', ''), '(?m)[ \t]+$', '', 'g')"


def _blank(c: str) -> str:
    inside = SPACES.replace(r"\n", "")
    return f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '(?m)[{inside}]+$', '', 'g')"


def blank_sql(c: str) -> str:
    return f"regexp_replace({_blank(c)}, '\\n+\\z', '')"


def output_sql(c: str) -> str:
    return f"regexp_replace({_blank(c)}, '\\A{UNI_SPACE}+|{UNI_SPACE}+\\z', '', 'g')"


@query(f"SELECT candidate_id, {_NARROW.format('code_n')} AS narrow, {blank_sql('code_n')} AS blank, {output_sql('code_n')} AS output FROM {PROGRAMS_SQL}")
def j01_j03_normal_forms(spark: SparkSession, root: str) -> DataFrame:
    """The three normal forms of a program."""
    p = programs(spark, root)
    return p.select("candidate_id", *[C.normalize_code(F.col("code_n"), m).alias(m) for m in ("narrow", "blank", "output")])


@query(f"""SELECT candidate_id, levenshtein(code_n, code_n1) AS distance,
  CASE WHEN length(code_n) + length(code_n1) = 0 THEN 0 ELSE round(levenshtein(code_n, code_n1) / (length(code_n) + length(code_n1)), 9) END AS code_distance,
  CASE WHEN length(code_n) + length(code_n1) = 0 THEN 1 ELSE round((length(code_n) + length(code_n1) - levenshtein(code_n, code_n1)) / (length(code_n) + length(code_n1)), 9) END AS ratio
  FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL""")
def j04_j06_code_distance(spark: SparkSession, root: str) -> DataFrame:
    """Edit distance, normalised distance and ratio of two attempts."""
    a, b = F.col("code_n"), F.col("code_n1")
    return programs(spark, root).where(a.isNotNull() & b.isNotNull()).select(
        "candidate_id", C.edit_distance(a, b).alias("distance"),
        F.round(C.code_distance(a, b), 9).alias("code_distance"), F.round(C.levenshtein_ratio(a, b), 9).alias("ratio"),
    )


def token_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '{C.TOKEN}')"


_KW = "[" + ", ".join(f"'{k}'" for k in C.KEYWORDS) + "]"


@query(f"""SELECT candidate_id, len(t) AS n_tokens, len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z_]') AND NOT list_contains({_KW}, x))) AS n_identifiers,
  len(list_filter(t, lambda x: NOT (regexp_matches(x, '^[A-Za-z_]') AND NOT list_contains({_KW}, x)))) AS n_structural
  FROM (SELECT candidate_id, {token_sql('code_n')} AS t FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL)""")
def j07_j08_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of a program and their parts."""
    t = programs(spark, root).where("code_n IS NOT NULL").select("candidate_id", C.code_tokens(F.col("code_n")).alias("t"))
    size = lambda c: F.size(c).cast("bigint")
    return t.select("candidate_id", size("t").alias("n_tokens"), size(C.identifier_tokens(F.col("t"))).alias("n_identifiers"),
                    size(C.structural_tokens(F.col("t"))).alias("n_structural"))


_OVER = "list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda z: z = x)))))"


@query(f"""SELECT candidate_id, CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE round(2 * coalesce({_OVER}, 0) / (len(a) + len(b)), 9) END AS token_f1,
  CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE round(coalesce({_OVER}, 0) / (len(a) + len(b) - coalesce({_OVER}, 0)), 9) END AS multiset_jaccard
  FROM (SELECT candidate_id, {token_sql('code_n')} AS a, {token_sql('code_n1')} AS b FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL)""")
def j09_j42_token_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Multiset F1 and Jaccard of the tokens of two attempts."""
    from tapeloom.functions.sequences import multiset_jaccard

    t = programs(spark, root).where("code_n IS NOT NULL AND code_n1 IS NOT NULL").select(
        "candidate_id", C.code_tokens(F.col("code_n")).alias("a"), C.code_tokens(F.col("code_n1")).alias("b"))
    return t.select("candidate_id", F.round(C.token_f1(F.col("a"), F.col("b")), 9).alias("token_f1"),
                    F.round(multiset_jaccard(F.col("a"), F.col("b")), 9).alias("multiset_jaccard"))


@query(f"""SELECT a.candidate_id, round(1 - levenshtein(b.code_n1, a.code_n1) / levenshtein(a.code_n, a.code_n1), 9) AS gain_raw,
  round((levenshtein(a.code_n, a.code_n1) - levenshtein(b.code_n1, a.code_n1)) / greatest(levenshtein(a.code_n, a.code_n1), levenshtein(b.code_n1, a.code_n1)), 9) AS gain_bounded
  FROM (SELECT *, lead(candidate_id) OVER (PARTITION BY class_id, assessment_id, exercise_id ORDER BY candidate_id) AS other FROM {PROGRAMS_SQL}) a
  JOIN {PROGRAMS_SQL} b ON b.candidate_id = a.other
  WHERE a.code_n <> a.code_n1 AND b.code_n1 IS NOT NULL AND a.code_n IS NOT NULL""")
def j17_j18_gain_over_copy(spark: SparkSession, root: str) -> DataFrame:
    """Gain over copying of the next candidate's program as a prediction."""
    from pyspark.sql import Window

    p = programs(spark, root)
    w = Window.partitionBy("class_id", "assessment_id", "exercise_id").orderBy("candidate_id")
    a = p.withColumn("other", F.lead("candidate_id").over(w)).where("code_n <> code_n1")
    b = p.select(F.col("candidate_id").alias("other"), F.col("code_n1").alias("predicted")).where("predicted IS NOT NULL")
    args = (F.col("code_n"), F.col("predicted"), F.col("code_n1"))
    return a.join(b, "other").select("candidate_id", F.round(C.gain_raw(*args), 9).alias("gain_raw"), F.round(C.gain_bounded(*args), 9).alias("gain_bounded"))


@query(f"""SELECT candidate_id, array_to_string(list_transform(vector, lambda x: CASE WHEN x THEN 'P' ELSE 'F' END), '') AS signature,
  list_filter(list_transform(vector, lambda x, i: CASE WHEN NOT x THEN CAST(i - 1 AS INTEGER) END), lambda y: y IS NOT NULL) AS failed,
  len(list_filter(vector, lambda x: x)) AS n_passed,
  CASE WHEN len(vector) > 0 THEN CASE WHEN NOT list_bool_or(vector) THEN 'all_fail' WHEN list_bool_and(vector) THEN 'all_pass' ELSE 'mixed' END END AS outcome,
  CASE WHEN len(list_filter(vector, lambda x: x)) = 0 THEN '0' WHEN len(list_filter(vector, lambda x: x)) = len(vector) THEN 'all' ELSE 'partial' END AS bucket
  FROM {PROGRAMS_SQL} WHERE vector IS NOT NULL""")
def j49_j52_test_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Signature, failed tests, passes, outcome and bucket of a result vector."""
    v = F.col("vector")
    return programs(spark, root).where(v.isNotNull()).select(
        "candidate_id", C.pass_signature(v).alias("signature"), C.failed_tests(v).alias("failed"), C.pass_count(v).cast("bigint").alias("n_passed"),
        C.next_outcome(v).alias("outcome"), C.passed_bucket(v).alias("bucket"))


@query("""SELECT a.delivery_id, CASE WHEN list_bool_and(b.v) THEN 'solved' WHEN len(list_filter(b.v, lambda x: x)) > len(list_filter(a.v, lambda x: x)) THEN 'partial_fix'
    WHEN len(list_filter(b.v, lambda x: x)) = len(list_filter(a.v, lambda x: x)) THEN 'no_improvement' ELSE 'regressed' END AS outcome
  FROM (SELECT delivery_id, attempt_n_pass_fail_vector AS v, lead(delivery_id) OVER (PARTITION BY student_id ORDER BY delivery_id) AS nxt FROM scored_row) a
  JOIN (SELECT delivery_id, attempt_n_pass_fail_vector AS v FROM scored_row) b ON b.delivery_id = a.nxt WHERE a.v IS NOT NULL AND b.v IS NOT NULL""")
def c15_outcome_bucket(spark: SparkSession, root: str) -> DataFrame:
    """What became of the tests from one delivery of a student to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("student_id").orderBy("delivery_id")
    rows = table(spark, root, "scored_row").select("delivery_id", F.col("attempt_n_pass_fail_vector").alias("a"),
                                                   F.lead("attempt_n_pass_fail_vector").over(w).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL").select("delivery_id", C.outcome_bucket(F.col("a"), F.col("b")).alias("outcome"))


@query("""SELECT doc_id, CASE WHEN trim(s, '_') = '' THEN 'unknown' ELSE trim(s, '_') END AS slug, try_cast(regexp_extract(source || ' ' || doc_id, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS grade
  FROM (SELECT *, regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '_', 'g') AS s FROM documents)""")
def c10_a05_slug_and_grade(spark: SparkSession, root: str) -> DataFrame:
    """Slug of a name and first number of a line."""
    d = table(spark, root, "documents")
    return d.select("doc_id", C.slug(F.col("source")).alias("slug"), C.grade(F.concat_ws(" ", "source", "doc_id")).alias("grade"))


@query("""SELECT log_id, transition_index_0idx, CASE WHEN visible_attempt_count - 1 = 0 THEN '0' WHEN visible_attempt_count - 1 = 1 THEN '1' ELSE '2_plus' END AS depth,
  CASE WHEN visible_change_event_count <= 2 THEN 'local_1_to_2_lines' WHEN visible_change_event_count <= 5 THEN 'regional_3_to_5_lines' ELSE 'broad_6_plus_lines' END AS scope
  FROM (SELECT DISTINCT log_id, transition_index_0idx, visible_attempt_count, visible_change_event_count FROM candidate_transition)""")
def c18_c20_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Depth and edit-scope buckets."""
    t = table(spark, root, "candidate_transition").select("log_id", "transition_index_0idx", "visible_attempt_count", "visible_change_event_count").distinct()
    return t.select("log_id", "transition_index_0idx", C.steps_bucket(F.col("visible_attempt_count") - 1).alias("depth"), C.touched_bucket(F.col("visible_change_event_count")).alias("scope"))


@query(f"""WITH t AS (SELECT candidate_id, {output_sql('code_n')} AS e, {output_sql('code_n1')} AS a, {output_sql('custom_id')} AS g FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL AND code_n1 IS NOT NULL),
   l AS (SELECT *, CASE WHEN e = '' THEN [] ELSE string_split(e, chr(10)) END AS x, CASE WHEN a = '' THEN [] ELSE string_split(a, chr(10)) END AS y FROM t)
   SELECT candidate_id, CASE WHEN a = '' THEN 'empty_output' WHEN a = g THEN 'unchanged_input_echo' WHEN len(y) < len(x) THEN 'missing_output_lines' WHEN len(y) > len(x) AND len(list_distinct(y)) < len(y) THEN 'repeated_output_value'
     WHEN len(y) > len(x) THEN 'extra_output_lines' WHEN x[1] <> y[1] THEN 'wrong_first_output_line' WHEN x[-1] <> y[-1] THEN 'wrong_final_output_line' ELSE 'other_output_mismatch' END AS signature FROM l""")
def c17_mismatch_signature(spark: SparkSession, root: str) -> DataFrame:
    """How one text differs from another, as outputs (C17)."""
    p = programs(spark, root).where("code_n IS NOT NULL AND code_n1 IS NOT NULL")
    return p.select("candidate_id", C.mismatch_signature(F.col("code_n"), F.col("code_n1"), F.col("custom_id")).alias("signature"))


_WORDS = f"regexp_extract_all(lower(summary), '{W.WORD}')"
_NG = "list_transform(CASE WHEN len(w) >= {n} THEN range(1, len(w) - {n} + 2) ELSE [] END, lambda i: array_to_string(w[i:i + {n} - 1], ' '))"


@query(f"SELECT custom_id, run_condition, len(w) AS n_words, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 9) END AS ttr, array_to_string(w[1:3], ' ') AS opening, len({_NG.format(n=2)}) AS n_bigrams, len(list_distinct({_NG.format(n=3)})) AS n_trigrams FROM (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL})")
def j56_j66_word_features(spark: SparkSession, root: str) -> DataFrame:
    """Words, type-token ratio, opening and n-grams of summaries."""
    s = summaries(spark, root).withColumn("w", W.word_list(F.col("summary")))
    n = lambda c: F.size(c).cast("bigint")
    w = F.col("w")
    return s.select("custom_id", "run_condition", n(w).alias("n_words"), F.round(W.type_token_ratio(w), 9).alias("ttr"), W.leading_phrase(F.col("summary")).alias("opening"),
                    n(W.ngrams(w, 2)).alias("n_bigrams"), n(F.array_distinct(W.ngrams(w, 3))).alias("n_trigrams"))


_STOP = "[" + ", ".join(f"'{k}'" for k in W.STOPWORDS) + "]"


@query(f"""SELECT custom_id, run_condition, len(list_filter(list_distinct({_NG.format(n=3)} || {_NG.format(n=4)} || {_NG.format(n=5)} || {_NG.format(n=6)}),
    lambda g: len(list_filter(string_split(g, ' '), lambda x: NOT list_contains({_STOP}, x))) > 0)) AS n_ngrams,
  len(list_filter(list_distinct({_NG.format(n=1)} || {_NG.format(n=2)} || {_NG.format(n=3)}), lambda g: NOT list_contains({_STOP}, string_split(g, ' ')[1]) AND NOT list_contains({_STOP}, string_split(g, ' ')[-1]))) AS n_phrases,
  list_filter(list_transform([3, 4, 5, 6], lambda n: CASE WHEN len(w) >= n THEN array_to_string(w[1:n], ' ') END), lambda p: p IS NOT NULL) AS openings
  FROM (SELECT *, {_WORDS} AS w FROM {SUMMARIES_SQL})""")
def j57_j59_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Distinct n-grams, phrase candidates and openings."""
    s = summaries(spark, root).withColumn("w", W.word_list(F.col("summary")))
    w = F.col("w")
    n = lambda c: F.size(c).cast("bigint")
    return s.select("custom_id", "run_condition", n(W.distinct_ngrams(w, 3, 6)).alias("n_ngrams"), n(W.phrase_candidates(w)).alias("n_phrases"), W.leading_ngrams(w).alias("openings"))


def _clause_sql() -> str:
    has = lambda ws: f"list_has_any(regexp_extract_all(p, '{W.WORD}'), [{', '.join(repr(x) for x in ws)}])"
    every = [w for ws in W.CLAUSE_WORDS.values() for w in ws]
    cols = [f"len(list_filter(c, lambda p: {has(ws)})) AS n_{k}" for k, ws in W.CLAUSE_WORDS.items()]
    cols.append(f"len(list_filter(c, lambda p: NOT {has(every)})) AS n_other")
    return f"""SELECT custom_id, run_condition, {', '.join(cols)} FROM (SELECT *, list_filter(list_transform(
      regexp_split_to_array({ascii_sql('lower(summary)')}, '[;,.]|\\band\\b'), lambda x: trim(x)), lambda y: y <> '') AS c FROM {SUMMARIES_SQL})"""


@query(_clause_sql())
def j60_clause_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Clauses of summaries by kind."""
    s = summaries(spark, root).select("custom_id", "run_condition", W.clause_counts(F.col("summary")).alias("c"))
    return s.select("custom_id", "run_condition", *[F.col(f"c.{k}").cast("bigint").alias(f"n_{k}") for k in [*W.CLAUSE_WORDS, "other"]])


_ACT = {k: p.replace("(?i)", "") for k, p in W.ACTION_PATTERNS.items()}


@query(f"""SELECT custom_id, run_condition, len(list_filter(regexp_split_to_array(regexp_replace(summary, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n_sentences,
  list_filter([{', '.join(f"CASE WHEN regexp_matches({ascii_sql('summary')}, '{p}', 'i') THEN '{k}' END" for k, p in _ACT.items())}], lambda x: x IS NOT NULL) AS actions FROM {SUMMARIES_SQL}""")
def j65_j68_sentences_and_actions(spark: SparkSession, root: str) -> DataFrame:
    """Sentences and the actions a summary speaks of."""
    s = summaries(spark, root)
    return s.select("custom_id", "run_condition", F.size(W.sentences(F.col("summary"))).cast("bigint").alias("n_sentences"), W.action_kinds(F.col("summary")).alias("actions"))


_LINES = r"""list_sort(list_distinct(flatten(list_transform(regexp_extract_all(lower(summary), 'lines?\s+(\d{1,6}(?:\s*(?:-|to|and)\s*\d{1,6})?)', 1),
   lambda m: CASE WHEN contains(m, 'and') THEN [least(a(m), b(m)) - 1, greatest(a(m), b(m)) - 1] ELSE range(least(a(m), b(m)) - 1, greatest(a(m), b(m))) END))))"""
_LINES = _LINES.replace("a(m)", r"CAST(regexp_extract(m, '^(\d+)', 1) AS BIGINT)").replace("b(m)", r"CAST(regexp_extract(m, '(\d+)$', 1) AS BIGINT)")


@query(f"SELECT custom_id, run_condition, {_LINES} AS lines FROM {SUMMARIES_SQL}")
def j67_line_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Lines that summaries name."""
    return summaries(spark, root).select("custom_id", "run_condition", W.line_mentions(F.col("summary")).cast("array<bigint>").alias("lines"))


@query(f"""SELECT s.custom_id, run_condition, list_sort(list_distinct(list_filter(regexp_extract_all(summary, '{W.WORD}'), lambda w: (regexp_matches(w, '[_\\d]') OR length(w) >= 4)
   AND list_contains(t, w) AND regexp_matches(w, '^[A-Za-z_]') AND NOT list_contains({_KW}, w)))) AS refs
  FROM {SUMMARIES_SQL} s JOIN (SELECT custom_id, {token_sql('code_n')} AS t FROM {PROGRAMS_SQL} WHERE code_n IS NOT NULL) p USING (custom_id)""")
def j61_j70_code_references(spark: SparkSession, root: str) -> DataFrame:
    """Names of the program that its summary speaks of."""
    p = programs(spark, root).where("code_n IS NOT NULL").select("custom_id", "code_n")
    return summaries(spark, root).join(p, "custom_id").select("custom_id", "run_condition", W.identifier_references(F.col("summary"), F.col("code_n")).alias("refs"))


@query(f"""SELECT delivery_id, parts[1] AS class_id, parts[2] AS student_id, parts[3] AS assessment_id, parts[4] AS exercise_id, try_cast(parts[5] AS INTEGER) AS n,
  coalesce(len(parts) = 5 AND NOT list_contains(parts, '') AND try_cast(parts[5] AS INTEGER) IS NOT NULL, false) AS valid
  FROM (SELECT delivery_id, string_split({strip_sql('custom_id')}, ':') AS parts FROM scored_row)""")
def k11_row_keys(spark: SparkSession, root: str) -> DataFrame:
    """The parts of a custom_id as columns, and whether they are what they should be."""
    from tapeloom.operators.contracts import row_key
    from tapeloom.shared import stripped

    return table(spark, root, "scored_row").select("delivery_id", row_key(stripped(F.col("custom_id"))).alias("k")).select("delivery_id", "k.*")


@query("""SELECT delivery_id, CASE WHEN attempt_n_pass_fail_vector IS NULL OR attempt_n_pass_vector_signature IS NULL THEN 'missing'
   WHEN array_to_string(list_transform(attempt_n_pass_fail_vector, lambda x: CASE WHEN x THEN 'P' ELSE 'F' END), '') <> attempt_n_pass_vector_signature THEN 'signature_differs' END AS problem,
   CASE WHEN hyp_probabilities IS NULL THEN 'missing' WHEN len(hyp_probabilities) <> 3 THEN 'not_three' WHEN len(list_filter(hyp_probabilities, lambda p: p <= 0 OR p > 1 OR isnan(p))) > 0 THEN 'out_of_range'
   WHEN abs(list_sum(hyp_probabilities) - 1) > 1e-3 THEN 'not_one' END AS probability_problem FROM scored_row""")
def k01_k12_row_contract(spark: SparkSession, root: str) -> DataFrame:
    """Contract of scored rows: the signature is the vector's, three probabilities sum to one."""
    from tapeloom.operators.contracts import probability_problem, signature_problem

    return table(spark, root, "scored_row").select("delivery_id",
        signature_problem(F.col("attempt_n_pass_fail_vector"), F.col("attempt_n_pass_vector_signature")).alias("problem"),
        probability_problem(F.col("hyp_probabilities"), 3, 3, 1e-3).alias("probability_problem"))


@query("""SELECT * , n_violations = 0 AS holds FROM (SELECT 'unique_delivery' AS check_name, (SELECT count(*) FROM (SELECT delivery_id FROM scored_row GROUP BY 1 HAVING count(*) > 1)) AS n_violations
   UNION ALL SELECT 'key_present', (SELECT count(*) FROM scored_row WHERE custom_id IS NULL) UNION ALL SELECT 'score_in_range', (SELECT count(*) FROM scored_row WHERE top_1_score < 0 OR top_1_score > 1)
   UNION ALL SELECT 'candidate_of_scope', (SELECT count(*) FROM validated_candidate v WHERE NOT EXISTS (SELECT 1 FROM scope_record s WHERE s.class_id = v.class_id AND s.assessment_id = v.assessment_id AND s.exercise_id = v.exercise_id)))""")
def k08_k09_expectations(spark: SparkSession, root: str) -> DataFrame:
    """Integrity checks across tables, as numbers of violations."""
    from tapeloom.operators import contracts as K

    s, v = table(spark, root, "scored_row"), table(spark, root, "validated_candidate")
    scope = ["class_id", "assessment_id", "exercise_id"]
    return K.expectations({
        "unique_delivery": K.duplicate_keys(s, ["delivery_id"]), "key_present": s.where("custom_id IS NULL"),
        "score_in_range": s.where("top_1_score < 0 OR top_1_score > 1"), "candidate_of_scope": v.join(table(spark, root, "scope_record"), scope, "left_anti"),
    })

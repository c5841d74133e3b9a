"""SQL of the numerical parts that several queries are compared with: bootstrap, sign flips, p values, tables of two sequences."""

from __future__ import annotations


def hash_draw(seed: int, b: str, i: str, n: str) -> str:
    """SQL of `inference.draw`."""
    return f"CAST(('0x' || substr(md5('{seed}:' || {b} || ':' || {i}), 1, 8)) AS BIGINT) % {n}"


def boot_row(clusters: str, samples: int, order: str = "scope", seed: int = 42) -> str:
    """One row of `inference.cluster_bootstrap`; `clusters` is a select with sl, nl, sr, nr."""
    return f"""(WITH c AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM {clusters}), k AS (SELECT count(*) AS k FROM c),
   d AS (SELECT b.range AS b, {hash_draw(seed, 'b.range', 's.range', 'k.k')} AS i FROM range({samples}) b, k, LATERAL (SELECT * FROM range(k.k)) s),
   t AS (SELECT b, sum(sl) / sum(nl) - sum(sr) / sum(nr) AS theta FROM d JOIN c USING (i) GROUP BY b)
   SELECT round((SELECT sum(sl) / sum(nl) - sum(sr) / sum(nr) FROM c), 9) AS observed, (SELECT count(*) FROM c) AS n_clusters, round(quantile_cont(theta, 0.025), 9) AS low, round(quantile_cont(theta, 0.975), 9) AS high,
     round(avg(CASE WHEN theta > 0 THEN 1 ELSE 0 END), 9) AS share_positive FROM t)"""


def flip_row(clusters: str, samples: int, order: str = "scope", seed: int = 42) -> str:
    """One row of `inference.sign_flip` on the contributions of `clusters`."""
    return f"""(WITH c AS (SELECT (sl - sr) / (SELECT sum(nl) FROM {clusters}) AS c, row_number() OVER (ORDER BY {order}) - 1 AS i FROM {clusters}), k AS (SELECT count(*) <= 20 AS exact, CASE WHEN count(*) <= 20 THEN 1 << count(*) ELSE {samples} END AS total FROM c),
   x AS (SELECT b, sum(CASE WHEN CASE WHEN exact THEN (b >> i) & 1 ELSE {hash_draw(seed, 'b', 'i', '2')} END = 1 THEN -c ELSE c END) AS x FROM k, LATERAL (SELECT range AS b FROM range(k.total)), c GROUP BY b)
   SELECT round(CASE WHEN any_value(exact) THEN count(*) FILTER (hit) / any_value(total) ELSE (count(*) FILTER (hit) + 1) / (any_value(total) + 1) END, 9) AS p, CAST(any_value(total) AS BIGINT) AS n_assignments, any_value(exact) AS exact
   FROM (SELECT abs(x) + 1e-12 >= (SELECT abs(sum(c)) FROM c) AS hit FROM x), k)"""


def _simpson(f: str, top: str, steps: int = 4_000) -> str:
    """The integral of `f`, in which x is the variable, from 0 to `top`."""
    at = f.replace("{x}", f"({top} * i / {steps})")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {at})) * {top} / {3 * steps})"


def normal_two_sided(z: str) -> str:
    """P(|Z| >= z) of the standard normal distribution."""
    return f"(CASE WHEN {z} > 12 THEN 0.0 ELSE 1 - 2 * {_simpson('exp(-{x} * {x} / 2)', z)} / sqrt(2 * pi()) END)"


def student_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) of Student's distribution, by the angle whose tangent is t / sqrt(df)."""
    top = f"atan(abs({t}) / sqrt({df}))"
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"(1 - 2 * {scale} * {_simpson('power(cos({x}), ' + df + ' - 1)', top)})"


def signed_ranks(rows: str, key: str) -> str:
    """(key, n, w_plus, p) of `inference.wilcoxon`; `rows` is a select with the key and delta."""
    return f"""(WITH RECURSIVE ways(m, s, w) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT m + 1, s, sum(w) FROM (SELECT m, s + d * (m + 1) AS s, w FROM ways, (SELECT unnest([0, 1]) AS d) WHERE m < 50) GROUP BY m, s),
   r AS (SELECT {key}, delta, rank() OVER (PARTITION BY {key} ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY {key}, abs(delta)) - 1) / 2 AS r, count(*) OVER (PARTITION BY {key}, abs(delta)) AS t FROM {rows} WHERE delta <> 0),
   s AS (SELECT {key}, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(t * t - 1.0) AS ties FROM r GROUP BY {key}),
   z AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48, 0)) AS z FROM s)
   SELECT {key}, n, round(w_plus, 6) AS w_plus, round(CASE WHEN n <= 50 AND ties = 0 THEN least(1.0, 2 * (SELECT sum(w) FROM ways WHERE m = n AND s <= floor(least(w_plus, n * (n + 1) / 2 - w_plus))) / power(2, n)) WHEN z IS NULL THEN 1.0 ELSE {normal_two_sided('z')} END, 7) AS p FROM z)"""


def sequence_tables(pairs: str, keys: str) -> str:
    """(keys, lcs, dtw): longest common subsequence and time-warping cost of the lists a and b, by anti-diagonals of both tables."""
    return f"""(WITH RECURSIVE p AS (SELECT {keys}, a, b, len(a) AS n, len(b) AS m FROM {pairs}),
   t AS (SELECT {keys}, a, b, n, m, CAST(1 AS BIGINT) AS k, list_transform(range(0, n + 1), lambda i: 0) AS l2, list_transform(range(0, n + 1), lambda i: 0) AS l1,
       list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS w2, list_transform(range(0, n + 1), lambda i: 1000000) AS w1 FROM p
     UNION ALL SELECT {keys}, a, b, n, m, k + 1, l1, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR k + 1 - i < 1 OR k + 1 - i > m THEN 0 WHEN a[i] = b[k + 1 - i] THEN l2[i] + 1 ELSE greatest(l1[i], l1[i + 1]) END), w1,
       list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR k + 1 - i < 1 OR k + 1 - i > m THEN 1000000 ELSE least(w2[i], w1[i], w1[i + 1]) + CASE WHEN a[i] = b[k + 1 - i] THEN 0 ELSE 1 END END) FROM t WHERE k < n + m)
   SELECT {keys}, l1[n + 1] AS lcs, w1[n + 1] AS dtw FROM t WHERE k = n + m)"""

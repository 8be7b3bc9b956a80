"""The catalog's queries as DuckDB SQL: a chain of common tables, and a last select for each query."""

from __future__ import annotations

import re

from ..functions import anchors as A
from ..operators.reports import LOG_FIELDS
from . import fixtures

_WORDS = "SELECT doc_id, source AS allele, translate(upper(w), 'BJOUXZ', 'DLKCGE') AS pep FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z]{6,14}')) AS w FROM documents)"
_POSTERIOR = "least(greatest(1 / (1 + exp(-least(greatest(ln(p_h) + n_pos * ln(1 - alpha) + n_neg * ln(alpha) - ln(1 - p_h) - n_pos * ln(beta) - n_neg * ln(1 - beta), -500.0), 500.0))), 1e-10), 1 - 1e-10)"
_CLIP_A = "least(greatest((2.0 + {fn}) / (20.0 + {nb}), 0.001), 0.40)"
_CLIP_B = "least(greatest((1.0 + {fp}) / (50.0 + {no}), 0.001), 0.15)"


def _rates(name: str, source: str, binder: str, other: str) -> str:
    """alpha and beta of each allele, from the pairs of source that the two conditions pick."""
    s = lambda c, m: f"coalesce(sum(CASE WHEN {m} THEN {c} ELSE 0 END), 0)"
    a, b = _CLIP_A.format(fn=s("n_neg", binder), nb=s("n_total", binder)), _CLIP_B.format(fp=s("n_pos", other), no=s("n_total", other))
    return f"{name} AS (SELECT hla_idx, {a} AS alpha, {b} AS beta FROM idx LEFT JOIN {source} USING (hla_idx) GROUP BY hla_idx)"


_PMF = "lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({k} + 1) - lgamma(a + b - {k} + 1) - lgamma(a + c - {k} + 1) - lgamma(d - a + {k} + 1)"


def _tests(called: str, tag: str) -> list[str]:
    """Tables of the tests of alleles by the calls of a table, their similarities and the propagated labels; names end with tag."""
    t = tag
    return [
        f"cells{t} AS (SELECT x.hla_idx AS h1, y.hla_idx AS h2, count_if(x.b_call = 1 AND y.b_call = 1) AS a, count_if(x.b_call = 1 AND y.b_call = 0) AS b, count_if(x.b_call = 0 AND y.b_call = 1) AS c, count_if(x.b_call = 0 AND y.b_call = 0) AS d, count(*) AS shared FROM {called} x JOIN {called} y ON x.cluster_id = y.cluster_id AND x.hla_idx < y.hla_idx GROUP BY ALL HAVING count(*) >= 10)",
        f"support{t} AS (SELECT *, {_PMF.format(k='k')} AS lp, {_PMF.format(k='a')} AS la FROM cells{t}, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS t(k))",
        f"ps{t} AS (SELECT h1, h2, CASE WHEN any_value((a + b) * (c + d) * (a + c) * (b + d)) = 0 THEN 1.0 ELSE least(1.0, sum(CASE WHEN lp <= la + 1e-7 THEN exp(lp) ELSE 0 END)) END AS pvalue FROM support{t} GROUP BY h1, h2)",
        f'unadjusted{t} AS (SELECT *, CASE WHEN b * c = 0 THEN 1.0 ELSE CAST(a * d AS DOUBLE) / (b * c) END AS "OR", b * c = 0 AS or_degenerate, greatest(1.0, exp(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) - 1.96 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)))) AS OR_conservative, count(*) OVER () AS m, count(*) OVER (ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM cells{t} JOIN ps{t} USING (h1, h2))',
        f"tested{t} AS MATERIALIZED (SELECT *, pvalue_adj < 0.05 AS significant FROM (SELECT *, least(1.0, min(pvalue * m / rk) OVER (ORDER BY pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pvalue_adj FROM unadjusted{t}))",
        f"half{t} AS (SELECT h1, h2, ln(greatest(OR_conservative, 1e-10)) AS s FROM tested{t} WHERE significant)",
        f"sim{t} AS (SELECT h1, h2, s FROM half{t} UNION ALL SELECT h2, h1, s FROM half{t})",
    ]


def _labels(called: str, tag: str) -> list[str]:
    return [
        f"sums{tag} AS (SELECT p.cluster_id, w.h2 AS hla_idx, sum(s * CAST(gamma AS DOUBLE)) AS wg, sum(s) AS ws, sum(s * n_total * penalty) AS wn FROM {called} p JOIN cover USING (cluster_id) JOIN sim{tag} w ON p.hla_idx = w.h1 AND s > 0 JOIN targets t ON t.hla_idx = w.h2 GROUP BY ALL)",
        f"labels_{tag} AS MATERIALIZED (SELECT cluster_id, hla_idx, CAST(wg / ws AS FLOAT) AS p_tilde, CAST(wn AS FLOAT) AS n_tilde, CAST(wn / (wn + 10.0) AS FLOAT) AS lambda_w FROM sums{tag} ANTI JOIN pairs USING (cluster_id, hla_idx))",
    ]


def _iteration(k: int, method: str, labels: str | None = None) -> list[str]:
    """Tables of one refinement step, with feedback from a table of labels: theta, noise, rate, post.

    Methods: gibbs (hard states), em (soft ones), drawn (states by the hash of the keys, seed 7), fed (gibbs, with labels from the third on).
    """
    before = "called" if k == 1 else f"post{k - 1}_{method}"
    drawn = f"CAST('0x' || substr(md5(concat_ws('|', '7', '{k}', cluster_id, hla_idx)), 1, 13) AS BIGINT) / 4503599627370496.0"
    state = {"em": "gamma", "drawn": f"CASE WHEN {drawn} < CAST(gamma AS DOUBLE) THEN 1 ELSE 0 END"}.get(method, "CASE WHEN gamma > 0.5 THEN 1 ELSE 0 END")
    t = f"theta{k}_{method}"
    first, second = ("n_total >= 5 AND n_pos / n_total > 0.90", "n_total >= 5 AND n_neg / n_total > 0.90") if method == "em" else ("theta = 1", "theta = 0")
    own = f"(SELECT hla_idx, least(greatest((coalesce(sum(theta), 0) + 50 * any_value(pg)) / (count(theta) + 50.0), 0.001), 0.95) AS p_h FROM idx LEFT JOIN {t} USING (hla_idx), (SELECT sum(theta) / count(*) AS pg FROM {t}) GROUP BY hla_idx)"
    if labels:
        fed = f"(SELECT hla_idx, sum(CAST(lambda_w AS DOUBLE) * CAST(p_tilde AS DOUBLE)) AS fp, sum(CAST(lambda_w AS DOUBLE)) AS fw FROM {labels} GROUP BY hla_idx)"
        own = f"(SELECT hla_idx, least(greatest(CASE WHEN fw > 0 THEN (1 - fw / (fw + 100)) * p_h + fw / (fw + 100) * fp / fw ELSE p_h END, 0.001), 0.95) AS p_h FROM {own} LEFT JOIN {fed} USING (hla_idx))"
    return [
        f"{t} AS (SELECT cluster_id, hla_idx, n_pos, n_neg, n_total, CAST({state} AS DOUBLE) AS theta, CAST({'gamma' if k == 1 else 'gamma64'} AS DOUBLE) AS previous FROM {before})",
        _rates(f"noise{k}_{method}", t, first, second),
        f"rate{k}_{method} AS (SELECT hla_idx, p_h FROM {own})",
        f"post{k}_{method} AS MATERIALIZED (SELECT *, CAST(gamma64 AS FLOAT) AS gamma, CAST(gamma64 > least(2 * p_h, 0.5) AS INT) AS b_call FROM (SELECT cluster_id, hla_idx, n_pos, n_neg, n_total, p_h, previous, {_POSTERIOR} AS gamma64 FROM {t} JOIN noise{k}_{method} USING (hla_idx) JOIN rate{k}_{method} USING (hla_idx)))",
    ]


#: The refinement with feedback: labels are renewed in the third iteration.
MOST_ITERATIONS = 6
_FED = [*(x for k in (1, 2, 3) for x in _iteration(k, "fed")), *_tests("post3_fed", "3"), *_labels("post3_fed", "3"), *(x for k in (4, 5, 6) for x in _iteration(k, "fed", "labels_3"))]
_FED += ["moves AS (" + " UNION ALL ".join(f"SELECT {k} AS k, max(abs(gamma64 - previous)) AS delta FROM post{k}_fed" for k in range(1, 7)) + ")", "last_step AS (SELECT coalesce(min(CASE WHEN delta < 1e-3 THEN k END), 6) AS k FROM moves)"]



CHAIN = [
    "obs AS (SELECT l_partkey AS cluster_id, n_name AS allele, CAST((substr(md5(concat_ws('|', l_partkey, n_regionkey)), 1, 2) < '40') <> (substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_suppkey, l_partkey)), 1, 2) < '0d') AS INT) AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)",
    "sizes AS (SELECT l_partkey AS cluster_id, 4 * count(DISTINCT l_suppkey) AS n_members FROM lineitem GROUP BY l_partkey)",
    "idx AS (SELECT CAST(row_number() OVER (ORDER BY allele) - 1 AS INT) AS hla_idx, allele AS hla_name FROM (SELECT DISTINCT allele FROM obs))",
    "pairs AS MATERIALIZED (SELECT cluster_id, hla_idx, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, count(*) AS n_total FROM obs JOIN idx ON allele = hla_name GROUP BY cluster_id, hla_idx)",
    "rates AS (SELECT hla_idx, CAST(coalesce(sum(n_pos), 0) AS BIGINT) AS pos, CAST(coalesce(sum(n_total), 0) AS BIGINT) AS tot, coalesce(sum(n_pos) / nullif(sum(n_total), 0), 0.0) AS p_raw, least(greatest((coalesce(sum(n_pos), 0) + 50 * any_value(pg)) / (coalesce(sum(n_total), 0) + 50.0), 0.001), 0.95) AS p_h FROM idx LEFT JOIN pairs USING (hla_idx), (SELECT sum(n_pos) / sum(n_total) AS pg FROM pairs) GROUP BY hla_idx)",
    _rates("noise", "pairs", "n_total >= 5 AND n_pos / n_total > 0.90", "n_total >= 5 AND n_neg / n_total > 0.90"),
    f"called AS MATERIALIZED (SELECT *, CAST(gamma64 AS FLOAT) AS gamma, CAST(gamma64 > least(2 * p_h, 0.5) AS INT) AS b_call FROM (SELECT cluster_id, hla_idx, n_pos, n_neg, n_total, p_h, {_POSTERIOR} AS gamma64 FROM pairs JOIN noise USING (hla_idx) JOIN rates USING (hla_idx)))",
    "phis AS (SELECT *, ln((n_pos + 1e-6) / (n_neg + 1e-6)) AS phi FROM pairs)",
    "counts AS (SELECT hla_idx, hla_name, p_h, CAST(coalesce(sum(b_call), 0) AS BIGINT) AS n_binder_clusters, count(b_call) AS n_total_clusters, CAST(count(b_call) - coalesce(sum(b_call), 0) AS BIGINT) AS n_nonbinder_clusters, coalesce(sum(b_call) / nullif(count(b_call), 0), 0.0) AS binder_fraction FROM idx JOIN rates USING (hla_idx) LEFT JOIN called USING (hla_idx) GROUP BY ALL)".replace("LEFT JOIN called USING (hla_idx)", "LEFT JOIN (SELECT hla_idx, b_call FROM called) USING (hla_idx)"),
    *_tests("called", ""),
    "grid AS (SELECT i.hla_idx AS i1, j.hla_idx AS i2, i.hla_name AS row_name, j.hla_name AS col_name FROM idx i CROSS JOIN idx j)",
    "both_p AS (SELECT h1, h2, pvalue, pvalue_adj FROM tested UNION ALL SELECT h2, h1, pvalue, pvalue_adj FROM tested)",
    'both_or AS (SELECT h1, h2, "OR" AS x FROM tested UNION ALL SELECT h2, h1, "OR" FROM tested)',
    "cells_or AS (SELECT i.hla_name AS row_name, j.hla_name AS col_name, CASE WHEN i.hla_idx = j.hla_idx THEN NULL ELSE coalesce(x, 1.0) END AS value FROM idx i CROSS JOIN idx j LEFT JOIN both_or ON h1 = i.hla_idx AND h2 = j.hla_idx)",
    "assoc AS (SELECT hla_idx, hla_name, count(significant) AS n_tested, count_if(significant) AS n_significant FROM idx LEFT JOIN (SELECT h1 AS hla_idx, significant FROM tested UNION ALL SELECT h2, significant FROM tested) USING (hla_idx) GROUP BY ALL)",
    "targets AS (SELECT hla_idx, count(cluster_id) AS n_pairs FROM idx LEFT JOIN pairs USING (hla_idx) GROUP BY hla_idx HAVING count(cluster_id) < 5000)",
    "cover AS (SELECT cluster_id, CAST(sum(n_total) AS BIGINT) AS n_labelled, CAST(greatest(coalesce(any_value(n_members), 1), 1) AS BIGINT) AS n_members, pow(least(sum(n_total) / greatest(coalesce(any_value(n_members), 1), 1), 1.0), 0.5) AS penalty FROM pairs LEFT JOIN sizes USING (cluster_id) GROUP BY cluster_id)",
    *_labels("called", ""),
    *_iteration(1, "gibbs"), *_iteration(2, "gibbs"), *_iteration(1, "em"), *_iteration(1, "drawn"), *_FED, *_tests("post2_gibbs", "9"), *_labels("post2_gibbs", "9"),
    f"words AS ({_WORDS})",
    "raw_obs AS (SELECT pep, allele, quality AS label FROM words JOIN labels USING (doc_id))",
    "fed_idx AS (SELECT CAST(row_number() OVER (ORDER BY allele) - 1 AS INT) AS hla_idx, allele FROM (SELECT DISTINCT allele FROM raw_obs WHERE allele IS NOT NULL))",
    "fed_pairs AS MATERIALIZED (SELECT left(pep, 3) || right(pep, 3) AS cluster_id, hla_idx, CAST(sum(coalesce(label, 0)) AS BIGINT) AS n_pos, CAST(count(*) - sum(coalesce(label, 0)) AS BIGINT) AS n_neg, count(*) AS n_total FROM raw_obs JOIN fed_idx USING (allele) GROUP BY 1, 2)",
    "fed_rates AS (SELECT hla_idx, least(greatest((sum(n_pos) + 50 * any_value(pg)) / (sum(n_total) + 50.0), 0.001), 0.95) AS p_h FROM fed_pairs, (SELECT sum(n_pos) / sum(n_total) AS pg FROM fed_pairs) GROUP BY hla_idx)",
    _rates("fed_noise", "fed_pairs", "n_total >= 5 AND n_pos / n_total > 0.90", "n_total >= 5 AND n_neg / n_total > 0.90").replace("FROM idx ", "FROM fed_idx "),
    "members AS (SELECT DISTINCT pep AS sequence, 32 * (ascii(pep) - 65) + length(pep) AS cluster_id FROM words WHERE length(pep) <= 12)",
    "anchors AS (SELECT left(pep, 3) || right(pep, 3) AS anchor, count(*) AS n FROM words GROUP BY 1)",
    "exact AS (SELECT pep AS member, min(pep) OVER (PARTITION BY left(pep, 3) || right(pep, 3)) AS rep FROM (SELECT DISTINCT pep FROM words))",
    "rep_sizes AS (SELECT rep, count(*) AS size FROM exact GROUP BY rep)",
    "res AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {g})" for g, letters in enumerate(A.GROUPS) for c in letters) + ") AS t(letter, g))",
    "sims AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}{q}', CAST({float(A.matrix()[i, j])!r} AS DOUBLE))" for i, p in enumerate(A.RESIDUES) for j, q in enumerate(A.RESIDUES)) + ") AS t(two, v))",
    "blocks AS (SELECT anchor, n, x.g AS g2, y.g AS g6, row_number() OVER (PARTITION BY x.g, y.g ORDER BY n DESC, anchor) AS prio FROM anchors JOIN res x ON substr(anchor, 2, 1) = x.letter JOIN res y ON substr(anchor, 6, 1) = y.letter)",
]

_TERMS = " + ".join(f"{A.WEIGHTS[k] / sum(A.WEIGHTS)!r} * s{k}.v" for k in A.ORDER)
_SIMS = " ".join(f"JOIN sims s{k} ON s{k}.two = substr(x.anchor, {k + 1}, 1) || substr(y.anchor, {k + 1}, 1)" for k in A.ORDER)
# greedy first-fit, one priority of all blocks at a time: a block's row holds its centroids so far
CHAIN += [
    f"scored AS (SELECT x.anchor AS earlier, y.anchor AS later, x.prio AS prio, {_TERMS} AS score, (2 - s0.v - s2.v) / 8 AS loss1, (2 - s3.v - s4.v) / 8 AS loss2 FROM blocks x JOIN blocks y ON x.g2 = y.g2 AND x.g6 = y.g6 AND x.prio < y.prio {_SIMS})",
    "alike AS MATERIALIZED (SELECT later, list(earlier ORDER BY prio) AS before FROM scored WHERE score >= 0.8 GROUP BY later)",
    "tries AS MATERIALIZED (SELECT g2, g6, prio, anchor, coalesce(before, CAST([] AS VARCHAR[])) AS before FROM blocks LEFT JOIN alike ON anchor = later)",
    "greedy(g2, g6, prio, anchor, centroid, centres) AS (SELECT DISTINCT g2, g6, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM blocks UNION ALL "
    "SELECT g2, g6, prio, anchor, coalesce(fit, anchor), CASE WHEN fit IS NULL THEN list_append(centres, anchor) ELSE centres END FROM (SELECT g2, g6, t.prio, t.anchor, centres, list_filter(t.before, lambda e: list_contains(centres, e))[1] AS fit FROM greedy JOIN tries t USING (g2, g6) WHERE t.prio = greedy.prio + 1))",
]

r = lambda *names: ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)
r4 = lambda *names: ", ".join(f"round(CAST({n} AS DOUBLE), 4) AS {n}" for n in names)
_STATS = ", ".join(f"round({f}(CAST({c} AS DOUBLE)), 4) AS {n}_{s}" for c, n in (("p_tilde", "ptilde"), ("n_tilde", "ntilde"), ("lambda_w", "lambda")) for f, s in (("avg", "mean"), ("stddev_samp", "std"), ("median", "median")))


def _logged(k: int) -> str:
    """What the log states of the k-th of two iterations; tests and labels are renewed in the second."""
    last = {
        "l2_significant_pairs": "(SELECT count_if(significant) FROM tested9)", "l2_nonzero_entries": "(SELECT count_if(s <> 0) FROM sim9)", "l3_propagated": "(SELECT count(*) FROM labels_9)",
        "l3_positive": "(SELECT count_if(p_tilde > 0.5) FROM labels_9)", "l3_lambda_mean": "(SELECT round(avg(CAST(lambda_w AS DOUBLE)), 4) FROM labels_9)",
    }
    of_alleles = f"(SELECT {{}} FROM noise{k}_gibbs JOIN rate{k}_gibbs USING (hla_idx))"
    values = {
        "theta_binders": f"(SELECT CAST(sum(theta) AS BIGINT) FROM theta{k}_gibbs)", "theta_pct": f"(SELECT round(100.0 * sum(theta) / count(*), 2) FROM theta{k}_gibbs)",
        "alpha_mean": of_alleles.format("round(avg(alpha), 4)"), "beta_mean": of_alleles.format("round(avg(beta), 4)"), "ph_mean": of_alleles.format("round(avg(p_h), 4)"), "ph_median": of_alleles.format("round(median(p_h), 4)"),
        "gamma_mean": f"(SELECT round(avg(gamma64), 4) FROM post{k}_gibbs)", "gamma_median": f"(SELECT round(median(gamma64), 4) FROM post{k}_gibbs)", "gamma_gt_half": f"(SELECT count_if(gamma64 > 0.5) FROM post{k}_gibbs)",
        "tau_mean": of_alleles.format("round(avg(least(2 * p_h, 0.5)), 4)"), "tau_median": of_alleles.format("round(median(least(2 * p_h, 0.5)), 4)"), "tau_cap_count": of_alleles.format("count_if(2 * p_h > 0.5)"),
        "positive_calls": f"(SELECT CAST(sum(b_call) AS BIGINT) FROM post{k}_gibbs)", "positive_pct": f"(SELECT round(100.0 * sum(b_call) / count(*), 2) FROM post{k}_gibbs)",
        "delta_gamma_max": f"(SELECT round(max(abs(gamma64 - previous)), 6) FROM post{k}_gibbs)", "delta_gamma_mean": f"(SELECT round(avg(abs(gamma64 - previous)), 6) FROM post{k}_gibbs)",
    } | {n: x if k == 2 else "NULL" for n, x in last.items()}
    kinds = {name: "BIGINT" if kind == "long" else "DOUBLE" for name, _, _, kind, _ in LOG_FIELDS}
    return f"SELECT CAST({k} AS INT) AS iteration, " + ", ".join(f"CAST({values[n]} AS {kinds[n]}) AS {n}" for n in kinds if n in values)


_SUMMARY = "count(*) AS n, round(avg({x}), 4) AS mean, round(median({x}), 4) AS median, round(min({x}), 4) AS min, round(max({x}), 4) AS max, count_if({x} > {t}) AS n_above"
_BOX = "WITH q AS (SELECT hla_idx, count(*) AS n, quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.5) AS median, quantile_cont(g, 0.75) AS q3 FROM (SELECT hla_idx, round(CAST({x} AS DOUBLE), 4) AS g FROM labels_) GROUP BY hla_idx) SELECT hla_idx, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(g) AS low, max(g) AS high FROM (SELECT hla_idx, round(CAST({x} AS DOUBLE), 4) AS g FROM labels_) JOIN q USING (hla_idx) WHERE g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1) GROUP BY hla_idx"
_OBSERVED = "SELECT allele, count(*) AS n, CAST(sum(coalesce(label, 0)) AS BIGINT) AS pos FROM raw_obs GROUP BY allele"

LAST = {
    "obs_load": "SELECT pep AS peptide, allele, count(*) AS n, CAST(sum(coalesce(label, 0)) AS BIGINT) AS pos FROM raw_obs GROUP BY ALL",
    "prefix_filter": "SELECT allele, count(*) AS n FROM raw_obs WHERE starts_with(allele, 'src1') GROUP BY allele",
    "label_normalize": "SELECT count_if(coalesce(quality, 0) = 1) AS n_pos, count_if(coalesce(quality, 0) = 0) AS n_neg, round(count_if(coalesce(quality, 0) = 1) / count(*), 6) AS positive_rate FROM words LEFT JOIN labels USING (doc_id)",
    "map_clusters": "SELECT CAST(cluster_id AS INT) AS cluster_id, hla_idx, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, count(*) AS n_total FROM raw_obs JOIN members ON pep = sequence JOIN (SELECT CAST(row_number() OVER (ORDER BY allele) - 1 AS INT) AS hla_idx, allele FROM (SELECT DISTINCT allele FROM raw_obs)) USING (allele) GROUP BY ALL",
    "unmapped_rate": "SELECT count(*) AS n_obs, count_if(sequence IS NULL) AS n_unmapped, round(100.0 * count_if(sequence IS NULL) / count(*), 6) AS pct_unmapped FROM raw_obs LEFT JOIN members ON pep = sequence",
    "cluster_sizes": "SELECT CAST(cluster_id AS INT) AS cluster_id, count(*) AS n_members FROM members GROUP BY cluster_id",
    "allele_index": "SELECT hla_idx, hla_name FROM idx",
    "pair_counts": "SELECT * FROM pairs",
    "count_reconciliation": "SELECT n_rows, rows_pos, pairs_total, pairs_pos, n_clusters, n_pairs, n_rows = pairs_total AND rows_pos = pairs_pos AS agrees FROM (SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS rows_pos FROM obs), (SELECT CAST(sum(n_total) AS BIGINT) AS pairs_total, CAST(sum(n_pos) AS BIGINT) AS pairs_pos, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_pairs FROM pairs)",
    "binder_rates": f"SELECT hla_idx, pos, tot, {r('p_raw', 'p_h')} FROM rates",
    "noise_params": f"SELECT hla_idx, {r('alpha', 'beta', 'p_h')}, round(least(2 * p_h, 0.5), 6) AS tau_h FROM noise JOIN rates USING (hla_idx)",
    "posterior_gamma": f"SELECT cluster_id, hla_idx, {r('gamma64')} FROM called",
    "binarize_calls": "SELECT cluster_id, hla_idx, b_call FROM called",
    "gamma_summary": "SELECT count(*) AS n, round(avg(gamma64), 6) AS mean, round(median(gamma64), 6) AS median, round(min(gamma64), 6) AS min, round(max(gamma64), 6) AS max, count_if(gamma64 > 0.5) AS n_above FROM called",
    "phi_pairs": "SELECT cluster_id, hla_idx, round(phi, 6) AS phi_ch FROM phis",
    "allele_purity": "SELECT hla_idx, hla_name, round(coalesce(avg(phi), 0), 6) AS mean_phi, round(coalesce(stddev_samp(phi), 0), 6) AS std_phi, round(coalesce(median(phi), 0), 6) AS median_phi, round(coalesce(min(phi), 0), 6) AS min_phi, round(coalesce(max(phi), 0), 6) AS max_phi, count(phi) AS n_clusters FROM idx LEFT JOIN phis USING (hla_idx) GROUP BY ALL",
    "cluster_counts": f"SELECT hla_idx, hla_name, n_binder_clusters, n_total_clusters, n_nonbinder_clusters, {r('p_h', 'binder_fraction')} FROM counts",
    "top30_alleles": f"SELECT hla_idx, hla_name, n_binder_clusters, n_total_clusters, n_nonbinder_clusters, {r('p_h', 'binder_fraction')} FROM counts ORDER BY n_total_clusters DESC, hla_idx LIMIT 30",
    "phi_histogram": "SELECT bin, CAST(round(-15.0 + bin * 0.25, 6) AS DOUBLE) AS bin_low, count(*) AS n FROM (SELECT CAST(least(greatest(floor((phi + 15.0) / 0.25), 0), 119) AS INT) AS bin FROM phis) GROUP BY bin",
    "fraction_histogram": "SELECT bin, CAST(round(bin * 0.02, 6) AS DOUBLE) AS bin_low, count(*) AS n FROM (SELECT CAST(least(greatest(floor(binder_fraction / 0.02), 0), 49) AS INT) AS bin FROM counts) GROUP BY bin",
    "contingency": "SELECT * FROM cells",
    "fisher_pvalues": f"SELECT h1, h2, {r('pvalue')} FROM tested",
    "fisher_by_rows": f"SELECT h1, h2, {r('pvalue')} FROM tested",
    "odds_ratios": 'SELECT h1, h2, round("OR", 6) AS "OR", round(OR_conservative, 6) AS OR_conservative, or_degenerate FROM tested',
    "bh_fdr": f"SELECT h1, h2, {r('pvalue_adj')}, significant FROM tested",
    "similarity": f"SELECT h1, h2, {r('s')} FROM sim",
    "similarity_counts": "SELECT count_if(s <> 0) AS n_nonzero, count_if(s > 0) AS n_positive, count_if(s < 0) AS n_negative, count_if(abs(s) <= 1e-8) AS n_near_zero FROM half",
    "matrix_or_long": f"SELECT row_name, col_name, {r('value')} FROM cells_or",
    "matrix_or_wide": "SELECT row_name, " + ", ".join(f"max(CASE WHEN col_name = '{n}' THEN round(value, 6) END) AS \"{n}\"" for n in fixtures.NATIONS) + " FROM cells_or GROUP BY row_name",
    "heat_cells": "SELECT row_name, col_name, round(log10(greatest(coalesce(value, 1.0), 1e-10)), 6) AS shade FROM cells_or",
    "associations": "SELECT hla_idx, hla_name, n_tested, n_significant FROM assoc",
    "association_histogram": "SELECT bin, round(lo + bin * (hi - lo) / 40, 6) AS bin_low, count(*) AS n FROM (SELECT CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / ((hi - lo) / 40)), 39) AS INT) ELSE 0 END AS bin, lo, hi FROM (SELECT log10(n_significant + 1) AS x, min(log10(n_significant + 1)) OVER () AS lo, max(log10(n_significant + 1)) OVER () AS hi FROM assoc WHERE n_significant > 0)) GROUP BY bin, lo, hi",
    "colour_scale": "SELECT round(coalesce(quantile_cont(y, 0.95), 1.0), 6) AS p95_abs_log10_or FROM (SELECT abs(log10(greatest(x, 1e-10))) AS y FROM both_or) WHERE y > 0",
    "rare_targets": "SELECT hla_idx, n_pairs FROM targets",
    "coverage_penalty": f"SELECT cluster_id, n_labelled, n_members, {r('penalty')} FROM cover",
    "propagate_labels": f"SELECT cluster_id, hla_idx, {r4('p_tilde', 'n_tilde', 'lambda_w')} FROM labels_",
    "propagation_summary": "SELECT hla_idx, hla_name, count(*) AS n_propagated, round(avg(CAST(p_tilde AS DOUBLE)), 4) AS mean_p_tilde, round(avg(CAST(lambda_w AS DOUBLE)), 4) AS mean_lambda, count_if(p_tilde > 0.5) AS n_positive FROM labels_ JOIN idx USING (hla_idx) GROUP BY ALL",
    "feedback_rates": "SELECT hla_idx, round(CASE WHEN fw > 0 THEN (1 - fw / (fw + 100)) * p_h + fw / (fw + 100) * fp / fw ELSE p_h END, 6) AS p_h FROM rates LEFT JOIN (SELECT hla_idx, sum(CAST(lambda_w AS DOUBLE) * CAST(p_tilde AS DOUBLE)) AS fp, sum(CAST(lambda_w AS DOUBLE)) AS fw FROM labels_ GROUP BY hla_idx) USING (hla_idx)",
    "gibbs_det_1iter": f"SELECT cluster_id, hla_idx, {r('gamma64')}, b_call FROM post1_gibbs",
    "gibbs_det_2iter": f"SELECT cluster_id, hla_idx, {r('gamma64')}, b_call FROM post2_gibbs",
    "em_1iter": f"SELECT cluster_id, hla_idx, {r('gamma64')}, b_call FROM post1_em",
    "matrix_similarity": "SELECT row_name, col_name, round(coalesce(s, 0.0), 6) AS value FROM grid LEFT JOIN sim ON h1 = i1 AND h2 = i2",
    "heat_cells_p": "SELECT row_name, col_name, round(-log10(least(greatest(coalesce(pvalue, 1.0), 1e-300), 1.0)), 4) + 0.0 AS shade FROM grid LEFT JOIN both_p ON h1 = i1 AND h2 = i2",
    "heat_cells_p_adj": "SELECT row_name, col_name, round(-log10(least(greatest(coalesce(pvalue_adj, 1.0), 1e-300), 1.0)), 4) + 0.0 AS shade FROM grid LEFT JOIN both_p ON h1 = i1 AND h2 = i2",
    "tested_histogram": "SELECT bin, round(lo + bin * (hi - lo) / 40, 6) AS bin_low, count(*) AS n FROM (SELECT CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / ((hi - lo) / 40)), 39) AS INT) ELSE 0 END AS bin, lo, hi FROM (SELECT log10(n_tested + 1) AS x, min(log10(n_tested + 1)) OVER () AS lo, max(log10(n_tested + 1)) OVER () AS hi FROM assoc WHERE n_tested > 0)) GROUP BY bin, lo, hi",
    "mean_phi_histogram": "SELECT bin, round(lo + bin * (hi - lo) / 60, 4) AS bin_low, count(*) AS n FROM (SELECT CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / ((hi - lo) / 60)), 59) AS INT) ELSE 0 END AS bin, lo, hi FROM (SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM (SELECT round(coalesce(avg(phi), 0), 6) AS x FROM idx LEFT JOIN phis USING (hla_idx) GROUP BY hla_idx))) GROUP BY bin, lo, hi",
    "p_tilde_boxes": _BOX.format(x="p_tilde"),
    "n_tilde_boxes": _BOX.format(x="n_tilde"),
    "lambda_boxes": _BOX.format(x="lambda_w"),
    "run_statistics": " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{x}' AS value, {_SUMMARY.format(x=expression, t=t)} FROM {source}" for stage, x, expression, source, t in (("rates", "p_h", "p_h", "rates", 0.5), ("thresholds", "tau_h", "least(2 * p_h, 0.5)", "rates", 0.4999), ("posteriors", "gamma64", "gamma64", "called", 0.5), ("coverage", "penalty", "penalty", "cover", 0.5), ("propagation", "p_tilde", "CAST(p_tilde AS DOUBLE)", "labels_", 0.5), ("propagation", "lambda_w", "CAST(lambda_w AS DOUBLE)", "labels_", 0.5))),
    "csv_file": _OBSERVED,
    "tsv_file": _OBSERVED,
    "fasta_file": "SELECT DISTINCT pep AS header, pep AS sequence FROM words",
    "fasta_first_line": "SELECT DISTINCT pep AS header, left(pep, 3) AS sequence FROM words",
    "cluster_file": "SELECT 'cluster_' || cluster_id AS cluster_id, count(*) AS n FROM members GROUP BY cluster_id",
    "edge_file": "SELECT rep, count(*) AS n FROM exact GROUP BY rep",
    "result_fallback": "SELECT CAST(hla_idx AS VARCHAR) AS hla_idx, hla_name FROM idx",
    "best_run": "SELECT cluster_id, hla_idx, n_total FROM pairs",
    "fasta_sink": "SELECT 'cluster_' || cluster_id AS cluster_id, count(*) AS n FROM members GROUP BY cluster_id HAVING count(*) >= 100",
    "ordered_labels": "SELECT (SELECT count(*) FROM labels_) AS n, TRUE AS in_order",
    "summary_by_clusters": "SELECT row_number() OVER (ORDER BY n DESC, hla_idx) AS place, hla_idx, n AS n_clusters FROM (SELECT hla_idx, count(*) AS n FROM pairs GROUP BY hla_idx)",
    "gibbs_sampled": f"SELECT cluster_id, hla_idx, {r('gamma64')} FROM post1_drawn",
    "gibbs_converged": " UNION ALL ".join(f"SELECT cluster_id, hla_idx, {r('gamma64')} FROM post{k}_fed WHERE (SELECT k FROM last_step) = {k}" for k in range(1, 7)),
    "sampled_pairs": "SELECT cluster_id, hla_idx, n_pos, n_neg, n_total FROM (SELECT *, row_number() OVER (PARTITION BY hla_idx ORDER BY md5(concat_ws('|', '0', cluster_id, hla_idx)), cluster_id) AS k FROM pairs) WHERE k <= 300",
    "greedy_clusters": "SELECT anchor, centroid FROM greedy WHERE anchor IS NOT NULL",
    "gibbs_delta": "SELECT round(max(abs(gamma64 - previous)), 6) AS delta_max, round(avg(abs(gamma64 - previous)), 6) AS delta_mean FROM post1_gibbs",
    "observed_summary": "SELECT hla_idx, hla_name, round(coalesce(avg(CAST(gamma AS DOUBLE)), 0), 6) AS gamma_mean, round(coalesce(stddev_samp(CAST(gamma AS DOUBLE)), 0), 6) AS gamma_std, round(coalesce(median(CAST(gamma AS DOUBLE)), 0), 6) AS gamma_median, round(coalesce(min(CAST(gamma AS DOUBLE)), 0), 6) AS gamma_min, round(coalesce(max(CAST(gamma AS DOUBLE)), 0), 6) AS gamma_max, count(gamma) AS gamma_count, CAST(coalesce(sum(n_pos), 0) AS BIGINT) AS total_pos, CAST(coalesce(sum(n_neg), 0) AS BIGINT) AS total_neg, CAST(coalesce(sum(n_total), 0) AS BIGINT) AS total_obs, count(DISTINCT cluster_id) AS n_clusters FROM idx LEFT JOIN called USING (hla_idx) GROUP BY ALL",
    "observed_with_params": f"SELECT hla_idx, tot AS total_obs, {r('alpha', 'beta', 'p_h')}, round(least(2 * p_h, 0.5), 6) AS tau_h FROM rates JOIN noise USING (hla_idx)",
    "propagated_summary": f"SELECT hla_idx, hla_name, count(*) AS n_propagated, {_STATS}, count_if(p_tilde > 0.5) AS n_positive FROM labels_ JOIN idx USING (hla_idx) GROUP BY ALL",
    "run_metrics": "SELECT (SELECT count(*) FROM called) AS n_observed, (SELECT count(*) FROM labels_) AS n_propagated, (SELECT count(*) FROM idx) AS n_alleles, (SELECT count_if(significant) FROM tested) AS n_significant",
    "gamma_boxes": "WITH q AS (SELECT hla_idx, count(*) AS n, quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.5) AS median, quantile_cont(g, 0.75) AS q3 FROM (SELECT hla_idx, round(gamma64, 6) AS g FROM called) GROUP BY hla_idx) SELECT hla_idx, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(g) AS low, max(g) AS high FROM (SELECT hla_idx, round(gamma64, 6) AS g FROM called) JOIN q USING (hla_idx) WHERE g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1) GROUP BY hla_idx",
    "sign_bars": "SELECT hla_idx, hla_name, round(ln(pos + 1), 6) AS up, round(-ln(tot - pos + 1), 6) AS down FROM rates JOIN idx USING (hla_idx)",
    "gibbs_log_table": f"{_logged(1)} UNION ALL {_logged(2)}",
    "anchor_extract": "SELECT DISTINCT pep AS sequence, left(pep, 3) || right(pep, 3) AS anchor FROM words",
    "anchor_mask": "SELECT DISTINCT pep AS sequence, CASE WHEN length(pep) >= 6 THEN left(pep, 3) || right(pep, 3) ELSE pep END AS masked FROM words",
    "anchor_counts": "SELECT anchor, n FROM anchors",
    "anchor_block_sizes": "SELECT g2, g6, count(*) AS n_anchors FROM blocks GROUP BY ALL",
    "anchor_pair_scores": "SELECT earlier, later, round(score, 6) AS score FROM scored WHERE score >= 0.8",
    "exact_clusters": "SELECT rep, member FROM exact",
    "cluster_rank": "SELECT rep, size, row_number() OVER (ORDER BY size DESC, rep) - 1 AS cluster_num FROM rep_sizes",
    "cluster_size_buckets": "SELECT count_if(size = 1) AS singletons, count_if(size BETWEEN 2 AND 10) AS to_10, count_if(size BETWEEN 11 AND 100) AS to_100, count_if(size BETWEEN 101 AND 1000) AS to_1000, count_if(size > 1000) AS above, max(size) AS largest FROM rep_sizes",
    "cluster_report": "SELECT CAST(sum(size) AS BIGINT) AS n_members, count(*) AS n_clusters, count_if(size = 1) AS n_singletons, round(100.0 * count_if(size = 1) / count(*), 6) AS pct_singletons, max(size) AS max_size, round(avg(size), 6) AS mean_size, round(CAST(median(size) AS DOUBLE), 6) AS median_size FROM rep_sizes",
    "extreme_clusters": "(SELECT 'top' AS \"end\", rep, size, rep AS sequence FROM rep_sizes ORDER BY size DESC, rep LIMIT 5) UNION ALL (SELECT 'bottom', rep, size, rep FROM rep_sizes ORDER BY size, rep DESC LIMIT 5)",
}

LAST["anchor_comparisons"] = "SELECT (SELECT count(*) FROM blocks) AS n_anchors, (SELECT count(*) FROM scored) AS n_pairs, (SELECT count_if(loss1 <= 0.1 + 1e-9 OR loss2 <= 0.1 + 1e-9) FROM scored) AS n_candidates, (SELECT count_if(score >= 0.8) FROM scored) AS n_similar, (SELECT count_if(anchor = centroid) FROM greedy) AS n_centroids"
_DRAW = "CAST('0x' || substr(md5(concat_ws('|', '0', '{k}', cluster_id, hla_idx)), 1, 13) AS BIGINT) / 4503599627370496.0"
LAST["jittered_points"] = f"SELECT hla_idx, cluster_id, round(hla_idx + 0.08 * sqrt(-2 * ln(1 - {_DRAW.format(k=1)})) * cos(2 * pi() * {_DRAW.format(k=2)}), 6) AS x, round(gamma64, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY hla_idx ORDER BY md5(concat_ws('|', '0', cluster_id, hla_idx)), cluster_id) AS k FROM called) WHERE k <= 300"
LAST["matrix_wide_file"] = LAST["matrix_or_long"]
LAST["job1_observation_feed"] = f"SELECT allele, cluster_id, n_pos, n_neg, n_total, round(gamma64, 6) AS gamma, CAST(gamma64 > least(2 * p_h, 0.5) AS INT) AS b_call FROM (SELECT *, {_POSTERIOR} AS gamma64 FROM fed_pairs JOIN fed_noise USING (hla_idx) JOIN fed_rates USING (hla_idx) JOIN fed_idx USING (hla_idx))"
LAST["job2_label_release"] = "SELECT hla_name AS allele, cluster_id, 'observed' AS kind, round(gamma64, 4) AS value, CAST(n_total AS DOUBLE) AS weight FROM called JOIN idx USING (hla_idx) UNION ALL SELECT hla_name, cluster_id, 'propagated', round(CAST(p_tilde AS DOUBLE), 4), round(CAST(n_tilde AS DOUBLE), 4) FROM labels_ JOIN idx USING (hla_idx)"
LAST["log_file"] = LAST["gibbs_log_table"]


def _needed(last: str) -> list[str]:
    """The tables of the chain that a select uses, in order."""
    wanted, out = set(re.findall(r"\w+", last)), []
    for part in reversed(CHAIN):
        name = re.match(r"\w+", part)[0]
        if name in wanted:
            wanted |= set(re.findall(r"\w+", part))
            out.append(part)
    return out[::-1]


def _counted(sql: str) -> str:
    """count_if(...) as a count, which is a BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


ORACLE = {name: _counted(f"WITH {'RECURSIVE ' * ('greedy' in last)}{', '.join(parts)} SELECT * FROM ({last})" if (parts := _needed(last)) else last) for name, last in LAST.items()}

"""Operators made for many alleles, anchors and values, against plain loops and numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions import anchors, bits, neighbours
from pairwell.operators import clusters, diagnostics, quantiles, similarity
from pairwell.sources import tables


def quantile_rows():
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3001), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(700, -2.25),
        "far": 10.0 ** rng.integers(-300, 300, 400) * rng.choice([-1, 1], 400), "near": 1 + np.arange(40) * np.finfo(float).eps, "whole": rng.integers(-(2**52), 2**52, 300).astype(float),
    }
    return [(k, float(x), float(-x) if i % 3 else None) for k, v in groups.items() for i, x in enumerate(v)]


@pytest.mark.parametrize("bins", [2, 7, 512])
def test_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows = [r for r in quantile_rows() if bins > 2 or r[0] != "far"]
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = spark.createDataFrame(rows + [("normal", None, float("nan")), ("nothing", None, None)], "k string, x double, y double").repartition(5)
    found = {r.k: r for r in quantiles.quantiles(df, ["k"], ["x", "y"], shares).collect()}
    assert set(found) == {r[0] for r in rows}
    for k in found:
        for c, name in ((1, "x"), (2, "y")):
            values = [r[c] for r in rows if r[0] == k and r[c] is not None]
            if not values:
                assert found[k][name] is None
            else:
                want, size = np.quantile(values, shares), max(map(abs, values))
                assert np.allclose(found[k][name], want, rtol=1e-12, atol=1e-15 * size), (k, name)


def test_quantiles_of_everything_and_of_nothing(spark):
    df = spark.createDataFrame(quantile_rows(), "k string, x double, y double")
    assert quantiles.quantiles(df, [], ["x"], [0.5]).first().x == [float(np.median([r[1] for r in quantile_rows()]))]
    empty = df.where("false")
    assert quantiles.quantiles(empty, ["k"], ["x"], [0.5]).count() == 0
    assert quantiles.quantiles(empty, [], ["x"], [0.5]).collect() == [] or quantiles.quantiles(empty, [], ["x"], [0.5]).first().x is None
    plain = empty.agg(F.count("*").alias("n"))
    assert [tuple(r) for r in quantiles.with_medians(plain, empty, [], {"x": "m"}).collect()] == [(0, None)]


def test_no_task_of_quantiles_holds_a_group(spark):
    """The largest table between the rounds has a row a bin, not a row a value."""
    seen = []
    real = quantiles._narrowed

    def counted(long, targets, on):
        out = real(long, targets, on)
        seen.append((targets.select(*on, "_low").distinct().count(), out.count()))
        return out

    quantiles._narrowed = counted
    try:
        df = spark.range(200_000).select(F.rand(3).alias("x"))
        found = quantiles.quantiles(df, [], ["x"], [0.5]).first().x[0]
    finally:
        quantiles._narrowed = real
    assert 0.49 < found < 0.51 and len(seen) <= 4 and all(n <= 2 for n, _ in seen)


def plain_cells(rows):
    calls = {}
    for cluster, h, call in rows:
        calls.setdefault(h, {})[cluster] = call
    out = {}
    for h1, h2 in itertools.combinations(sorted(calls), 2):
        both = [(calls[h1][c], calls[h2][c]) for c in calls[h1].keys() & calls[h2].keys()]
        if both:
            out[h1, h2] = tuple(both.count(x) for x in ((1, 1), (1, 0), (0, 1), (0, 0))) + (len(both),)
    return out


@pytest.mark.parametrize("block,tile", [(1_000_000, 1024), (40, 1024), (1_000_000, 3), (25, 2), (1, 1)])
def test_contingency_by_blocks_and_tiles(spark, monkeypatch, block, tile):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(2)
    rows = [(int(c), int(h), int(rng.integers(2))) for c in range(60) for h in rng.choice(9, rng.integers(0, 7), replace=False)]
    df = spark.createDataFrame(rows, "cluster_id long, hla_idx int, b_call int")
    found = {(r.h1, r.h2): (r.a, r.b, r.c, r.d, r.shared) for r in similarity.contingency(df).collect()}
    assert found == plain_cells(rows)
    at_least = similarity.contingency(df, 12).collect()
    assert {(r.h1, r.h2) for r in at_least} == {k for k, v in found.items() if v[4] >= 12}


def test_contingency_of_nothing(spark):
    assert similarity.contingency(spark.createDataFrame([], "cluster_id long, hla_idx int, b_call int")).count() == 0


def test_bits_past_a_stride(monkeypatch):
    monkeypatch.setattr(bits, "STRIDE", 64)
    rng = np.random.default_rng(3)
    rows = [(int(c), int(h), int(rng.integers(2))) for c in rng.choice(10_000, 300, replace=False) for h in rng.choice(6, 4, replace=False)]
    side = tuple(np.array(x) for x in ([r[1] for r in rows], [r[0] for r in rows], [r[2] == 1 for r in rows]))
    assert {(int(c[0]), int(c[1])): tuple(map(int, c[2:])) for c in zip(*bits.cells(side, side), strict=True)} == plain_cells(rows)


def plain_adjusted(p):
    order = np.argsort(p, kind="stable")
    rank = np.searchsorted(np.sort(p), p, "right")
    scaled, out, least = p * len(p) / rank, np.empty(len(p)), 1.0
    for k in order[::-1]:
        least = min(least, scaled[k])
        out[k] = least
    return out


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_false_discovery_over_ranges(spark, parts):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(300) ** 3, rng.choice([0.01, 0.02, 0.5, 1.0], 500), np.full(400, 1.0), [0.0, 0.0, 1e-300]])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, pvalue double")
        found = similarity.adjusted(df, 0.05)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_adjusted(p)
    assert len(rows) == len(p) and all(abs(r.pvalue_adj - want[r.i]) < 1e-12 and r.significant == (want[r.i] < 0.05) for r in rows)
    assert "Window" in plan and "SinglePartition" not in plan  # no window over everything
    assert similarity.adjusted(df.where("false"), 0.05).count() == 0


def all_pairs(names, threshold):
    table, codes = anchors.weighted(), anchors.coded(names)
    group = {c: i for i, g in enumerate(anchors.GROUPS) for c in g}
    block = [(group.get(n[1], -1), group.get(n[5], -1)) for n in names]
    return {(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if block[a] == block[b] and anchors.scores(table, codes[a], codes[b : b + 1])[0] >= threshold}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.8, 0.95, 1.0])
def test_the_index_loses_no_pair(spark, threshold):
    rng = np.random.default_rng(5)
    letters = list("AVLISTKRX*")
    names = sorted({"".join(rng.choice(letters, 6)) for _ in range(160)})
    counts = spark.createDataFrame([(n, 1000 - i, n) for i, n in enumerate(names)], "anchor string, n int, first string")
    found = clusters.similar_pairs(counts, threshold).select("earlier", "later").collect()
    want = {(names[a], names[b]) for a, b in all_pairs(names, threshold)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def plain_greedy(names, threshold):
    close, homes = all_pairs(names, threshold), []
    for k in range(len(names)):
        homes.append(next((j for j in range(k) if homes[j] == j and (j, k) in close), k))
    return homes


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_greedy_scores_only_what_is_near(threshold):
    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("AVLISTKRDE"), 6)) for _ in range(3000)})
    names = [n for n in names if n[1] in "VILM" and n[5] in "AST"]  # one block
    homes, scored = clusters._fit(names, threshold)
    assert homes == plain_greedy(names, threshold)
    full = sum(1 for k, h in enumerate(homes) for j in range(k) if homes[j] == j and j <= (h if h != k else k))
    assert threshold < 0.8 or scored < 0.5 * full


def test_counters(spark):
    counts = spark.createDataFrame([(n, 1, n) for n in ("AVAAAA", "AVAAAS", "AIAAAT", "WVWWWA", "GGGGGG")], "anchor string, n int, first string")
    found = clusters.comparisons(counts, 0.8).first()
    assert (found.n_anchors, found.n_pairs) == (5, 6) and found.n_similar <= found.n_candidates <= found.n_pairs and found.n_centroids == len({r.centroid for r in clusters.greedy_clusters(counts, 0.8).collect()})
    nothing = clusters.comparisons(counts.where("false"), 0.8).first()
    assert tuple(nothing) == (0, 0, 0, 0, 0, 0)


def test_near_keys_hold_equal_ones():
    for close in neighbours.near(1.0):
        known = [a * neighbours.LETTERS + b for a in range(1, neighbours.LETTERS) for b in range(1, neighbours.LETTERS)]
        assert close[known, known].all() and close.sum() == len(known)


def test_saved_tables_can_be_dropped(spark):
    one = tables.saved(spark.range(3))
    tables.dropped(one)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(one.saved_at).count()


def test_normal_draws(spark):
    found = np.array([r[0] for r in spark.range(20_000).select(diagnostics.normal(3, "id")).collect()])
    assert abs(found.mean()) < 0.03 and abs(found.std() - 1) < 0.03 and abs((found < 1).mean() - 0.8413) < 0.01 and abs((found < -2).mean() - 0.0228) < 0.005
    again = spark.range(20_000).repartition(7).select("id", diagnostics.normal(3, "id").alias("x")).orderBy("id").collect()
    assert [r.x for r in again] == found.tolist()

"""op5: statistics against brute force, estimates against numpy, and what is rejected."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairwell.llm import quality, queries, runtime

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c d e f g h", "a b c d e f g h " * 2, "x\ny\nx\n\n\nx", "é ü𝒳 #*|", "w " * 9, "\x0bA\x0cb\x1cc d"]
    texts += [" ".join(rng.choice(["a", "b", "c\n", "#"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts.append(" ".join(str(rng.randrange(5000)) for _ in range(20_000)) + " tail" * 40)
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kept int")
    for r in quality.quality(docs).collect():
        want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in quality.STATS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (r.kept is not None) and not (r.base_failed and r.kept)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.quality(docs).where("kept").collect())
    twice = quality.kept_documents(docs.union(docs).withColumnRenamed("kept", "row"))
    assert twice.count() % 2 == 0 and twice.columns[-1] == "row"


def test_empty_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert quality.quality(docs).first().kept is False  # a repeated window
    assert quality.quality(docs.limit(0)).count() == 0 and quality.kept_documents(docs.limit(0)).columns == docs.columns
    assert quality.quality(spark.createDataFrame([(1, None)], docs.schema)).first().base_failed


VECTORS = "lang string, source string, base_failed boolean, z0 long, z1 long, z2 long, z3 long"


def vectors(spark, lang, source, z):
    return spark.createDataFrame([(lang, source, False, *map(int, v)) for v in z], VECTORS)


def floored_logdet(z):
    """The log determinant of z's covariance as the operator takes it: by its root, with the least spreads."""
    c, out = np.cov(z.T, bias=True), 0.0
    root = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            rest = c[i, j] - root[i, :j] @ root[j, :j]
            root[i, j] = math.sqrt(max(rest, quality.SPREAD[i] ** 2)) if i == j else rest / root[j, j]
        out += 2 * math.log(root[i, i])
    return out, root


def fast_mcd(z, rng, starts=200, core=0.75):
    """The least determinant that concentration from many random starts finds."""
    h, best = math.ceil(core * len(z)), math.inf
    for _ in range(starts):
        own = rng.choice(len(z), 6, replace=False)
        for _ in range(30):
            _, root = floored_logdet(z[own])
            d = (np.linalg.solve(root, (z - z[own].mean(axis=0)).T) ** 2).sum(axis=0)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if len(new) == len(own) and (new == own).all():
                break
            own = new
        best = min(best, floored_logdet(z[own])[0])
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_least_determinant(spark, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(4, 4)) * 900
    z = np.round(rng.normal(size=(400, 4)) @ mix + [9000, 8000, 9000, 9000]).astype(int)
    far = rng.choice(400, 80, replace=False)
    z[far] += rng.integers(4000, 7000, 4) * rng.choice([-1, 1], 4)  # contamination in one place, which must not move the estimate
    got = {r.level: r for r in quality.estimates(vectors(spark, "en", "s", z)).collect()}
    want = fast_mcd(z, rng)
    assert got[2].total == 400 and got[2].m0 == got[1].m0 == got[0].m0
    assert abs(got[2].logdet - want) < 0.25
    clean = np.delete(z, far, axis=0).mean(axis=0)
    assert all(abs(got[2][f"m{i}"] - clean[i]) < 0.25 * np.abs(mix[:, i]).sum() for i in range(4))
    root = np.zeros((4, 4))
    for i, j in quality._PAIRS:
        root[i, j] = got[2][f"l{i}{j}"]
    y = np.linalg.solve(root, (z - np.array([got[2][f"m{i}"] for i in range(4)])).T)
    found = quality._distance(vectors(spark, "en", "s", z).crossJoin(quality.estimates(vectors(spark, "en", "s", z)).where("level = 2").drop("k1", "k2"))).select("d").toPandas().d
    assert np.allclose(sorted(found), sorted((y**2).sum(axis=0)))


def test_every_group_has_its_estimate(spark, monkeypatch):
    docs = runtime.table(spark, SF, "documents")
    rows = quality.measured(docs, [docs["doc_id"]])
    groups = rows.where("not base_failed and z0 is not null").select("lang", "source").distinct().count()
    found = quality.estimates(rows)
    assert groups > 70 and found.where("level = 2").count() == groups == quality.regularised(found).count()
    leaning = quality.regularised(found).toPandas()
    assert leaning.m0.round(3).nunique() > groups // 2  # none takes another's
    whole = {r.row.doc_id: (r.kept, r.distance) for r in quality.judged(rows).collect()}
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)  # by salted joins
    assert whole == {r.row.doc_id: (r.kept, r.distance) for r in quality.judged(rows).collect()}


def test_tiny_groups_lean_on_their_language(spark):
    rng = np.random.default_rng(9)
    z = np.abs(rng.normal([1500, 50, 50, 50], 40, (500, 4))).round()
    rows = vectors(spark, "en", "big", z).unionByName(vectors(spark, "en", "one", [[1520, 60, 40, 50]])).unionByName(vectors(spark, "en", "odd", [[3900, 4000, 4000, 4000]]))
    got = Counter((r.source, r.kept) for r in quality.judged(rows).collect())
    assert got[("one", True)] == got[("odd", False)] == 1 and got[("big", True)] >= 495


@pytest.mark.parametrize("parts", [1, 7])
def test_query(spark, parts):
    rows = quality.quality(runtime.table(spark, SF, "documents").repartition(parts)).collect()
    texts = {r.doc_id: r.text for r in runtime.table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in runtime.table(spark, SF, "labels").collect()}
    assert all(tuple(r[c] for c in quality.STATS) == brute(texts[r.doc_id]) for r in rows)
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert clean.count(True) > 0.99 * len(clean)
    assert sum(not r.kept for r in rows if labels.get(r.doc_id) == 0) > 10
    if not hasattr(test_query, "seen"):
        test_query.seen = sorted((r.doc_id, r.kept, r.distance) for r in rows)
    assert test_query.seen == sorted((r.doc_id, r.kept, r.distance) for r in rows)
    assert set(queries.op5_quality(spark, SF).columns) >= {"doc_id", "kept", "base_failed", *quality.STATS}


def test_cutoff_rejects_its_share_of_normal_data(spark):
    c = quality.CUTOFF
    assert abs(math.exp(-c / 2) * (1 + c / 2) - 0.0001) < 1e-6  # chi-square with 4 degrees of freedom
    z = np.random.default_rng(3).normal([5000, 9000, 9000, 9000], [45, 60, 250, 70], (20_000, 4)).round().astype(int)
    rows = vectors(spark, "en", "s", z)
    assert 0 <= quality.judged(rows).where("not kept").count() <= 12
    assert 5 <= quality.judged(rows, cutoff=18.47).where("not kept").count() <= 40  # the 0.999 quantile


def test_junk_that_passes_the_base_rules(spark):
    labels = {r.doc_id: r.quality for r in runtime.table(spark, SF, "labels").collect()}
    passed = [(labels.get(r.doc_id), r.kept) for r in quality.quality(runtime.table(spark, SF, "documents")).collect() if not r.base_failed]
    junk = [kept for label, kept in passed if label == 0]
    clean = [kept for label, kept in passed if label == 1]
    assert len(junk) > 20 and 10 * junk.count(False) > 9 * len(junk) and clean.count(True) > 0.99 * len(clean)


def test_small_language_beside_a_hot_one(spark):
    rng = np.random.default_rng(4)
    rows = [(lang, "s", False, *map(int, v)) for lang, n, centre in (("en", 3000, 1500), ("th", 60, 3500)) for v in np.abs(rng.normal([centre, 50, 50, 50], 40, (n, 4))).round()]
    rows.append(("th", "s", False, 1500, 50, 50, 50))
    found = quality.judged(spark.createDataFrame(rows, "lang string, source string, base_failed boolean, z0 long, z1 long, z2 long, z3 long"))
    gone = [(r.lang, r.z0) for r in found.where("not kept").collect()]
    assert [x for x in gone if x[0] == "th"] == [("th", 1500)] and len(gone) <= 4  # and hardly any of the 3000


def numpy_estimate(z, w, core=0.75):
    """The estimate of one key by plain numpy: centre, covariance, size of the core and scale."""
    def rooted(c):
        root = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = c[i, j] - root[i, :j] @ root[j, :j]
                root[i, j] = math.sqrt(max(rest, quality.SPREAD[i] ** 2)) if i == j else rest / root[j, j]
        return root

    def moments(keep):
        x, v = z[keep], w[keep].astype(float)
        m = (v[:, None] * x).sum(0) / v.sum()
        c = ((v[:, None] * x).T @ x - np.outer(m, (v[:, None] * x).sum(0))) / (quality.UNITS * len(x))
        return m, c, len(x)

    def distance(m, root):
        return w / quality.UNITS * (np.linalg.solve(root, (z - m).T) ** 2).sum(0)

    def step(m, root):
        bins = np.floor(quality.BINS * np.log1p(distance(m, root))).astype(int)
        values, counts = np.unique(bins, return_counts=True)
        before = np.cumsum(counts) - counts
        return moments(bins <= values[before < math.ceil(core * len(z))].max())

    logdet = lambda root: 2 * np.log(np.diag(root)).sum()
    q = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
    starts = [(q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, quality.SPREAD)))]
    everything = moments(np.ones(len(z), bool))
    starts.append((everything[0], rooted(everything[1])))
    inside = ((z >= q[0]) & (z <= q[2])).all(1)
    if inside.any():
        box = moments(inside)
        starts.append((box[0], rooted(box[1])))
    found = []
    for m, root in starts:
        for _ in range(2):
            m, c, n = step(m, root)
            root = rooted(c)
        found.append((logdet(root), m, c, n, root))
    return min(found, key=lambda x: x[0]), step, rooted, logdet, distance


def numpy_verdicts(rows):
    """kept and distance of rows (a pandas table) by plain numpy: all keys, their steps, regularisation and distances."""
    names = [f"z{i}" for i in range(4)]
    good = rows[~rows.base_failed & rows.z0.notna()][["lang", "source", *names, "w"]].drop_duplicates()
    keys = {("", "", 0): good} | {(k, "", 1): g for k, g in good.groupby("lang")} | {(*k, 2): g for k, g in good.groupby(["lang", "source"])}
    state = {k: numpy_estimate(g[names].to_numpy(float), g.w.to_numpy()) for k, g in keys.items()}
    best = {k: s[0] for k, s in state.items()}
    for _ in range(quality.MOST_STEPS):  # all keys go on until no determinant falls any more
        fell = []
        for k, (_, step, rooted, logdet, _) in state.items():
            m, c, n = step(best[k][1], best[k][4])
            root = rooted(c)
            fell.append(best[k][0] - logdet(root))
            if fell[-1] > 0:
                best[k] = (logdet(root), m, c, n, root)
        if max(fell) < quality.SETTLED:
            break
    scale = {k: max(1.0, math.expm1(np.quantile(np.floor(quality.BINS * np.log1p(state[k][4](best[k][1], best[k][4]))), 0.5) / quality.BINS) / 3.357) for k in keys}
    mixed = {k: (best[k][1], best[k][2], scale[k]) for k in keys}
    for level in (1, 2):
        for k in [k for k in keys if k[2] == level]:
            above, n = mixed[("", "", 0)] if level == 1 else mixed[(k[0], "", 1)], best[k][3]
            m, c, s = ((n * own + quality.PRIOR * a) / (n + quality.PRIOR) for own, a in zip((best[k][1], best[k][2], scale[k]), above, strict=True))
            c[np.diag_indices(4)] = np.maximum(np.diag(c), np.diag(above[1]) / 4)
            mixed[k] = (m, c, s)
    out = []
    for r in rows.itertuples():
        own = mixed.get((r.lang, r.source, 2))
        d = None
        if own and not math.isnan(r.z0):
            y = np.linalg.solve(state[(r.lang, r.source, 2)][2](own[1]), np.array([r.z0, r.z1, r.z2, r.z3]) - own[0])
            d = r.w / quality.UNITS * (y**2).sum() / own[2]
        out.append((d, not r.base_failed and not (d is not None and d > quality.CUTOFF)))
    return out


def test_verdicts_equal_numpy(spark):
    docs = runtime.table(spark, SF, "documents")
    rows = quality.judged(quality.measured(docs, [docs["doc_id"]])).toPandas()
    want = numpy_verdicts(rows)
    assert len(rows) > 900 and all(math.isnan(r.distance) if w[0] is None else abs(r.distance - w[0]) < 1e-6 * (1 + w[0]) for r, w in zip(rows.itertuples(), want, strict=True))
    assert [bool(k) for k in rows.kept] == [w[1] for w in want]


def test_the_estimates_decide(spark):
    docs = runtime.table(spark, SF, "documents")
    measured = quality.measured(docs, [docs["doc_id"]])
    found = quality.regularised(quality.estimates(measured)).toPandas()
    spreads = np.stack([found[f"l{i}{i}"] for i in range(4)], 1)
    assert (spreads <= np.array(quality.SPREAD) + 1e-9).mean() < 0.05  # few sit on the floor
    assert (spreads.max(0) / spreads.min(0)).min() > 1.3  # and they differ
    rows = quality.judged(measured).where("not base_failed").toPandas()
    fixed = [((r.z0 - 1600) / 150) ** 2 + ((r.z1 - 650) / 150) ** 2 + ((r.z2 + 3700) / 700) ** 2 + ((r.z3 - 3800) / 200) ** 2 <= quality.CUTOFF for r in rows.itertuples()]
    assert sum(a != b for a, b in zip(fixed, rows.kept, strict=True)) > 20


def test_copies_tell_nothing_about_spread(spark):
    rng = np.random.default_rng(6)
    z = rng.normal([1600, 650, -3700, 3800], [45, 60, 250, 70], (400, 4)).round()
    rows = vectors(spark, "en", "s", np.concatenate([z, np.repeat(z[:1], 3000, 0)])).unionByName(vectors(spark, "en", "other", rng.normal([1600, 650, -3700, 3800], [45, 60, 250, 70], (400, 4)).round()))
    assert quality.judged(rows).where("not kept").count() < 8

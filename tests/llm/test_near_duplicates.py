"""op4 against brute force on made clusters, chains and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import components, near_duplicates


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(3000))
    texts = []
    passage = [word() for _ in range(60)]
    for size in (12, 40, 150):
        base = [word() for _ in range(size)]
        for _ in range(45):  # near copies around the threshold, and copies of copies
            new = list(rng.choice([base, base, texts[-1].split()] if texts else [base]))
            for _ in range(rng.randrange(1 + size // 10)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(100)]
    for _ in range(12):  # each links to the next only
        chain[rng.randrange(100)] = word()
        chain[rng.randrange(100)] = word()
        texts.append(" ".join(chain))
    for _ in range(60):  # unrelated, with a common passage
        texts.append(" ".join([*passage, *[word() for _ in range(rng.choice([5, 20, 200]))]]))
    texts += [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "a  B c\td e", texts[0], texts[0].upper(), "x " * 4000]
    out = [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (7, texts[3]), (None, texts[5]), (None, "alone here"), (3, "x y z x y z x")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk,frequent", [(64, 64), (3, 2)])
def test_brute_force(spark, rows, monkeypatch, chunk, frequent):
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    monkeypatch.setattr(near_duplicates, "HUBS", chunk // 3)
    monkeypatch.setattr(near_duplicates, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(near_duplicates, "MEMBERS", chunk)
    monkeypatch.setattr(near_duplicates, "QUERIES", chunk)
    monkeypatch.setattr(near_duplicates, "TOKENS", 60 * chunk)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, s1 int").repartition(3)
    found = near_duplicates.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_one_of_each(spark, rows):
    rows = list(dict((r[0], r) for r in rows if r[0] is not None).values())
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in brute(rows) if d == c or not n)


def test_one_of_each_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, None, None), (None, " ", "c"), (None, " ", "c")], "doc_id long, text string, comp string")
    assert near_duplicates.one_of_each(docs).count() == 5
    assert near_duplicates.one_of_each(docs.limit(0)).columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).collect())) == [(1, 0, 1, 1), (2, 0, 2, 2)]


@pytest.mark.parametrize("seed", [0, 1])
def test_no_link_is_left_closed(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = rng.permutation(base)[: rng.integers(50, 80)]
        sets.append(np.unique(np.concatenate((own, rng.integers(1, 1 << 60, rng.integers(0, 20)).astype(np.uint64)))))
    frequent = np.zeros(1 << 17, np.uint8)
    for t in base[:30].tolist():
        frequent[(t & (1 << 20) - 1) >> 3] |= 1 << (t & 7)
    assert all((near_duplicates.among(s, frequent) == np.isin(s & np.uint64((1 << 20) - 1), base[:30] & np.uint64((1 << 20) - 1))).all() for s in sets)
    lists = [near_duplicates.listed_tokens(s, near_duplicates.among(s, frequent)) for s in sets]
    group = [k // 6 * 6 if k < 60 else k for k in range(120)]
    size = [group.count(g) for g in group]
    entries = spark.createDataFrame([(t, k, len(sets[k]), group[k], size[k]) for k in range(120) for t in lists[k].view(np.int64).tolist()], "token long, node long, n long, grp long, members long")
    unions = {(r.token, r.grp): (r.low, r.high) for r in near_duplicates.token_groups(entries).collect()}
    assert unions == {(t, g): (min(len(sets[k]) for k in have), max(len(sets[k]) for k in have)) for t, g in unions for have in [[k for k in range(120) if group[k] == g and t in lists[k].view(np.int64)]]}
    found = set(map(tuple, near_duplicates.opened_groups(entries).collect()))
    both = near_duplicates.overlaps(sets, list(sets), 40_000)
    assert all(near_duplicates.overlaps(sets, sets, 40_000)[a, b] == both[a, b] for a in range(120) for b in range(a))
    assert all(both[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(40) for b in range(40) if a != b)
    links = {(a, b) for a in range(120) for b in range(120) if (size[a], group[a]) < (size[b], group[b]) and 7 * both[a, b] >= 3 * (len(sets[a]) + len(sets[b]))}
    assert links and all((a, group[b]) in found for a, b in links)
    assert len(found) < sum(len({g for g, s in zip(group, size, strict=True) if (s, g) > (size[a], group[a])}) for a in range(120))


def test_least_overlap(spark):
    def brute(n, low, high):
        fits = [m for m in range(low, high + 1) if 3 * m <= 4 * n and 3 * n <= 4 * m]
        return min((max(1, -(-3 * (n + m) // 7) - (-(-3 * max(n, m) // 4) - 1)) for m in fits), default=None)

    cases = [(n, low, high) for n in range(1, 40) for low in range(1, 60, 3) for high in range(low, 60, 7)] + [(1000, 1000, 1000), (1000, 990, 1010), (997, 1100, 1330), (10**6, 10**6, 10**6 + 1)]
    cases = [c for c in cases if brute(*c) is not None]
    rows = spark.createDataFrame(cases, "n long, low long, high long")
    got = rows.select("*", near_duplicates.least_overlap(F.col("n"), F.col("low"), F.col("high")).alias("x")).collect()
    assert all(brute(r.n, r.low, r.high) - 1 <= r.x <= brute(r.n, r.low, r.high) for r in got) and all(r.x == brute(r.n, r.low, r.high) for r in got if r.high <= r.n)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (2000, 7)] * 3
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {k: k for e in edges for k in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {k: found.get(k, k) for k in root} == root
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_by_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a")] * 20 + [(None, text, "b"), (9, text + " more", "c"), (None, "other " * 3 + text[::-1], "d"), (None, "other " * 3 + text[::-1], "d"), (3, None, "e"), (3, None, "e"), (5, text[::-1].replace("w", "v"), "f"), (5, text, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.row) for r in kept.collect()) == [(0, "d"), (3, "e"), (3, "e"), (5, "f"), (5, "g")]
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_repeated_rows_are_dealt_once(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:59], "other"])
    docs = spark.createDataFrame([(1, text)] * 2000 + [(None, text)] * 50 + [(None, near), (2, near)], "doc_id long, text string").repartition(3)
    dealt, plain = [], near_duplicates._dealt

    def counted(rows, sets):
        out = plain(rows, sets)
        dealt.append((rows.count(), sets.count(), out.count()))
        return out

    monkeypatch.setattr(near_duplicates, "_dealt", counted)
    found = near_duplicates.near_duplicates(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert sorted(map(tuple, found), key=str) == [(1, 56, 1, 2000), (2, 56, 1, 1), (None, 56, 1, 51)]
    assert dealt[0] == (4, 2, 4) and all(a == c for a, _, c in dealt)

"""op10 against brute force on made texts with edge cases, and the winnowing guarantee."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairwell.llm import decontaminate, wordhash


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(window, len(v))
        have = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in have:
                hit.update(range(i, i + n))
                if item_id is not None:
                    named.add(str(item_id))
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma délta Eps 12 x y".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 20, 60]))) for i in range(20)] + [(3, text(30)), (90, None), (91, ""), (92, "!!"), (None, text(15))]
    docs = [text(rng.choice([0, 1, 5, 13, 40, 200])) for _ in range(60)]
    for _ in range(60):
        at = rng.choice([i for i in items if i[1]])[1].split()
        lo = rng.randrange(len(at))
        docs.append(f"{text(rng.randrange(30))}; {', '.join(at[lo : lo + rng.choice([5, 12, 13, 14, 99])]).upper()} - {text(rng.randrange(200))}")
    docs += [None, "", "  ", docs[-1], docs[-1], "same " * 5000, items[0][1]]
    return docs, items


@pytest.mark.parametrize("bits", [3, 24])
def test_brute_force(spark, case, bits):
    docs, items = case
    rows = spark.createDataFrame([(i, t, "n_hit", 5) for i, t in enumerate(docs)], "doc_id long, text string, print string, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(rows, bench, filter_bits=bits).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found} == {i: brute(t, items) for i, t in enumerate(docs)}


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.contamination(rows, bench.limit(0)).collect()) == [(0, 0), (2, 0), (2, 0)]
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.contamination(rows, bench).collect()) == [(0, 0), (2, 2), (2, 2)]
    assert decontaminate.contamination(rows.limit(0), bench).count() == 0


def test_every_window_holds_a_fingerprint():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], n)) for n in (0, 3, 13, 14, 50, 400, 12, 13)]
    hashes, offsets = wordhash.words(pa.array(texts), wordhash.ALNUM)
    places, g = decontaminate.winnow(hashes, offsets, 5, 13)
    have = set(places.tolist())
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        assert all(any(p in have for p in range(i, i + 9)) for i in range(lo, hi - 12))
        assert all(p + 5 <= hi for p in have if lo <= p < hi)


def test_hashes_are_of_whole_words():
    texts = pa.array(["Ab  cd", None, "x", "", "ab CD é"]).slice(0, 5)
    hashes, offsets = wordhash.words(texts, wordhash.SOLID)
    assert offsets.tolist() == [0, 2, 2, 3, 3, 6] and hashes[0] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def test_clean_documents_by_row(spark):
    bad, good = " ".join(f"w{i}" for i in range(30)), " ".join(f"g{i}" for i in range(30))
    rows = [(None, bad), (None, good), (1, bad), (1, good), (2, None), (2, bad), (3, good), (3, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("i", bad)], "item_id string, text string")
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.where("text is null or text like 'g%'").collect(), key=str)


def test_a_passage_of_many_items(spark):
    common = " ".join(f"c{i}" for i in range(40))
    items = [(i, f"a{i} b{i} {common} z{i}") for i in range(30)] + [(7, common)]
    docs = [(k, f"x{k} y{k} {common if k % 2 else ''} {items[k][1] if k % 3 == 0 else ''}") for k in range(24)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found} == {i: brute(t, items) for i, t in docs}


def test_clean_documents_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (1, "", "y", 2), (None, "w " * 50, None, None)], "doc_id long, text string, row string, _gone int")
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert decontaminate.clean_documents(docs, items).count() == 3 and decontaminate.clean_documents(docs.limit(0), items).columns == docs.columns
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 3

"""The hidden Markov model against plain loops: paths, recursions, a whole training, and held-out texts."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwell.llm import hidden_markov as H
from pairwell.llm import wordhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(k: int, symbols: int, seed: int = 0) -> H.Model:
    draw = np.random.default_rng(seed)
    start, emit, out = draw.random(k + 1), draw.random((symbols, k)), draw.random((k, k + 1))
    start, emit, out = start / start.sum(), emit / emit.sum(0), out / out.sum(1, keepdims=True)
    return H.Model(start[:k], float(start[k]), out[:, :k], out[:, k], emit.astype(np.float32))


def plain_likelihood(m: H.Model, text: list[int]) -> float:
    """log10 by the recursion of the definition, in exact fractions of floats' size."""
    if not text:
        return math.log10(m.empty)
    value, log = m.start * m.emit[text[0]].astype(float), 0.0
    for s in text[1:]:
        log += math.log10(value.sum())
        value = (value / value.sum()) @ m.move * m.emit[s].astype(float)
    return log + math.log10(value @ m.end)


def plain_expect(m: H.Model, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    k, counts = len(m.start), np.zeros(m.emit.shape)
    edges, emit = np.zeros((2 + k, k)), m.emit.astype(float)
    for text in filter(None, texts):
        fore = [m.start * emit[text[0]]]
        fore[0] /= fore[0].sum()
        for s in text[1:]:
            v = fore[-1] @ m.move * emit[s]
            fore.append(v / v.sum())
        back = [m.end]
        for s in reversed(text[1:]):
            v = m.move @ (emit[s] * back[0])
            back.insert(0, v / v.sum())
        for t, s in enumerate(text):
            g = fore[t] * back[t]
            counts[s] += g / g.sum()
            if t:
                x = fore[t - 1][:, None] * m.move * (emit[s] * back[t])[None, :]
                edges[2:] += x / x.sum()
        edges[0] += fore[0] * back[0] / (fore[0] * back[0]).sum()
        edges[1] += fore[-1] * back[-1] / (fore[-1] * back[-1]).sum()
    return counts, edges


def test_all_paths():
    m = model(3, 4)
    for text in itertools.chain.from_iterable(itertools.product(range(4), repeat=n) for n in range(5)):
        total = m.empty if not text else 0.0
        for path in itertools.product(range(3), repeat=len(text)) if text else []:
            p = m.start[path[0]] * m.end[path[-1]] * math.prod(float(m.emit[s, i]) for s, i in zip(text, path, strict=True))
            total += p * math.prod(m.move[a, b] for a, b in zip(path, path[1:]))
        found = H.log_likelihoods(m, np.array(text, np.int32), np.array([len(text)]))
        assert abs(found[0] - math.log10(total)) < 1e-9


def test_distribution_sums_to_one():
    m = model(2, 3)
    total = sum(10 ** H.log_likelihoods(m, np.array(t, np.int32), np.array([n]))[0] for n in range(10) for t in itertools.product(range(3), repeat=n))
    alive = m.start @ np.linalg.matrix_power(m.move, 9) @ np.ones(2)  # what is left for texts of ten symbols and more
    assert abs(total + alive - 1) < 1e-6


@pytest.mark.parametrize("piece,group", [(1024, 1 << 19), (3, 7), (1, 1), (5, 1000)])
def test_recursions_in_pieces(monkeypatch, piece, group):
    monkeypatch.setattr(H, "PIECE", piece)
    monkeypatch.setattr(H, "GROUP", group)
    draw, m = np.random.default_rng(1), model(4, 9, 2)
    texts = [draw.integers(0, 9, n).tolist() for n in [0, 1, 2, 3, 5, 17, 40, 0, 7, 6, 31, 1]]
    flat, lengths = np.array(sum(texts, []), np.int32), np.array(list(map(len, texts)))
    assert np.allclose(H.log_likelihoods(m, flat, lengths), [plain_likelihood(m, t) for t in texts], atol=1e-9)
    counts = np.zeros(m.emit.shape)
    edges = H.expect(m, flat, lengths, counts)
    want, want_edges = plain_expect(m, texts)
    assert np.allclose(counts, want, atol=1e-4) and np.allclose(edges, want_edges, atol=1e-4)


def test_long_text_neither_underflows_nor_drifts(monkeypatch):
    m = model(8, 50, 3)
    text = np.random.default_rng(4).integers(0, 50, 60_000).astype(np.int32)
    assert abs(H.log_likelihoods(m, text, np.array([len(text)]))[0] - plain_likelihood(m, text.tolist())) < 1e-6


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def plain_scores(rows, states, passes, classes, least, least_share, prior):
    """The whole training by plain loops, in doubles; word hashes only place words in classes and order them."""
    texts = [words_of(t) for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    every, train = Counter(w for t in texts for w in t), Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    d = held.count(False)
    n, v = sum(train.values()) + d, len(train) + bool(d)
    vocabulary = list(every)
    hashes, tails, _ = wordhash.words_and_tails(pa.array(vocabulary, pa.string()), wordhash.SOLID)
    kind = dict(zip(vocabulary, (tails % np.uint64(classes)).tolist(), strict=True))
    edge = max(least, math.ceil(least_share * sum(every.values())))
    own = [w for _, w in sorted(zip(hashes.view(np.int64).tolist(), vocabulary, strict=True)) if every[w] >= edge and train[w] >= least]
    symbol = {w: classes + i for i, w in enumerate(own)}
    in_class = {c: [w for w in train if w not in symbol and kind[w] == c] for c in range(classes)}
    size = {c: sum(train[w] for w in ws) + len(ws) + 1 for c, ws in in_class.items()}
    lex = H.Lexicon(np.array([0] * len(own)), np.array([train[w] for w in own]), np.array([symbol[w] for w in own], np.int64), np.array([sum(train[w] for w in in_class[c]) for c in range(classes)], float), np.zeros(classes), n - d, v - bool(d), d)
    m, plain = H.first_model(lex, states)
    coded = [[symbol.get(w, kind[w]) for w in t] for t in texts]
    learn = [t for t, h in zip(coded, held, strict=True) if not h]
    for _ in range(passes if d else 0):
        counts, edges = plain_expect(m, learn)
        start = np.append(edges[0], sum(not t for t in learn)) + 1
        out = np.column_stack([edges[2:], edges[1]]) + 0.1
        emit = (counts + prior * plain[:, None]) / (counts.sum(0) + prior)
        m = H.Model(start[:-1] / start.sum(), start[-1] / start.sum(), (out / out.sum(1, keepdims=True))[:, :-1], (out / out.sum(1, keepdims=True))[:, -1], (emit / emit.sum(0)).astype(np.float32))
    found = []
    for (i, _), t, c, h in zip(rows, texts, coded, held, strict=True):
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(train[w] for w in t), d])
        inside = sum(math.log10((train[w] + 1) / size[kind[w]]) for w in t if w not in symbol)
        found.append((i, h, len(t) + 1, sum(train[w] > 0 for w in t) + (d > 0), n, base, plain_likelihood(m, c) + inside))
    return found


SMALL = dict(states=3, passes=3, classes=8, least=3, least_share=0.01, prior=5.0)


def agree(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, H.scores(docs, **SMALL).collect()), key=repr)
    want = sorted(plain_scores(rows, **SMALL), key=repr)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in want], atol=2e-3, rtol=1e-5)


def test_scores_equal_plain_loops(spark):
    draw = np.random.default_rng(5)
    tongues = [[f"{a}{b}{e}" for a in "bcdfg" for b in "aeiou"] for e in ("um", "is", "ön")]
    rows = [(i, " ".join(draw.choice(tongues[i % 3], 1 + i % 29) if i % 11 else ["New%d" % i, "New%d" % i])) for i in range(90)]
    agree(spark, rows)


def test_odd_rows(spark):
    agree(spark, [(None, "a b"), (1, None), (2, ""), (2, "  \n\t"), (3, "A a A a a"), (3, "A a A a a"), (4, "x" * 5000), (5, "a " * 3000), (30, "never seen"), (7, "a")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.scores(empty).count() == 0
    held_only = spark.createDataFrame([(i, "some words") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = H.scores(held_only, **SMALL).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b a", 5, "x"), (8, "b", 6, "y")], "doc_id long, text string, row long, symbols string")
    plain = docs.select("doc_id", "text")
    assert sorted(H.scores(docs, **SMALL).collect()) == sorted(H.scores(plain, **SMALL).collect())


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in H.scores(docs).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.1  # log10 a token

"""The alignment against a plain one: whole texts through both libraries, all pairs of tokens compared by their byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest

from pairwell.llm import alignment as A

A_PATH, B_PATH = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
ODD = [
    "a\nb c", "\n\n\nword", "word\n\n\nword  next", "don't we'll 'tis O'Neil's", "x\t y", "a  b   c ", " lead", "   ", "\n", "1,234.5 (6)", "über Äpfel×÷ñ.\nÉté", "日本語 テスト。文", "emoji 👍🏽 ok 👍.", "tab\tline\r\nend",
    "nb sp em　id x", "zero​width", "<|endoftext|> <s> </s> <unk>", "mark ▁ here", "▁", "nul\x00 x", "ﬁ ﬂ", "a." * 50, "aaaaaaa" * 30, "́ combining é", "…", "'s", "x's's", "\x85 next", "a\x85b", "a\n b", "a\n\tb", "(\n)", "q\nÄ", "q\n×", "q\n日",
]


@pytest.fixture(scope="module")
def pair():
    return A.Pair(A_PATH, B_PATH)


def tokens(pair, text):
    """Whole text through both libraries: (id, start, end) lists, or None."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    want, out = (" " + text).encode(), []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(table[i] for i in ids) != want:
            return None
        at, rows = 0, []
        for i in ids:
            rows.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(rows)
    return out


def plain(pair, rows):
    aligned, counts = [tokens(pair, t) for _, t in rows], Counter()
    pairs = [[(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else [] for found in aligned]
    for p in pairs:
        counts.update(p)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), found, p in zip(rows, aligned, pairs, strict=True):
        if not found:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({x[2] for x in found[0]} & {y[2] for y in found[1]})
        groups = [[",".join(str(t[0]) for t in side if lo <= t[1] < hi) for side in found] for lo, hi in zip([0, *cuts], cuts)]
        text = ";".join("|".join(g) for g in groups)
        out.append((i, len(found[0]), len(found[1]), len(cuts), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(text.encode()).hexdigest()))
    return out


def agree(spark, pair, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, A.align(docs, A_PATH, B_PATH, **options).collect()), key=repr) == sorted(plain(pair, rows), key=repr)


def test_units_encode_as_whole_texts(pair):
    draw = random.Random(3)
    letters = list("abzAZ019.,'’-_()\"!?@#\n\t\r    ​×ßéñЖ日語👍▁") + ["'s", "\n\n", "  ", "the", " of"]
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 40))) for _ in range(4000)]
    several = 0
    for text in texts:
        data = np.frombuffer((" " + text).encode(), np.uint8)
        starts = pair.cutter.starts(data, np.array([0]))
        units = [bytes(data[lo:hi]).decode() for lo, hi in zip(starts, [*starts[1:], len(data)])]
        a, b, good = pair.encode(units)
        assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids, text
        assert all(good) == (tokens(pair, text) is not None)
        if all(good):
            assert sum(b, []) == pair.b.encode(text), text
        several += len(units) > 1
    assert pair.cutter.usable and several > 3000


def test_starts_of_several_texts(pair):
    texts = [" " + t for t in ODD]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])[:-1]
    whole = pair.cutter.starts(data, at)
    assert set(at) <= set(whole)
    for lo, hi in zip(at, [*at[1:], len(data)]):
        alone = pair.cutter.starts(data[lo:hi], np.array([0])) + lo
        assert [x for x in whole if lo <= x < hi] == alone.tolist()


def test_brute_force(spark, pair):
    draw = random.Random(4)
    words = "the of Über naïve tokenizer 2024 don't co-op x=1; 日本 schließlich\n unbelievable ▁ aaaa".split(" ")
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(draw.choice(words[:-2] if i % 5 else words) for _ in range(draw.randrange(1, 60)))) for i in range(60)]
    rows += [(None, "null id"), (7, None), (8, ""), (100, rows[40][1]), (100, rows[40][1]), (200, "x" * 3000), (201, "word, " * 2000), (202, "日本語" * 300)]
    agree(spark, pair, rows)
    agree(spark, pair, rows, block_bytes=64)


def test_empty_table_and_clashing_columns(spark, pair):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b.", "u", 2)], "doc_id long, text string, unit string, block int")
    found = A.align(docs, A_PATH, B_PATH, keep_groups=True).collect()
    assert [tuple(r)[:-1] for r in found] == plain(pair, [(1, "a b.")]) and hashlib.sha256(found[0].groups.encode()).hexdigest() == found[0].groups_sha256
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, A.align(only_empty, A_PATH, B_PATH).collect())) == plain(pair, [(1, None), (2, "")])


def test_driver_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # brute force of all pairs is slow on long texts; the shorter half suffices here
    agree(spark, pair, sorted(rows, key=lambda r: len(r[1] or ""))[: len(rows) // 2])

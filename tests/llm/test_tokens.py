"""op6, op8 and op9 against the libraries, on the small tables and on edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import bpe_tree, queries, runtime, token_counts, token_files

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "a\n\n b", "x'll y'", "don't 'LL", "naïve  café\u00a0x", "<|endoftext|> a<|endoftext|>", "▁▁a▁", "1234567 890", "a" * 9000, "!?" * 3000, " " * 700 + "x", "\n \n\t z", "日本語テキスト" * 40, "\u3000x \x85y \x1cz", "<s>a</s>"]


def docs(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in runtime.table(spark, SF, "documents").orderBy("doc_id").select("text").collect()]


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe_tree.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken"))
    return [bpe_tree.TreeBPE(ranks, vocabularies.PATTERN, a, b) for a, b in ((1, 1), (3, 2), (17, 5), (8192, 4096))]


def test_tree_equals_library(codecs, texts):
    for codec in codecs:
        for text in [*ODD, *(t[:1500] for t in texts[:40])]:
            ids = codec.encode(text)
            assert ids == codec.library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_every_token_encodes_to_itself(codecs):
    for token, rank in bpe_tree.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken")).items():
        if len(token) > 1:
            assert codecs[1].piece(token) == [rank]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stlre v1.,!\n\t é日 "), max_size=60))
def test_tree_on_random_texts(text):
    ranks = bpe_tree.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken")) if not hasattr(test_tree_on_random_texts, "codec") else None
    if ranks:
        test_tree_on_random_texts.codec = bpe_tree.TreeBPE(ranks, vocabularies.PATTERN, 3, 2)
    codec = test_tree_on_random_texts.codec
    assert codec.encode(text) == codec.library.encode_ordinary(text)


def test_encode_decode_rows(spark, codecs):
    rows = {r.doc_id: r for r in bpe_tree.encode_decode(docs(spark, [*ODD, None]), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, keep_ids=True, keep_bytes=True).collect()}
    for i, text in enumerate([*ODD, ""]):
        ids = codecs[-1].library.encode_ordinary(text)
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids) and bytes(rows[i].decoded) == text.encode()
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_tree.encode_decode(docs(spark, []), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN).count() == 0


def test_counts_equal_library(spark, texts):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.Counter(path, memo=100)
    assert counter.by_unit
    rng = random.Random(1)
    made = ["".join(rng.choice([" ", "  ", "a", "the", "é", "\n", "▁", "x1"]) for _ in range(12)) for _ in range(400)]
    every = [*ODD, *made, *texts]
    assert counter.count(every) == [len(model.encode(t)) for t in every]
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(spark, [*ODD, None]), path, limit=100).collect()}
    for i, text in enumerate([*ODD, ""]):
        n = len(model.encode(text))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def brute_files(rows, path, end):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_equal_library(spark, texts):
    path = vocabularies.path("byte_bpe_50k.json")
    rows = [(i * 7 % 211, t) for i, t in enumerate([*ODD, *texts[:150], None])] + [(5, "twice"), (5, "twice"), (None, "no id")]
    folder = runtime.shared_dir(spark)
    token_files.write(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5), folder, path, vocabularies.PATTERN, 2)
    found = sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1])
    assert found == brute_files(rows, path, 2)
    one = token_files.read(spark, folder, keep_ids=True).where("start = 0").first()
    assert len(one.ids) == one.n_tokens and one.ids[-1] == 2
    folder = runtime.shared_dir(spark)
    assert token_files.write(docs(spark, []), folder, path, vocabularies.PATTERN, 2) == [] and token_files.read(spark, folder).count() == 0


def test_queries_equal_libraries(spark, texts):
    rows = sorted(map(tuple, queries.op9_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    ids = [r[0] for r in runtime.table(spark, SF, "documents").orderBy("doc_id").select("doc_id").collect()]
    assert rows == sorted(brute_files(list(zip(ids, texts, strict=True)), vocabularies.path("byte_bpe_50k.json"), 2))

"""Byte-level BPE encoding as a monoid: halves are encoded recursively and neighbours joined.

The joined value of two neighbouring spans is the encoding of their concatenation. Only tokens near
the seam can change, so a join re-encodes a window around it and grows the window until the tokens
outside are proven stable:

* between pre-tokens: at a change from non-space to space, from letter to non-letter or from digit
  to non-digit the pattern always ends a match, whatever stands around it. The window grows from the
  seam to the nearest such place on either side;
* inside one very long pre-token: a token sequence is the BPE encoding of its bytes exactly if each
  pair of neighbouring tokens is the encoding of the pair's bytes. The window grows, token by token
  and doubling, until the pairs at its edges pass that test.

Decoding concatenates bytes up the same tree. Leaves, some twenty words or a long word's 64 bytes, are
encoded by the tokenizer library.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .runtime import ship


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TreeBPE:
    """Encoder and decoder; leaf_chars and leaf_bytes bound what a leaf of the tree holds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 128, leaf_bytes: int = 64):
        import regex
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.edge = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
        self.back = regex.compile(self.edge.pattern, regex.REVERSE)
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.stable = lru_cache(maxsize=100_000)(self._stable)

    # -- one pre-token -----------------------------------------------------------------------------
    def _stable(self, a: int, b: int) -> bool:
        return self.library._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one pre-token."""
        if len(data) <= self.leaf_bytes:
            return self.library._encode_single_piece(data) if data else []
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left and right together, inside one pre-token."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.library._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            left_holds = i == len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = (i if left_holds else 2 * i), (j if right_holds else 2 * j)

    # -- texts -------------------------------------------------------------------------------------
    def _edge_before(self, text: str, lo: int, seam: int) -> int:
        """The last proven pre-token boundary in text[lo:seam], else lo."""
        width = 64
        while True:
            at = max(lo, seam - width)
            if m := self.back.search(text[at:seam]):
                return at + m.start()
            if at == lo:
                return lo
            width *= 2

    def _edge_behind(self, text: str, seam: int, hi: int) -> int:
        """The first proven pre-token boundary in text[seam:hi], else hi."""
        width = 64
        while True:
            to = min(hi, seam + width)
            if m := self.edge.search(text[seam:to]):
                return seam + m.start()
            if to == hi:
                return hi
            width *= 2

    def _span(self, text: str) -> list[int]:
        """The encoding of a window, without the text tree."""
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        return [t for m in self.pattern.finditer(text) for t in self.piece(m[0].encode())]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives them."""

        def node(lo: int, hi: int) -> list[int]:
            if hi - lo <= self.leaf_chars:
                return self.library.encode_ordinary(text[lo:hi])
            seam = (lo + hi) // 2
            left, right = node(lo, seam), node(seam, hi)
            a, b = self._edge_before(text, lo, seam), self._edge_behind(text, seam, hi)
            gone_left, gone_right = len(self._span(text[a:seam])), len(self._span(text[seam:b]))
            return left[: len(left) - gone_left] + self._span(text[a:b]) + right[gone_right:]

        return node(0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> TreeBPE:
    return TreeBPE(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_bytes: bool = False, slice_rows: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; if asked for, also ids and decoded (bytes).

    A null text is an empty one: no tokens, the hashes of nothing. Repeated rows and equal ids give a
    row each; null ids stay null; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches):
        codec = _codec(ranks_path, pattern)
        names = [str(i) for i in range(max(codec.bytes_of) + 1)]
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                batch = big.slice(at, slice_rows)
                n, sha, back, all_ids, all_bytes = [], [], [], [], []
                for text in pc.fill_null(batch.column(1), "").to_pylist():
                    ids = codec.encode(text)
                    data = codec.decode(ids)
                    n.append(len(ids))
                    sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                    if keep_bytes:
                        all_bytes.append(data)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                labels = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    labels.append("ids")
                if keep_bytes:
                    columns.append(pa.array(all_bytes, pa.binary()))
                    labels.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_bytes
    return rows.mapInArrow(run, schema)

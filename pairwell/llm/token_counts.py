"""Token counts of texts by a sentencepiece model, with the whole-token shortcut.

No vocabulary entry of such a model holds the space mark after another character, so the merges of a
unit (spaces and the word behind them) never reach into the next unit and the count of a text is the
sum over its units. `provable` checks that offline for the vocabulary in use; without it texts go to
the library whole. `whole_tokens` proves which words encode alone as one token; those are counted by
a lookup. Only the other units are merged, by the library, and remembered up to `memo` units.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .runtime import ship

MARK = "▁"
#: Units longer than this are not remembered.
LONG = 48
_UNITS = re.compile(" +[^ ]*")


def provable(pieces: list[str]) -> bool:
    """Whether no piece holds the space mark behind another character."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


def whole_tokens(model) -> dict[str, int]:
    """The words of the vocabulary that the model encodes alone as exactly one token."""
    words = [p[1:] for p in map(model.id_to_piece, range(model.get_piece_size())) if p.startswith(MARK) and MARK not in p[1:]]
    words = [w for w in words if w]
    return {w: 1 for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1}


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str, memo: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = self.model.encode("a b", out_type=str)
        self.by_unit = provable(pieces) and probe == [MARK + "a", MARK + "b"] and len(self.model.encode("  a ")) == len(self.model.encode("  a")) + 1
        self.known = whole_tokens(self.model) | {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}  # a unit that is one space
        self.room = memo

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text, each without its first space (the model puts one before a text)."""
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [u[1:] for u in _UNITS.findall(" " + text)]
        return text.split(" ") if text else []

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        known, out, waiting = self.known, [], {}
        for text in texts:
            units = self.units(text)
            try:
                out.append(sum(map(known.__getitem__, units)))
            except KeyError:
                out.append(units)
                waiting.update((u, 0) for u in units if u not in known)
                if len(waiting) > 50_000:
                    self._settle(out, waiting)
                    waiting = {}
        self._settle(out, waiting)
        return out

    def _settle(self, out: list, waiting: dict[str, int]) -> None:
        """Replace the unit lists in out by counts."""
        known, names = self.known, list(waiting)
        waiting.update(zip(names, map(len, self.model.encode(names, num_threads=1)), strict=True))
        for i in range(len(out) - 1, -1, -1):
            if type(out[i]) is list:
                out[i] = sum(known[u] if u in known else waiting[u] for u in out[i])
        for u in names:
            if self.room <= 0:
                break
            if len(u) <= LONG:
                known[u] = waiting[u]
                self.room -= 1


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and equal ids give a row each; a
    null id stays null; other columns are not read, whatever their names; an empty table gives none.
    Long texts are counted whole.
    """
    ship(docs.sparkSession)

    def run(batches):
        counter = _counter(model_path)
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                batch = big.slice(at, slice_rows)
                text = pc.fill_null(batch.column(1), "")
                counts = pa.array(counter.count(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), counts, pc.greater(counts, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Token ids as flat unsigned files with 64-bit document offsets, and their reader.

Documents are range-partitioned and sorted by id, so partition p holds the documents before those of
p + 1. Each partition is one shard of three flat little-endian files in the shared folder:

* `shard-<p>.ids`      ids of all its documents, uint16 where the vocabulary fits, else uint32
* `shard-<p>.offsets`  uint64, number of documents + 1: where each document starts in the shard
* `shard-<p>.docs`     int64 document ids, then a byte for each: 1 where the id is null

The bases of the shards are the prefix sums of their lengths, in `manifest.json`. Tasks write under a
name of their attempt and rename at the end, so a repeated task replaces its shard by an equal one.
The reader maps the files and slices them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship

#: A space with white space or the end behind it.
_ODD = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")
LONG = 48


class Memo(dict):
    """Ids by part; notes which parts it was asked for in vain."""

    def __init__(self):
        self.missed: list[str] = []

    def __missing__(self, part: str) -> bytes:
        self.missed.append(part)
        return b""


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones as they are, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian bytes.

    The pre-tokenizer's pattern always starts a pre-token at a space with a non-space behind it, so a
    text can be cut there and the ids of the parts concatenated. A part's pre-tokens go through the
    library's model once and are remembered, as are parts, up to `memo` of each. Texts that hold the
    string of an added token go through the library whole, and so does everything if a probe shows
    that the tokenizer isn't of this kind.
    """

    def __init__(self, path: str, pattern: str, memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters, self.findall = self.library.model, byte_letters(), regex.compile(pattern).findall
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo, self.parts, self.tokens = memo, Memo(), {}
        probe = "A probe's  text,\n it'll \t cost 12.50 €; déjà  VU?! \n\n x"
        self.cuts = all(self._part(t) == self._whole(t) for t in (probe, " " + probe, "probe", " probe"))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, text: str) -> bytes:
        """The ids of text, pre-token by pre-token."""
        out, tokens = [], self.tokens
        for piece in self.findall(text):
            ids = tokens.get(piece)
            if ids is None:
                found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
                ids = np.array([t.id for t in found], self.kind).tobytes()
                if len(tokens) < self.memo and len(piece) <= LONG:
                    tokens[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if not self.cuts or any(a in text for a in self.added):
            return self._whole(text)
        if _ODD.search(text):
            cut = _BEFORE_WORD.split(text)
            first, rest = cut[0], [p[1:] for p in cut[1:]]
        else:
            first, *rest = text.split(" ")
        memo = self.parts
        ids = list(map(memo.__getitem__, rest))
        if memo.missed:
            new = {p: self._part(" " + p) for p in set(memo.missed)}
            memo.missed.clear()
            ids = [x or new[p] for p, x in zip(rest, ids, strict=True)]
            if len(memo) < self.memo:
                memo.update((p, x) for p, x in new.items() if len(p) <= LONG)
        return self._part(first) + b"".join(ids)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _path(uri: str) -> str:
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 256) -> list[dict]:
    """Write the shards and the manifest; returns the manifest's shards, one a partition with rows.

    Rows with equal ids stand in the order of their texts, null ids first, null texts as empty ones:
    only end_id. Repeated rows are all written. An empty table gives a manifest without shards.
    """
    ship(docs.sparkSession)
    folder = _path(folder)
    store, root = _open(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        encoder, task = _encoder(tokenizer_path, pattern), TaskContext.get()
        end, step = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        place, top = _open(folder)
        name, mine = f"{top}/shard-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        lengths, ids, nulls, out = [0], [], [], None
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                batch = big.slice(at, slice_rows)
                out = out or place.open_output_stream(f"{name}.ids{mine}")
                for data in encoder.encode(pc.fill_null(batch.column(1), "").to_pylist()):
                    out.write(data + end)
                    lengths.append(len(data) // step + 1)
                ids.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False))
                nulls.append(pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False))
        if not out:
            return
        out.close()
        offsets = np.cumsum(lengths, dtype="<u8")
        for kind, data in (("offsets", offsets.tobytes()), ("docs", np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())):
            with place.open_output_stream(f"{name}.{kind}{mine}") as f:
                f.write(data)
        for kind in ("ids", "offsets", "docs"):
            place.move(f"{name}.{kind}{mine}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_docs": [len(lengths) - 1], "n_ids": [int(offsets[-1])], "width": [step]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = [r.asDict() for r in rows.mapInArrow(run, "shard long, n_docs long, n_ids long, width long").collect()]  # one row a partition
    shards.sort(key=lambda s: s["shard"])
    for shard, base in zip(shards, accumulate((s["n_ids"] for s in shards), initial=0), strict=False):
        shard["base"] = base
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"shards": shards, "end_id": end_id}).encode())
    return shards


def _flat(place: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array; mapped where the store is a local or mounted one."""
    if isinstance(place, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with place.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str, *, slice_rows: int = 4096, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; with keep_ids also ids."""
    ship(spark)
    folder = _path(folder)
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def run(batches):
        place, top = _open(folder)
        for batch in batches:
            for s in batch.to_pylist():
                name = f"{top}/shard-{s['shard']:06d}"
                ids = _flat(place, f"{name}.ids", f"<u{s['width']}")
                offsets = _flat(place, f"{name}.offsets", "<u8")
                docs = _flat(place, f"{name}.docs", "u1")
                n = s["n_docs"]
                doc_ids, nulls = docs[: 8 * n].view("<i8"), docs[8 * n :].astype(bool)
                for lo in range(0, n, slice_rows):
                    hi = min(n, lo + slice_rows)
                    at = offsets[lo : hi + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = [pa.array(doc_ids[lo:hi], mask=nulls[lo:hi]), pa.array(at[:-1] + s["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = spark.createDataFrame([(s["shard"], s["n_docs"], s["width"], s["base"]) for s in shards], "shard long, n_docs long, width long, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return rows.repartition(max(1, len(shards))).mapInArrow(run, schema)

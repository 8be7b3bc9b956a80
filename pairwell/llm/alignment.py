"""Alignment of two tokenizers: groups between common cuts, links of overlapping tokens, counts of linked ids.

A text is cut into units at places where both tokenizers are proven to end a token whatever stands
around (`Cutter`), so the tokens of a text are those of its units. Equal units align equally: the
alignment is made once for each distinct unit and weighted by how often the unit occurs.

* Texts go, in blocks of bounded size, to places in a block's list of distinct units.
* The units of all blocks, dealt by unit once for both uses, are each encoded once by both libraries.
* The alignment is relational: a row a token, a running sum of lengths gives its end, both sides meet
  on (unit, end); rows where both end are cuts, whose running count numbers the groups. Between
  neighbouring ends exactly one token of each side overlaps, and an overlap holds no end inside, so
  the rows themselves, each with the tokens that end there or next, are the links.
* Links weighted by occurrences give the counts of id pairs and each B id's highest; sums by unit go
  back to the blocks, where each text adds up its units.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, wordhash
from .runtime import ship

MARK = "▁"
_BLOCK = "block long, doc_ids array<long>, sizes array<int>, places array<int>, units array<string>, times array<int>"
#: Pairs of ids that are broadcast at most.
TOP_PAIRS = 1 << 16
#: Bytes looked at together when a block is cut.
_STRIDE = 1 << 20
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (self.a.get_vocab_size(with_added_tokens=True))
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]  # the library drops a space that is all it gets
        self.cutter = Cutter(a_path, self.b)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """A's and B's ids of units as they stand inside a text, and whether both give the unit's bytes."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)] if units else []
        probe = self.cutter.probe
        heads = ["" if u[0] == " " else probe[u.encode()[0]] for u in units]
        b = self.b.encode([u[1:] if not h else h + u for u, h in zip(units, heads, strict=True)], num_threads=1) if units else []
        skip = {h: len(self.b.encode(h)) for h in set(heads) if h}
        b = [ids[skip[h] :] if h else ids or self.space for ids, h in zip(b, heads, strict=True)]
        good = []
        for u, x, y in zip(units, a, b, strict=True):
            data = u.encode()
            good.append(b"".join(map(self.a_bytes.__getitem__, x)) == data and b"".join(map(self.b_bytes.__getitem__, y)) == data)
        return a, b, good


class Cutter:
    """Where both tokenizers surely end a token, from the bytes around.

    A: with the usual byte-level pattern and nothing before it, a match ends between white space and what
    precedes it, between a letter and an ASCII character that isn't one, and between a single line feed and
    a character that isn't white space. B: merges only make pieces of the vocabulary, so no token spans two
    bytes that stand side by side in no piece. Without the first no text is cut at all: a unit is a text.
    """

    def __init__(self, a_path: str, b_model):
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.usable = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made["model"].get("dropout")
        pieces = [b_model.id_to_piece(i) for i in range(b_model.get_piece_size()) if not (b_model.is_byte(i) or b_model.is_control(i) or b_model.is_unknown(i))]
        together = np.zeros((256, 256), bool)
        for piece in pieces:
            data = np.frombuffer(piece.encode(), np.uint8)
            together[data[:-1], data[1:]] = True
        identity = b_model.encode("a  b ", out_type=str) == [MARK + "a", MARK, MARK + "b", MARK] and not b_model.encode(MARK + "x") == b_model.encode("x")
        self.usable &= identity
        apart = ~together
        apart[:, 32] = not any(MARK in p.lstrip(MARK) for p in pieces)  # spaces are marks there
        self.probe = {}
        for byte in range(128):
            found = [c for c in "\nabcdefghijklmnopqrstuvwxyz" if apart[ord(c), byte]]
            if byte != 32 and found:
                self.probe[byte] = found[0]
        for lead in range(0xC3, 0xF5):
            if apart[10, lead]:
                self.probe[lead] = "\n"
        self.apart = apart & (np.isin(np.arange(256), [32, *self.probe]))[None, :]

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether units start at the bytes from the fifth on."""
        now, before = data[4:], data[3:-1]
        two, three, four = data[2:-2], data[1:-3], data[:-4]
        wide = before >= 0x80
        solid = (before > 32) & (before < 127) | wide & ((two >= 0xC3) & (two <= 0xDF) | (three >= 0xE4) & (three <= 0xEE) | (four >= 0xF0) & (four <= 0xF4))
        letter = _LETTER[before] | wide & (two >= 0xC3) & (two <= 0xC9) & ~((two == 0xC3) & np.isin(before, [0x97, 0xB7]))
        space = (now == 32) | (now == 10) | (now == 9) | (now == 13)
        found = solid & space | letter & (now < 128) & ~_LETTER[now]
        line = np.zeros(len(found), bool)  # a line feed that is a unit
        line[1:] = (before[1:] == 10) & (solid & space)[:-1]
        found |= line & ((now > 32) & (now < 127) | (now >= 0xC3) & (now <= 0xDF) | (now >= 0xE4) & (now <= 0xEE) | (now >= 0xF0) & (now <= 0xF4))
        return found & self.apart[before, now]

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where units start in the bytes of texts (each led by a space), given where texts start."""
        cut = np.zeros(len(data), bool)
        for lo in range(4, len(data) if self.usable else 0, _STRIDE):
            cut[lo : lo + _STRIDE] = self._cuts(data[lo - 4 : lo + _STRIDE])
        for k in range(1, 4):  # the bytes read before a text's first few are those of another text
            near = texts + k
            cut[near[near < len(data)]] = False
        cut[texts] = True
        return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Blocks of texts: the distinct units, how often each occurs, and each text as places of units in that list."""

    def run(batches):
        cutter, block = _pair(a_path, b_path).cutter, TaskContext.get().partitionId() << 33
        for batch in wordhash.slices(batches, 1, block_bytes):
            text = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            text = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text.filter(pa.array(~empty)), pa.scalar(" ", pa.large_string()))
            n = len(text)
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n else np.empty(0, np.uint8)
            at = ends - ends[0]
            starts = cutter.starts(data, at[:-1]) if n else np.empty(0, np.int64)
            units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            places, listed = units.indices.to_numpy(), units.dictionary
            times = np.bincount(places, minlength=len(listed))
            order = np.argsort(-times, kind="stable")  # common units get small places, which take less space
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            places, listed, times = rank[places], listed.take(pa.array(order)), times[order]
            sizes = np.zeros(batch.num_rows, np.int32)
            sizes[~empty] = np.diff(np.searchsorted(starts, at))
            row = [block, batch.column(0), sizes, places, listed.cast(pa.string()), times.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in row[1:]]], names=[p.split()[0] for p in _BLOCK.split(", ")])
            block += 1

    return docs.mapInArrow(run, _BLOCK)


def _encoded(units: DataFrame, a_path: str, b_path: str, slice_rows: int = 2048) -> DataFrame:
    """unit, times, uid, good, and for both sides ids and lengths."""

    def run(batches):
        pair, uid = _pair(a_path, b_path), TaskContext.get().partitionId() << 33
        for big in batches:
            for lo in range(0, big.num_rows, slice_rows):
                batch = big.slice(lo, slice_rows)
                a, b, good = pair.encode(batch.column(0).to_pylist())
                columns = [batch.column(0), batch.column(1), pa.array(uid + np.arange(batch.num_rows)), pa.array(good)]
                for ids, sizes in ((a, pair.a_size), (b, pair.b_size)):
                    ids = pa.array(ids, pa.list_(pa.int32()))
                    columns += [ids, pa.ListArray.from_arrays(ids.offsets, pa.array(sizes[ids.flatten().to_numpy(zero_copy_only=False)]))]
                uid += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "times", "uid", "good", "a", "a_size", "b", "b_size"])

    return units.mapInArrow(run, "unit string, times long, uid long, good boolean, a array<int>, a_size array<int>, b array<int>, b_size array<int>")


def _places(blocks: DataFrame) -> DataFrame:
    """of (block), place, unit, times: the units of all blocks, dealt by unit; a unit has at most a row a block."""
    rows = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("units", "times")).alias("place", "x"))
    return rows.select("of", "place", F.col("x.units").alias("unit"), F.col("x.times").alias("times")).repartition(_buckets(blocks), "unit")


def _distinct_units(places: DataFrame) -> DataFrame:
    """unit, times: all units, and how often they occur."""
    return places.groupBy("unit").agg(F.sum("times").alias("times"))


def _usable(blocks: DataFrame, encoded: DataFrame, spoiled: DataFrame) -> DataFrame:
    """The encoded units that both tokenizers give back, with their occurrences in texts that have tokens."""
    found = encoded.where("good").select("uid", "unit", "times", "a", "a_size", "b", "b_size")
    if spoiled.isEmpty():
        return found
    return found.join(_lost(blocks, spoiled), "unit", "left").withColumn("times", F.col("times") - F.coalesce("lost", F.lit(0))).drop("lost")


def _lost(blocks: DataFrame, bad: DataFrame) -> DataFrame:
    """unit, lost: occurrences in texts that hold a unit whose bytes a tokenizer doesn't give back."""
    hits = blocks.select("block", F.posexplode("units").alias("place", "unit")).join(bad, "unit", "left_semi").groupBy("block").agg(F.collect_list("place").alias("bad"))  # at most a block's units

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, places, bad = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (0, 1, 3))
                units = batch.column(2)[row].values
                text = np.repeat(np.arange(len(sizes)), sizes)
                gone = np.zeros(len(sizes), bool)
                gone[text[np.isin(places, bad)]] = True
                lost = np.bincount(places[gone[text]], minlength=len(units))
                some = np.flatnonzero(lost)
                yield pa.RecordBatch.from_arrays([units.take(pa.array(some)), pa.array(lost[some])], names=["unit", "lost"])

    lost = blocks.join(hits, "block").select("sizes", "places", "units", "bad").mapInArrow(run, "unit string, lost long")
    return lost.groupBy("unit").agg(F.sum("lost").alias("lost"))


def token_ends(encoded: DataFrame) -> DataFrame:
    """uid, times, end, a, b: where tokens end in a unit, with the id of the token of each side that ends there, else null.

    The full outer join of both sides on (uid, end), as one grouping, since both come from the same rows.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.arrays_zip(F.col(n).alias("id"), F.col(f"{n}_size").alias("size")).alias("tokens")) for k, n in enumerate("ab")])
    rows = encoded.select("uid", "times", F.explode(sides).alias("x")).select("uid", "times", "x.side", F.posexplode("x.tokens").alias("pos", "token"))
    running = F.sum("token.size").over(Window.partitionBy("uid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = rows.select("uid", "times", "side", F.col("token.id").alias("id"), running.cast("int").alias("end"))
    return ends.groupBy("uid", "end").agg(F.first("times").alias("times"), *[F.max(F.when(F.col("side") == k, F.col("id"))).alias(n) for k, n in enumerate("ab")])


def linked(ends: DataFrame) -> DataFrame:
    """ends with link_a, link_b (the linked ids: those that end there or next) and part (the group's number from the unit's end)."""
    back = Window.partitionBy("uid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    return ends.select("*", F.last("a", ignorenulls=True).over(back).alias("link_a"), F.last("b", ignorenulls=True).over(back).alias("link_b"), F.sum(cut).over(back).cast("int").alias("part"))


def _of_units(encoded: DataFrame) -> DataFrame:
    """unit, uid, times, groups and links (pairs of ids) of each unit; rows of a unit stay in one partition throughout."""
    placed = encoded.repartition("uid")
    rows = linked(token_ends(placed))
    parts = rows.groupBy("uid", "part").agg(F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("end", "a", "b", "link_a", "link_b"))).alias("x"))
    ids = lambda c: F.transform(F.filter("x", lambda e: e[c].isNotNull()), lambda e: e[c].cast("string"))
    parts = parts.select("uid", "part", "times", "x", ids("a").alias("ids_a"), ids("b").alias("ids_b"))
    group = F.concat(F.array_join("ids_a", ","), F.lit("|"), F.array_join("ids_b", ","))
    parts = parts.select("uid", "part", "times", group.alias("group"), F.transform("x", lambda e: F.struct(e["link_a"].alias("a"), e["link_b"].alias("b"))).alias("links"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("part"), "group", "links")))
    units = parts.groupBy("uid").agg(F.first("times").alias("times"), listed.alias("x"))
    units = units.select("uid", "times", F.array_join(F.transform("x", lambda e: e["group"]), ";").alias("groups"), F.flatten(F.transform("x", lambda e: e["links"])).alias("links"))
    return units.join(placed.select("uid", "unit"), "uid")


def group_sizes(groups: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """n_a, n_b, n_groups and n_links of group strings, which needn't be sent beside them; of null ones any numbers.

    The ends in a group are those of its tokens, the last of which both sides share: it has one link less than tokens.
    """
    count = lambda x, mark: pc.fill_null(pc.count_substring(x, mark), 0).to_numpy().astype(np.int64)
    n_groups = count(groups, ";") + 1
    n_a = count(pc.replace_substring_regex(groups, r"\|[^;]*", ""), ",") + n_groups
    n_b = count(groups, ",") + 2 * n_groups - n_a
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}


def _exploded(units: DataFrame, *columns: str) -> DataFrame:
    """A row for each link of the units, with its pair of ids as one number."""
    rows = units.select(*columns, F.explode("links").alias("x"))
    return rows.select(*columns, (F.shiftleft(F.col("x.a").cast("long"), 32) + F.col("x.b")).alias("pair"))


def pair_counts(units: DataFrame) -> DataFrame:
    """pair, n (links corpus-wide) and best (whether n is the highest of its B id)."""
    pairs = _exploded(units, "times").groupBy("pair").agg(F.sum("times").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return pairs.select("pair", "n", (F.col("n") == top).alias("best"))


def _weights(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """uid, n_best, count_sum.

    Pairs with at least a TOP_PAIRS-th of all links are at most TOP_PAIRS, and broadcast: their links are added up
    by unit before any shuffle. Only links of rarer pairs, so of no hot key, meet their counts in a join.
    """
    edge = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / TOP_PAIRS
    common, rare = pairs.where(F.col("n") >= edge), pairs.where(F.col("n") < edge)
    hit = _exploded(units, "uid").join(F.broadcast(common), "pair").select("uid", "n", "best")
    missed = _exploded(units, "uid").join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").select("uid", "n", "best")
    return hit.unionByName(missed).groupBy("uid").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))


#: What a text adds up over its units.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _of_texts(blocks: DataFrame, places: DataFrame, units: DataFrame, keep_groups: bool) -> DataFrame:
    """The sums and group strings of each text; a block and its units are one group, bounded by the block's bytes."""
    found = places.drop("times").join(units, "unit").drop("unit")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string" + ", groups string" * keep_groups

    def run(texts: pa.Table, parts: pa.Table) -> pa.Table:
        row = texts.slice(0, 1).combine_chunks().to_batches()[0]
        ids, sizes, places = (row.column(row.schema.get_field_index(c))[0].values for c in ("doc_ids", "sizes", "places"))
        sizes, places = sizes.to_numpy(zero_copy_only=False).astype(np.int64), places.to_numpy(zero_copy_only=False)
        order = np.empty(parts.num_rows, np.int64)
        order[parts["place"].to_numpy()] = np.arange(parts.num_rows)
        at = np.concatenate([[0], np.cumsum(sizes)])
        spoiled = pc.is_null(parts["groups"]).to_numpy()[order].astype(np.int64) if parts.num_rows else np.empty(0, np.int64)
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[places])])[at])
        good = (add(spoiled) == 0) & (sizes > 0)
        sums = group_sizes(parts["groups"]) | {c: pc.fill_null(parts[c], 0).to_numpy() for c in ("n_best", "count_sum")}
        out = [ids] + [pa.array(np.where(good, add(sums[c][order]), 0)) for c in SUMS]
        strings = parts["groups"].take(pa.array(order)).to_pylist()
        whole = [";".join([strings[p] for p in places[at[i] : at[i + 1]].tolist()]) if good[i] else "" for i in range(len(sizes))]
        out.append(pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in whole], pa.string()))
        if keep_groups:
            out.append(pa.array(whole, pa.string()))
        return pa.Table.from_arrays(out, names=["doc_id", *SUMS, "groups_sha256"] + ["groups"] * keep_groups)

    sent = blocks.select("block", "doc_ids", "sizes", "places")
    return sent.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def _saved(make) -> DataFrame:
    """The table that make() describes, saved; nothing refers to its plan any more, so its shuffle files can go."""
    out = runtime.save(make())
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(df: DataFrame, column: str) -> DataFrame:
    """df, saved in buckets by a column, so that later only what meets it is shuffled."""
    spark = df.sparkSession
    name = f"pairwell_{uuid.uuid4().hex}"
    df.write.bucketBy(_buckets(df), column).option("path", runtime.shared_dir(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; if asked for, also groups.

    A tokenizes a space and the text, B the text (it adds the space). Null and empty texts, and texts
    whose bytes one of them doesn't give back, have no tokens: zeros and ''; they count for no pair. Repeated rows and equal
    ids give a row each, and count each; a null id stays null; other columns aren't read, whatever their
    names; an empty table gives no rows. Texts of any length are aligned whole. Ties are all best.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    blocks = _bucketed(_blocks(rows, a_path, b_path, block_bytes), "block")
    places = _bucketed(_places(blocks), "unit")
    encoded = _saved(lambda: _encoded(_distinct_units(places), a_path, b_path))
    spoiled = _saved(lambda: encoded.where("not good").select("unit"))
    aligned = _saved(lambda: _of_units(_usable(blocks, encoded, spoiled)))
    runtime.drop(encoded)
    pairs = _saved(lambda: pair_counts(aligned))
    weights = _saved(lambda: _weights(aligned, pairs))
    units = _saved(lambda: aligned.drop("links", "times").join(weights, "uid", "left").drop("uid").unionByName(spoiled, allowMissingColumns=True))
    runtime.drop(aligned, weights, pairs)
    return _of_texts(blocks, places, units, keep_groups)

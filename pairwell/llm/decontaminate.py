"""Benchmark decontamination by winnowed fingerprints.

Texts become word hashes. Of every `window - gram + 1` neighbouring word grams the one with the least
hash is a fingerprint (all of them, on ties), so any span of `window` words that a document shares
with an item holds a fingerprint at the same place in both. Items shorter than a window are one
window of their own length and its only fingerprint.

A fixed-size bitmap of the benchmark's fingerprints lets the documents' task drop nearly all of
theirs before anything is shuffled; what it lets through, with the words around it, is joined with
the benchmark's fingerprints by equality, and each match is extended word by word to both sides as
far as a window can reach. Extended spans of at least a window are hits. Fingerprints that stand in
the same words in several items are joined once, as one row with a set of items, so a passage of many
items and many documents makes a row for each of its places; the items are put in at the end, once
for each document and set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .runtime import bitmap, drop, save, ship, without

#: Up to so many rows of fingerprints the benchmark's side is broadcast (about 0.3 kB each).
BROADCAST_ROWS = 100_000


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i : i + width], for each i with a full window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def winnow(hashes: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the fingerprints of all texts."""
    g, wide = wordhash.grams(hashes, gram), window - gram + 1
    if len(g) < wide:
        return np.empty(0, np.int64), g[:0]
    least = _slide(g, wide, np.minimum)  # of the window that starts at a word
    for end in offsets[1:-1].tolist():  # windows that reach into the next text don't count
        least[max(0, end - window + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * (wide - 1), np.uint64)
    padded[wide - 1 : wide - 1 + len(least)] = least
    most = _slide(padded, wide, np.maximum)  # of the windows that hold a gram
    places = np.flatnonzero((most == g) & (g > 0))
    return places, g[places]


def _around(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, places: np.ndarray, gram: int, window: int, outside: int) -> np.ndarray:
    """The words from window - gram before each place to as many behind its gram; `outside` beyond the text [lo, hi)."""
    at = places[:, None] + np.arange(gram - window, window)[None, :]
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, hashes[np.clip(at, 0, max(0, len(hashes) - 1))], np.uint64(outside))


def _prints(hashes, offsets, gram, window, short, outside):
    """Places, hashes, lengths (window, or a short item's words), texts and the words around."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    places, g = winnow(hashes, offsets, gram, window)
    found.append((places, g, np.full(len(places), window)))
    for n in short:
        g = wordhash.grams(hashes, n)
        places = np.flatnonzero(offsets[1:][owner[: len(g)]] - np.arange(len(g)) >= n)
        found.append((places, g[places] ^ np.uint64(n), np.full(len(places), n)))
    return found, owner


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, gram: int = 5, filter_bits: int = 24, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated of every row of docs.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A document's
    word is hit if it stands in a run of `window` words that an item holds too, or in a whole item of
    fewer words. Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null texts have no words and hit
    nothing, nor do items without words; repeated items count once by id; an item without an id marks
    words but isn't named; repeated documents and equal ids give a row each; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    reach = 2 * window - gram
    items = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))

    def item_prints(batches):
        for batch in wordhash.slices(batches, 1):
            hashes, offsets = wordhash.words(batch.column(1), wordhash.ALNUM)
            sizes = np.diff(offsets)
            places, g = winnow(hashes, offsets, gram, window)
            owner = np.searchsorted(offsets, places, "right") - 1
            words = _around(hashes, offsets[owner], offsets[owner + 1], places, gram, window, 1)
            ids = [batch.column(0).take(pa.array(owner))]
            prints, lengths, around = [g], [np.full(len(g), window)], [words]
            few = np.flatnonzero((sizes > 0) & (sizes < window))
            for n in np.unique(sizes[few]).tolist():
                own = few[sizes[few] == n]
                prints.append(wordhash.grams(hashes, n)[offsets[own]] ^ np.uint64(n))
                lengths.append(np.full(len(own), n))
                around.append(_around(hashes, offsets[own], offsets[own + 1], offsets[own], gram, window, 1))
                ids.append(batch.column(0).take(pa.array(own)))
            around = np.concatenate(around)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(_longs(np.concatenate(prints))), pa.array(np.concatenate(lengths), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(around) + 1) * reach, pa.int32()), pa.array(_longs(around.ravel())))],
                names=["item_id", "print", "length", "item_words"],
            )

    found = items.mapInArrow(item_prints, "item_id string, print long, length long, item_words array<long>")
    bench = found.groupBy("print", "length", "item_words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    bench = save(bench.withColumn("items", F.md5(F.to_json("item_ids").cast("binary"))))
    short = sorted(r[0] for r in bench.where(F.col("length") < window).select("length").distinct().collect())  # fewer than a window
    listed_prints = spark.sparkContext.broadcast(bitmap(bench.select(F.pmod("print", F.lit(1 << filter_bits)).alias("bit")), filter_bits))

    def document_prints(batches):
        listed, part, row = listed_prints.value, TaskContext.get().partitionId() << 40, 0
        cut = np.uint64((1 << filter_bits) - 1)
        for batch in wordhash.slices(batches, 1):
            hashes, offsets = wordhash.words(batch.column(1), wordhash.ALNUM)
            found, owner = _prints(hashes, offsets, gram, window, short, 0)
            kept = []
            for places, g, length in found:
                bit = g & cut
                on = np.flatnonzero(listed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                kept.append((places[on], g[on], length[on]))
            places, g, length = (np.concatenate(x) for x in zip(*kept, strict=True))
            own = owner[places]
            order = np.argsort(own, kind="stable")
            places, g, length, own = places[order], g[order], length[order], own[order]
            around = _around(hashes, offsets[own], offsets[own + 1], places, gram, window, 0)
            lists = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
            hit = pa.StructArray.from_arrays(
                [pa.array(_longs(g)), pa.array(length, pa.int64()), pa.array(places - offsets[own], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(around) + 1) * reach, pa.int32()), pa.array(_longs(around.ravel())))],
                names=["print", "length", "place", "words"],
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows) + part), batch.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(lists, hit)], names=["row", "doc_id", "n_words", "hits"])
            row += batch.num_rows

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = save(rows.mapInArrow(document_prints, "row long, doc_id long, n_words long, hits array<struct<print:long,length:long,place:long,words:array<long>>>"))

    side = bench.select("print", "length", "items", "item_words")
    if bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    pairs = hits.join(side, ["print", "length"]).select("row", "items", "length", "place", "words", "item_words")

    def extend(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, place = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (batch.column(k).flatten().to_numpy().reshape(-1, reach) for k in (4, 5))
            same, left = a == b, window - gram
            core = np.where(length == window, gram, length)
            before = np.cumprod(same[:, left - 1 :: -1] if left else same[:, :0], axis=1).sum(axis=1)
            behind = np.cumprod(same[:, left:], axis=1).sum(axis=1)
            whole = length < window  # of a short item the whole, which starts at the place
            lo = np.where(whole, place, place - before)
            hi = np.where(whole, place + length, place + behind)
            ok = np.flatnonzero((behind >= core) & (hi - lo >= length))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(lo[ok], pa.int64()), pa.array(hi[ok], pa.int64())], names=["row", "items", "lo", "hi"])

    spans = pairs.mapInArrow(extend, "row long, items string, lo long, hi long")
    spans = save(spans.groupBy("row", "items", "lo").agg(F.max("hi").alias("hi")))
    sets = bench.select("items", "item_ids").dropDuplicates(["items"])
    named = spans.select("row", "items").distinct().join(sets, "items").select("row", F.explode("item_ids").alias("item_id"))
    named = named.distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    union = "aggregate(spans, named_struct('n', 0L, 'to', 0L), (acc, s) -> named_struct('n', acc.n + greatest(0L, s.hi - greatest(s.lo, acc.to)), 'to', greatest(acc.to, s.hi)), acc -> acc.n)"
    covered = spans.groupBy("row", "lo").agg(F.max("hi").alias("hi")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")).select("row", F.expr(union).alias("n_hit"))
    out = rows.select("row", "doc_id", "n_words").join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns; each by (a hash of) its text, whatever its id.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one;
    columns of any name are kept.
    """
    key = F.xxhash64(docs[text_col])
    found = contamination(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), items, **options)
    return without(docs, [key], save(found.where("contaminated").select("doc_id").distinct()))

"""Exact n-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct word 5-grams. Rows with equal sets form a class and
are represented by one of them; only classes are compared. Two classes link when
100 * |intersection| >= 75 * |union|, so 7 * |intersection| >= 3 * (|a| + |b|).

1. Similar classes are partitioned into groups: classes that share a pair of min-hashes meet in chunks
   of bounded size (large buckets are dealt to chunks, with a few hubs in all of them), where all
   intersections of whole sets come from one product of the chunk's class-token matrix. What is alike
   hangs together as a group; what links, inside it, as a part of the group. This finds many of the
   links, not all; it spares the exact steps the pairs inside parts.
2. The token-group matrix: every class lists the least tokens of its set, enough of them that linked
   classes share one (|set| - ceil(0.75 |set|) + 1). A row of the matrix is (token, group), once for
   all members that list it, with the least and greatest of their set sizes: the union of the group's
   listed tokens. Tokens of many documents come last in the order, so they are rarely listed, and
   tokens that one class alone lists are left out.
3. A class queries the groups larger than its own (of equal ones, those of greater number), so every
   pair of groups is looked at once, from its smaller side. The query's listed tokens that stand in
   the group's union are summed. What a query and a member share is at most that sum and the unlisted
   rest of one of them; the group is opened only if this allows a link to a member of some size in
   its range. A class outside the largest part of its own group always queries that group.
4. Opened groups are compared in blocks of bounded size, by products of class-token matrices again:
   first of a fixed sixth of the tokens, which bounds the overlap once more, then, where that allows
   a link, of whole sets. Rows are (query, group), never pairs of documents.

Any order of tokens gives all links; which tokens count as frequent only decides how much is opened.
So bitmaps of fixed size hold the frequent tokens and the shared ones: tokens that share a bit with a
frequent one come late too, and those that share one with a shared one stay in the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .runtime import bitmap, drop, save, ship, without

WORDS = 5
CHUNK, HUBS = 64, 8
#: Members and queries of a block of an opened group.
MEMBERS, QUERIES = 512, 1024
#: Tokens of a chunk or of one side of a block, about: long sets go into smaller ones.
TOKENS = 2_000_000
#: A token is frequent from so many documents on, as far as tasks see it repeat.
LEAST_FREQUENT = 64
#: Bits of the bitmaps of frequent and of shared tokens, which is what is broadcast.
FREQUENT_BITS = SHARED_BITS = 26
#: The part of a set that opened pairs are bounded by: tokens below this.
PART = np.uint64((1 << 64) // 6)
#: Tokens counted at a time in a task.
COUNTED = 4_000_000
_FILTER_BITS = 23
#: Sets that a task remembers to have sent.
SENT = 1 << 16
_NULL_ID = -(1 << 63)


def shingle_sets(batch: pa.RecordBatch, text: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text; a text with fewer words is one shingle."""
    hashes, offsets = wordhash.words(batch.column(text), wordhash.SOLID)
    grams = wordhash.grams(hashes, WORDS)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            found = np.sort(grams[lo : hi - WORDS + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            yield wordhash.grams(hashes[lo:hi], hi - lo) if hi > lo else grams[:0]


def _sums(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    a = np.add.reduceat(wordhash.mix(tokens ^ np.uint64(0x243F6A8885A308D3)), starts)
    b = np.add.reduceat(wordhash.mix(tokens ^ np.uint64(0x13198A2E03707344)), starts)
    return a, b


def _bands(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two keys of each set, each of two min-hashes."""
    least = [np.minimum.reduceat(wordhash.mix(tokens * np.uint64(2 * j + 3) ^ np.uint64(0xA4093822299F31D0 + j)), starts) for j in range(4)]
    return [wordhash.mix(least[2 * b] ^ (least[2 * b + 1] * np.uint64(31)) ^ np.uint64(b)) for b in (0, 1)]


def halves(tokens: np.ndarray) -> np.ndarray:
    """The distinct upper halves of sorted tokens."""
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, the starts of the sets with tokens, and which sets those are."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
    return (np.concatenate(sets) if len(full) else np.empty(0, np.uint64)), starts, full


def repeated(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur three times or more, and how often; tokens are sorted in place, so little is held beside them."""
    tokens.sort()
    third = tokens[2:] == tokens[:-2]
    third[1:] &= tokens[1:-2] != tokens[:-3]
    first = np.flatnonzero(third)
    found = tokens[first]
    return found, np.searchsorted(tokens, found, "right") - first


def _described(docs: DataFrame) -> DataFrame:
    """A row for each document (kind 0: row, doc_id, tag, key, n, s1, s2, k1, k2), and counts of tokens (kind 1: s1, n); saved."""

    def run(batches):
        row, held, size = TaskContext.get().partitionId() << 40, np.empty(0, np.uint64), 0

        def counted():
            tokens, n = repeated(held[:size])
            one, none = np.ones(len(n), np.int64), pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(one), none, none, none, none, pa.array(n), _longs(tokens), none, none, none], names=names)

        names = ["kind", "row", "doc_id", "tag", "key", "n", "s1", "s2", "k1", "k2"]
        for batch in wordhash.slices(batches, 1):
            sets = list(shingle_sets(batch, 1))
            tokens, starts, full = _flat(sets)
            sums = [np.zeros(len(sets), np.uint64) for _ in range(4)]
            if len(full):
                for to, values in zip(sums, [*_sums(tokens, starts), *_bands(tokens, starts)], strict=True):
                    to[full] = values
                if size + len(tokens) > len(held):
                    held = np.concatenate((held[:size], np.empty(max(size, len(tokens), COUNTED // 8), np.uint64)))
                held[size : size + len(tokens)] = tokens
                size += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int64)), pa.array(np.arange(row, row + len(sets))), batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in sets], pa.int64()), *map(_longs, sums)], names=names)
            row += len(sets)
            if size >= COUNTED:
                yield counted()
                size = 0
        if size:
            yield counted()

    return save(docs.select("doc_id", "text", "tag", "key").mapInArrow(run, "kind long, row long, doc_id long, tag long, key long, n long, s1 long, s2 long, k1 long, k2 long"))


def _in(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bits are set."""
    return bits[bit >> bit.dtype.type(3)] >> (bit & bit.dtype.type(7)).astype(np.uint8) & np.uint8(1) == 1


def among(tokens: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which tokens count as listed in a bitmap, by their low bits."""
    return _in(listed, tokens & np.uint64(8 * len(listed) - 1))


def _low(name: str, size: int):
    return F.col(name).bitwiseAND(F.lit((1 << size) - 1)).alias("bit")


def _frequent(described: DataFrame) -> np.ndarray:
    """The bitmap of frequent tokens, by their low bits."""
    found = described.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    return bitmap(found.select(_low("s1", FREQUENT_BITS)), FREQUENT_BITS)


def _made_of(docs: DataFrame, needed: DataFrame, columns: dict[str, str], make) -> DataFrame:
    """key, s1 and the columns that make(sets, tokens, starts) gives, of documents whose key is in needed (key), and perhaps of a few others.

    needed reaches the tasks as a bitmap of fixed size; the join that follows decides. However often a
    row is repeated, its set is there once: tasks leave out what they have just sent, and of the rest
    one row a (key, s1) goes on from where all of them are dealt to.
    """
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << _FILTER_BITS)).alias("bit")
    listed = docs.sparkSession.sparkContext.broadcast(bitmap(needed.select(bit), _FILTER_BITS))

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for big in batches:
            on = np.flatnonzero(_in(listed.value, big.column(2).to_numpy()))
            for batch in wordhash.slices(iter([big.take(pa.array(on))]), 1):
                sets = list(shingle_sets(batch, 1))
                tokens, starts, full = _flat(sets)
                if not len(full):
                    continue
                key, (s1, _) = batch.column(0).to_numpy()[full], _sums(tokens, starts)
                names = list(zip(key.tolist(), s1.tolist(), strict=True))
                new = [k for k, name in enumerate(names) if not (name in sent or sent.add(name))]
                if len(new) < len(names):
                    sets, key, s1 = [sets[full[k]] for k in new], key[new], s1[new]
                    tokens, starts, full = _flat(sets)
                if len(full):
                    yield pa.RecordBatch.from_arrays([pa.array(key), _longs(s1), *make([sets[k] for k in full], tokens, starts)], names=["key", "s1", *columns])
                if len(sent) > SENT:
                    sent.clear()

    schema = ", ".join(["key long", "s1 long", *(f"{a} {b}" for a, b in columns.items())])
    made = docs.select("key", "text", bit).mapInArrow(run, schema)
    return made.repartition("key", "s1").dropDuplicates(["key", "s1"])


def _sets_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """key, s1 and tokens of documents whose key is in needed."""
    return _made_of(docs, needed, {"tokens": "binary"}, lambda sets, _, __: [pa.array([x.tobytes() for x in sets], pa.binary())])


def _dealt(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with their sets. Sets are dealt by key at every size, as they must be where rows are many; so small inputs show what large ones move."""
    return rows.join(sets.hint("merge"), ["key", "s1"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group; batches are sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and lo == 0 and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(keys)) or held and lo > 0:
                yield _whole(held)
                held = []
            held.append(part)
    if held:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of each of rows with each of columns, as a product of set-token matrices."""
    own = rows is columns
    n, sets = len(rows), rows if own else [*rows, *columns]
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, bool)
    number = np.cumsum(first, dtype=np.int32) - 1
    kinds = int(number[-1]) + 1 if len(number) else 0
    if own:
        both = np.bincount(number, minlength=kinds) > 1  # the diagonal is left too small
    else:
        here, there = np.zeros(kinds, bool), np.zeros(kinds, bool)
        here[number[owner < n]] = True
        there[number[owner >= n]] = True
        both = here & there  # only tokens of both sides count
    keep = both[number]
    number, owner = (np.cumsum(both, dtype=np.int32) - 1)[number[keep]], owner[keep]
    block = max(256, most // len(sets))
    out = np.zeros((n, len(columns)), np.float64)
    for lo in range(0, int(both.sum()), block):
        a, b = np.searchsorted(number, (lo, lo + block))
        matrix = np.zeros((len(sets), block), np.float32)
        matrix[owner[a:b], number[a:b] - lo] = 1
        out += matrix[:n] @ (matrix if own else matrix[n:]).T
    return out.astype(np.int64)


def _hung(nodes: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each node of a chunk to the least one that it is connected with."""
    root = np.arange(len(nodes))
    for _ in range(len(nodes)):
        new = np.minimum(np.where(joined, root[None, :], len(nodes)).min(axis=1), root)
        if (new == root).all():
            break
        root = new
    return [(int(nodes[k]), int(nodes[r])) for k, r in enumerate(root.tolist()) if k != r]


def _links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Edges (u, v, 1) of linked sets of a chunk and (u, v, 0) of alike ones."""
    n = np.array([len(s) for s in sets], np.int64)
    total, shared = n[:, None] + n[None, :], overlaps(sets, sets)
    return [(*e, 1) for e in _hung(nodes, 7 * shared >= 3 * total)] + [(*e, 0) for e in _hung(nodes, 7 * shared >= 2 * total)]


def _chunk_edges(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 1: edges between classes with a common min-hash key; u, v, link (else only alike); saved."""
    keyed = classes.select("node", "key", "s1", "n", F.explode(F.array("k1", "k2")).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
    whole = (F.col("size") <= CHUNK + HUBS) & (F.col("tokens") <= TOKENS)
    chunks = F.greatest(F.ceil((F.col("size") - HUBS) / F.lit(CHUNK)), F.ceil(F.col("tokens") / TOKENS)).cast("int")
    members = keyed.drop("n").join(sizes, "k").withColumn("chunks", F.when(whole, F.lit(1)).otherwise(F.least(chunks, F.col("size").cast("int"))))
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("size")) < HUBS)
    own = F.array(F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")).cast("int"))
    members = save(members.select("k", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)).alias("chunk"), "node", "key", "s1"))
    sets = _dealt(members, _sets_of(docs, members.select("key"))).select("k", "chunk", "node", "tokens")

    def run(batches):
        for group in _grouped(batches, 2):
            nodes, first = np.unique(group.column(2).to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            column = group.column(3)
            edges = _links(nodes, [np.frombuffer(column[i].as_buffer(), np.uint64) for i in first.tolist()])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(3)], names=["u", "v", "link"])

    found = save(sets.repartition("k", "chunk").sortWithinPartitions("k", "chunk").mapInArrow(run, "u long, v long, link long"))
    drop(members)
    return found


def listed_tokens(tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set in the order (frequent, hash), as many as a link needs."""
    size = len(tokens) - -(-3 * len(tokens) // 4) + 1
    rare = tokens[~often]
    return rare[:size] if len(rare) >= size else np.concatenate((rare, tokens[often][: size - len(rare)]))


def _lists(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """key, s1, listed (tokens in order) and part (upper halves of the tokens below PART) of all classes; saved."""
    often = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(sets, tokens, starts):
        lists = [listed_tokens(x, mark) for x, mark in zip(sets, np.split(among(tokens, often.value), starts[1:]), strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        part = [halves(x[: np.searchsorted(x, PART)]).tobytes() for x in sets]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate(lists))), pa.array(part, pa.binary())]

    return save(_made_of(docs, classes.select("key"), {"listed": "array<long>", "part": "binary"}, make))


def _entries(lists: DataFrame, labelled: DataFrame) -> DataFrame:
    """Step 2: token, node, n, grp and members (of the group) of the listed tokens that two rows list, or more; saved."""
    counted = lists.select(F.explode("listed").alias("token")).groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    several = lists.sparkSession.sparkContext.broadcast(bitmap(counted.select(_low("token", SHARED_BITS)), SHARED_BITS))

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            tokens, ends = column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))
            keep = np.flatnonzero(among(tokens.view(np.uint64), several.value))
            kept = np.searchsorted(keep, np.concatenate(([0], ends)))
            some = pa.array(np.flatnonzero(np.diff(kept)))
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(tokens[keep]))
            yield pa.RecordBatch.from_arrays([x.take(some) for x in (batch.column(0), batch.column(1), lists)], names=["key", "s1", "tokens"])

    sizes = labelled.groupBy("grp").agg(F.count("*").alias("members"))
    own = labelled.select("key", "s1", "node", "n", "grp").join(sizes, "grp")
    pruned = lists.select("key", "s1", "listed").mapInArrow(run, "key long, s1 long, tokens array<long>")
    return save(pruned.join(own, ["key", "s1"]).select(F.explode("tokens").alias("token"), "node", "n", "grp", "members"))


def token_groups(entries: DataFrame) -> DataFrame:
    """The token-group matrix: token, grp, members, and low and high, the least and greatest set sizes of the members that list the token."""
    return entries.groupBy("token", "grp", "members").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def least_overlap(n, low, high):
    """A lower bound of the listed tokens that a set of n tokens shares with one of low to high tokens that it links with (columns).

    Links share 3 (n + m) / 7, of which the longer set doesn't list ceil(0.75 max(n, m)) - 1 at most.
    What is left rises with m up to n and falls from there on.
    """
    low, high = F.greatest(low, F.ceil(0.75 * n)), F.least(high, F.floor(4 * n / 3))
    shorter = F.ceil(3 * (n + low) / 7) - F.ceil(0.75 * n) + 1
    longer = F.ceil(3 * n / 7 - 9 * high / 28 + 0.25 - 1e-6)
    return F.greatest(F.lit(1), F.least(F.when(low <= n, shorter), F.when(high > n, longer)))


def opened_groups(entries: DataFrame) -> DataFrame:
    """Step 3: q, grp: queries, and the larger groups whose token unions allow a link."""
    matrix = token_groups(entries)
    asked = entries.select("token", F.col("node").alias("q"), "n", F.col("grp").alias("own"), F.col("members").alias("own_members"))
    smaller = F.struct("own_members", "own") < F.struct("members", "grp")
    reach = (4 * F.col("high") >= 3 * F.col("n")) & (3 * F.col("low") <= 4 * F.col("n"))
    sums = asked.join(matrix, "token").where(smaller & reach).groupBy("q", "grp", "n").agg(F.count("*").alias("overlap"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sums.where(F.col("overlap") >= least_overlap(F.col("n"), F.col("low"), F.col("high"))).select("q", "grp")


def _asked(entries: DataFrame, labelled: DataFrame) -> DataFrame:
    """q, grp of all queries and the groups that are compared with them; saved."""
    parts = labelled.groupBy("grp", "comp").agg(F.count("*").alias("size"))
    largest = parts.groupBy("grp").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    inside = labelled.join(largest, "grp").where("comp <> main").select(F.col("node").alias("q"), "grp")
    return save(opened_groups(entries).unionByName(inside))


def _blocks(asked: DataFrame, labelled: DataFrame) -> DataFrame:
    """node, grp, mb, qb, query (whether) of the blocks of the groups that are asked for (q, grp); saved.

    A group's members are dealt to mb blocks and its queries to qb; each member block meets each query block.
    """
    blocks = lambda most: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / TOKENS)).cast("int")
    asked = asked.join(labelled.select(F.col("node").alias("q"), "n"), "q")
    queries = asked.groupBy("grp").agg(blocks(QUERIES).alias("qbs"))
    sizes = labelled.join(queries, "grp", "left_semi").groupBy("grp").agg(blocks(MEMBERS).alias("mbs"))
    both = sizes.join(queries, "grp")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = labelled.select("node", "grp").join(both, "grp").select("node", "grp", F.pmod(F.xxhash64("node"), F.col("mbs")).cast("int").alias("mb"), every("qbs").alias("qb"), F.lit(0).alias("query"))
    query = asked.select(F.col("q").alias("node"), "grp").join(both, "grp").select("node", "grp", every("mbs").alias("mb"), F.pmod(F.xxhash64("node"), F.col("qbs")).cast("int").alias("qb"), F.lit(1).alias("query"))
    return member.unionByName(query)


def _compared(rows: DataFrame, kind: type, whole: bool) -> DataFrame:
    """rows (grp, mb, qb, query, node, comp, n, tokens) compared within blocks.

    Of whole sets: u, v, the comps that link. Of parts: node, grp, mb, qb, query of what whole sets are needed of.
    """

    def run(batches):
        for block in _grouped(batches, 3):
            query = block.column(3).to_numpy() == 1
            node, comp, n = (block.column(k).to_numpy() for k in (4, 5, 6))
            column = block.column(7)
            ask, have = np.flatnonzero(query), np.flatnonzero(~query)
            if not len(ask) or not len(have):
                continue
            sets = lambda at: [np.frombuffer(column[i].as_buffer(), kind) for i in at.tolist()]
            x, y = sets(ask), sets(have)
            total = n[ask][:, None] + n[have][None, :]
            fits = (comp[ask][:, None] != comp[have][None, :]) & (7 * np.minimum(n[ask][:, None], n[have][None, :]) >= 3 * total)
            if not fits.any():
                continue
            if len(ask) * len(have) <= 4:
                shared = np.array([[_shared(a, b) for b in y] for a in x])
            else:
                shared = overlaps(x, y)
            if whole:
                i, j = np.nonzero(fits & (7 * shared >= 3 * total))
                if len(i):
                    ends = np.unique(np.stack((comp[ask[i]], comp[have[j]])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["u", "v"])
                continue
            # tokens of a set with equal halves count once in its part, else in the rest
            sizes = [np.array([len(a) for a in side]) for side in (x, y)]
            rest = np.minimum((n[ask] - sizes[0])[:, None], (n[have] - sizes[1])[None, :])
            i, j = np.nonzero(fits & (7 * (shared + rest) >= 3 * total))
            if len(i):
                keep = np.concatenate((np.unique(ask[i]), np.unique(have[j])))
                keep = block.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([keep.column(k) for k in (4, 0, 1, 2, 3)], names=["node", "grp", "mb", "qb", "query"])

    schema = "u long, v long" if whole else "node long, grp long, mb int, qb int, query int"
    ordered = rows.select("grp", "mb", "qb", "query", "node", "comp", "n", "tokens")
    return ordered.repartition("grp", "mb", "qb").sortWithinPartitions("grp", "mb", "qb").mapInArrow(run, schema)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct ones share."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # merges two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _verified(docs: DataFrame, labelled: DataFrame, lists: DataFrame, asked: DataFrame) -> DataFrame:
    """Step 4: the comps that link; u, v; saved."""
    own = labelled.select("node", "key", "s1", "comp", "n")
    parts = _blocks(asked, labelled).join(own, "node").join(lists.select("key", "s1", F.col("part").alias("tokens")), ["key", "s1"])
    left = save(_compared(parts, np.uint32, False))
    nodes = save(left.join(own, "node"))
    sets = _dealt(nodes, _sets_of(docs, nodes.select("key")))
    found = save(_compared(sets, np.uint64, True))
    drop(left, nodes)
    return found


def _solved(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, tag) as doc_id, tag, n, class_id, component_id and comp, which tells components apart; saved.

    key, a hash of id and text, finds the texts of classes again; many rows may share an id, or have none.
    """
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    described = _described(docs)
    rows = described.where("kind = 0")
    ids = F.min(F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("row", "key")).alias("rep"), ids.alias("class_id"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    classes = save(classes.select(F.col("rep.row").alias("node"), F.col("rep.key").alias("key"), "s1", "s2", "n", "k1", "k2", "class_id"))
    edges = _chunk_edges(docs, classes)
    labelled, roots = classes.drop("k1", "k2"), []
    for name, found in (("comp", edges.where("link = 1")), ("grp", edges)):
        roots.append(components(found))
        labelled = labelled.join(roots[-1], "node", "left").withColumn(name, F.coalesce("root", "node")).drop("root")
    labelled = save(labelled)
    drop(classes, edges, *roots)
    lists = _lists(docs, labelled, _frequent(described))
    entries = _entries(lists, labelled)
    asked = _asked(entries, labelled)
    drop(entries)
    links = _verified(docs, labelled, lists, asked)
    drop(lists, asked)
    joined = components(links)
    final = labelled.join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp"))
    least = final.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = final.join(least, "comp").select("s1", "s2", "n", "class_id", "component_id", "comp")
    own = F.nullif(F.col("doc_id"), F.lit(_NULL_ID))
    out = rows.where("n > 0").select("doc_id", "tag", "s1", "s2", "n").join(named, ["s1", "s2", "n"]).select(own.alias("doc_id"), "tag", "n", "class_id", "component_id", "comp")
    empty = rows.where("n = 0").select(own.alias("doc_id"), "tag", "n", own.alias("class_id"), own.alias("component_id"), F.lit(None).cast("long").alias("comp"))
    out = save(out.unionByName(empty))
    drop(described, labelled, links, joined)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    component_id is the least doc_id of the rows reachable by links, itself included; class_id the
    least of the rows with an equal set. A text without words, or null, has an empty set and is linked
    with nothing, also not with another empty one. Repeated rows and equal ids give a row each; rows
    without an id take part, and their component's id is null only if none of its rows has one.
    Other columns are not read. An empty table gives no rows. The result is a table in the shared folder.
    """
    ship(docs.sparkSession)
    solved = _solved(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("tag")))
    return solved.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id of each component, with its columns, of equal ids the one whose text has the least hash; rows without words stay.

    Rows are known by their id and a hash of their text, so of rows that share an id one stays, and of
    rows that share both too. A row without an id stays only if no row of its component has one. An
    empty table gives an empty one; columns of any name are kept.
    """
    ship(docs.sparkSession)
    own_id, tag = F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)), F.xxhash64(docs[text_col])
    solved = _solved(docs.select(own_id.alias("doc_id"), docs[text_col].alias("text"), tag.alias("tag"))).where("n > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    least = solved.groupBy("comp").agg(F.min(rank).alias("least"))
    first = solved.join(least, "comp").select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "tag", (rank == F.col("least")).alias("first"))
    found = save(first.groupBy("doc_id", "tag").agg(F.max("first").alias("first"), F.count("*").alias("rows")))
    out = without(docs, [own_id, tag], found.where("not first or rows > 1").select("doc_id", "tag"))
    again = found.where("first and rows > 1").select("doc_id", "tag")
    if not again.isEmpty():  # of rows with one id and one text, one
        keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), own_id.alias("doc_id"), tag.alias("tag"))
        out = out.unionByName(keyed.join(again, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]).select("own.*"))
    return out

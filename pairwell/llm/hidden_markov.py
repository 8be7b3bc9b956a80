"""A hidden Markov model of language: Baum-Welch over all training texts, exact likelihoods of all texts.

The model gives a distribution over whole texts. A state is drawn at the start (or the text is empty),
each state says one symbol and then moves on or ends the text. A symbol is a frequent word of its own
or the class of all other words with the same last bytes; inside a class a word has its smoothed share
of the class in training, where one unseen word has a place too, so unseen words have a probability.

* Counts of all words, however many, are a distributed table.
* Words with at least `least_share` of all word occurrences number at most 1 / least_share, so they and
  the states' emissions are broadcast; the expected counts of a pass have as many rows at most. All
  other words (each with less than that share, so no key is hot) meet their counts in a join.
* A pass of Baum-Welch is one map over the saved symbols: each task adds up what it expects of its
  texts and gives one row a symbol; these are summed by symbol. Nothing is kept between passes but the
  model, so a lost executor costs only its tasks.
* Inside a task, pieces of texts go through the recursion in lockstep, scaled at each token. Texts
  longer than a piece are exact too: a piece's matrix (what it makes of each state) is chained from
  piece to piece, so time is linear and memory is that of a group of pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, wordhash
from .runtime import ship

#: Tokens of a piece, and of the pieces that go through the recursion together.
PIECE, GROUP = 2048, 1 << 19
#: Steps after which a piece's matrix is scaled: as many probabilities multiplied stay far above the least double.
STEPS = 16


@dataclass
class Model:
    """Probabilities: of the first state (the rest is the empty text), of moves and of the end, and of symbols (a row each)."""

    start: np.ndarray
    empty: float
    move: np.ndarray
    end: np.ndarray
    emit: np.ndarray


# -- the recursion, for the pieces of a batch of texts ------------------------------------------------
class _Pieces:
    """Texts (ends of their symbols, none empty) cut into pieces."""

    def __init__(self, lengths: np.ndarray, most: int):
        count = -(-lengths // most)
        self.text = np.repeat(np.arange(len(lengths)), count)
        head = np.concatenate([[0], np.cumsum(count)])
        self.place = np.arange(len(self.text)) - head[self.text]
        self.last = self.place == count[self.text] - 1
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.begin = begin[self.text] + self.place * most
        self.length = np.where(self.last, lengths[self.text] - self.place * most, most)
        self.many = count[self.text] > 1
        self.chained = [np.flatnonzero(self.many & (self.place == k)) for k in range(int(count.max(initial=1)))] if self.many.any() else []

    def groups(self, chosen: np.ndarray, most: int):
        """chosen in groups of about `most` symbols, like lengths together."""
        chosen = chosen[np.argsort(-self.length[chosen], kind="stable")]
        at = (np.cumsum(self.length[chosen]) - self.length[chosen]) // most
        return np.split(chosen, np.flatnonzero(np.diff(at)) + 1) if len(chosen) else []


class _Lockstep:
    """Pieces of a group, longest first, their symbols by step and then by piece."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.active = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than a step
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.rank = np.repeat(np.arange(len(length)), length)
        place = self.at[step] + self.rank
        self.symbols = np.empty(len(place), symbols.dtype)
        self.symbols[place] = symbols[np.repeat(begin, length) + step]
        ranks = np.empty_like(self.rank)
        ranks[place] = self.rank
        self.rank = ranks
        self.final = self.at[length - 1] + np.arange(len(length))

    def forward(self, enter: np.ndarray, move: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values, and the scales; said: the states' probabilities of each symbol."""
        value, scale, ones = np.empty_like(said), np.empty(len(said), said.dtype), np.ones(said.shape[1], said.dtype)
        at = self.at
        for t in range(len(self.active)):
            lo, hi = at[t], at[t + 1]
            now, sum_ = value[lo:hi], scale[lo:hi]
            if t:
                np.matmul(value[at[t - 1] : at[t - 1] + hi - lo], move, out=now)
                now *= said[lo:hi]
            else:
                np.multiply(enter, said[lo:hi], out=now)
            np.matmul(now, ones, out=sum_)
            now *= (1 / sum_)[:, None]
        return value, scale

    def backward(self, leave: np.ndarray, move: np.ndarray, said: np.ndarray, fore: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward values, and the sum of (forward, backward) products of neighbours; said is divided by the scales.

        leave is scaled for each piece so that forward and backward values of a symbol multiply to states' shares.
        """
        value, back, pairs = np.empty_like(said), np.ascontiguousarray(move.T), np.zeros(move.shape)
        at = self.at
        for t in range(len(self.active) - 1, -1, -1):
            lo, hi = at[t], at[t + 1]
            more = self.active[t + 1] if t + 1 < len(self.active) else 0
            if more:
                nxt = slice(at[t + 1], at[t + 1] + more)
                weight = value[nxt] * said[nxt]
                np.matmul(weight, back, out=value[lo : lo + more])
                pairs += fore[lo : lo + more].T @ weight
            value[lo + more : hi] = leave[more : hi - lo]
        return value, pairs


def _matrices(model: Model, symbols: np.ndarray, cut: _Pieces, chosen: np.ndarray) -> np.ndarray:
    """For the chosen pieces: what each state before the first symbol becomes at the last, up to a factor a piece."""
    k = len(model.start)
    out = np.zeros((len(cut.text), k, k))
    move = model.move
    for group in cut.groups(chosen, max(1, GROUP // k)):
        lock = _Lockstep(symbols, cut.begin[group], cut.length[group])
        said = model.emit[lock.symbols].astype(float)
        value, log = np.broadcast_to(np.eye(k), (len(group), k, k)).copy(), np.zeros((len(group), k))
        spare = np.empty_like(value)
        for t, n in enumerate(lock.active):
            if t:
                np.matmul(value[:n].reshape(n * k, k), move, out=spare[:n].reshape(n * k, k))
                np.multiply(spare[:n], said[lock.at[t] : lock.at[t + 1], None, :], out=value[:n])
            else:
                value *= said[:n, None, :]
            if t % STEPS == 0:
                total = value[:n].sum(2)
                log[:n] += np.log(np.maximum(total, 1e-300))
                value[:n] /= np.maximum(total, 1e-300)[:, :, None]
        out[group] = value * np.exp(log - log.max(1, keepdims=True))[:, :, None]
    return out


def _edges(model: Model, symbols: np.ndarray, cut: _Pieces, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states' weights before each piece's first symbol, (if both) those behind its last, and the forward values of the symbol before it."""
    k = len(model.start)
    enter, leave = np.tile(model.start, (len(cut.text), 1)), np.tile(model.end, (len(cut.text), 1))
    prior = np.zeros_like(enter)
    if cut.chained:
        matrix = _matrices(model, symbols, cut, np.flatnonzero(cut.many if both else cut.many & ~cut.last))
        for now in cut.chained[1:]:
            value = np.einsum("ni,nij->nj", enter[now - 1], matrix[now - 1])
            prior[now] = value / value.sum(1, keepdims=True)
            enter[now] = prior[now] @ model.move
        for now in reversed(cut.chained[1:]) if both else []:
            value = np.einsum("nij,nj->ni", matrix[now], leave[now]) @ model.move.T
            leave[now - 1] = value * (k / value.sum(1, keepdims=True))
    return enter, leave, prior


def log_likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The exact log10 likelihood of each text, given by its symbols (texts one behind the other)."""
    out = np.full(len(lengths), np.log10(model.empty))
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    cut = _Pieces(lengths[some], PIECE)
    enter, _, _ = _edges(model, symbols, cut, False)
    out[some] = 0
    for group in cut.groups(np.arange(len(cut.text)), GROUP):
        lock = _Lockstep(symbols, cut.begin[group], cut.length[group])
        value, scale = lock.forward(enter[group], model.move, model.emit[lock.symbols].astype(float))
        found = np.bincount(lock.rank, np.log10(scale), len(group))
        found += np.where(cut.last[group], np.log10(value[lock.final] @ model.end), 0)
        np.add.at(out, some[cut.text[group]], found)
    return out


def expect(model: Model, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the expected uses of each symbol by each state to counts; returns rows of the start, the end and the moves."""
    k = len(model.start)
    edges = np.zeros((2 + k, k))
    some = np.flatnonzero(lengths)
    if not len(some):
        return edges
    cut = _Pieces(lengths[some], PIECE)
    enter, leave, prior = (x.astype(np.float32) for x in _edges(model, symbols, cut, True))
    move, emit = model.move.astype(np.float32), model.emit
    for group in cut.groups(np.arange(len(cut.text)), GROUP):
        lock = _Lockstep(symbols, cut.begin[group], cut.length[group])
        said = emit[lock.symbols]
        value, scale = lock.forward(enter[group], move, said)
        said *= (1 / scale)[:, None]
        behind = leave[group]
        behind = behind / (value[lock.final] * behind).sum(1, keepdims=True)
        back, pairs = lock.backward(behind, move, said, value)
        edges[2:] += pairs * move
        first, place = slice(0, len(group)), cut.place[group]
        inner = place > 0  # moves into a piece from the one before
        edges[2:] += (prior[group][inner].T @ (back[first] * said[first])[inner]) * move
        back *= value  # now the states' shares
        for j in range(k):
            counts[:, j] += np.bincount(lock.symbols, back[:, j], len(counts))
        edges[0] += back[first][~inner].sum(0)
        edges[1] += back[lock.final][cut.last[group]].sum(0)
    return edges


# -- the model from a table --------------------------------------------------------------------------
@dataclass
class Lexicon:
    """Frequent words (sorted hashes), their training counts and symbols; classes' training totals; words N, V and texts D of training."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_words: np.ndarray
    class_kinds: np.ndarray
    n_words: int
    n_kinds: int
    n_texts: int

    @property
    def n_symbols(self) -> int:
        return len(self.class_words) + int((self.symbols >= 0).sum())


def _batches(batches, most: int):
    """(columns before the lists, values, lengths) of batches with a list column at the end, some `most` values at a time."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        values, lo = lists.flatten().to_numpy(zero_copy_only=False), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), values[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            lo = hi


def _word_counts(rows: DataFrame, classes: int) -> DataFrame:
    """word, class, n_train, n_all of every word (rows: held_out, text)."""

    def merged(parts):
        word, tail, train, every = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        word = word[order]
        heads = np.flatnonzero(np.diff(word, prepend=word[:1] ^ 1))
        add = lambda x: np.add.reduceat(x[order].astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
        return word[heads], tail[order][heads], add(train), add(every)

    def run(batches):
        parts, held = [], 0
        for batch in wordhash.slices(batches, 1, 4 << 20):
            hashes, tails, at = wordhash.words_and_tails(batch.column(1), wordhash.SOLID)
            if len(hashes):
                kept = ~np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(at))
                parts.append(merged([(hashes.view(np.int64), (tails % np.uint64(classes)).astype(np.int32), kept, np.ones(len(hashes), np.int64))]))
                held += len(parts[-1][0])
            if held > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["word", "class", "n_train", "n_all"])
                parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["word", "class", "n_train", "n_all"])

    found = rows.select("held_out", "text").mapInArrow(run, "word long, class int, n_train long, n_all long")
    return found.groupBy("word").agg(F.min("class").alias("class"), F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _lexicon(counts: DataFrame, n_texts: int, classes: int, least: int, least_share: float) -> tuple[Lexicon, int]:
    """The lexicon, and the occurrences from which a word is in it."""
    total = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count_if(F.col("n_train") > 0).alias("v"), F.coalesce(F.sum("n_all"), F.lit(0)).alias("a")).first()
    edge = max(least, int(np.ceil(least_share * total.a)), 1)
    words = counts.where(F.col("n_all") >= edge).select("word", "n_train").toArrow()  # at most 1 / least_share rows
    word, n = words["word"].to_numpy(), words["n_train"].to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    own = n >= least
    symbols = np.where(own, classes + np.cumsum(own) - 1, -1).astype(np.int32)
    rest = counts.where((F.col("n_train") > 0) & ((F.col("n_all") < edge) | (F.col("n_train") < least)))
    by_class = rest.groupBy("class").agg(F.sum("n_train").alias("n"), F.count("*").alias("v")).toArrow()  # a row a class
    class_words, class_kinds = np.zeros(classes), np.zeros(classes)
    class_words[by_class["class"].to_numpy()], class_kinds[by_class["class"].to_numpy()] = by_class["n"].to_numpy(), by_class["v"].to_numpy()
    return Lexicon(word, n, symbols, class_words, class_kinds, total.n, total.v, n_texts), edge


def _symbols(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row, doc_id, held_out, n_words, n_known, base (log10 of count + 1), inside (log10 of words inside their classes), rare, symbols.

    n_known, base and inside lack the counts of the words in rare, which the lexicon doesn't hold.
    """
    shared, classes = rows.sparkSession.sparkContext.broadcast(lexicon), len(lexicon.class_words)

    def run(batches):
        lex, first, k = shared.value, TaskContext.get().partitionId() << 33, 0
        share = -np.log10(lex.class_words + lex.class_kinds + 1)
        count_log = np.log10(lex.counts + 1.0)
        for batch in wordhash.slices(batches, 2, 4 << 20):
            hashes, tails, at = wordhash.words_and_tails(batch.column(2), wordhash.SOLID)
            hashes, kind = hashes.view(np.int64), (tails % np.uint64(classes)).astype(np.int32)
            place = np.minimum(np.searchsorted(lex.words, hashes), max(len(lex.words) - 1, 0))
            known = lex.words[place] == hashes if len(lex.words) else np.zeros(len(hashes), bool)
            symbol, count, seen = kind.copy(), np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
            symbol[known] = np.where(lex.symbols[place[known]] >= 0, lex.symbols[place[known]], kind[known])
            count[known] = count_log[place[known]]
            seen[known] = lex.counts[place[known]] > 0
            inside = np.where(symbol < classes, count + share[kind], 0)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~known)])[at], pa.int32()), pa.array(hashes[~known]))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(symbol))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + k + np.arange(n)), batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(add(seen)), pa.array(add(count)), pa.array(add(inside)), rare, lists],
                names=["row", "doc_id", "held_out", "n_words", "n_known", "base", "inside", "rare", "symbols"],
            )
            k += n

    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_words long, n_known long, base double, inside double, rare array<long>, symbols array<int>")


def first_model(lexicon: Lexicon, states: int, seed: int = 1) -> tuple[Model, np.ndarray]:
    """Unigram emissions, disturbed by a seeded draw so that states can part; and the undisturbed shares of symbols."""
    counts = np.concatenate([lexicon.class_words + 1, lexicon.counts[lexicon.symbols >= 0]])
    plain = counts / counts.sum()
    emit = plain[:, None] * np.exp(np.random.default_rng(seed).standard_normal((len(plain), states)))
    stay = 0.95 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(move, stay)
    ends = (lexicon.n_texts + 1) / (lexicon.n_words + lexicon.n_texts + 2)
    return Model(np.full(states, (1 - ends) / states), ends, move * (1 - ends), np.full(states, ends), (emit / emit.sum(0)).astype(np.float32)), plain


def _pass(texts: DataFrame, model: Model, plain: np.ndarray, n_empty: int, prior: float) -> Model:
    """One pass of Baum-Welch over texts (symbols); emissions are drawn towards `plain` by `prior` occurrences."""
    k, spark = len(model.start), texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        now = shared.value
        counts, edges = np.zeros(now.emit.shape), np.zeros((2 + k, k))
        for _, values, lengths in _batches(batches, 2 * GROUP):
            edges += expect(now, values, lengths, counts)
        used = np.flatnonzero(counts.any(1))
        names, rows = np.concatenate([-1 - np.arange(2 + k), used]), np.concatenate([edges, counts[used]])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(rows[:, j]) for j in range(k)]], names=["symbol", *[f"e{j}" for j in range(k)]])

    expected = texts.select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"e{j} double" for j in range(k)))
    sums = expected.groupBy("symbol").agg(*[F.sum(f"e{j}").alias(f"e{j}") for j in range(k)]).toArrow()  # a row a symbol
    shared.destroy()
    names, rows = sums["symbol"].to_numpy(), np.stack([sums[f"e{j}"].to_numpy() for j in range(k)], 1)
    edges, counts = np.zeros((2 + k, k)), np.zeros(model.emit.shape)
    edges[-1 - names[names < 0]], counts[names[names >= 0]] = rows[names < 0], rows[names >= 0]
    start = np.append(edges[0], n_empty) + 1
    start /= start.sum()
    out = np.column_stack([edges[2:], edges[1]]) + 0.1
    out /= out.sum(1, keepdims=True)
    emit = (counts + prior * plain[:, None]) / (counts.sum(0) + prior)
    return Model(start[:k], float(start[k]), out[:, :k], out[:, k], (emit / emit.sum(0)).astype(np.float32))


def _likelihoods(texts: DataFrame, model: Model) -> DataFrame:
    """row, hmm: log10 likelihoods of symbols."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, values, lengths in _batches(batches, 2 * GROUP):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_likelihoods(shared.value, values, lengths))], names=["row", "hmm"])

    return texts.select("row", "symbols").mapInArrow(run, "row long, hmm double")


def scores(docs: DataFrame, *, states: int = 8, passes: int = 4, classes: int = 4096, least: int = 5, least_share: float = 1e-6, prior: float = 1000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learned from the rows that aren't held out.

    A row is held out if crc32(its id as text) mod 7 is 2; a null id counts as the text '' and trains.
    A null text is empty: one token, the end. Repeated rows and equal ids give (and train) a row each.
    Other columns aren't read, whatever their names. An empty table gives no rows; one without
    training rows is scored by the even model. Texts of any length are learned and scored whole. base_score is of
    the add-one unigram model; score of the hidden Markov model, whose states are `states`, learned in
    `passes` passes. Scores are rounded to six places, below which the order of sums may show.
    """
    spark = docs.sparkSession
    ship(spark)
    number = docs[id_col].cast("long")
    held = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(number.alias("doc_id"), held.alias("held_out"), docs[text_col].alias("text"))
    counts = runtime.save(_word_counts(rows, classes))
    lexicon, edge = _lexicon(counts, rows.where("not held_out").count(), classes, least, least_share)
    texts = runtime.save(_symbols(rows, lexicon))
    training = texts.where("not held_out")
    model, plain = first_model(lexicon, states)
    if lexicon.n_texts:
        n_empty = training.where("n_words = 0").count()
        for _ in range(passes):
            model = _pass(training, model, plain, n_empty, prior)
    rare = texts.select("row", F.explode("rare").alias("word")).join(counts.where((F.col("n_all") < edge) & (F.col("n_train") > 0)), "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n_train") + 1)).alias("rare_base"), F.count("*").alias("rare_known"))
    found = texts.drop("rare", "symbols").join(_likelihoods(texts, model), "row").join(rare, "row", "left").na.fill(0, ["rare_base", "rare_known"])
    n, d = F.lit(lexicon.n_words + lexicon.n_texts), lexicon.n_texts
    kinds = lexicon.n_kinds + bool(d)
    tokens = F.col("n_words") + 1
    base = F.col("base") + F.col("rare_base") + F.log10(F.lit(d + 1.0)) - tokens * F.log10(F.lit(float(lexicon.n_words + d + kinds + 1)))
    score = F.col("hmm") + F.col("inside") + F.col("rare_base")
    return found.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.col("rare_known") + int(d > 0)).alias("n_known"), n.cast("long").alias("train_tokens"), F.round(base, 6).alias("base_score"), F.round(score, 6).alias("score"))

"""Quality rules: fixed rules, then robust multivariate outliers of each language and source.

Every document gets a vector of four statistics that vary among good texts too: the mean length of words
(each up to 16 letters, so a token or address weighs little), the share of words of at most three letters, the share of
punctuation (log scale), and the variety of words (log of distinct over log of all). For each (language, source), each
language and the whole table the centre and scatter of the `core` share of documents whose covariance
determinant is least are estimated: three starts (medians and quartile spreads, all documents, documents
inside all quartiles) are refined by two concentration steps each, which re-estimate from the core share
with the least distances; the start with the least determinant goes on until no determinant falls any more.

A mean of few words scatters more than one of many, so a document's deviations count by the weight
n / (n + EVEN) of its n words, in centres, scatters and distances alike. Copies tell nothing about the
spread of texts: equal vectors of a (language, source) are estimated from once.

An estimate is regularised towards the one above it (a source's towards its language's, that towards
the table's) as by PRIOR documents more, at every size alike, and no spread of it falls below half of the
one above, so small sources, and sources of near copies, lean on their language and none switches to
another rule. A document is rejected if its squared Mahalanobis distance passes `cutoff`.

Only DataFrame functions are used. Vectors are integers (thousandths) and moments are sums of them by
group and distance bin, so estimates are the same for any partitioning, a step reads the vectors once
and shuffles some hundreds of rows a group. Estimates meet the vectors by a broadcast as long as they
are few, else by a salted join, so a hot source is split and summed before any shuffle by its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import drop, save, without

WHITE = " \t\n\x0b\f\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least spreads (in thousandths) of a scatter, against singular ones only: good texts spread ten times as much and more.
SPREAD = (3, 3, 3, 3)
DIM = len(SPREAD)
#: Words that count half, and the units in which weights are whole numbers.
EVEN, UNITS = 200, 16
#: The 0.9999 quantile of chi-square with DIM degrees of freedom: texts have longer tails than normal vectors.
CUTOFF = 23.51
#: Distance bins: this many to a factor of e.
BINS = 40
#: Documents that the estimate above counts as.
PRIOR = 8
#: Concentration steps of the best start at most, and the fall of a log determinant that ends them.
MOST_STEPS, SETTLED = 10, 0.01
#: Up to so many estimates (some 200 bytes each) are broadcast; more meet the vectors by a join of this many salts a key.
BROADCAST_GROUPS, SALTS = 50_000, 64
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), evaluating value once."""
    return F.transform(F.array(value), then)[0]


def _repeated(words: Column, width: int) -> Column:
    """How many words stand in windows of `width` words that occur twice or more."""

    def from_hashes(h: Column) -> Column:
        def marked(p: Column) -> Column:
            same = lambda x, i: (i >= 0) & (F.get(p, i)["h"] == x["h"])
            twice = F.filter(p, lambda x, i: same(x, i - 1) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        step = lambda acc, i: F.struct((acc["n"] + width - F.greatest(F.lit(0), acc["to"] - i)).alias("n"), (i + width).alias("to"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(_with(pairs, marked), start, step, lambda acc: acc["n"]))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(_with(_with(hashes, windows), from_hashes))


def statistics(docs: DataFrame, text_col: str = "text", window: int = 8) -> Column:
    """A struct of STATS for a text; words are runs without ASCII white space."""
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    n_dup = _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w, window).cast("long").alias("n_repeat_words"),
        F.aggregate(w, F.lit(0), lambda n, x: n + F.least(F.length(x), F.lit(16))).cast("long").alias("letters"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"), F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).cast("long").alias("n_distinct"),
    )
    marks = F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks")
    return F.struct(_with(words, of_words).alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), n_dup.cast("long").alias("n_dup_lines"), marks)


def _vector() -> list[Column]:
    """Thousandths of the transformed statistics, null without words; and the weight, in UNITS."""
    n, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    raw = [F.ln(F.col("letters") / n), F.asin(F.sqrt(F.col("n_short") / n)), F.ln((F.col("n_marks") + 1) / chars), 4 * F.ln(F.col("n_distinct")) / F.ln(n + 1)]
    weight = F.greatest(F.round(UNITS * F.col("n_words") / (F.col("n_words") + EVEN)), F.lit(1)).cast("long").alias("w")
    return [*[F.round(1000 * x).cast("long").alias(f"z{i}") for i, x in enumerate(raw)], weight]


def measured(docs: DataFrame, keep: list[Column], *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", window: int = 8) -> DataFrame:
    """The columns `keep`, lang and source (null: a group of their own), STATS, base_failed and the vector, saved once, without texts."""
    keys = [F.coalesce(docs[c].cast("string"), F.lit("\0")) if c in docs.columns else F.lit("\0") for c in (lang_col, source_col)]
    got = docs.select(F.struct(*keep).alias("row"), keys[0].alias("lang"), keys[1].alias("source"), statistics(docs, text_col, window).alias("s"))
    got = got.select("row", "lang", "source", "s.w.*", "s.n_symbols", "s.n_dup_lines", "s.n_marks")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return save(got.select("row", "lang", "source", *STATS, failed.alias("base_failed"), *_vector()))


def _weighed(rows: DataFrame) -> DataFrame:
    """rows with the weight of long texts where they have none."""
    return rows if "w" in rows.columns else rows.withColumn("w", F.lit(UNITS))


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d: the weighted squared Mahalanobis distance, by forward substitution in the scatter's root (columns m*, l*)."""
    rows = _weighed(rows)
    for i in range(DIM):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d", F.col("w") / UNITS * sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)), F.lit(0.0))).drop(*[f"y{i}" for i in range(DIM)])


_SUMS = ["sw"] + [f"s{i}" for i in range(DIM)] + [f"q{i}{j}" for i, j in _PAIRS]
_CENTRE, _ROOT = [f"m{i}" for i in range(DIM)], [f"l{i}{j}" for i, j in _PAIRS]


def _moments(where: Column | None = None) -> list[Column]:
    """n and the weighted sums of ones, vectors and their products."""
    z, w = [F.col(f"z{i}") for i in range(DIM)], F.col("w") if where is None else F.when(where, F.col("w"))
    n = F.count("*") if where is None else F.count_if(where)
    return [n.alias("n"), F.sum(w).alias("sw"), *[F.sum(w * x).alias(f"s{i}") for i, x in enumerate(z)], *[F.sum(w * z[i] * z[j]).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _scatter(groups: DataFrame) -> DataFrame:
    """groups (n, s*, q*) with centres m* and covariances c* of the weighted deviations."""
    n = F.col("n").cast("double") * UNITS
    groups = groups.withColumns({f"m{i}": F.col(f"s{i}") / F.col("sw") for i in range(DIM)})
    return groups.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"s{j}")) / n for i, j in _PAIRS})


def _rooted(groups: DataFrame) -> DataFrame:
    """groups with the root l* of their covariances c*, and logdet."""
    for i, j in _PAIRS:
        c = F.col(f"c{i}{j}")
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(float(SPREAD[i] ** 2)))) if i == j else c / F.col(f"l{j}{j}"))
    return groups.withColumn("logdet", 2 * sum((F.ln(f"l{i}{i}") for i in range(DIM)), F.lit(0.0)))


def _bin() -> Column:
    return F.floor(BINS * F.log1p(F.col("d"))).cast("int").alias("bin")


def _keyed(rows: DataFrame) -> DataFrame:
    """Each vector of a (language, source), once, under this pair, its language and the whole table."""
    keys = [F.struct(F.col("lang").alias("k1"), F.col("source").alias("k2"), F.lit(2).alias("level")), F.struct(F.col("lang").alias("k1"), F.lit("").alias("k2"), F.lit(1).alias("level")), F.struct(F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("level"))]
    columns = [*[f"z{i}" for i in range(DIM)], "w"]
    return rows.select("lang", "source", *columns).distinct().select(F.explode(F.array(*keys)).alias("k"), *columns).select("k.*", *columns)


_KEY = ["k1", "k2", "level"]


def _met(rows: DataFrame, groups: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups by key; groups is a saved table."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, how)
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[f"z{i}" for i in range(DIM)]), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(dealt, [*key, "_salt"], how).drop("_salt")


def _step(keyed: DataFrame, groups: DataFrame, core: float) -> DataFrame:
    """A concentration step: each estimate again from the core share of its documents with the least distances; saved."""
    key = [*_KEY, "start"]
    binned = _distance(_met(keyed, groups.select(*key, *_CENTRE, *_ROOT), _KEY)).groupBy(*key, _bin()).agg(*_moments())
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ranked = binned.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*key))})
    kept = ranked.where(F.col("before") < F.ceil(core * F.col("total")))
    sums = kept.groupBy(*key).agg(F.sum("n").alias("n"), F.first("total").alias("total"), *[F.sum(c).alias(c) for c in _SUMS])
    return save(_rooted(_scatter(sums)).drop(*_SUMS))


def _starts(keyed: DataFrame) -> DataFrame:
    """The three starts of each key; saved."""
    columns = [*_KEY, "start", *_CENTRE, *_ROOT]
    quartiles = keyed.groupBy(*_KEY).agg(*[F.percentile(f"z{i}", [0.25, 0.5, 0.75]).alias(f"p{i}") for i in range(DIM)], *_moments())
    quartiles = save(quartiles)
    middle = {f"m{i}": F.col(f"p{i}")[1] for i in range(DIM)}
    for i, j in _PAIRS:
        middle[f"l{i}{j}"] = F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(float(SPREAD[i]))) if i == j else F.lit(0.0)
    robust = quartiles.select(*_KEY, F.lit(0).alias("start"), *[c.alias(n) for n, c in middle.items()])
    plain = _rooted(_scatter(quartiles)).withColumn("start", F.lit(1)).select(*columns)
    inside = F.lit(True)
    for i in range(DIM):
        inside = inside & F.col(f"z{i}").between(F.col(f"p{i}")[0], F.col(f"p{i}")[2])
    box = _met(keyed, quartiles.drop("n", *_SUMS), _KEY).groupBy(*_KEY).agg(*_moments(inside)).where("n > 0")
    out = save(robust.unionByName(plain).unionByName(_rooted(_scatter(box)).withColumn("start", F.lit(2)).select(*columns)))
    drop(quartiles)
    return out


def estimates(rows: DataFrame, *, core: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant estimates of each key: n, total, m*, c*, l*, logdet and scale (of d); saved."""
    keyed = save(_keyed(_weighed(rows).where("not base_failed and z0 is not null")))
    groups = _starts(keyed)
    for _ in range(2):
        before, groups = groups, _step(keyed, groups, core)
        drop(before)
    best = F.row_number().over(Window.partitionBy(*_KEY).orderBy("logdet", "start"))
    before, groups = groups, save(groups.withColumn("place", best).where("place = 1").drop("place"))
    drop(before)
    for _ in range(MOST_STEPS):
        new = _step(keyed, groups, core)
        both = new.join(groups.select(*_KEY, F.col("logdet").alias("old")), _KEY)
        # bins make the core's size a little uneven, so a step may also raise a determinant: then the old estimate stays
        fell = both.agg(F.max(F.col("old") - F.col("logdet"))).first()[0]
        better = new.join(groups.select(*_KEY, F.col("logdet").alias("old")), _KEY).where("logdet < old").drop("old")
        before, groups = groups, save(better.unionByName(groups.join(better.select(*_KEY), _KEY, "left_anti")))
        drop(before, new)
        if fell is None or fell < SETTLED:
            break
    middle = _distance(_met(keyed, groups.select(*_KEY, *_CENTRE, *_ROOT), _KEY)).groupBy(*_KEY).agg(F.percentile(_bin(), 0.5).alias("mid"))
    # A core's scatter is too small by a factor that the median tells; below 1 it tells only of spreads at their floor.
    scale = F.greatest(F.lit(1.0), F.expm1(F.col("mid") / BINS) / 3.357)  # the median of chi-square with 4 degrees
    out = save(groups.join(middle, _KEY).withColumn("scale", scale).drop("mid", "start"))
    drop(groups, keyed)
    return out


def regularised(found: DataFrame) -> DataFrame:
    """lang, source, m*, l* and scale of each (language, source): its estimate, leaning on its language's, that on the table's; saved."""
    mixed = [*_CENTRE, *[f"c{i}{j}" for i, j in _PAIRS], "scale"]

    def lean(own: DataFrame, above: DataFrame, on) -> DataFrame:
        n = F.col("n").cast("double")
        joined = own.join(above.select(*[F.col(c).alias(f"k_{c}") if c in _KEY else F.col(c).alias(f"a_{c}") for c in above.columns]), on, "inner")
        mean = {c: (n * F.col(c) + PRIOR * F.col(f"a_{c}")) / (n + PRIOR) for c in mixed}
        mean |= {c: F.greatest(mean[c], F.col(f"a_{c}") / 4) for c in (f"c{i}{i}" for i in range(DIM))}  # half the spread above
        return joined.select(*_KEY, "n", *[v.alias(c) for c, v in mean.items()])

    level = lambda k: found.where(F.col("level") == k).select(*_KEY, "n", *mixed)
    table = level(0)
    languages = lean(level(1), table, F.lit(True))  # one row above
    return save(_rooted(lean(level(2), languages, F.col("k1") == F.col("k_k1"))).select(F.col("k1").alias("lang"), F.col("k2").alias("source"), *_CENTRE, *_ROOT, "scale"))


def judged(rows: DataFrame, *, cutoff: float = CUTOFF, core: float = 0.75) -> DataFrame:
    """rows with kept and distance: not base_failed, and no outlier of its (language, source).

    A row without words, or of a (language, source) of which all rows failed, has no distance.
    """
    found = estimates(rows, core=core)
    groups = regularised(found)
    drop(found)
    distance = F.col("d") / F.col("scale")
    kept = ~F.col("base_failed") & ~F.coalesce(distance > cutoff, F.lit(False))
    return _distance(_met(rows, groups, ["lang", "source"], "left")).select(*rows.columns, distance.alias("distance"), kept.alias("kept"))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, STATS, base_failed, distance and kept of every row.

    A null text has no words and fails the base rules. Null languages and sources form groups of their
    own; missing columns one group. Repeated rows and equal ids give a row each. An empty table gives
    none. Other columns are not read.
    """
    rows = judged(measured(docs, [docs[id_col].alias("id")], text_col=text_col, lang_col=lang_col, source_col=source_col), cutoff=cutoff)
    return rows.select(F.col("row.id").alias("doc_id"), *STATS, "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns.

    Rows with equal text, language and source get equal verdicts, so the verdicts come back to the
    rows by 128 bits of hash of these three. Nulls, missing columns and empty tables as in quality().
    """
    judged_by = [docs[c] for c in (text_col, lang_col, source_col) if c in docs.columns]
    keys = [F.xxhash64(F.lit(k), *judged_by, *[c.isNull() for c in judged_by]) for k in (1, 2)]
    rows = measured(docs, [k.alias(f"h{i}") for i, k in enumerate(keys)], text_col=text_col, lang_col=lang_col, source_col=source_col)
    gone = save(judged(rows, cutoff=cutoff).where("not kept").select("row.h0", "row.h1").distinct())
    drop(rows)
    return without(docs, keys, gone)

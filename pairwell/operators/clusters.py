"""Anchor clusters: counting, greedy first-fit inside blocks, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import anchors, neighbours
from ..sources.ship import ship
from ..sources.tables import saved


def split_short(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (header, sequence, ...) with upper-case sequence and anchor, and those too short for one."""
    upper = records.withColumn("sequence", F.upper("sequence")).withColumn("anchor", anchors.anchor(F.col("sequence")))
    return upper.where("anchor is not null"), upper.where("anchor is null").drop("anchor")


def anchor_counts(records: DataFrame, order: Column | None = None) -> DataFrame:
    """anchor, n, first: how often an anchor stands, and the least of order (else the anchor), which breaks ties."""
    first = F.min(order) if order is not None else F.first("anchor")
    return records.groupBy("anchor").agg(F.count("*").alias("n"), first.alias("first"))


def blocked(counts: DataFrame) -> DataFrame:
    """counts with g2 and g6, the block."""
    g2, g6 = anchors.block(F.col("anchor"))
    return counts.withColumns({"g2": g2, "g6": g6})


def block_sizes(counts: DataFrame) -> DataFrame:
    """g2, g6, n_anchors."""
    return blocked(counts).groupBy("g2", "g6").agg(F.count("*").alias("n_anchors"))


def prioritised(counts: DataFrame) -> DataFrame:
    """Blocked counts with prio: 1.. by falling n, then first, inside the block."""
    return blocked(counts).withColumn("prio", F.row_number().over(Window.partitionBy("g2", "g6").orderBy(F.desc("n"), "first")))


def _fit(names: list[str], threshold: float) -> tuple[list[int], int]:
    """The place of each anchor's centroid, for anchors in order of priority; and how many scores that took.

    Only centroids near in one part of the index (neighbours.near) are scored; no other can be like enough.
    """
    table, codes = anchors.weighted(), anchors.coded(names)
    own = (codes + 1) % neighbours.LETTERS  # 0 is unknown there
    keys = [own[:, i] * neighbours.LETTERS + own[:, j] for i, j in neighbours.PARTS]
    close = [[np.flatnonzero(row) for row in part] for part in neighbours.near(threshold)]
    listed: list[dict[int, list[int]]] = [{}, {}]
    out, scored = [], 0
    for k in range(len(codes)):
        found = {c for part in (0, 1) for key in close[part][keys[part][k]].tolist() for c in listed[part].get(key, ())}
        home = k
        if found:
            many = np.fromiter(sorted(found), np.int64)
            scored += len(many)
            fits = np.flatnonzero(anchors.scores(table, codes[k], codes[many]) >= threshold)
            if len(fits):
                home = int(many[fits[0]])
        if home == k:
            for part in (0, 1):
                listed[part].setdefault(int(keys[part][k]), []).append(k)
        out.append(home)
    return out, scored


def greedy_clusters(counts: DataFrame, threshold: float) -> DataFrame:
    """anchor, centroid: each anchor, by priority, joins the first centroid of its block that is like enough, or becomes one.

    Sequential inside a block, so a block is one group; it holds distinct six-letter anchors only,
    which the alphabet bounds. clusters_by_rounds() gives the same from joins.
    """
    return greedy_blocks(counts, threshold).select("anchor", "centroid")


def greedy_blocks(counts: DataFrame, threshold: float) -> DataFrame:
    """greedy_clusters() with g2, g6, and scored: on the row of a block's first anchor the scores that the block took, else 0."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share")
    ship(counts.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = group.sort_values("prio")["anchor"].tolist()
        homes, scored = _fit(names, threshold)
        return pd.DataFrame({"g2": group["g2"].iloc[0], "g6": group["g6"].iloc[0], "anchor": names, "centroid": [names[k] for k in homes], "scored": [scored] + [0] * (len(names) - 1)})

    ranked = prioritised(counts).select("g2", "g6", "anchor", "prio")
    return ranked.groupBy("g2", "g6").applyInPandas(run, "g2 int, g6 int, anchor string, centroid string, scored long")


def _candidates(counts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a block that are near in a part of the index, each once, with what they lose so far."""
    p = prioritised(counts).withColumn("codes", anchors.codes(F.col("anchor")))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), neighbours.key(F.col("codes"), k).alias("key")) for k in range(len(neighbours.PARTS))])).alias("x")
    rows = p.select("g2", "g6", "anchor", "prio", "codes", parts).select("g2", "g6", "anchor", "prio", "codes", "x.*")
    a = rows.select("g2", "g6", "part", F.col("key").alias("other"), F.col("anchor").alias("earlier"), "prio", F.col("codes").alias("earlier_codes"))
    b = rows.join(F.broadcast(neighbours.table(counts.sparkSession, threshold)), ["part", "key"])
    b = b.select("g2", "g6", "part", "other", F.col("anchor").alias("later"), F.col("prio").alias("later_prio"), F.col("codes").alias("later_codes"))
    found = a.join(b, ["g2", "g6", "part", "other"]).where("prio < later_prio")
    first = anchors.partial_loss(F.col("earlier_codes"), F.col("later_codes"), neighbours.PARTS[0])
    return found.where((F.col("part") == 0) | (first > (1 - threshold) / 2 + neighbours.SLACK))  # a pair that both parts find is the first one's


def similar_pairs(counts: DataFrame, threshold: float) -> DataFrame:
    """earlier, later, prio (of earlier) of pairs in a block with a score of at least threshold.

    An index join instead of all pairs of a block: a later anchor looks for earlier ones at the keys near
    its own, in two parts of the light places; keys spread a block over hundreds of groups. Candidates whose heavy
    places alone lose too much go before they are scored. No pair is lost at any threshold; low ones just prune less.
    """
    left, right = F.col("earlier_codes"), F.col("later_codes")
    heavy = anchors.partial_loss(left, right, tuple(k for k, w in enumerate(anchors.WEIGHTS) if w > 1))
    likely = _candidates(counts, threshold).where(heavy <= 1 - threshold + neighbours.SLACK)
    return likely.where(anchors.coded_score(left, right) >= threshold).select("earlier", "later", "prio")


def comparisons(counts: DataFrame, threshold: float) -> DataFrame:
    """n_anchors, n_pairs (of anchors in a block), n_candidates (that the index join makes), n_similar, n_scored (by greedy_clusters) and n_centroids."""
    sizes = block_sizes(counts).agg(F.coalesce(F.sum("n_anchors"), F.lit(0)).alias("n_anchors"), F.coalesce(F.sum(F.expr("n_anchors * (n_anchors - 1) div 2")), F.lit(0)).alias("n_pairs"))
    alike = anchors.coded_score(F.col("earlier_codes"), F.col("later_codes")) >= threshold
    joined = _candidates(counts, threshold).agg(F.count("*").alias("n_candidates"), F.count_if(alike).alias("n_similar"))
    greedy = greedy_blocks(counts, threshold).agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("n_scored"), F.count_if(F.col("anchor") == F.col("centroid")).alias("n_centroids"))
    return sizes.crossJoin(joined).crossJoin(greedy)  # one row each


def clusters_by_rounds(counts: DataFrame, threshold: float) -> DataFrame:
    """greedy_clusters() as the lexicographically first maximal independent set, found in rounds of joins.

    A round makes those centroids whose earlier neighbours are all decided, then their later
    neighbours members. Rounds grow with the logarithm of a block, but pairs with its square.
    """
    edges, open_, centres = saved(similar_pairs(counts, threshold)), saved(counts.select("anchor")), None
    while open_.limit(1).count():
        waits = edges.join(open_.withColumnRenamed("anchor", "earlier"), "earlier", "left_semi").select(F.col("later").alias("anchor")).distinct()
        new = saved(open_.join(waits, "anchor", "left_anti"))
        centres = new if centres is None else centres.unionByName(new)
        taken = edges.join(new.withColumnRenamed("anchor", "earlier"), "earlier", "left_semi").select(F.col("later").alias("anchor")).distinct()
        open_ = saved(open_.join(new, "anchor", "left_anti").join(taken, "anchor", "left_anti"))
    if centres is None:
        return counts.select("anchor", F.col("anchor").alias("centroid"))
    homes = edges.join(centres.withColumnRenamed("anchor", "earlier"), "earlier", "left_semi").groupBy("later").agg(F.min_by("earlier", "prio").alias("centroid"))
    members = homes.join(centres.withColumnRenamed("anchor", "later"), "later", "left_anti").select(F.col("later").alias("anchor"), "centroid")
    return members.unionByName(centres.select("anchor", F.col("anchor").alias("centroid")))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name: 0.. in order, without bringing all rows to one task."""
    kept = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return kept.withColumn("_part", part).join(base, "_part").withColumn(name, F.col("_base") + place).drop("_at", "_part", "_base")


def ranked_clusters(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """cluster_num, representative_anchor, size: by falling size, then anchor."""
    sizes = records.join(mapping, "anchor").groupBy(F.col("centroid").alias("representative_anchor")).agg(F.count("*").alias("size"))
    return numbered(sizes, [F.desc("size"), F.asc("representative_anchor")], "cluster_num")


def memberships(records: DataFrame, mapping: DataFrame, ranked: DataFrame) -> DataFrame:
    """cluster_id (`cluster_<n>`), representative_anchor, peptide_header, sequence, anchor."""
    named = records.join(mapping, "anchor").join(ranked.select(F.col("representative_anchor").alias("centroid"), "cluster_num"), "centroid")
    return named.select(F.concat(F.lit("cluster_"), F.col("cluster_num")).alias("cluster_id"), F.col("centroid").alias("representative_anchor"), F.col("header").alias("peptide_header"), "sequence", "anchor")


def exact_clusters(records: DataFrame) -> DataFrame:
    """rep, member of records (header, sequence) with equal masks; rep is the least header."""
    masked = records.select("header", anchors.mask(F.col("sequence")).alias("m"))
    reps = masked.groupBy("m").agg(F.min("header").alias("rep"))
    return masked.join(reps, "m").select("rep", F.col("header").alias("member"))

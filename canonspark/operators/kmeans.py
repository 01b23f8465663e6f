"""Character n-gram TF-IDF and k-means with a silhouette search.

TF-IDF follows the common char-analyzer definition: lower-case, runs of two
or more whitespace characters become one space, n-grams of length 2-4, raw
counts, ``idf = ln((1 + N) / (1 + df)) + 1`` with every occurrence a
document, rows L2-normalised.  It is computed with group-bys on the
distinct-value table weighted by occurrence counts.

k-means runs for all groups, all k and all starts at once, on tables keyed by ``(group_key, k, s)``; k runs over ``[min_k, max_k]`` with ``k < size``.

* *Starts.*  Start 0 takes values by a seeded hash.  The others are seeded by
  k-means||: a few rounds draw values with a chance that follows their squared
  distance to what is drawn, many at once; the drawn ones, weighted by the values
  they are nearest to, are thinned to an order of ``max_k`` centres, whose first k
  serve every k.
* *Rounds.*  A round takes weighted means and moves values (weighted by their
  occurrences, equal to running over every occurrence) to a nearer centre.  A group's
  values lie in blocks; a task takes a block and the group's centres, and gives out the
  block's labels and its part of the next means.  A run ends when no value moves;
  every move makes the sum of squares smaller, so it does end.
* *Choice.*  Of a k's starts the one with the smallest sum of squares counts; of the
  ks the one with the largest mean silhouette (Euclidean, over all occurrences).
  Results with one label are skipped, no valid k gives one cluster.

Silhouettes need the distance of every two values of a group: its values are dealt into
blocks, and a task takes one pair of blocks and gives out, for each value, its sum of
distances to every cluster of every k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonspark.functions import text as T
from canonspark.operators.topk import top_k_per_group
from canonspark.session import ensure_checkpoint_dir

# Reference search ranges, starts and seed
CATEGORY_K = (2, 20)
DIRECT_K = (2, 8)
STARTS = {"category": 10, "direct": 1}
SEED = 42
DRAWS = 5        # rounds of drawing seeds
DIGITS = 10      # of distances; so equal ones compare equal
NEARER = 1e-9    # a value moves to a centre that is nearer by more than rounding errors
THIN = 4         # rounds after which ended runs are taken out
BLOCK = 256      # values of a block of the distance table


def tfidf(nodes: DataFrame, n_min: int = 2, n_max: int = 4) -> DataFrame:
    """``nodes(group_key, norm, n)`` -> ``group_key, norm, gram, tf, df, idf, weight``."""
    doc = F.regexp_replace(F.lower("norm"), r"(?U)\s\s+", " ")
    grams = (nodes.select("group_key", "norm", "n", F.explode(T.char_ngrams(doc, n_min, n_max)).alias("gram"))
             .groupBy("group_key", "norm", "n", "gram").agg(F.count(F.lit(1)).alias("tf")))
    docs = nodes.groupBy("group_key").agg(F.sum("n").alias("big_n"))
    df = grams.groupBy("group_key", "gram").agg(F.sum("n").alias("df"))
    w = (grams.join(df, ["group_key", "gram"]).join(docs, "group_key")
         .withColumn("idf", F.log((F.lit(1.0) + F.col("big_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
         .withColumn("w", F.col("tf") * F.col("idf")))
    norms = w.groupBy("group_key", "norm").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2"))
    return (w.join(norms, ["group_key", "norm"])
            .select("group_key", "norm", "gram", F.col("tf").cast("long").alias("tf"),
                    F.col("df").cast("long").alias("df"), "idf", (F.col("w") / F.col("l2")).alias("weight")))


def _ckpt(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RUN = ["group_key", "k", "s"]


def value_blocks(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Values with their vectors, dealt to blocks: ``group_key, block, norm, n, grams, ws``."""
    lists = entries.groupBy("group_key", "norm").agg(F.collect_list(F.struct("gram", "weight")).alias("e"))
    blocks = nodes.groupBy("group_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    return (nodes.join(blocks, "group_key").join(lists, ["group_key", "norm"], "left")
            .select("group_key", F.pmod(F.xxhash64("norm"), F.col("blocks")).cast("int").alias("block"), "norm",
                    F.col("n").cast("long").alias("n"),
                    F.coalesce("e.gram", F.expr("cast(array() as array<string>)")).alias("grams"),
                    F.coalesce("e.weight", F.expr("cast(array() as array<double>)")).alias("ws")))


def centre_lists(centres: DataFrame) -> DataFrame:
    """``(*RUN, c, gram, w)`` -> one row a centre: ``*RUN, c, len, grams, ws``; ``len`` is its square."""
    return centres.groupBy(*RUN, "c").agg(
        F.sum(F.col("w") * F.col("w")).alias("len"), F.collect_list(F.struct("gram", "w")).alias("e")).select(
        *RUN, "c", "len", F.col("e.gram").alias("grams"), F.col("e.w").alias("ws"))


def _dense(grams, ws, names: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(grams), max(1, len(names))))
    for r, (gs, w) in enumerate(zip(grams, ws)):
        at = np.array([names.get(g, -1) for g in gs], dtype=np.int64)
        x[r, at[at >= 0]] = np.asarray(w, dtype=float)[at >= 0]
    return x


def _round(values: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One block's part of a round: for every run a row with the labels (c = 0), and one for every
    centre with what the block's values add to its next mean."""
    out: list[tuple] = []
    if len(values) and len(right):
        values = values.sort_values("norm").reset_index(drop=True)
        names = {g: i for i, g in enumerate(sorted({g for grams in values["grams"] for g in grams}))}
        words = np.array(sorted(names), dtype=object)
        x, n = _dense(values["grams"], values["ws"], names), values["n"].to_numpy(float)
        square, norms = (x * x).sum(axis=1), values["norm"].tolist()
        centres = right[right["c"] > 0].sort_values(["k", "s", "c"]).reset_index(drop=True)
        was = {(r.k, r.s): np.asarray(r.labels) for r in right[right["c"] == 0].itertuples()}
        far = np.round(centres["len"].to_numpy(float) - 2 * (x @ _dense(centres["grams"], centres["ws"], names).T), DIGITS)
        for (k, s), at in centres.groupby(["k", "s"], sort=False).indices.items():
            d, number = far[:, at], centres["c"].to_numpy()[at]
            best = d.argmin(axis=1)  # ties to the lower number
            own = None
            if (k, s) in was:
                own = np.searchsorted(number, was[k, s])
                rows = np.arange(len(x))
                best = np.where(d[rows, best] >= d[rows, own] - NEARER, own, best)
            nearest = d[np.arange(len(x)), best]
            moved = len(x) if own is None else int((own != best).sum())
            out.append((k, s, 0, norms, number[best].tolist(), nearest.tolist(),
                        float((n * (square + nearest)).sum()), moved, 0.0, None, None))
            one_hot = np.zeros((len(x), len(at)))
            one_hot[np.arange(len(x)), best] = n
            sums = one_hot.T @ x
            for i in np.flatnonzero(one_hot.any(axis=0)):
                some = np.flatnonzero(sums[i])
                out.append((k, s, int(number[i]), None, None, None, 0.0, 0, float(one_hot[:, i].sum()),
                            words[some].tolist() if len(names) else [], sums[i, some].tolist()))
    r = pd.DataFrame(out, columns=["k", "s", "c", "norms", "labels", "ds", "cost", "moved", "total", "grams", "ws"])
    r.insert(0, "group_key", values["group_key"].iloc[0])  # centres are sent to blocks that exist
    r.insert(1, "block", values["block"].iloc[0])
    return r


def step(blocks: DataFrame, centres: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A round of all runs: every value to the nearest of its run's centres (ties to the lower number;
    with the labels of ``before`` a value stays unless another centre is nearer by more than
    ``NEARER``).  A block of values meets all its group's centres in one task."""
    here = blocks.select("group_key", "block").distinct()
    right = centres.join(here, "group_key").select(
        "group_key", "block", "k", "s", "c", "len", "grams", "ws", F.lit(None).cast("array<int>").alias("labels"))
    if before is not None:
        right = right.unionByName(before.where("c = 0").select("group_key", "block", "k", "s", "c", "labels"),
                                  allowMissingColumns=True)
    schema = (f"group_key {dict(blocks.dtypes)['group_key']}, block int, k int, s int, c int, norms array<string>, "
              "labels array<int>, ds array<double>, cost double, moved long, total double, grams array<string>, ws array<double>")
    right = right.withColumnsRenamed({"group_key": "of_group", "block": "of_block"})
    return blocks.groupBy("group_key", "block").cogroup(right.groupBy("of_group", "of_block")).applyInPandas(_round, schema)


def means_of(stepped: DataFrame) -> DataFrame:
    """The next centres: the parts of all blocks put together."""
    parts = stepped.where("c > 0")
    total = parts.groupBy(*RUN, "c").agg(F.sum("total").alias("total"))
    sums = (parts.select(*RUN, "c", F.explode(F.arrays_zip("grams", "ws")).alias("x"))
            .groupBy(*RUN, "c", F.col("x.grams").alias("gram")).agg(F.sum("x.ws").alias("t")))
    means = centre_lists(sums.join(total, [*RUN, "c"]).select(*RUN, "c", "gram", (F.col("t") / F.col("total")).alias("w")))
    # a centre of values without n-grams is the origin
    bare = total.join(means.select(*RUN, "c"), [*RUN, "c"], "left_anti").select(
        *RUN, "c", F.lit(0.0).alias("len"), F.expr("cast(array() as array<string>)").alias("grams"),
        F.expr("cast(array() as array<double>)").alias("ws"))
    return means.unionByName(bare)


def lloyd(blocks: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds until no value of a run moves.  Returns the labels by block (``*RUN, block, norms, labels``) and
    ``(*RUN, inertia)``.  Runs that have ended take no further part."""
    live, done, rounds = _ckpt(step(blocks, centres)), [], 0
    while True:
        moved = _ckpt(step(blocks, means_of(live), live))
        rounds += 1
        ended = moved.agg(F.sum("moved")).first()[0] in (None, 0)
        if ended or rounds % THIN == 0:  # a run that has ended stays as it is; now and then such runs are taken out
            going = _ckpt(moved.where("c = 0").groupBy(*RUN).agg(F.sum("moved").alias("moved"))
                          .where("moved > 0").select(*RUN))
            done.append(_ckpt(moved.where("c = 0").join(going, RUN, "left_anti")))
            moved = _ckpt(moved.join(going, RUN, "left_semi"))
        if ended:
            every = _union(done)
            return every.select(*RUN, "norms", "labels"), every.groupBy(*RUN).agg(F.sum("cost").alias("inertia"))
        live = moved


def labels_of(runs: DataFrame) -> DataFrame:
    """``(*RUN, norms, labels)`` -> ``*RUN, norm, c``."""
    return runs.select(*RUN, F.explode(F.arrays_zip("norms", "labels")).alias("x")).select(
        *RUN, F.col("x.norms").alias("norm"), F.col("x.labels").alias("c"))


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(SEED)), 11) + 0.5) / F.lit(float(1 << 53))


def _thinned(max_k: int):
    """Order of ``max_k`` centres of one (group, start) from its weighted candidates: each with a
    chance that follows its weight and its squared distance to those before it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("norm").reset_index(drop=True)
        names = {g: i for i, g in enumerate(sorted({g for grams in pdf["grams"] for g in grams}))}
        x = np.zeros((len(pdf), len(names)))
        for i, (grams, w) in enumerate(zip(pdf["grams"], pdf["ws"])):
            x[i, [names[g] for g in grams]] = w
        rng = np.random.default_rng([SEED, int(pdf["s"][0])])
        mass, far = pdf["mass"].to_numpy(float), np.full(len(pdf), 2.0)
        order: list[int] = []
        for _ in range(min(max_k, len(pdf))):
            p = mass * far
            p[order] = 0
            if p.sum() <= 1e-12:
                p = np.ones(len(pdf))
                p[order] = 0
            order.append(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(pdf) - 1)))
            far = np.minimum(far, np.maximum(0, ((x - x[order[-1]]) ** 2).sum(axis=1)))
        return pd.DataFrame({"group_key": pdf["group_key"][0], "s": pdf["s"][0], "norm": pdf["norm"][order],
                             "c": np.arange(1, len(order) + 1)})

    return run


def seeds(entries: DataFrame, weights: DataFrame, max_k: int, starts: int) -> DataFrame:
    """``(group_key, s, norm, c)``: for every start the values that are its centres 1 to ``max_k``;
    start 0 by hash, starts 1 to ``starts`` by k-means||."""
    points = _ckpt(entries.select("group_key", "norm").distinct().join(weights, ["group_key", "norm"]))
    first = top_k_per_group(points.drop("n"), ["group_key"], [F.xxhash64("norm", F.lit(SEED)), F.col("norm")], max_k, out="c")
    by_hash = first.select("group_key", F.lit(0).alias("s"), "norm", "c")
    each = points.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(starts))))
    key = ["group_key", "s"]
    # also what the hash gives, so that there are enough candidates
    spare = first.select("group_key", "norm").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(starts))))
    drawn = _ckpt(each.groupBy(*key).agg(F.min_by("norm", F.struct(_uniform("norm", "s"), "norm")).alias("norm")))
    all_drawn, near = [drawn], None
    for i in range(DRAWS + 1):
        vectors = drawn.withColumnRenamed("norm", "of").join(
            entries.select("group_key", F.col("norm").alias("of"), "gram", F.col("weight").alias("w")), ["group_key", "of"])
        dots = (entries.join(vectors, ["group_key", "gram"]).groupBy(*key, "norm", "of")
                .agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
                .groupBy(*key, "norm").agg(F.max(F.struct("dot", "of")).alias("new")))
        known = each if near is None else near
        best = F.col("new") if near is None else F.greatest("best", "new")
        near = _ckpt(known.join(dots, [*key, "norm"], "left").select(*key, "norm", "n", best.alias("best")))
        if i == DRAWS:
            break
        d = F.greatest(F.lit(0.0), 2 - 2 * F.coalesce("best.dot", F.lit(0.0)))
        spread = near.withColumn("d", d)
        total = spread.groupBy(*key).agg(F.sum(F.col("n") * F.col("d")).alias("total"))
        chance = 2 * max_k * F.col("n") * F.col("d") / F.col("total")
        drawn = _ckpt(spread.join(total, key).where((F.col("d") > NEARER) & (_uniform("norm", "s", F.lit(i)) < chance))
                      .select(*key, "norm"))
        all_drawn.append(drawn)
    mass = near.where("best is not null").groupBy(*key, F.col("best.of").alias("norm")).agg(F.sum("n").alias("mass"))
    cand = _union([*all_drawn, spare.select(*key, "norm")]).distinct().join(mass, [*key, "norm"], "left").fillna(1, ["mass"])
    lists = entries.groupBy("group_key", "norm").agg(F.collect_list(F.struct("gram", "weight")).alias("e"))
    ready = cand.join(lists, ["group_key", "norm"]).select(
        *key, "norm", F.col("mass").cast("double").alias("mass"), F.col("e.gram").alias("grams"), F.col("e.weight").alias("ws"))
    types = dict(entries.dtypes)
    thin = ready.groupBy(*key).applyInPandas(
        _thinned(max_k), f"group_key {types['group_key']}, s int, norm string, c int")
    return by_hash.unionByName(thin)


def _cell(ks: int):
    """Sums of the distances of a block's values to the clusters of the other block's."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {g: i for i, g in enumerate(sorted({g for grams in pdf["grams"] for g in grams}))}
        x = np.zeros((len(pdf), max(1, len(names))))
        for r, (grams, w) in enumerate(zip(pdf["grams"], pdf["ws"])):
            x[r, [names[g] for g in grams]] = w
        square = (x * x).sum(axis=1)
        dist = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * (x @ x.T)))
        np.fill_diagonal(dist, 0)
        labels = np.array(pdf["labels"].tolist(), dtype=np.int64).reshape(len(pdf), ks)
        block, n = pdf["block"].to_numpy(), pdf["n"].to_numpy(float)
        one = pdf["i"][0] == pdf["j"][0]
        side = block == pdf["j"][0]
        out = [pd.DataFrame({"group_key": pdf["group_key"][:0], "norm": pdf["norm"][:0],
                             "sums": pd.Series([], dtype=object)})]
        if not one and (side.all() or not side.any()):
            return out[0]
        for own, other in ([(slice(None), slice(None))] if one else [(side, ~side), (~side, side)]):
            d, sums = dist[own][:, other], []
            for j in range(ks):
                c = labels[other, j]
                one_hot = np.zeros((len(c), _WIDTH))
                known = c >= 0
                one_hot[np.flatnonzero(known), c[known]] = n[other][known]
                sums.append(d @ one_hot)
            out.append(pd.DataFrame({"group_key": pdf["group_key"][own], "norm": pdf["norm"][own],
                                     "sums": list(np.concatenate(sums, axis=1))}))
        return pd.concat(out, ignore_index=True)

    return run


_WIDTH = 21  # clusters of a run at most, with a place for number 0


def silhouettes(assigned: DataFrame, entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean silhouette ``(group_key, k, score)`` of ``assigned(group_key, k, norm, c)`` over all
    occurrences: Euclidean distances, the mean to the other occurrences of the own cluster
    against the smallest mean to another cluster; 0 alone in a cluster.  Results
    with one label have no row."""
    k_values = sorted(r["k"] for r in assigned.select("k").distinct().collect())  # at most 19
    empty = "cast(array() as array<{}>)"
    labels = assigned.groupBy("group_key", "norm").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    lists = entries.groupBy("group_key", "norm").agg(F.collect_list(F.struct("gram", "weight")).alias("e"))
    blocks = labels.groupBy("group_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    rows = (labels.join(weights, ["group_key", "norm"]).join(lists, ["group_key", "norm"], "left").join(blocks, "group_key")
            .select("group_key", "norm", "n", "blocks", F.pmod(F.xxhash64("norm"), F.col("blocks")).cast("int").alias("block"),
                    F.coalesce("e.gram", F.expr(empty.format("string"))).alias("grams"),
                    F.coalesce("e.weight", F.expr(empty.format("double"))).alias("ws"),
                    F.array(*[F.coalesce(F.col("m")[k], F.lit(-1)).cast("int") for k in k_values]).alias("labels")))
    cells = (rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}))
    schema = f"group_key {dict(assigned.dtypes)['group_key']}, norm string, sums array<double>"
    part = cells.select("group_key", "i", "j", "block", "norm", "n", "grams", "ws", "labels").groupBy(
        "group_key", "i", "j").applyInPandas(_cell(len(k_values)), schema)
    width = len(k_values) * _WIDTH
    total = part.groupBy("group_key", "norm").agg(F.array(*[F.sum(F.col("sums")[p]) for p in range(width)]).alias("sums"))
    each = total.select("group_key", "norm", F.explode(F.expr(
        f"transform(sequence(0, {len(k_values) - 1}), i -> named_struct('k', array({', '.join(map(str, k_values)) or 0})[i], "
        f"'sums', slice(sums, i * {_WIDTH} + 1, {_WIDTH})))")).alias("r")).select("group_key", "norm", "r.k", "r.sums")
    sizes = (assigned.join(weights, ["group_key", "norm"]).groupBy("group_key", "k", "c").agg(F.sum("n").alias("size"))
             .groupBy("group_key", "k").agg(F.collect_list(F.struct("c", "size")).alias("sizes")).where("size(sizes) > 1"))
    p = assigned.join(weights, ["group_key", "norm"]).join(each, ["group_key", "k", "norm"]).join(sizes, ["group_key", "k"])
    mine = F.element_at(F.filter("sizes", lambda x: x["c"] == F.col("c")), 1)["size"]
    a = F.get("sums", F.col("c")) / (F.col("mine") - 1)
    b = F.array_min(F.transform(F.filter("sizes", lambda x: x["c"] != F.col("c")),
                                lambda x: F.get("sums", x["c"]) / x["size"]))
    s = F.when((F.col("mine") == 1) | (F.greatest("a", "b") <= 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return (p.withColumn("mine", mine).withColumns({"a": F.when(F.col("mine") > 1, a).otherwise(0.0), "b": b})
            .withColumn("sil", s).groupBy("group_key", "k")
            .agg((F.sum(F.col("sil") * F.col("n")) / F.sum("n")).alias("score")))


def kmeans_runs(nodes: DataFrame, mode: str = "category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All runs of all groups to their end: labels (``*RUN, norms, labels``), ``(*RUN, inertia)`` and the TF-IDF
    entries."""
    min_k, max_k = CATEGORY_K if mode == "category" else DIRECT_K
    entries = _ckpt(tfidf(nodes).select("group_key", "norm", "gram", "weight"))
    weights = nodes.select("group_key", "norm", "n")
    sizes = nodes.groupBy("group_key").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("ndist"))
    top = F.least(F.lit(max_k), F.col("size") - 1, F.col("ndist")).cast("int")
    # A group without any n-gram has no vocabulary and stays one cluster
    ks = (sizes.join(entries.select("group_key").distinct(), "group_key").withColumn("top", top).where(F.col("top") >= min_k)
          .select("group_key", F.explode(F.sequence(F.lit(min_k), F.col("top"))).alias("k")))
    begin = seeds(entries, weights, max_k, STARTS[mode])
    centres = (begin.join(ks, "group_key").where("c <= k").join(entries, ["group_key", "norm"])
               .select(*RUN, "c", "gram", F.col("weight").alias("w")))
    blocks = _ckpt(value_blocks(nodes.join(ks.select("group_key").distinct(), "group_key", "left_semi"), entries))
    return *lloyd(blocks, _ckpt(centre_lists(centres))), entries


def kmeans_clusters(nodes: DataFrame, mode: str = "category") -> DataFrame:
    """C3 / C4 over ``nodes(group_key, norm, occ, n)``: same rows plus ``leader``,
    ``cluster_id`` and ``cluster_tag`` (labels numbered by first occurrence)."""
    runs, inertia, entries = kmeans_runs(nodes, mode)
    weights = nodes.select("group_key", "norm", "n")
    start = (inertia.groupBy("group_key", "k")
             .agg(F.min_by("s", F.struct(F.round("inertia", 9), "s")).alias("s")))
    chosen = _ckpt(labels_of(runs.join(start, RUN, "left_semi")).drop("s"))
    best = silhouettes(chosen, entries, weights).groupBy("group_key").agg(
        F.max_by("k", F.struct(F.round("score", 12), -F.col("k"))).alias("k"))
    label = chosen.join(best, ["group_key", "k"]).select("group_key", "norm", "c")
    out = _ckpt(nodes.join(label, ["group_key", "norm"], "left").withColumn("c", F.coalesce("c", F.lit(0))))
    # at most max_k labels per group: the window over the leader table is small
    first = out.groupBy("group_key", "c").agg(F.min("occ").alias("leader"))
    first = first.withColumn("cluster_id", F.row_number().over(
        Window.partitionBy("group_key").orderBy("leader")).cast("long"))
    return _ckpt(out.join(first, ["group_key", "c"])
                 .withColumn("cluster_tag", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))).drop("c"))

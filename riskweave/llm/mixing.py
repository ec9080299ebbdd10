"""Operator 4: mix sources to target weights by subset-sum budget fitting.

Every source gets a target number of words.  Whole copies of a source are taken
while they fit; what remains of the target is a budget that is filled by

1. counting the documents of each exact length (one partial aggregation);
2. taking the same share of every length, rounded down, then long documents while
   they fit, until a small budget is left;
3. a bounded-knapsack dynamic programme over (length, documents left) that finds
   the largest reachable sum within that small budget;
4. selecting, within each length, the documents that come first by a seeded hash.

Only (source, length) counts reach one task at a time.  The selection sorts no rows:
texts are hashed, equal hashes are counted, and hash slices say which slices of a
length are taken whole.  Only the hashes of the one slice that straddles the cut are
ordered, which gives each length a border: rows before it are taken.  Rows meet
nothing but the table of borders, one row for each source and length, and are
numbered only where a border falls within rows of equal hash, that is between copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .common import fresh, n_words

SLICES = 1024
DP_WORDS = 4096
SPAN = 1 << 16          # rows of a span, where copies are numbered


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Add ``target`` to rows (size, weight): ``total`` shared by weight, no target
    above ``cap * size``, the excess reshared among the others until none is above.

    Each round is one aggregation; only its two sums reach the driver.  A round
    closes at least one source, as a level that closes none is final."""
    limit = F.col("size") * F.lit(float(cap))
    level = 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        done, weight = sources.agg(
            F.sum(F.when(full, limit).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double")))).first()
        if not weight or (raised := (total - done) / weight) <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int,
               dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as close
    to ``budget`` from below as the last step can reach.  ``counts`` documents exist."""
    total = sum(n * c for n, c in zip(lengths, counts))
    budget = max(0, min(budget, total))
    take = [c * budget // total if total else 0 for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: lengths[i])
    for i in reversed(order):
        more = min(counts[i] - take[i], max(0, rest - dp_words) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    # Bounded knapsack over the sums 0..rest, held as the bits of an integer; a
    # count is split into powers of two, so it costs log(count) shifts.
    mask, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        left, part = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not sums >> rest & 1:
            part = min(part, left)
            steps.append((i, part, sums))
            sums |= sums << part * lengths[i] & mask
            left -= part
            part *= 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * lengths[i]
    return take


def mix_sources(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                source: str = "source", weights: Sequence[float] = (1, 2, 3), share: float = 1.0,
                max_repeats: int = 3, seed: int = 17, slices: int = SLICES,
                out: str = "mix") -> DataFrame:
    """The rows of ``docs`` with a struct column ``out``: size, source_size, target,
    taken (words the mix takes, repeats counted) and repeats (0..max_repeats).

    Sources in code point order, null last, get ``weights`` in turn.  A null or empty
    text has size 0 and is never repeated; a text of any length counts whole.  Rows that
    repeat are separate documents; which of several rows of equal id and text is taken is
    not fixed, how many is.  An existing column named ``out`` is replaced.  An
    empty table gives no rows."""
    spark = docs.sparkSession
    docs = docs.drop(out)
    names = docs.columns  # of any kind; inside they are c0, c1, ...
    text, doc_id, source = (f"c{names.index(c)}" for c in (text, doc_id, source))
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    keyed = docs.select(
        "*", n_words(F.col(text)).alias("__size"),
        F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)).alias("__hash"))
    slice_of = F.pmod("__hash", F.lit(slices)).cast("int")
    hashes = snapshot(
        keyed.groupBy(F.col(source).alias("source"), F.col("__size").alias("size"), slice_of.alias("slice"),
                      F.col("__hash").alias("hash")).agg(F.count(F.lit(1)).alias("n")), "mix-hashes")
    cells = snapshot(hashes.groupBy("source", "size", "slice").agg(F.sum("n").alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    # One row per source: their order needs one sort, of names only.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    sources = snapshot(sources.withColumn("weight", weight), "mix-sources")
    total = (sources.agg(F.sum("size")).first()[0] or 0) * share
    sources = water_fill(sources, float(total), float(max_repeats))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    sources = sources.withColumn("whole", F.least(whole, F.lit(max_repeats)).cast("int"))
    sources = snapshot(
        sources.withColumn("budget", F.when(F.col("whole") < max_repeats, F.round(
            F.col("target") - F.col("whole") * F.col("size"))).otherwise(0).cast("long"))
        .withColumnRenamed("size", "source_size"), "mix-targets")

    def fit(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        n = fit_budget(lengths["size"].tolist(), lengths["n"].tolist(), int(lengths["budget"].iloc[0]))
        return lengths[["source", "size"]].assign(n_take=n)

    lengths = (cells.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
               .join(sources.select(F.col("source").alias("__s"), "budget"),
                     F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    takes = (lengths.groupBy("source").applyInPandas(fit, "source string, size long, n_take long")
             .select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n_take"))
    # Of each length the first slice that is not taken whole, and what to take of it.
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("n")
    cut = (cells.where("size > 0").withColumn("before", before)
           .join(takes, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
           .where(F.col("before") + F.col("n") > F.col("n_take")).groupBy("__s", "__z")
           .agg(F.min_by(F.struct("slice", (F.col("n_take") - F.col("before")).alias("rest")), "slice").alias("cut"))
           .select("__s", "__z", F.col("cut.slice").alias("__l"), F.col("cut.rest").alias("__rest")))
    # Within that slice the first hash that is not taken whole.
    inside = hashes.join(cut, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
                         & (F.col("slice") == F.col("__l")))
    before = F.sum("n").over(Window.partitionBy("__s", "__z").orderBy("hash")) - F.col("n")
    border = (inside.withColumn("before", before).where(F.col("before") + F.col("n") > F.col("__rest"))
              .groupBy("__s", "__z", "__l").agg(F.min_by(
                  F.struct("hash", (F.col("__rest") - F.col("before")).alias("copies")), "hash").alias("border"))
              .select(F.col("__s").alias("__s3"), F.col("__z").alias("__z3"), "__l",
                      F.col("border.hash").alias("__h"), F.col("border.copies").alias("__m")))
    sizes = (cells.select(F.col("source").alias("__s"), F.col("size").alias("__z")).distinct()
             .join(border, F.col("__s").eqNullSafe(F.col("__s3")) & (F.col("__z") == F.col("__z3")), "left").drop("__s3", "__z3"))
    sizes = snapshot(
        sizes.join(sources.select(F.col("source").alias("__s2"), F.col("source_size").alias("__ss"),
                                  F.col("target").alias("__t"), F.col("whole").alias("__w")),
                   F.col("__s").eqNullSafe(F.col("__s2"))).drop("__s2"), "mix-borders")
    joined = (keyed.withColumn("__slice", slice_of)
              .join(sizes, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))))
    # 1: taken once more, 0: not, null: a copy at the border, of which __m are taken.
    more = (F.when((F.col("__size") == 0), 0).when(F.col("__l").isNull(), 1)
            .when(F.col("__slice") != F.col("__l"), (F.col("__slice") < F.col("__l")).cast("int"))
            .when(F.col("__hash") != F.col("__h"), (F.col("__hash") < F.col("__h")).cast("int"))
            .when(F.col("__m") == 0, 0))
    joined = joined.withColumn("__more", more)
    if sizes.where("__m > 0").isEmpty():
        mixed = joined
    else:
        split = joined.where(F.col("__more").isNull()).withColumn("__row", F.monotonically_increasing_id())
        mixed = joined.where(F.col("__more").isNotNull()).unionByName(_number(snapshot(split, "mix-copies")))
    mixed = mixed.withColumn("__r", F.when(F.col("__size") > 0, F.col("__w") + F.col("__more")).otherwise(0))
    return mixed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.struct(
        F.col("__size").alias("size"), F.col("__ss").alias("source_size"), F.col("__t").alias("target"),
        (F.col("__size") * F.col("__r")).alias("taken"), F.col("__r").alias("repeats")).alias(out))


def _number(copies: DataFrame, spans: int = SPAN) -> DataFrame:
    """Of the written rows of each border the first ``__m`` get ``__more`` = 1, the others
    0.  The rows of a border fall into spans of row numbers; a span is numbered by itself
    and shifted by the counts of the spans before it."""
    key = ["__s", "__z"]
    copies = copies.withColumn("__span", F.floor(F.col("__row") / spans))
    counts = copies.groupBy(*key, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__span")) - F.col("__n")
    counts = counts.select(F.col("__s").alias("__s3"), F.col("__z").alias("__z3"), F.col("__span").alias("__p3"), before.alias("__b"))
    place = F.row_number().over(Window.partitionBy(*key, "__span").orderBy("__row"))
    return (copies.join(counts, F.col("__s").eqNullSafe(F.col("__s3")) & (F.col("__z") == F.col("__z3")) & (F.col("__span") == F.col("__p3")))
            .withColumn("__more", (place + F.col("__b") <= F.col("__m")).cast("int"))
            .drop("__s3", "__z3", "__p3", "__b", "__span", "__row"))


def mixed_rows(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    mix, copy = fresh(docs, "__mix"), fresh(docs, "__copy")
    mixed = mix_sources(docs, out=mix, **kwargs)
    return (mixed.where(F.col(mix)["repeats"] > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mix)["repeats"])))
            .drop(mix, copy))

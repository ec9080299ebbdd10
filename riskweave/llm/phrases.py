"""Operator 11: phrase collocation mining by SON partitioning.

The corpus is dealt into a few shards.  A phrase that has the support in the whole
corpus of a language has a share of it in at least one shard: the support times the
shard's share of the language's words, rounded up.  Each shard is mined completely at
that lowered support, level by level (a phrase is only counted where the phrases of one
word less that it holds are frequent in the shard).  The union of what is frequent in
some shard is then counted over the whole corpus, exactly and by its letters.

The support is a number of occurrences, so it can't be lowered any number of times: with
ten shards or more every phrase would be frequent in one of them.  Shards are therefore
few at every size, and a shard is not the work of one task: its counts are an ordinary
grouped aggregation.  Mining uses 64-bit hashes; two phrases of one hash are counted
together there, which can only propose too much.  What is frequent travels between
levels as bitmaps of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .bitmaps import collect_bits, holds
from .wordstream import Part, chain, kinds_of, mix, parts

KINDS = kinds_of(breaks=b".,;:!?\n\x0b\x0c\r", blanks=b" \t")
SUPPORT = 10
LONGEST = 3
SHARDS = 3
SHARD_BITS = 24        # bits of each shard in the bitmap of a level: 2 MB a shard
UNION_BITS = 27        # bits of the union's bitmap: 16 MB
HELD = 1 << 20         # phrases that a task counts at once before it hands them on
READ = 2 << 20         # bytes of text that a task looks at at once
YIELDED = 1 << 16      # rows of a batch that a task hands on
SALTS = 64             # parts in which the first phrases of a language are picked first


def _phrase_hashes(part: Part, salt: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to n words that begin at each word; the last words have
    none of the longer ones."""
    out = [chain(salt, part.hashes)]
    for k in range(1, n):
        out.append(chain(out[-1][:-1], part.hashes[k:]) if len(out[-1]) else out[-1])
    return out


def _whole(part: Part, n: int) -> np.ndarray:
    """Where the phrase of n words from a word on lies in one piece and belongs to the part."""
    size = max(0, len(part.starts) - n + 1)
    return (part.piece[:size] == part.piece[n - 1:n - 1 + size]) & (np.arange(size) < part.own)


def _position(hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return (shard.astype(np.int64) << SHARD_BITS) | (hashes & np.uint64((1 << SHARD_BITS) - 1)).astype(np.int64)


def _tally(docs: DataFrame, n: int, frequent) -> DataFrame:
    """(lang_key, shard, h, c): counts of phrases of n words in each shard, summed per
    shard by the caller's groupBy.  ``frequent`` is the broadcast bitmap of n - 1 words."""
    def flush(groups, held):
        """Counts of the held (group, hash); groups are numbers of (lang_key, shard)."""
        of, hashes = map(np.concatenate, zip(*held))
        of = of.astype(np.uint16) if len(groups) < 1 << 16 else of  # sorted by digits, not by comparing
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(groups) + 1))
        hashes = hashes[order]
        for k, (key, shard) in enumerate(groups):
            if cuts[k] < cuts[k + 1]:
                h, c = np.unique(hashes[cuts[k]:cuts[k + 1]], return_counts=True)
                yield from _small(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), key)), pa.array(np.full(len(h), shard, np.int32)),
                     pa.array(h.view(np.int64)), pa.array(c.astype(np.int32))], ["lang_key", "shard", "h", "c"]))

    def run(batches):
        groups: dict[tuple[int, int], int] = {}
        held, size = [], 0
        for b in batches:
            key, shard = b.column(1).to_numpy(), b.column(2).to_numpy()
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(key.tolist(), shard.tolist())], np.int32)
            salt = mix(key.view(np.uint64))
            for part in parts(b.column(0), KINDS, n - 1, READ):
                if not len(part.starts):
                    continue
                hashes = _phrase_hashes(part, salt[part.row], n)
                ok = _whole(part, n)
                if n > 1:
                    known = holds(frequent.value, _position(hashes[-2], shard[part.row[:len(hashes[-2])]]))
                    ok &= known[:len(ok)] & known[1:len(ok) + 1]
                at = np.flatnonzero(ok)
                held.append((group[part.row[at]], hashes[-1][at]))
                size += len(at)
                if size >= HELD:
                    yield from flush(list(groups), held)
                    held, size = [], 0
        if size:
            yield from flush(list(groups), held)

    return (docs.select("text", "lang_key", "shard").mapInArrow(run, "lang_key long, shard int, h long, c int")
            .groupBy("lang_key", "shard", "h").agg(F.sum("c").alias("c")))


def _count(docs: DataFrame, n: int, union) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all proposed phrases of 1 to n words, by
    their letters; one row of 0 words has the number of all words of a language."""
    def run(batches):
        for b in batches:
            coded = b.column(1).dictionary_encode()
            names, lang = coded.dictionary, coded.indices.to_numpy()
            salt = mix(b.column(2).to_numpy().view(np.uint64))
            for part in parts(b.column(0), KINDS, n - 1, READ):
                if not len(part.starts):
                    continue
                word_lang = lang[part.row]
                hashes = _phrase_hashes(part, salt[part.row], n)
                total = np.bincount(word_lang[:part.own], minlength=len(names))
                yield _named(names, np.arange(len(names)), 0, pa.array([""] * len(names)), total)
                for k in range(1, n + 1):
                    size = max(0, len(part.starts) - k + 1)
                    inside = holds(union.value, hashes[k - 1][:size] & np.uint64((1 << UNION_BITS) - 1))
                    at = np.flatnonzero(_whole(part, k) & inside)
                    columns = {"lang": word_lang[at]} | {f"w{j}": part.codes[at + j] for j in range(k)}
                    groups = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
                    spelled = [part.words.take(groups.column(f"w{j}").combine_chunks()) for j in range(k)]
                    phrase = spelled[0] if k == 1 else pc.binary_join_element_wise(*spelled, " ")
                    yield from _small(_named(names, groups.column("lang").to_numpy(), k, phrase, groups.column("count_all").to_numpy()))

    return (docs.select("text", "lang", "lang_key").mapInArrow(run, "lang string, words int, phrase string, f long")
            .groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")))


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, YIELDED):
        yield batch.slice(k, YIELDED)


def _named(names, lang, words, phrase, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(lang)), pa.array(np.full(len(lang), words, np.int32)), phrase, pa.array(f.astype(np.int64))],
        ["lang", "words", "phrase", "f"])


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", support: int = SUPPORT,
                  longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of 2 to ``longest`` words that occurs
    ``support`` times in its language (overlaps included), of every word in one of them,
    and with 0 words and an empty phrase the number of all words.  Other phrases may be
    among the rows, with their exact counts.

    A null text counts as empty, a null language as ``und``; rows that repeat count each;
    an empty table gives no rows.  Long texts are read in stretches, whole.  Only the two
    named columns are read, so other names cannot clash."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    docs = docs.select("text", "lang", F.xxhash64("lang").alias("lang_key"),
                       F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
    words = snapshot(_tally(docs, 1, None), "phrase-words")
    sizes = words.groupBy("lang_key", "shard").agg(F.sum("c").alias("size"))
    totals = sizes.groupBy("lang_key").agg(F.sum("size").alias("total"))
    least = snapshot(sizes.join(totals, "lang_key").selectExpr(
        "lang_key", "shard", f"({support} * size + total - 1) div total AS least"), "phrase-support")
    width = SHARD_BITS + max(1, (shards - 1).bit_length())
    place = F.shiftleft(F.col("shard").cast("long"), SHARD_BITS).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << SHARD_BITS) - 1)))
    frequent, union = None, np.zeros(1 << (UNION_BITS - 3), np.uint8)
    for n in range(1, longest + 1):
        counted = words if n == 1 else _tally(docs, n, frequent)
        level = snapshot(counted.join(least, ["lang_key", "shard"]).where("c >= least").select("shard", "h"), "phrase-frequent")
        if n < longest:
            frequent = spark.sparkContext.broadcast(collect_bits(level, place, width))
        union |= collect_bits(level, F.col("h").bitwiseAND(F.lit((1 << UNION_BITS) - 1)), UNION_BITS)
    return _count(docs, longest, spark.sparkContext.broadcast(union))


def _inside(words: str, longest: int) -> str:
    """SQL array of the shorter phrases, of two words or more, that lie in a phrase."""
    return (f"flatten(transform(sequence(2, {longest}), m -> transform(filter(sequence(1, {longest}), "
            f"i -> m < {words} AND i + m - 1 <= {words}), i -> array_join(slice(w, i, m), ' '))))")


def collocations(docs: DataFrame, *, top: int = 2000, held_percent: int = 50, support: int = SUPPORT,
                 longest: int = LONGEST, **kwargs) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (the first of
    equal ones), n all words of the language; the score is floor(1000000 * a * a / (l * r)).
    A phrase is left out if a longer frequent one that holds it has ``held_percent`` of its
    count.  Order: score and a from high to low, then phrase by bytes.  See phrase_counts
    for nulls, empty and long texts, repeated rows and empty tables."""
    counts = snapshot(phrase_counts(docs, support=support, longest=longest, **kwargs), "phrase-counts")
    found = counts.where((F.col("words") > 1) & (F.col("f") >= support)).select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("tail"))
    part = counts.where("words > 0")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("over", (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)"))
    cuts = cuts.withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("cast(over div under AS bigint)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = (found.where("words > 2").select("lang", F.col("a").alias("around"), F.explode(
        F.expr(_inside("words", longest))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        f"around IS NULL OR 100 * around < {held_percent} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task sorts all of a large one
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

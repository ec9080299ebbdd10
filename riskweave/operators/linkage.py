"""Record linkage: dedupe-by-max, key translation, left-join linkage with
zero-fill, multi-source OR, small reference joins, fan-out audit (J1-J11, A2, A3).

Scale notes.  Sources are collapsed to one row per key *before* the join
(partial aggregation, so a duplicated key never becomes a hot task) and null
keys are dropped first (in a group-by they would form one giant group, and they
can never match a join anyway).  All linkage joins of one spine share the same
key, so Spark hash-partitions the spine once and reuses that partitioning for
every source join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.recode import either_source, present, recode_map
from ..session import materialize
from .common import attach_row


def dedupe_max(df: DataFrame, key: str, cols: Sequence[str] | None = None,
               numeric: bool = True) -> DataFrame:
    """A2: one row per key, max of every column.  String codes are cast with
    ``try_cast`` first so '10' > '9' numerically and junk codes become null."""
    cols = [c for c in (cols or df.columns) if c != key]
    val = (lambda c: F.col(c).try_cast("double")) if numeric else F.col
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(*[F.max(val(c)).alias(c) for c in cols]))


def dedupe_severity(df: DataFrame, key: str, code_col: str, mapping: Mapping, out: str,
                    other_max: Sequence[str] = ()) -> DataFrame:
    """A3: recode an ordinal code then keep the most severe level per key."""
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.max(recode_map(F.col(code_col), dict(mapping))).cast("int").alias(out),
                   *[F.max(c).alias(c) for c in other_max]))


def link(spine: DataFrame, source: DataFrame, key: str, fill_zero: Iterable[str] = ()) -> DataFrame:
    """Left join (spine row count preserved when the source is unique per key);
    ``fill_zero`` columns read absence of a record as absence of the condition."""
    out = spine.join(source, key, "left")
    fill = list(fill_zero)
    return out.fillna(0, subset=fill) if fill else out


def link_all(spine: DataFrame, sources: Sequence[tuple[DataFrame, Iterable[str]]], key: str) -> DataFrame:
    """Chain of same-key left joins."""
    return reduce(lambda acc, s: link(acc, s[0], key, s[1]), sources, spine)


def translate_id(source: DataFrame, lookup: DataFrame, source_key: str, lookup_from: str,
                 lookup_to: str) -> DataFrame:
    """Replace a source's key by the study id through a lookup; untranslatable
    rows (null id) are dropped, never grouped into one null key.  Repeated rows of the
    lookup count once; a key that leads to several ids gives a row for each of them."""
    lk = (lookup.select(F.col(lookup_from).alias(source_key), lookup_to)
          .where(F.col(source_key).isNotNull()).distinct())
    return (source.join(lk, source_key, "left").where(F.col(lookup_to).isNotNull())
                  .drop(source_key))


def attach_reference(df: DataFrame, ref: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join to a reference table.  Whether it is broadcast is left to the
    planner, which compares its size in bytes with the session's limit at run time."""
    return df.join(ref, key, "left")


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all common columns."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common columns")
    return left.join(right, common, how)


def link_flag(spine: DataFrame, lookup: DataFrame, key: str, present_col: str, out: str) -> DataFrame:
    """J10 + C8: 1 when the spine id has a non-null partner in the lookup."""
    lk = (lookup.where(F.col(key).isNotNull())
          .groupBy(key).agg(F.max(present(F.col(present_col))).alias(out)))
    return spine.join(lk, key, "left").fillna(0, subset=[out])


def join_suffix(left: DataFrame, right: DataFrame, key: str,
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join where clashing column names get suffixes (dplyr ``suffix=``); a suffix
    is repeated until the name is not taken by another column of either side."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    taken = (set(left.columns) | set(right.columns)) - clash

    def named(columns: list[str], suffix: str) -> list[str]:
        out = []
        for c in columns:
            new = c + suffix if c in clash else c
            while c in clash and new in taken:
                new += suffix
            taken.add(new)
            out.append(new)
        return out

    l2 = left.toDF(*named(left.columns, suffixes[0]))
    r2 = right.toDF(*named(right.columns, suffixes[1]))
    return l2.join(r2, key, "left")


def combine_sources(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``out = 1 if primary == 1 else secondary`` then null -> 0."""
    return df.withColumns({out: either_source(F.col(p), F.col(s)) for out, (p, s) in pairs.items()})


def fanout_audit(spine: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Row counts before/after linkage and the number of keys that fanned out."""
    per_key = linked.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    a = spine.agg(F.count(F.lit(1)).alias("n_spine"))
    b = per_key.agg(F.sum("c").alias("n_linked"), F.count(F.lit(1)).alias("n_keys"),
                    F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).cast("long").alias("n_fanout_keys"),
                    F.max("c").alias("max_rows_per_key"))
    return attach_row(a, b).withColumn("fanout", (F.col("n_linked") != F.col("n_spine")).cast("int"))


def linked_and_counted(spine: DataFrame, link: Callable[[DataFrame], DataFrame],
                       allow_fanout: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """J11/S11/A9 without passes of their own: ``link(spine)``, written once, and its row
    counts (n_spine, n_linked), observed while it is written.

    Raises if the linked frame has another number of rows than the spine, unless
    ``allow_fanout`` is set.  ``link`` must read its argument once; an attempt of a stage
    that is repeated after a lost executor may count its rows twice, so a difference is
    counted again from the written frame before it raises."""
    before, after = Observation(), Observation()
    seen = spine.observe(before, F.count(F.lit(1)).alias("n_spine"))
    out = materialize(link(seen).observe(after, F.count(F.lit(1)).alias("n_linked")))
    counts = {**before.get, **after.get}
    if counts["n_spine"] != counts["n_linked"]:
        counts = {"n_spine": spine.count(), "n_linked": out.count()}
        if counts["n_spine"] != counts["n_linked"] and not allow_fanout:
            raise ValueError(f"linkage changed the number of rows: {counts}")
    return out, counts

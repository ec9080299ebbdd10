"""Operator 13: vector codes from part-wise codebooks, found by slices of bitmasks.

A vector of whole numbers is cut into equal parts, and each part is coded by the nearest
entry of its position's codebook.  For the search every coordinate of a codebook keeps
its entries in order, with the mask of the entries up to each place.  In each dimension
the entries within an initial radius are one range, the exclusive-or of two prefix masks.
The masks of all dimensions, ANDed, name the few entries inside the box around the
vector, and only these are compared.  The box is widened where an entry outside it could
be nearer, so the result is exact.
"""

from __future__ import annotations

import decimal
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import matrix
from .vectors import usable

PARTS = 8
ENTRIES = 16           # at most 64, the bits of a mask
ROUNDS = 6
SCALE = 4096
LARGEST = 2.0 ** 50    # components from here on have no place in 64-bit entries


class Codebook:
    """The entries of one part position, with sorted coordinates and prefix masks."""

    def __init__(self, entries: list[list[int]]):
        self.rows = entries
        self.size = max((abs(v) for e in entries for v in e), default=0)
        self.at = self._search(np.int64) if self.size < 1 << 62 else None
        self.wide = self._search(object)

    def _search(self, kind):
        table = np.array(self.rows, kind).reshape(len(self.rows), -1)
        order = np.argsort(table, axis=0, kind="stable")
        masks = np.zeros((len(self.rows) + 1, table.shape[1]), np.uint64)
        for k in range(len(self.rows)):
            masks[k + 1] = masks[k] | (np.uint64(1) << order[k].astype(np.uint64))
        apart = sorted(min((int(np.abs(a - b).max()) for j, b in enumerate(table) if j != k), default=1)
                       for k, a in enumerate(table))
        return table, np.take_along_axis(table, order, 0), masks, max(1, apart[len(apart) // 2] // 2)

    def _box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries whose coordinates all are within ``radius``, for each row."""
        _, ordered, masks, _ = self.wide if x.dtype == object else self.at
        out = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(x.shape[1]):
            low = np.searchsorted(ordered[:, d], x[:, d] - radius)
            high = np.searchsorted(ordered[:, d], x[:, d] + radius, side="right")
            out &= masks[high, d] ^ masks[low, d]
        return out

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry, the lower one of equals; its squared distance; mask of the
        entries that were compared) of each row.

        The box grows until an entry is inside.  An entry outside it is farther than its
        radius, so where the nearest inside is too, a box of that distance is looked at."""
        table, _, _, start = self.wide if x.dtype == object else self.at
        radius = np.full(len(x), start, x.dtype)
        mask = self._box(x, radius)
        rows = np.flatnonzero(mask == 0)
        while len(rows):
            radius[rows] *= 2
            mask[rows] = self._box(x[rows], radius[rows])
            rows = rows[mask[rows] == 0]
        best = np.full(len(x), len(table))
        least = np.zeros(len(x), x.dtype)

        def compare(rows: np.ndarray, mask: np.ndarray) -> None:
            for e in range(len(table)):
                at = rows[np.flatnonzero(mask >> np.uint64(e) & np.uint64(1))]
                far = ((x[at] - table[e]) ** 2).sum(axis=1)
                better = (best[at] == len(table)) | (far < least[at]) | ((far == least[at]) & (e < best[at]))
                best[at[better]], least[at[better]] = e, far[better]

        compare(np.arange(len(x)), mask)
        rows = np.flatnonzero(least > radius * radius)
        if len(rows):
            if x.dtype == object:
                wider = np.array([math.isqrt(f) + 1 for f in least[rows]], object)
            else:
                wider = np.sqrt(least[rows].astype(np.float64)).astype(np.int64) + 2
            more = self._box(x[rows], wider) & ~mask[rows]
            mask[rows] |= more
            compare(rows, more)
        return best, least, mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's nearest entry."""
        return self.search(x)[:2]


def whole(x: np.ndarray, books: list[Codebook], scale: int) -> np.ndarray:
    """Components as whole numbers, in 64 bits where all distances fit and else in
    Python's numbers of any size."""
    scaled = np.floor(x * scale)
    most = max(float(np.abs(scaled).max(initial=0)), float(max(b.size for b in books)))
    if x.shape[1] * (2 * most + 2) ** 2 < 2.0 ** 62:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], object).reshape(scaled.shape)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return matrix(pa.table([vectors.cast(pa.list_(pa.float64()))], ["x"]), 0, np.float64)


def taking_part(vector: Column, width: int) -> Column:
    """Vectors that can be coded: ``width`` finite components, each less than LARGEST."""
    fits = ~F.exists(vector.cast("array<double>"), lambda v: F.abs(v) >= F.lit(LARGEST))
    return usable(vector) & (F.size(vector) == width) & F.coalesce(fits, F.lit(False))


def width_of(vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS) -> int:
    """Length of the vectors that are coded: that of the smallest id whose vector can be
    cut into equal parts; 0 if there is none."""
    size = F.size(vector)
    good = usable(F.col(vector)) & (F.pmod(size, F.lit(parts)) == 0)
    found = (vectors.where(good).select(F.col(vec_id).alias("id"), size.alias("n"))
             .orderBy(F.asc_nulls_last("id"), "n").first())
    return found["n"] if found else 0


def fit_codebooks(vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS,
                  entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int | None = None) -> list[Codebook]:
    """The codebook of each part position: the parts of the smallest ids, moved in each
    round to the floor of the mean of the parts nearest to them.  Fewer vectors than
    entries give fewer entries, none give no codebooks.

    Each round is one pass; a task sums its own rows before anything is shuffled, and as
    many numbers as the codebooks hold reach the driver."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    width = width_of(vectors, vector=vector, vec_id=vec_id, parts=parts) if width is None else width
    kept = vectors.where(taking_part(F.col(vector), width)).select(
        F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    first = [[math.floor(v * scale) for v in r["x"]]
             for r in kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()] if width else []
    if not first:
        return []
    wide = width // parts
    books = [Codebook([v[p * wide:(p + 1) * wide] for v in first]) for p in range(parts)]
    for _ in range(rounds):
        sent = kept.sparkSession.sparkContext.broadcast(books)

        def run(batches, sent=sent):
            books = sent.value
            sums = np.zeros((parts, len(books[0].rows), wide), object)
            counts = np.zeros((parts, len(books[0].rows)), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = whole(_matrix(b.column(0)), books, scale)
                for p, book in enumerate(books):
                    mine = x[:, p * wide:(p + 1) * wide]
                    nearest, _ = book.nearest(mine)
                    for e in range(len(book.rows)):
                        rows = nearest == e
                        counts[p, e] += rows.sum()
                        sums[p, e] += np.array([int(v) for v in mine[rows].sum(axis=0)], object)
            p, e, k = np.meshgrid(*map(np.arange, sums.shape), indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.ravel().astype(np.int32)), pa.array(e.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)),
                 pa.array([decimal.Decimal(int(v)) for v in sums.ravel()], pa.decimal128(38, 0)),
                 pa.array(np.repeat(counts.ravel(), wide))], ["p", "e", "k", "s", "n"])

        found = (kept.select("x").mapInArrow(run, "p int, e int, k int, s decimal(38,0), n long")
                 .groupBy("p", "e", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())
        table = [[list(row) for row in book.rows] for book in books]
        for r in found:
            if r["n"]:
                table[r["p"]][r["e"]][r["k"]] = int(r["s"]) // r["n"]
        sent.unpersist()
        books = [Codebook(rows) for rows in table]
    return books


def books_sha256(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.rows for v in row).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[Codebook], *, vector: str = "embedding", scale: int = SCALE,
           out: str = "coded") -> DataFrame:
    """The rows of ``vectors`` that take part, with a struct ``out``: code (entry numbers,
    one byte each) and error (squared distances summed over the parts, null where that
    passes 64 bits).  Other rows are dropped; rows that repeat get equal codes.  An
    existing column ``out`` is replaced."""
    wide = len(books[0].rows[0]) if books else 0
    kept = vectors.where(taking_part(F.col(vector), wide * len(books)))
    if not books:
        return kept.limit(0).withColumn(out, F.lit(None).cast("struct<code:binary,error:bigint>"))
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<code:binary,error:bigint>")
    def code(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("code", pa.binary()), ("error", pa.int64())]))
        books = sent.value
        x = whole(_matrix(column), books, scale)
        found = [book.nearest(x[:, p * wide:(p + 1) * wide]) for p, book in enumerate(books)]
        numbers = np.stack([f[0] for f in found], 1).astype(np.uint8)
        error = [int(v) for v in sum(f[1] for f in found)]
        return pa.StructArray.from_arrays(
            [pa.array([row.tobytes() for row in numbers], pa.binary()),
             pa.array([v if v < 1 << 63 else None for v in error], pa.int64())], ["code", "error"])

    return kept.withColumn(out, code(F.col(vector).cast("array<double>")))


def decode(coded: DataFrame, books: list[Codebook], *, code: str = "coded.code", scale: int = SCALE,
           out: str = "approximate") -> DataFrame:
    """``coded`` with the vector that each code stands for (null for a null code)."""
    sent = coded.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("array<double>")
    def back(column: pa.Array) -> pa.Array:
        books = sent.value
        return pa.array([None if c is None else [v / scale for p, e in enumerate(c) for v in books[p].rows[e]]
                         for c in column.to_pylist()], pa.list_(pa.float64()))

    return coded.withColumn(out, back(F.col(code)))


def compress(vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
             parts: int = PARTS, **kwargs) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of all vectors that take part;
    label_error sums the errors of rows of one label, null labels together (null if one
    of them is).

    Vectors that are null or empty, hold null or non-finite components or one of LARGEST
    or more, or are not as long as that of the smallest id take no part.  A null id comes
    after all others; an empty table gives no rows.  Only the three named columns are
    read, so other names cannot clash."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("x"), F.col(label).alias("label"))
    books = fit_codebooks(rows, vector="x", vec_id="id", parts=parts, **kwargs)
    coded = encode(rows, books, vector="x", scale=kwargs.get("scale", SCALE))
    coded = coded.select("id", "label", F.lower(F.hex("coded.code")).alias("code"), F.col("coded.error").alias("error"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.try_sum(F.col("error"))).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))

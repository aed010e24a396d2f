"""Vector code compression: product quantization by active-entry Lloyd rounds on integers.

Vectors are scaled to integers and cut into equal parts; every part position has a codebook. A
round assigns each part to the nearest entry and replaces entries by the mean of their parts.

Beside the code, a row keeps the exact squared distance of each part to its entry. After an update
some entries are where they were. A part whose entry did not move keeps a true distance: it is
compared with the entries that moved only. A part whose entry moved is compared with all. Both give
what a full scan gives, ties to the lower index included, and late rounds touch few entries.

Each round writes the rows with codes and distances to the shared folder; the sums of a codebook are
added up inside each task, then by key. The driver sees codebooks only: entries x width numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Rows that are compared with a codebook at once.
ROWS = 4096
# Components beyond this, after scaling, would let sums of squares leave a long.
LARGEST = 1 << 24

STATE = "vec_id long, label {label}, v array<int>, code array<int>, distance array<long>"


class Codes(NamedTuple):
    """`rows`: vec_id, label, code, error. `codebooks`: integers of shape (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray


def whole(vector: Column | str) -> Column:
    """Whether a vector and all its components are there and finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component, of the rows that can be used."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    in_range = F.forall(vector, lambda x: F.abs(x.cast("double")) * scale < LARGEST)
    checked = F.when(in_range, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(
        f"a component is not within {LARGEST} after scaling")).cast("array<int>"))
    return vectors.where(whole(vector)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", checked.alias("v"))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row per row of x."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - entries[None, :, k]
        out += gap * gap
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry; of equally near ones the lowest."""
    far = _distances(x, entries)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code]


def renewed(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray,
            distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest`, from the last round's codes and distances and the entries that have moved."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    if lost.any():
        code[lost], distance[lost] = nearest(x[lost], entries)
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~lost)
    if len(active) and len(kept):
        far = _distances(x[kept], entries[active])
        best = far.argmin(axis=1)
        near, index = far[np.arange(len(kept)), best], active[best]
        better = (near < distance[kept]) | ((near == distance[kept]) & (index < code[kept]))
        code[kept[better]], distance[kept[better]] = index[better], near[better]
    return code, distance


def assigned(rows: DataFrame, codebooks: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with code and distance for these codebooks; `moved` None: without a last round."""
    parts = len(codebooks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                v = part.column(2).flatten().to_numpy().reshape(n, parts, -1).astype(np.int64)
                code, distance = np.empty((n, parts), np.int32), np.empty((n, parts), np.int64)
                if moved is not None:
                    old = [part.column(k).flatten().to_numpy().reshape(n, parts) for k in (3, 4)]
                for p in range(parts):
                    code[:, p], distance[:, p] = nearest(v[:, p], codebooks[p]) if moved is None else \
                        renewed(v[:, p], codebooks[p], moved[p], old[0][:, p], old[1][:, p])
                ends = np.arange(0, n * parts + 1, parts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.ListArray.from_arrays(ends, pa.array(code.ravel())),
                     pa.ListArray.from_arrays(ends, pa.array(distance.ravel()))],
                    names=["vec_id", "label", "v", "code", "distance"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, STATE.format(label=label))


def means(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks with each entry that has parts replaced by their mean, rounded down."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            v = batch.column(0).flatten().to_numpy().reshape(n * parts, width).astype(np.int64)
            code = batch.column(1).flatten().to_numpy().reshape(n, parts)
            entry = (code + np.arange(parts) * entries).ravel()
            order = np.argsort(entry, kind="stable")
            used, first = np.unique(entry[order], return_index=True)
            if n:
                total[used, :width] += np.add.reduceat(v[order], first, axis=0)
                total[used, width] += np.diff(np.r_[first, n * parts])
        used = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)),
             *[pa.array(total[used, k].copy()) for k in range(width + 1)]],
            names=["entry", *[f"s{k}" for k in range(width)], "n"])

    columns = [*[f"s{k}" for k in range(width)], "n"]
    sums = (state.select("v", "code")
            .mapInArrow(run, ", ".join(["entry int", *[f"{c} long" for c in columns]]))
            .groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns]))
    out = codebooks.reshape(parts * entries, width).copy()
    for row in sums.collect():  # at most parts x entries rows
        out[row.entry] = [row[f"s{k}"] // row.n for k in range(width)]
    return out.reshape(codebooks.shape)


def compressed(vectors: DataFrame, vector: str = "embedding", parts: int = 16, entries: int = 64,
               rounds: int = 2, scale: int = 256) -> Codes | None:
    """Codes of all usable rows, or None where there is none.

    Rows whose vector is null or holds a null or a value that is not finite are dropped. The first
    entries are the parts of the `entries` rows with the least vec_ids; equal vec_ids are ordered
    by their vectors and null ones come last. Entries that no part uses stay. With fewer rows there
    are fewer entries. All vectors must have one width, a multiple of `parts`.
    """
    found = integers(vectors, vector, scale)
    rows = written(found, "vectors")
    widths = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if not widths:
        return None
    if len(widths) > 1 or widths[0] % parts or not widths[0]:
        raise ValueError(f"vectors of width {widths} cannot be cut into {parts} equal parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = np.array([r.v for r in first], np.int64).reshape(
        len(first), parts, -1).transpose(1, 0, 2)
    state, moved = rows, None
    for k in range(rounds + 1):
        state = written(assigned(state, codebooks, moved), "codes")
        if k < rounds:
            new = means(state, codebooks)
            codebooks, moved = new, (new != codebooks).any(axis=2)
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, x: a + x)
    return Codes(state.select("vec_id", "label", "code", error.alias("error")), codebooks)


def codebook_text(codebooks: np.ndarray) -> str:
    """All components, by part, entry and place, joined by commas."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """One row per usable row: vec_id, label, code (hex), error, label_error, codebooks_sha256.

    `error` is the squared distance between the scaled vector and its code, `label_error` its sum
    over the rows of one label; rows without a label are one label. Null vec_ids stay null and
    repeated rows count and return each; an empty table gives no rows; other columns are ignored.
    """
    import hashlib

    found = compressed(vectors, **options)
    label = vectors.schema["label"].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id long, label {label}, code string, error long, label_error long, "
                "codebooks_sha256 string")
    digest = hashlib.sha256(codebook_text(found.codebooks).encode()).hexdigest()
    # Sums per label are combined before the shuffle; the join may split a very frequent label.
    by_label = found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", digits.alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"))

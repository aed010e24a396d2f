"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. A text is the set of its distinct word shingles. Equal sets are one class from there on. A class
   has `TREES` signatures of the last of `DEPTHS` MinHash values each, and a sketch of one bit of
   each of `FUNCTIONS` MinHash values.
2. A tree is the sorted order of its signatures; classes whose signatures share a prefix are
   neighbours there. Every class takes part at the least depth at which its region, the classes
   with the same prefix, has at most `region_limit` members: sparse regions compare after two
   values, dense ones after more. Within a region, pairs whose sizes and sketches allow the
   similarity are candidates; a region gives a spanning forest of them. A region that is still
   larger at the full depth is a candidate as a whole.
3. Components of candidates hold every pair that must be compared. Their full sets meet once, in
   cells of bounded size: a component is one cell, or is dealt into chunks and compared chunk by
   chunk. A cell counts intersections exactly and gives a spanning forest of the true links.
4. Components of the true links are the result.

A pair at the bound of 0.8 is missed by all trees with a probability of 0.36**16 after two values,
0.49**16 after three and 0.59**16 after four; beyond that depth most links of a dense region are
found through other members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, texts, written
from .components import connected

TREES = 16
DEPTHS = (2, 3, 4, 6, 8)
FUNCTIONS = 256
# Regions of at most so many members are looked over at once.
SMALL = 48
# Shingles that meet all MinHash functions at once.
STEP = 2048
# Sets of a cell's chunk: most members and most hashes (8 bytes each).
CHUNK_MEMBERS = 2048
CHUNK_HASHES = 2 << 20

SKETCH = [f"b{k}" for k in range(FUNCTIONS // 64)]
KEYS = [f"k{d}" for d in DEPTHS]
_FACTORS = np.random.default_rng(12).integers(0, 1 << 31, FUNCTIONS).astype(np.uint32) * 2 + 1


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words where there are fewer."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest, k = b" ".join(words), xxhash.xxh64_intdigest, min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    return np.unique(np.array(
        [digest(joined[a:b]) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each function over a set that is not empty."""
    low = hashes.astype(np.uint32)
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), STEP):
        np.minimum(out, (low[at:at + STEP, None] * _FACTORS).min(axis=0), out=out)
    return out


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n, node (64 bits of the set, null for an empty one), values (MinHash)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, nodes, values = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), shingle)
                n.append(len(found))
                nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))
                             if len(found) else None)
                values.append(min_hashes(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                 pa.array(nodes, pa.int64()), pa.array(values, pa.binary())],
                names=["doc_id", "text_key", "n", "node", "values"])

    return texts(docs).select("doc_id", text_key(), "text").mapInArrow(
        run, "doc_id long, text_key long, n long, node long, values binary")


def tree_rows(classes: DataFrame) -> DataFrame:
    """One row per class and tree: node, n, the sketch and a key of each prefix in DEPTHS."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, FUNCTIONS)
            sketch = np.packbits((_mixed(values) & np.uint32(1)).astype(np.uint8), axis=1,
                                 bitorder="little").view("<i8")
            for tree in range(TREES):
                part = values[:, tree * DEPTHS[-1]:(tree + 1) * DEPTHS[-1]].astype(np.uint64)
                key, keys = np.full(len(part), tree + 1, np.uint64), []
                for depth in range(1, DEPTHS[-1] + 1):
                    key = (key ^ part[:, depth - 1]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                    if depth in DEPTHS:
                        keys.append(pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(s.copy()) for s in sketch.T], *keys],
                    names=["node", "n", *SKETCH, *KEYS])

    return classes.select("node", "n", "values").mapInArrow(
        run, ", ".join(f"{c} long" for c in ["node", "n", *SKETCH, *KEYS]))


def runs_of(batches: Iterator, width: int) -> Iterator[list]:
    """Lists of columns of whole runs: rows that are equal in the first `width` columns."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy() for c in batch.columns[:width]], axis=1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if held and (keys[0] != held[0]).any():
            yield [pa.concat_arrays(c) for c in zip(*held[1])]
            held = []
        if len(new):
            cut = int(new[-1])
            before = held[1] if held else []
            yield [pa.concat_arrays(c) for c in zip(*before, batch.slice(0, cut).columns)]
            held = [keys[-1], [batch.slice(cut).columns]]
        elif held:
            held[1].append(batch.columns)
        else:
            held = [keys[-1], [batch.columns]]
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held[1])]


def spanning(m: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect 0 .. m-1 as all true pairs do; `linked(i, js)` tells which js i is linked to.

    Only members that are not yet connected to i are asked for.
    """
    root, out = np.arange(m), []
    for i in range(m - 1):
        others = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
        if not len(others):
            continue
        found = others[linked(i, others)]
        if len(found):
            roots = np.unique(np.r_[root[i], root[found]])
            out += [(int(r), int(roots[0])) for r in roots[1:]]
            root[np.isin(root, roots)] = roots[0]
    return out


def most_differing(percent: int) -> int:
    """Sketch bits in which sets of this similarity differ at most, but for one pair of 10**7."""
    share = (1 - percent / 100) / 2
    return int(FUNCTIONS * share + 6.5 * (FUNCTIONS * share * (1 - share)) ** 0.5)


def placed(trees: DataFrame, hot_region: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with `place`, whose rows meet in one task, and the links of what is too dense for it.

    Rows meet by their prefix of the least depth; those of a prefix that more than `hot_region`
    share, by their full prefix. Where that is shared by more still, each is linked to the least.
    """
    first, full = KEYS[0], KEYS[-1]
    sizes = written(trees.groupBy(first).count().where(F.col("count") > hot_region).select(first), "hot")
    if sizes.isEmpty():
        return trees.withColumn("place", F.col(first)), None
    cool = trees.join(sizes, first, "left_anti").withColumn("place", F.col(first))
    hot = trees.join(sizes, first, "left_semi")
    dense = written(hot.groupBy(full).agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("v"))
                    .where(F.col("count") > hot_region).select(full, "v"), "dense")
    links = hot.join(dense, full).select(F.col("node").alias("u"), "v")
    split = hot.join(dense, full, "left_anti").withColumn("place", F.col(full))
    return cool.unionByName(split), links


def candidates(trees: DataFrame, percent: int, region_limit: int, hot_region: int) -> DataFrame:
    """(u, v): links that connect all pairs of classes of which some tree makes a candidate."""
    differing = most_differing(percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for columns in runs_of(batches, 1):
            place, node, n = (c.to_numpy() for c in columns[:3])
            sketch = np.stack([c.to_numpy().view(np.uint64) for c in columns[3:3 + len(SKETCH)]], axis=1)
            keys = [c.to_numpy() for c in columns[3 + len(SKETCH):]]
            out = []

            def allowed(i, js):
                gap = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=-1)
                near = 100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js])
                return near & (gap <= differing)

            def runs(column, lo, hi):
                cuts = np.flatnonzero(column[lo + 1:hi] != column[lo:hi - 1]) + lo + 1
                return zip([lo, *cuts.tolist()], [*cuts.tolist(), hi])

            def region(lo, hi, depth):
                """Links within the rows lo to hi, which share their prefix of KEYS[depth]."""
                size = hi - lo
                if size > region_limit and depth + 1 < len(KEYS):
                    for a, b in runs(keys[depth + 1], lo, hi):
                        if b - a > 1:
                            region(a, b, depth + 1)
                    return
                if size > region_limit:
                    out.append(np.stack([node[lo + 1:hi], np.full(size - 1, node[lo])], axis=1))
                    return
                if size <= SMALL:
                    one, other = np.triu_indices(size, 1)
                    if not allowed(lo + one, lo + other).any():
                        return
                pairs = spanning(size, lambda i, js: allowed(lo + i, lo + js))
                if pairs:
                    out.append(node[lo + np.array(pairs)])

            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            sizes = np.diff(np.r_[starts, len(place)])
            two = starts[sizes == 2]
            two = two[allowed(two, two + 1)] if len(two) else two
            out.append(np.stack([node[two], node[two + 1]], axis=1))
            for lo, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                region(lo, lo + size, 0)
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    rows, links = placed(trees, hot_region)
    found = (rows.select("place", "node", "n", *SKETCH, *KEYS).repartition("place")
             .sortWithinPartitions("place", *KEYS).mapInArrow(run, "u long, v long"))
    return found if links is None else found.unionByName(links)


def dealt(classes: DataFrame, near: DataFrame) -> DataFrame:
    """rep_id, rep_key, node, root, chunk, chunks: where a class of a candidate component goes."""
    inside = classes.select("node", "n", "rep").join(near, "node")
    totals = inside.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("hashes") / CHUNK_HASHES))
    return inside.join(totals.select("root", chunks.cast("int").alias("chunks")), "root").select(
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "node", "root",
        F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "chunks")


def full_sets(docs: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """node, root, chunk, chunks, hashes: the shingle set of one text of each placed class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = set()  # rows that repeat a document give its set once in a task
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            take = [k for k, node in enumerate(nodes) if not (node in seen or seen.add(node))]
            for at in range(0, len(take), 1000):
                part = batch.take(pa.array(take[at:at + 1000]))
                sets = [shingle_set(t.as_py(), shingle).tobytes() for t in part.column(4)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(sets, pa.binary())],
                    names=["node", "root", "chunk", "chunks", "hashes"])

    rows = texts(docs).select("doc_id", text_key(), "text")
    # Sorted and merged at every size: places grow with the documents.
    held = rows.join(places.hint("merge"), (rows.text_key == places.rep_key) & rows.doc_id.eqNullSafe(places.rep_id))
    return held.select("node", "root", "chunk", "chunks", "text").mapInArrow(
        run, "node long, root long, chunk int, chunks int, hashes binary")


def _true_links(sets: list[np.ndarray], side: np.ndarray, crossing: bool, percent: int) -> list:
    """Spanning forest of the pairs of sets that are similar; `crossing`: of pairs of both sides."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, np.int64)

    def linked(i, js):
        near = 100 * np.minimum(sizes[i], sizes[js]) >= percent * np.maximum(sizes[i], sizes[js])
        if crossing:
            near &= side[js] != side[i]
        out, asked = np.zeros(len(js), bool), np.flatnonzero(near)
        if not len(asked):
            return out
        own = ids[starts[i]:ends[i]]
        mark[own] = 1
        j = js[asked]
        if 4 * len(j) > len(sets) - j[0]:  # most of what follows: one sweep
            tail = starts[j[0]:]
            both = np.add.reduceat(mark[ids[tail[0]:]], tail - tail[0])[j - j[0]]
        else:
            both = np.array([mark[ids[a:b]].sum() for a, b in zip(starts[j], ends[j])])
        mark[own] = 0
        out[asked] = 100 * both >= percent * (sizes[i] + sizes[j] - both)
        return out

    return spanning(len(sets), linked)


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect the classes as all pairs of sufficient similarity do."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for columns in runs_of(batches, 3):
            cells = np.stack([c.to_numpy() for c in columns[:3]], axis=1)
            nodes, chunk, hashes = columns[3].to_numpy(), columns[4].to_numpy(), columns[5]
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
            u, v = [], []
            for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(cells)].tolist()):
                _, at = np.unique(nodes[lo:hi], return_index=True)  # repeated rows of other tasks
                at = at + lo
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(hashes[int(k)].as_buffer(), np.uint64) for k in at]
                pairs = _true_links(sets, chunk[at], cells[lo, 1] != cells[lo, 2], percent)
                if pairs:
                    ends = nodes[at][np.array(pairs)]
                    u.append(ends[:, 0])
                    v.append(ends[:, 1])
            if u:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"),
        "node", "chunk", "hashes")
    return cells.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(
        run, "u long, v long")


def minhash_groups(docs: DataFrame, shingle: int = 5, percent: int = 80,
                   region_limit: int = 1024, hot_region: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of distinct shingles is `percent`
    of 100 or more. `component_id` is the least doc_id that links reach; `kept` tells whether it is
    the document's own. Letters A to Z count as lower case, nothing else is changed. A null text is
    empty; texts without words are linked with nothing, themselves included. Null doc_ids take part
    in links, and only components of nothing else have a null id; rows that repeat a doc_id and a
    text return each, alike; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    rows = written(prints(docs, shingle), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = written(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.min(place).alias("rep"), F.first("values").alias("values")), "classes")
    trees = written(tree_rows(classes), "trees")
    near = connected(candidates(trees, percent, region_limit, hot_region))
    sets = full_sets(docs, written(dealt(classes, near), "places"), shingle)
    roots = connected(confirmed(sets, percent))
    named = classes.join(roots, "node", "left").select(
        "node", F.col("rep.doc_id").alias("least"), F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(groups, "root").select(F.col("node").alias("of"), "component_id")
    out = rows.join(of_node.hint("merge"), rows.node == of_node.of, "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"),
                      component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))

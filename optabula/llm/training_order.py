"""Training order: token sequences in a keyed random order, in files of fixed-stride records.

1. A first pass tokenizes every text once; Spark keeps the ids, two bytes each, in executor memory
   and on executor disks beyond it, and a lost part is tokenized again from the table. The same pass
   counts the sequences of every split of the table. Splits are numbered by their least
   doc_id, rows within a split by their order in it: every sequence has an index, gapless from 0.
   For a table whose files follow the doc_id, indices do not depend on where splits are cut.
2. A keyed Feistel permutation of the indices, with cycle-walking for sizes that are no power of
   four, gives each sequence its slot. The slot fixes the shard and the record in it: shard
   `slot // shard_records`, record `slot % shard_records`.
3. One shuffle by shard moves the ids; each shard is sorted by slot and written as one file of
   records of one size.

Reading from slot s on needs no index: the file's number gives its first slot, the stride the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optabula.cluster import shared_path

from .common import texts
from .tokens import default_path, tokenizer

ROUNDS = 6
# Ends every record: eight bytes that let a reader notice a shifted or torn file.
RECORD_END = "\x1eSEQEND\n"
# Marks a record whose doc_id is null.
NULL_ID = 1
# Records that leave a task at once, and bytes of ids that do after tokenizing (one text at least).
BATCH_RECORDS = 1024
BATCH_BYTES = 1 << 20
# The last id that a record of two bytes an id can hold.
LAST_TOKEN = (1 << 16) - 1
SEQUENCES = "slot long, doc_id long, piece int, n_tokens int, ids array<int>"


def record_body(length: int) -> np.dtype:
    """A record without its end mark."""
    return np.dtype([("doc_id", "<i8"), ("slot", "<i8"), ("piece", "<u4"), ("flags", "<u2"),
                     ("n_tokens", "<u2"), ("ids", "<u2", (length,))])


def record_type(length: int) -> np.dtype:
    return np.dtype([*record_body(length).descr, ("end", f"S{len(RECORD_END)}")])


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: 64-bit multiply and shift mixing of the half and the round's key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slot of each index: a keyed bijection of 0 .. size-1.

    A balanced Feistel network permutes the next power of four, which is less than four times
    `size` large; what leaves the space is put through it again until it comes back, which it does
    as its cycle holds the index it came from.
    """
    out = np.asarray(index).astype(np.uint64)
    if len(out) and not 0 <= int(np.min(index)) <= int(np.max(index)) < size:
        raise ValueError(f"an index is outside the {size} sequences")
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, int(k)) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= size]
    return out.astype(np.int64)


def _splits(docs: DataFrame) -> DataFrame:
    """doc_id, text and `split`, a number of the scan's partition and of the file range in it."""
    return texts(docs).select("doc_id", "text", F.xxhash64(
        F.spark_partition_id(), F.input_file_name(), F.input_file_block_start()).alias("split"))


def _tokenized(docs: DataFrame, source: str, length: int, end_id: int) -> DataFrame:
    """split, doc_id, n, ids: a text's ids and the end id, two bytes each, and its sequences."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of, end = tokenizer(source).encode, end_id.to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held)])
            return pa.RecordBatch.from_arrays(
                [pa.array(splits, pa.int64()), pa.array(doc_ids, pa.int64()),
                 pa.array(-(-np.diff(ends) // (2 * length))), pa.array(held, pa.binary())],
                names=["split", "doc_id", "n", "ids"])

        splits, doc_ids, held, size = [], [], [], 0
        for batch in batches:
            for doc_id, text, split in zip(*batch.columns):
                tokens = np.frombuffer(ids_of(text.as_py()) + end, "<u4")
                if int(tokens.max()) > LAST_TOKEN:
                    raise ValueError(f"the id {tokens.max()} does not fit two bytes")
                splits.append(split.as_py())
                doc_ids.append(doc_id.as_py())
                held.append(tokens.astype("<u2").tobytes())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield flush()
                    splits, doc_ids, held, size = [], [], [], 0
        if held:
            yield flush()

    return _splits(docs).mapInArrow(encode, "split long, doc_id long, n long, ids binary")


def write_in_training_order(
    docs: DataFrame, path: str, key: int = 20_240_229, length: int = 256,
    shard_records: int = 32_768, tokenizer_path: str | None = None, end_id: int = 1,
) -> None:
    """Tokenizes `docs`, cuts each document into sequences of `length` ids and writes them to `path`.

    `docs` must be a table or a checkpoint: what is lost is read from it again, in the same order. The
    order is fixed by `key` and by the order of its rows (see above). Every file but the last holds `shard_records` records. A null
    text is empty and gives one sequence, the end id; null doc_ids are marked in the record;
    repeated rows give sequences each; an empty table gives no files; other columns are ignored.
    Ids of 65,536 and more raise an error. Lost tasks write again: files appear when the job commits.
    """
    if length < 1 or shard_records < 1 or not 0 <= end_id <= LAST_TOKEN:
        raise ValueError("length and shard_records are above 0, end_id fits two bytes")
    rows = _tokenized(docs, tokenizer_path or default_path(), length, end_id).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        _write_tokenized(rows, path, key, length, shard_records)
    finally:
        rows.unpersist()


def _write_tokenized(rows: DataFrame, path: str, key: int, length: int, shard_records: int) -> None:
    # One row per split of the scan reaches the driver.
    splits = sorted(rows.groupBy("split").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"))
                    .collect(), key=lambda r: (r.least is None, r.least or 0, r.split))
    firsts, size = {}, 0
    for r in splits:
        firsts[r.split], size = (size, size + r.n), size + r.n
    if not size:
        return
    body = record_body(length)

    def sequences(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = {}
        held = np.zeros(BATCH_RECORDS, body)
        ids = np.zeros((BATCH_RECORDS, length), np.uint16)
        index, n = np.zeros(BATCH_RECORDS, np.int64), 0

        def flush() -> pa.RecordBatch:
            records = held[:n].copy()
            records["ids"] = ids[:n]
            records["slot"] = permuted(index[:n], size, key)
            ends = np.arange(0, (n + 1) * body.itemsize, body.itemsize, dtype=np.int32)
            slot = records["slot"].copy()
            return pa.RecordBatch.from_arrays(
                [pa.array((slot // shard_records).astype(np.int32)), pa.array(slot),
                 pa.Array.from_buffers(pa.binary(), n, [
                     None, pa.py_buffer(ends), pa.py_buffer(records.view(np.uint8))])],
                names=["shard", "slot", "record"])

        for batch in batches:
            for split, doc_id, pieces, tokens in zip(*batch.columns):
                split, doc_id, pieces = split.as_py(), doc_id.as_py(), pieces.as_py()
                tokens, first = np.frombuffer(tokens.as_buffer(), "<u2"), at.get(split)
                first = firsts[split][0] if first is None else first
                at[split] = first + pieces
                if at[split] > firsts[split][1]:
                    raise ValueError("a split gives more sequences than it was counted with")
                done = 0
                while done < pieces:
                    take = min(pieces - done, BATCH_RECORDS - n)
                    part = tokens[done * length:(done + take) * length]
                    flat = ids[n:n + take].reshape(-1)
                    flat[:len(part)], flat[len(part):] = part, 0
                    rows = held[n:n + take]
                    rows["doc_id"], rows["flags"] = doc_id or 0, NULL_ID if doc_id is None else 0
                    rows["piece"] = np.arange(done, done + take)
                    rows["n_tokens"] = length
                    rows["n_tokens"][-1] = len(part) - (take - 1) * length
                    index[n:n + take] = np.arange(first + done, first + done + take)
                    done, n = done + take, n + take
                    if n == BATCH_RECORDS:
                        yield flush()
                        n = 0
        if n:
            yield flush()

    shards = -(-size // shard_records)
    (rows.mapInArrow(sequences, "shard int, slot long, record binary")
     .repartitionById(shards, "shard").sortWithinPartitions("slot")
     # Bytes go out as they are: the text writer copies them and adds the record's end.
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", RECORD_END).text(path))


def manifest(spark: SparkSession, path: str, length: int = 256,
             shard_records: int = 32_768) -> DataFrame:
    """One row per file: path, shard, records, first_slot. File contents are not read.

    An empty folder gives no rows; a file's shard is the number in its name.
    """
    stride = record_type(length).itemsize
    shard = F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("long")
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where("length > 0")
            .select("path", shard.alias("shard"), F.expr(f"length div {stride}").alias("records"))
            .withColumn("first_slot", F.col("shard") * shard_records))


def read_training_order(spark: SparkSession, path: str, from_slot: int = 0, length: int = 256,
                        shard_records: int = 32_768) -> DataFrame:
    """The sequences from `from_slot` on: slot, doc_id, piece, n_tokens, ids.

    Files before `from_slot` are left out by their number; the file that holds it is read and its
    earlier records are passed over. A `from_slot` beyond the last gives no rows. A record without
    its end mark, or whose slot is not the one its place says, raises an error.
    """
    files = manifest(spark, path, length, shard_records).where(
        f"first_slot + records > {from_slot}").select("path").collect()
    if not files:
        return spark.createDataFrame([], SEQUENCES)
    dtype = record_type(length)

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, shard, content in zip(*batch.columns):
                first = shard.as_py() * shard_records
                records = np.frombuffer(content.as_buffer(), dtype)
                slots = np.arange(first, first + len(records))
                if not (records["end"] == RECORD_END.encode()).all() or (records["slot"] != slots).any():
                    raise ValueError(f"{name.as_py()} is torn: a record is not at its place")
                for lo in range(max(0, from_slot - first), len(records), BATCH_RECORDS):
                    part = records[lo:lo + BATCH_RECORDS]
                    n = part["n_tokens"].astype(int)
                    held = part["ids"][np.arange(length) < n[:, None]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[lo:lo + BATCH_RECORDS]),
                         pa.array(part["doc_id"], mask=part["flags"] & NULL_ID != 0),
                         pa.array(part["piece"].astype("i4")), pa.array(n.astype("i4")),
                         pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype("i4"),
                                                  pa.array(held.astype("i4")))],
                        names=["slot", "doc_id", "piece", "n_tokens", "ids"])

    shard = F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("long")
    return (spark.read.format("binaryFile").load([f.path for f in files])
            .select("path", shard.alias("shard"), "content").mapInArrow(parse, SEQUENCES))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Writes `docs` in training order to the shared folder and gives the records read back.

    Nulls, repeated rows and other columns as in `write_in_training_order`; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "training-order")
    write_in_training_order(docs, path, **options)
    layout = {k: v for k, v in options.items() if k in ("length", "shard_records")}
    return read_training_order(spark, path, **layout) if _exists(spark, path) else \
        spark.createDataFrame([], SEQUENCES)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)

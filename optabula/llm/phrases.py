"""Substring dedup: recurring phrases, located by sharded Aho-Corasick automata.

1. Every window of `window` words holds the `PHRASE` words that hash least in it. Equal windows hold
   equal phrases, so a window can recur only if its least phrase does. One pass over all texts gives
   the least phrases (about one in twenty words) with their texts; grouping by these confirms those
   of two different texts or more and gives their shards. Where a phrase stands is not kept.
2. Documents are dealt to shards of about `shard_bytes` of text. A shard gets the confirmed phrases
   of its documents, compiles their texts into one automaton and streams all its documents through
   it. The automaton alone tells where phrases occur. A phrase goes to the shards that need it, so
   automata stay small and every text is streamed once, however many phrases the corpus repeats.
3. Of the windows around the occurrences, those whose least phrase is confirmed are hashed with 128
   bits; grouping gives the least doc_id in which each word sequence starts. Words of windows that
   start in a smaller doc_id are removed.

Equal texts are one document up to the end: all but the first lose every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, texts, written

PHRASE = 10
# Words whose windows are hashed at once in a long text.
CHUNK = 100_000
LAST_ID = (1 << 63) - 1  # the place of null doc_ids: after all others

STATE = ("doc_id long, text_key long, n_words long, sha256 string, copy boolean, words binary, "
         "starts array<int>, h1 array<long>, h2 array<long>")
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest chunk so far."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def phrase_hashes(words: list[bytes], size: int = PHRASE) -> np.ndarray:
    """A mixed 64-bit hash of each run of `size` words joined by spaces."""
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, np.uint64),
                     np.cumsum((data + np.uint64(1)) * _powers(BASE, len(data)))]
        lo, hi = starts[:len(words) - size + 1], ends[size - 1:]
        h = (sums[hi] - sums[lo]) * _powers(INVERSE, len(data) + 1)[lo]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        h, reach = np.minimum(h[:-step], h[step:]), reach + step
    return h


def least_phrases(words: list[bytes], window: int) -> dict[tuple[int, str], str]:
    """The distinct phrases that hash least in some window, by hash and text: hashes may collide."""
    found = {}
    for at in range(0, len(words) - window + 1, CHUNK):
        h = phrase_hashes(words[at:at + CHUNK + window - 1])
        least = sliding_least(h, window - PHRASE + 1)
        least = least[np.r_[True, least[1:] != least[:-1]]]
        places = np.flatnonzero(np.isin(h, least))
        for p, x in zip(places.tolist(), h[places].view(np.int64).tolist()):
            phrase = b" ".join(words[at + p:at + p + PHRASE]).decode()
            found[x, phrase] = phrase
    return found


def phrases(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """(words, shard, md5): the least phrases of every document, with the digest of its text."""

    def select(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [least_phrases(t.as_py().encode().split(), window) for t in batch.column(2)]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            if len(owner):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for f in found for w in f.values()], pa.string()),
                     *[c.take(pa.array(owner)) for c in batch.columns[:2]]],
                    names=["words", "shard", "md5"])

    return sharded(docs, shards).select("shard", F.unhex(F.md5("text")).alias("md5"), "text").mapInArrow(
        select, "words string, shard int, md5 binary")


def confirmed(found: DataFrame) -> DataFrame:
    """(shard, words): the phrases of two different texts or more, once for every shard that has them.

    The words move in this one grouping only; equal texts, of one digest, confirm nothing.
    """
    return found.groupBy("words").agg(
        F.min("md5").alias("a"), F.max("md5").alias("b"), F.collect_set("shard").alias("shards")).where(
        "a < b").select(F.explode("shards").alias("shard"), "words")


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int")
    return texts(docs).select("doc_id", text_key(), "text").select(
        shard.alias("shard"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text_key", "text")


def _locate(docs: list[tuple], phrases: set[str], window: int) -> dict[tuple, np.ndarray]:
    """Starts of the windows to be hashed: those that hold an occurrence the automaton finds."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(f" {phrase} ")
    automaton.make_automaton()
    found = {}
    for key, words in docs:
        n = len(words)
        if n < window:
            continue
        text = b" ".join(words).decode()
        ends = [e for e, _ in automaton.iter(f" {text} ")]
        if not ends:
            continue
        after = np.cumsum([len(w) + 1 for w in text.split(" ")])
        first = np.searchsorted(after, ends) - (PHRASE - 1)
        edge = np.zeros(n + 1, np.int64)  # +1 where starts begin, -1 behind their last
        np.add.at(edge, np.maximum(first - (window - PHRASE), 0), 1)
        np.add.at(edge, np.minimum(first, n - window) + 1, -1)
        found[key] = np.flatnonzero(np.cumsum(edge)[:n - window + 1] > 0)
    return found


def led(words: list[bytes], starts: np.ndarray, least_of: np.ndarray, window: int) -> np.ndarray:
    """The starts of windows whose least phrase is one of `least_of`, hashes of confirmed phrases."""
    kept = []
    for at in range(0, len(words) - window + 1, CHUNK):
        here = starts[(starts >= at) & (starts < at + CHUNK)]
        if len(here):
            least = sliding_least(phrase_hashes(words[at:at + CHUNK + window - 1]), window - PHRASE + 1)
            kept.append(here[np.isin(least[here - at], least_of)])
    return np.concatenate(kept) if kept else starts


def shard_windows(window: int):
    """Cogrouped function: a shard's documents and its phrases -> STATE."""

    def run(_, docs, hits):
        import hashlib

        import pyarrow as pa
        import xxhash

        keys = list(zip(docs["doc_id"].to_pylist(), docs["text_key"].to_pylist()))
        words = [t.as_py().encode().split() for t in docs["text"]]
        of = list(zip(hits["doc_id"].to_pylist(), hits["text_key"].to_pylist()))
        wanted = hits["words"].to_pylist()
        copies = {key for key, phrase in zip(of, wanted) if phrase is None}
        confirmed = {phrase for phrase in wanted if phrase is not None}
        unique = {k: w for k, w in zip(keys, words) if k not in copies}
        starts = _locate(list(unique.items()), confirmed, window) if confirmed else {}
        hashes = np.array([phrase_hashes(p.encode().split())[0] for p in confirmed], np.uint64)
        starts = {key: led(unique[key], at, hashes, window) for key, at in starts.items()}
        rows = []
        for key, own in zip(keys, words):
            joined = b" ".join(own)
            row = [*key, len(own), hashlib.sha256(joined).hexdigest(), key in copies]
            at = starts.get(key)
            if at is None or not len(at):
                rows.append((*row, None, None, None, None))
                continue
            end = np.cumsum([len(w) + 1 for w in own]) - 1
            begin = np.r_[0, end[:-1] + 1]
            digests = np.frombuffer(b"".join([
                xxhash.xxh3_128_digest(joined[a:b])
                for a, b in zip(begin[at].tolist(), end[at + window - 1].tolist())]), "<i8")
            rows.append((*row, joined, at.astype(np.int32), digests[::2], digests[1::2]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(),
                 pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "text_key", "n_words", "sha256", "copy", "words", "starts", "h1", "h2"]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def cut(window: int):
    """Arrow function: state and flagged starts -> the result rows with removed spans."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, removed, sha, spans = r["n_words"], 0, r["sha256"], []
                if r["copy"] and n >= window:
                    removed, sha, spans = n, nothing, [(0, n)]
                elif r["flagged"]:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.array(r["flagged"])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    kept = [w for w, g in zip(r["words"].split(b" "), gone.tolist()) if not g]
                    removed, sha = n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
                    turn = np.flatnonzero(np.diff(np.r_[0, gone, 0])).tolist()
                    spans = list(zip(turn[::2], turn[1::2]))
                rows.append((None if r["doc_id"] == LAST_ID else r["doc_id"], r["text_key"], n,
                             removed, sha, [{"start": a, "end": b} for a, b in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            names = ["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "removed"]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, shard_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_removed, kept_sha256, removed spans.

    Words are split at blanks, tabs and line ends and never changed. A word goes if a window that
    covers it starts, with the same words, in a document with a smaller doc_id. Null doc_ids come
    after all others and are not smaller than each other; a null text has no words; rows that repeat
    doc_id and text are one document and return each; an empty table gives no rows; other columns
    are ignored. `removed` holds word positions, start inclusive and end exclusive.
    """
    if window < PHRASE:
        raise ValueError(f"windows of under {PHRASE} words hold no phrase")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keyed = sharded(docs, shards)
    digest = keyed.select("shard", "doc_id", "text_key", F.md5("text").alias("md5"))
    firsts = digest.groupBy("md5").agg(F.min("doc_id").alias("first_id"))
    copies = written(digest.join(firsts, "md5").where("doc_id > first_id")
                     .select("shard", "doc_id", "text_key").distinct(), "copies")
    # Each shard gets a phrase once, not once a document, be it from a copy: copies are not searched.
    hits = confirmed(phrases(docs, window, shards)).select(
        "shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_key"),
        "words").unionByName(copies.withColumn("words", F.lit(None).cast("string")))
    state = written(keyed.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(
        shard_windows(window), STATE), "state")
    windows = state.where("starts IS NOT NULL").select(
        "doc_id", "text_key", F.inline(F.arrays_zip("starts", "h1", "h2")))
    # Written, so that the join reads two plain exchanges and can split a very frequent window.
    seen = written(windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "windows")
    flagged = windows.join(seen, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id", "text_key").agg(
        F.collect_set("starts").alias("flagged"))
    return state.drop("starts", "h1", "h2").join(flagged, ["doc_id", "text_key"], "left").mapInArrow(
        cut(window), "doc_id long, text_key long, n_words long, n_removed long, "
        "kept_sha256 string, removed array<struct<start: long, end: long>>")

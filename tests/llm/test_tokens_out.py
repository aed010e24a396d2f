"""Packing and training order against direct tokenization and simple planning."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from optabula.llm.packing import pack, plan_bins
from optabula.llm.tokens import WordTokenizer, default_path
from optabula.llm.training_order import (
    manifest,
    permuted,
    read_training_order,
    training_order,
    write_in_training_order,
)

from .cases import documents, frame

PLAIN = Tokenizer.from_file(default_path())
CACHED = WordTokenizer(default_path())


def direct(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(
    st.characters(codec="utf-8"), st.sampled_from("abzÀÉßÿ'sdtrevml <|>*_\t\n0123 ́ "))))
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(CACHED.encode(text), "<u4").tolist() == direct(text)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1))
def test_plan_places_every_length_in_gapless_bins(histogram):
    bins, placed = {}, dict.fromkeys(histogram, 0)
    plan = plan_bins(histogram, 50)
    for length, lo, hi, first, offset, per in plan:
        assert placed[length] == lo
        placed[length] = hi
        for r in range(hi - lo):
            bins.setdefault(first + r // per, []).append((offset + r % per * length, length))
    assert placed == histogram and sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 50
    lengths = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)
    rooms = []  # best fit, longest first, one by one
    for x in lengths:
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(50 - x)
    assert len(bins) == len(rooms)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(3)
    few = {rng.randint(1, 4096): rng.randint(1, 50) for _ in range(900)}
    many = {k: v * 100_000 for k, v in few.items()}
    assert len(plan_bins(many, 4096)) < 3 * 4096


def test_pack_equals_brute_force(spark):
    rows = documents()
    found = [r.asDict() for r in pack(frame(spark, rows), capacity=256).collect()]
    want = []
    for doc_id, text in rows:
        ids = direct(text) + [1]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, [tuple(r[k] for k in key) for r in found])) == sorted(map(repr, want))
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 256
    assert pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_keyed_bijection(size):
    one, two = permuted(np.arange(size), size, 7), permuted(np.arange(size), size, 8)
    assert sorted(one.tolist()) == list(range(size))
    if size >= 64:
        assert (one != two).any() and (one != np.arange(size)).any()


def test_indices_outside_the_space_are_refused():
    for index in ([-1], [0, 16]):
        with pytest.raises(ValueError, match="outside"):
            permuted(np.array(index), 16, 8)
    assert permuted(np.zeros(0, np.int64), 0, 8).tolist() == []


def sequences_of(rows, length):
    out = []
    for doc_id, text in rows:
        ids = direct(text) + [1]
        out += [(doc_id, p, ids[at:at + length]) for p, at in enumerate(range(0, len(ids), length))]
    return out


# Texts of two- and four-byte characters that give more ids than bytes.
DENSE = [(500 + k, "\u0344" * 1000) for k in range(10)] + [(520, "\U0001d160" * 100), (521, "a " * 40_000)]


def test_training_order_reads_back_every_sequence(spark, tmp_path):
    rows = documents() + DENSE
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, out = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "out")
    layout = {"length": 64, "shard_records": 100}
    write_in_training_order(docs, out, key=5, **layout)
    found = [r.asDict() for r in read_training_order(spark, out, **layout).collect()]
    want = sequences_of(rows, 64)
    assert sorted(r["slot"] for r in found) == list(range(len(want)))
    assert sorted(repr((r["doc_id"], r["piece"], r["ids"])) for r in found) == sorted(map(repr, want))
    files = {r.shard: (r.records, r.first_slot) for r in manifest(spark, out, **layout).collect()}
    assert files == {k: (min(100, len(want) - 100 * k), 100 * k) for k in range(-(-len(want) // 100))}
    by_slot = {r["slot"]: r for r in found}
    rest = read_training_order(spark, out, from_slot=150, **layout).collect()
    assert {r.slot: r.asDict() for r in rest} == {s: r for s, r in by_slot.items() if s >= 150}
    assert read_training_order(spark, out, from_slot=len(want), **layout).count() == 0
    with pytest.raises(Exception, match="not at its place"):
        read_training_order(spark, out, length=64, shard_records=99).collect()
    order = [by_slot[s]["doc_id"] for s in range(len(want))]
    assert order != sorted(order, key=lambda x: (x is None, x))
    again, other = str(tmp_path / "again"), str(tmp_path / "other")
    write_in_training_order(docs, again, key=5, **layout)
    write_in_training_order(docs, other, key=6, **layout)
    assert sorted(map(str, read_training_order(spark, again, **layout).collect())) == sorted(
        str(r) for r in read_training_order(spark, out, **layout).collect())
    assert {r.slot: r.ids for r in read_training_order(spark, other, **layout).collect()} != {
        s: r["ids"] for s, r in by_slot.items()}
    assert training_order(frame(spark, [])).count() == 0


def test_slots_are_the_permuted_numbers_of_the_sequences_for_any_split(spark, tmp_path):
    rows = sorted((r for r in dict(documents()).items() if r[0] is not None), key=lambda r: r[0]) + DENSE
    want = sequences_of(rows, 32)
    slots = permuted(np.arange(len(want)), len(want), 9).tolist()
    for files in (1, 4):
        path = str(tmp_path / f"docs{files}")
        table = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(files, "doc_id")
        table.sortWithinPartitions("doc_id").write.parquet(path)
        got = training_order(spark.read.parquet(path), key=9, length=32, shard_records=50).collect()
        assert {r.slot: (r.doc_id, r.piece, r.ids) for r in got} == dict(zip(slots, want))


def test_ids_that_do_not_fit_two_bytes_are_refused(spark, tmp_path):
    from tokenizers import pre_tokenizers
    from tokenizers.models import WordLevel

    large = Tokenizer(WordLevel({"[UNK]": 0, "a": 70_000}, unk_token="[UNK]"))
    large.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    large.save(str(tmp_path / "large.json"))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "b a b")], "doc_id long, text string").write.parquet(path)
    with pytest.raises(Exception, match="70000 does not fit"):
        write_in_training_order(spark.read.parquet(path), str(tmp_path / "out"),
                                tokenizer_path=str(tmp_path / "large.json"))
    with pytest.raises(ValueError):
        write_in_training_order(spark.read.parquet(path), str(tmp_path / "out"), end_id=1 << 16)

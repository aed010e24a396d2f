"""Vector codes, LSH forest and fill-in-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from optabula.llm import lsh_forest
from optabula.llm.boundaries import ArrayContainer, BitmapContainer, BoundarySet, RunContainer
from optabula.llm.fill_middle import Rates, fill_in_middle, restored, word_ends
from optabula.llm.lsh_forest import minhash_groups, spanning
from optabula.llm.vector_codes import compressed, nearest, renewed, vector_codes

from .cases import CLASHES, documents, frame, words_of
from .test_dedup import LAST, brute_components, place

# --- fill-in-middle


@pytest.mark.parametrize("offsets, kind", [
    (list(range(3, 9000, 7)), ArrayContainer), (list(range(0, 65000, 3)), BitmapContainer),
    ([*range(5, 30000), *range(31000, 65536)], RunContainer)])
def test_containers_select_every_member(offsets, kind):
    held = BoundarySet(np.array(offsets))
    assert [type(c) for c in held.containers] == [kind]
    assert [held.select(k) for k in range(len(held))] == offsets


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400_000), max_size=300), st.integers(0, 3))
def test_boundary_sets_over_many_chunks(some, dense):
    offsets = sorted(some | set(range(dense * 70_000, dense * 70_000 + dense * 9000)))
    held = BoundarySet(np.array(offsets, np.int64))
    assert len(held) == len(offsets) and [held.select(k) for k in range(len(held))] == offsets
    for k in (-1, len(held)):
        with pytest.raises(IndexError):
            held.select(k)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(spark):
    rng = random.Random(3)
    rows = documents() + [(k, rng.choice([" a b  c\n", "<<P <S<M", "x <P> y", "  Ä <", "a " * 9000, "\t"])
                               ) for k in range(200, 260)]
    got = fill_in_middle(frame(spark, rows)).select("*", restored().alias("back")).collect()
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back))
                  for r in got) == sorted(repr(brute_fim(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_between_characters(spark):
    rows = [(k, "äb<c d\n" * k) for k in range(30)]
    got = fill_in_middle(frame(spark, rows), rates=Rates(100, 0), unit="character").select(
        "*", restored().alias("back")).collect()
    assert {r.doc_id: (r.back, r.n) for r in got} == {k: (t, len(t)) for k, t in rows}
    assert {r.form for r in got if r.n} == {"psm"}
    assert all(r.output == f"<P>{r.back[:r.prefix_chars]}<S>{r.back[r.prefix_chars + r.middle_chars:]}<M>"
               f"{r.back[r.prefix_chars:][:r.middle_chars]}" for r in got if r.n)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\rab\x1c\x85 ä\U0001f600"))
def test_word_ends_are_those_of_the_pattern(text):
    ends = np.cumsum([len(u.encode()) for u in UNIT.findall(text)]).tolist()
    assert word_ends(text.encode()).tolist() == ends


# --- vector codes


def brute_codes(rows, parts, entries, rounds):
    """Plain Lloyd rounds with full scans; rows: (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p in range(parts):
                far = [sum((a - b) ** 2 for a, b in zip(v[p * width:], e)) for e in books[p]]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width:(p + 1) * width] for (_, v, _), row in zip(kept, now) if row[p][0] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    now = assign()
    errors = [sum(d for _, d in row) for row in now]
    text = ",".join(str(x) for book in books for e in book for x in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for k, _ in row), e,
             sum(f for (_, _, other), f in zip(kept, errors) if other == label), sha)
            for (i, _, label), row, e in zip(kept, now, errors)]


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, width)) * 0.3
    rows = [(int(i), [float(np.float32(x)) for x in centers[i % 5] + rng.normal(size=width) * 0.05],
             None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    rows += [(900, None, 1), (901, [None] * width, 1), (902, [float("nan")] + [0.0] * (width - 1), 1),
             (903, [float("inf")] + [0.0] * (width - 1), None), (None, [0.1] * width, 2),
             (None, [-0.1] * width, None), rows[3], rows[3], (rows[4][0], [0.25] * width, 0)]
    return rows


def vector_frame(spark, rows):
    names = [c for c in CLASHES if c not in ("label", "v")] + ["v", "code", "distance", "error", "entry", "of"]
    names = list(dict.fromkeys(names))
    return spark.createDataFrame(
        [(*r, *["x"] * len(names)) for r in rows],
        "vec_id long, embedding array<float>, label int" + "".join(f", {c} string" for c in names)).repartition(3)


@pytest.mark.parametrize("n, width, parts, entries, rounds", [
    (90, 8, 4, 16, 2), (40, 12, 3, 64, 3), (60, 16, 16, 5, 0), (120, 8, 2, 30, 5)])
def test_vector_codes(spark, n, width, parts, entries, rounds):
    rows = vectors(n, n, width)
    got = vector_codes(vector_frame(spark, rows), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == \
        sorted(map(repr, brute_codes(rows, parts, entries, rounds)))


def test_vectors_that_cannot_be_coded(spark):
    empty = vector_codes(vector_frame(spark, []))
    assert empty.count() == 0
    assert vector_codes(vector_frame(spark, [(1, None, None)])).dtypes == empty.dtypes
    with pytest.raises(ValueError, match="equal parts"):
        compressed(vector_frame(spark, [(1, [0.5] * 6, 1)]), parts=4)
    with pytest.raises(ValueError, match="equal parts"):
        compressed(vector_frame(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)]), parts=4)
    with pytest.raises(Exception, match="not within"):
        compressed(vector_frame(spark, [(1, [1e30] * 4, 1)]), parts=4)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_renewed_is_a_full_scan(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (50, 2))
    old = rng.integers(-4, 5, (9, 2))
    new = np.where(rng.random((9, 1)) < 0.4, rng.integers(-4, 5, (9, 2)), old)
    code, distance = renewed(x, new, (new != old).any(axis=1), *nearest(x, old))
    want = nearest(x, new)
    assert code.tolist() == want[0].tolist() and distance.tolist() == want[1].tolist()


# --- LSH forest


def brute_minhash(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        k = min(shingle, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    unlike = {s: i for i, s in enumerate(sets)}
    kinds = {i: s for s, i in unlike.items()}
    roots = brute_components(kinds, lambda a, b: kinds[a] and kinds[b] and 100 * len(kinds[a] & kinds[b]) >=
                             percent * len(kinds[a] | kinds[b]))
    least = {}
    for (d, _), s in zip(rows, sets):
        least[roots[unlike[s]]] = min(least.get(roots[unlike[s]], LAST), place(d))
    out = []
    for (d, _), s in zip(rows, sets):
        c = least[roots[unlike[s]]] if s else place(d)
        c = None if c == LAST else c
        out.append((d, len(s), c, d == c))
    return sorted(map(repr, out))


def near_copies(seed):
    """Documents at and around the bound of 0.8, chains of near copies, and small sets."""
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        w = [f"x{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 12, 40, 200]))]
        for _ in range(rng.choice([2, 4, 15])):
            edited = list(w)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.08, 0.12, 0.2]))):
                edited[rng.randrange(len(w))] = f"y{rng.randrange(5000)}"
            rows.append((len(rows) + 1000, " ".join(edited).upper() if rng.random() < 0.2 else " ".join(edited)))
            if rng.random() < 0.4:
                w = edited
    return rows


@pytest.mark.parametrize("shingle, seed, limit, hot", [
    (2, 0, 1024, 9999), (5, 1, 1024, 9999), (2, 2, 8, 9999), (2, 3, 2, 20), (1, 4, 2, 3)])
def test_minhash_groups(spark, shingle, seed, limit, hot):
    rows = documents(seed) + near_copies(seed)
    got = minhash_groups(frame(spark, rows), shingle=shingle, region_limit=limit, hot_region=hot).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == \
        brute_minhash(rows, shingle, 80)


def test_minhash_of_chunked_components(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "CHUNK_MEMBERS", 5)
    rows = near_copies(7)
    got = minhash_groups(frame(spark, rows), shingle=2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == \
        brute_minhash(rows, 2, 80)
    assert minhash_groups(frame(spark, [])).count() == 0
    alone = minhash_groups(frame(spark, [(None, "a b"), (None, ""), (4, "a")])).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in alone if r.doc_id is None) == [
        (0, None, True), (1, None, True)]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30))
def test_spanning_connects_what_all_pairs_connect(seed, m):
    near = np.random.default_rng(seed).random((m, m)) < 0.08
    near |= near.T
    links = spanning(m, lambda i, js: near[i, js])
    mine = brute_components(range(m), lambda a, b: (a, b) in {tuple(sorted(x)) for x in links})
    assert mine == brute_components(range(m), lambda a, b: near[a, b])

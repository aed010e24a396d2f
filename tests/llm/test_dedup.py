"""Line, substring and SimHash dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from optabula.llm.components import connected
from optabula.llm.line_runs import dedup_lines
from optabula.llm.phrases import dedup_substrings, phrase_hashes, sliding_least
from optabula.llm.simhash import fingerprint, links, simhash_groups

from .cases import documents, frame, words_of

LAST = 1 << 63


def place(doc_id):
    return LAST if doc_id is None else doc_id


def brute_substrings(rows, window):
    first = {}
    for doc_id, text in rows:
        w = words_of(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, LAST), place(doc_id))
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if place(doc_id) > first[tuple(w[s:s + window])]:
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window, seed", [(50, 0), (12, 1)])
def test_substrings(spark, window, seed):
    rows = documents(seed)
    got = dedup_substrings(frame(spark, rows), window=window, shard_bytes=4096).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted(
        map(repr, brute_substrings(rows, window)))
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert any(r.n_removed for r in got)


def test_substrings_of_long_texts_in_chunks(spark, monkeypatch):
    from optabula.llm import phrases

    rng = random.Random(4)
    w = [f"v{rng.randint(0, 50)}" for _ in range(700)]
    whole = phrases.least_phrases([x.encode() for x in w], 30)
    monkeypatch.setattr(phrases, "CHUNK", 90)
    assert phrases.least_phrases([x.encode() for x in w], 30) == whole


def test_automaton_locates_every_occurrence():
    from optabula.llm import phrases

    rng = random.Random(5)
    docs = [(k, [rng.choice("abé") for _ in range(n)]) for k, n in enumerate((0, 9, 14, 15, 400, 3000))]
    # Places are not given: only the words of the phrases are.
    wanted = {" ".join(docs[5][1][at:at + phrases.PHRASE]) for at in (0, 1, 700, 2990)}
    found = phrases._locate([(k, [x.encode() for x in w]) for k, w in docs], wanted, 15)
    for key, words in docs:
        hit = [" ".join(words[p:p + phrases.PHRASE]) in wanted for p in range(len(words))]
        want = [s for s in range(len(words) - 14) if any(hit[s:s + 15 - phrases.PHRASE + 1])]
        assert found.get(key, np.zeros(0)).tolist() == want
    assert len(found[5]) > 5 and not phrases._locate(
        [(k, [x.encode() for x in w]) for k, w in docs], {"z " * 9 + "z"}, 15)


@pytest.mark.parametrize("chunk", [100_000, 90])
def test_only_windows_led_by_a_confirmed_phrase_are_hashed(monkeypatch, chunk):
    import pyarrow as pa

    from optabula.llm import phrases

    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = random.Random(6)
    passage = [f"p{rng.randint(0, 999)}" for _ in range(60)]
    docs = [[f"w{rng.randint(0, 999)}" for _ in range(200)] for _ in range(2)]
    docs = [w[:100] + passage + w[100:] for w in docs]
    own = [phrases.least_phrases([x.encode() for x in w], 50) for w in docs]
    confirmed = [own[0][h] for h in own[0].keys() & own[1].keys()]
    empty = [None] * len(confirmed)
    out = phrases.shard_windows(50)(
        None, pa.table({"shard": [0, 0], "doc_id": [1, 2], "text_key": [0, 0], "text": [" ".join(w) for w in docs]}),
        pa.table({"shard": empty, "doc_id": empty, "text_key": empty, "words": confirmed})).to_pylist()
    for r, w in zip(out, docs):
        want = []
        for s in range(211):
            runs = [w[p:p + phrases.PHRASE] for p in range(s, s + 50 - phrases.PHRASE + 1)]
            if " ".join(min(runs, key=lambda x: phrase_hashes([y.encode() for y in x])[0])) in confirmed:
                want.append(s)
        assert r["starts"] == want and set(range(100, 111)) <= set(want)


def test_phrases_of_one_hash_are_all_looked_for(spark):
    from optabula.llm import phrases

    twin = "a"  # two words of the same polynomial hash, whatever the base
    for _ in range(11):
        twin += twin.translate(str.maketrans("ab", "ba"))
    other, rest = twin.translate(str.maketrans("ab", "ba")), [f"r{i}" for i in range(9)]
    p, q = [twin, *rest], [other, *rest]
    assert phrase_hashes([x.encode() for x in p]) == phrase_hashes([x.encode() for x in q])
    words = [*p, *q]
    assert {" ".join(p), " ".join(q)} <= set(phrases.least_phrases([x.encode() for x in words], 10).values())
    rows = [(1, " ".join(words)), (2, " ".join(["t", *q])), (3, " ".join(words))]
    got = dedup_substrings(frame(spark, rows), window=10, shard_bytes=1).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 10), (3, 20)]


def test_words_of_phrases_move_once_and_are_not_stored(spark, monkeypatch):
    """Disk of op8: unconfirmed phrases, nearly all, are shuffled once and never written."""
    from optabula.llm import phrases

    frames, stored = {}, phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, name: (frames.update({name: df}), stored(df, name))[1])
    dedup_substrings(frame(spark, documents(0)), window=50, shard_bytes=4096).count()
    assert sorted(frames) == ["copies", "state", "windows"]
    plan = frames["state"]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_phrase_hashes_depend_on_the_words_only():
    w = [b"a", b"bc", b"d", b"e"] * 30
    h = phrase_hashes(w)
    assert (h[4:] == h[:-4]).all() and len(np.unique(h)) == 4
    values = np.random.default_rng(0).integers(0, 99, 200)
    for width in (1, 2, 7, 41):
        assert sliding_least(values, width).tolist() == [
            values[i:i + width].min() for i in range(200 - width + 1)]


def test_empty_substrings(spark):
    assert dedup_substrings(frame(spark, [])).count() == 0


def brute_lines(rows, k):
    def lines(text):
        return [x for x in (text or "").split("\n") if x.encode().split()]

    def key(doc_id, text):
        return place(doc_id)

    first, order = {}, {}
    for doc_id, text in rows:  # ties of doc_id are told apart by the text's hash in Spark
        order[doc_id, text or ""] = (key(doc_id, text), text or "")
    for (doc_id, text), at in order.items():
        x = lines(text)
        for s in range(len(x) - k + 1):
            run = tuple(x[s:s + k])
            first[run] = min(first.get(run, ((LAST + 1, ""), 0)), (at, s))
    out = []
    for doc_id, text in rows:
        x, gone = lines(text), set()
        for s in range(len(x) - k + 1):
            if (order[doc_id, text or ""], s) > first[tuple(x[s:s + k])]:
                gone.update(range(s, s + k))
        new = "\n".join(v for i, v in enumerate(x) if i not in gone) if gone else text
        out.append((doc_id, new, len(x), len(gone)))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_lines(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "e\t", "", " ", "ü", "f g h"])
                          for _ in range(rng.choice([0, 1, 3, 9, 40])))) for i in range(60)]
    rows += [(99, rows[7][1]), (100, rows[7][1]), (None, rows[9][1]), (101, None), (102, ""), rows[4]]
    rows += [(103, "\n".join(f"l{i % 9}" for i in range(200)))]
    docs = frame(spark, rows)
    got = dedup_lines(docs, k)
    assert got.columns == [*docs.columns, "line_dedup_"]
    assert sorted(repr((r.doc_id, r.text, r[-1].n_lines, r[-1].n_removed))
                  for r in got.collect()) == sorted(map(repr, brute_lines(rows, k)))


def test_lines_of_awkward_rows(spark):
    rows = documents()
    got = dedup_lines(frame(spark, rows))
    assert sorted(repr((r.doc_id, r.text, r[-1].n_lines, r[-1].n_removed))
                  for r in got.collect()) == sorted(map(repr, brute_lines(rows, 1)))
    assert dedup_lines(frame(spark, [])).count() == 0


def brute_fingerprint(text, size=4):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark):
    rows = documents()
    got = simhash_groups(frame(spark, rows)).select(
        "doc_id", "fp", "component_id").collect()
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    roots = brute_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d, p in prints:
        least[roots[p]] = min(least.get(roots[p], LAST), place(d))
    want = [(d, p, least[roots[p]]) for d, p in prints]
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == sorted(map(repr, want))
    assert simhash_groups(frame(spark, [])).count() == 0
    only_null = simhash_groups(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert [r.component_id for r in only_null] == [None, None]


def test_fingerprint_of_long_texts():
    text = " ".join(f"w{i % 977} v{i % 13}" for i in range(70_000))
    assert fingerprint(text, 4) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [2, 8, 4096])
def test_index_finds_all_links(spark, limit):
    rng = random.Random(limit)
    centers = [rng.getrandbits(64) for _ in range(12)]
    prints = {rng.getrandbits(64) for _ in range(100)} | {0}
    for c in centers:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in connected(links(fps, 4, limit)).collect()}
    want = brute_components(set(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    sizes = Counter(want.values())
    assert roots == {n: r for n, r in want.items() if sizes[r] > 1}


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (3, 2)]
    got = connected(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(61), 0) | dict.fromkeys(range(500, 540), 500)
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0

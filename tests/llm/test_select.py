"""Chat formatting, decontamination, sharding, rules, classifier: against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from optabula.llm.chat import format_chats
from optabula.llm.decontaminate import contaminated
from optabula.llm.ordinal import _loss, classify, features, fit_ordinal
from optabula.llm.quality_rules import STOP_WORDS, quality_rules
from optabula.llm.sharding import Leaf, even_tree, shard_documents

from .cases import documents, frame, prose, words_of


def brute_chats(rows):
    talks = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        key = ("row", k) if conv is None else conv
        talks.setdefault(key, set()).add((turn is not None, turn or 0, role or "", text or ""))
    said = {k: tuple(x[2:] for x in sorted(v)) for k, v in talks.items()}
    inner = {s[:n] for s in said.values() for n in range(1, len(s))}
    out = {}
    for key, s in said.items():
        if s not in inner:
            out.setdefault(s, []).append(None if isinstance(key, tuple) else key)
    return [(min((i for i in ids if i is not None), default=None), len(s), len(ids),
             "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s)) for s, ids in out.items()]


def test_chats(spark):
    rng = random.Random(1)
    rows, logs = [], []
    for c in range(25):
        logs.append([(("user", "assistant")[t % 2], rng.choice(["hi", "so", "", None, "long " * 50]))
                     for t in range(rng.randint(1, 7))])
    for c in range(60):
        log = rng.choice(logs)
        rows += [(c, t, *x) for t, x in enumerate(log[:rng.randint(1, len(log))])]
    rows += [(None, 0, "user", "hi"), (None, 0, "user", "alone"), (None, 3, "user", "alone"), (None, None, None, None)]
    rows += [(70, None, "user", "x"), (70, 1, None, "y"), (71, 0, "user", "x"), rows[0], rows[1], rows[0]]
    table = spark.createDataFrame([(*r, "z") for r in rows],
                                  "conv_id long, turn long, role string, text string, pos string").repartition(3)
    # Ties within a turn are ordered by content hash, so rows keep one text per turn here.
    got = [tuple(r) for r in format_chats(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_chats(rows)))
    assert format_chats(table.limit(0)).count() == 0


def brute_contaminated(docs, items, least=0.8):
    def words(t):
        return (t or "").lower().split()

    out = {}
    for item_id, item in items:
        iw = words(item)
        if not iw:
            continue
        k = min(5, len(iw))
        want = Counter(tuple(iw[i:i + k]) for i in range(len(iw) - k + 1))
        for doc_id, text in docs:
            w = words(text)
            for s in range(max(1, len(w) - len(iw) + 1)):
                part = w[s:s + len(iw)]
                have = Counter(tuple(part[i:i + k]) for i in range(len(part) - k + 1))
                both = sum((have & want).values())
                sim = both / max(1, sum(have.values()) + sum(want.values()) - both)
                if both and sim >= least:
                    key = (doc_id, text, item_id)
                    out[key] = min(out.get(key, (0, 0)), (-sim, s))
    return sorted((repr((d, i, s, round(-x, 9))) for (d, _, i), (x, s) in out.items()))


def test_contaminated(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, prose(rng, rng.randint(15, 60), vocabulary)) for i in range(12)]
    items += [(20, "one two three"), (21, None), (22, " "), (23, "same same same same same same same"),
              (None, prose(rng, 20, vocabulary)), items[3]]
    docs = []
    for i in range(40):
        before, after = prose(rng, rng.choice([0, 3, 50]), vocabulary), prose(rng, 9, vocabulary)
        item = rng.choice(items[:12])[1].split()
        how = i % 5
        if how == 1:
            item[rng.randrange(len(item))] = "other"
        if how == 2:
            item.insert(rng.randrange(len(item)), "more")
        if how == 3:
            item = item[:len(item) * 2 // 3]
        if how == 4:
            item = item[1:]
        docs.append((i, f"{before} {' '.join(item).upper()} {after}"))
    docs += [(50, "a ONE two  three b"), (51, None), (52, ""), (53, "same " * 30), (54, items[2][1]),
             (None, "x " + items[4][1]), (55, "y " + items[16][1]), docs[0]]
    table = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, h string")
    got = contaminated(frame(spark, docs), table).collect()
    assert sorted(repr((r.doc_id, r.item_id, r.start, round(r.similarity, 9))) for r in got) == \
        brute_contaminated(docs, items)
    assert contaminated(frame(spark, []), table).count() == 0
    assert contaminated(frame(spark, docs), table.limit(0)).count() == 0


def test_listed_items_are_not_broadcast(spark):
    from optabula.llm.common import written
    from optabula.llm.decontaminate import near_items

    prints = written(spark.createDataFrame(
        [(i, 60, i << 20) for i in range(50)], "doc_id long, size int, fp long"), "prints")
    items = written(spark.createDataFrame(
        [(0, 7, 60), (3 << 20, 8, 60), (3 << 20, 9, 61)], "fp long, item_key long, size int"), "items")
    near = near_items(prints, items, ["doc_id", "size"])
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString()
    # The radius holds all of these.
    assert sorted((r.doc_id, r.item_key) for r in near.collect()) == sorted((i, k) for i in range(50) for k in (7, 8))


def test_contaminated_in_another_order(spark):
    rng = random.Random(6)
    item, other = [f"i{k}" for k in range(60)], [f"o{k}" for k in range(300)]
    items = [(0, " ".join(item)), (1, prose(rng, 40, other))]
    second = items[1][1].split()

    def around(words, before=50, after=50):
        return " ".join([*rng.choices(other, k=before), *words, *rng.choices(other, k=after)])

    docs = [(0, around(item[30:] + item[:30])), (1, around(item[30:] + item[:30], 0, 0)),
            (2, around(item[45:] + item[20:45] + item[:20])), (3, around(second[13:] + second[:13])),
            (4, around(item[20:] + item[:20], 3, 0)), (5, around(item[10:20] + item[:10] + item[20:], 0, 9)),
            (6, around(item[30:] + ["x"] * 40 + item[:30])), (7, around(item[30:] + ["x"] + item[:30]))]
    docs += [(8, docs[0][1] + " " + docs[2][1])]
    got = contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.item_id, r.start, round(r.similarity, 9))) for r in got) == \
        brute_contaminated(docs, items)
    assert {0, 1, 3, 4, 8} <= {r.doc_id for r in got} and 6 not in {r.doc_id for r in got}


def test_sharding_places_all_rows(spark):
    rows = documents()
    got = shard_documents(frame(spark, rows), even_tree(8), even_tree(9)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert shard_documents(frame(spark, []), even_tree(8)).count() == 0


def test_weights_move_rows_only_through_changed_subtrees(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    tree = [Leaf("a", "a1", 0), Leaf("a", "a1", 1), Leaf("a", "a2", 2, 2.0), Leaf("b", "b1", 3, 3.0),
            Leaf("b", "b2", 4), Leaf("c", "c1", 5, 4.0)]
    more = [x if x.shard != 3 else x._replace(weight=5.0) for x in tree]
    got = shard_documents(docs, tree, more).collect()
    share = Counter(r.shard for r in got)
    for x in tree:
        assert abs(share[x.shard] / 6000 - x.weight / 12) < 0.03
    moved = {(r.shard, r.grown_shard) for r in got if r.shard != r.grown_shard}
    assert moved and all(to in (3, 4) for _, to in moved)  # into region b, or within it into rack b1
    assert all(to == 3 for was, to in moved if was in (3, 4))


def brute_rules(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    bullets = sum(x.lstrip(" \t")[:1] in ("-", "*", "•") and x.lstrip(" \t") != "" for x in lines)
    cuts = sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines)
    kept = (not failed and 2 <= chars / n <= 20 and symbols / n <= 0.1
            and (n < 50 or sum(x in STOP_WORDS for x in w) / n >= 0.02)
            and dup / len(lines) <= 0.5 and bullets / len(lines) <= 0.9 and cuts / len(lines) <= 0.3)
    return n, chars, symbols, dup, len(covered), failed, kept


def test_rules(spark):
    rng = random.Random(2)
    rows = documents() + [(900, "- the a\n- of b\n" * 20), (901, "the of and ...\n" * 9 + prose(rng, 30)),
                          (902, "der die das " * 9 + prose(rng, 60)), (903, "# the a of in b c d e f g h i")]
    got = quality_rules(frame(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                        r.base_failed, r.kept)) for r in got) == sorted(
        repr((d, *brute_rules(t))) for d, t in rows)
    assert quality_rules(frame(spark, [])).count() == 0


def test_gradient_of_the_ordinal_loss():
    rng = np.random.default_rng(0)
    p = rng.normal(size=22) * 0.3
    rows, grades = (rng.integers(0, 20, 300), np.repeat(np.arange(30), 10), 20), rng.integers(0, 3, 30)
    _, gradient = _loss(p, rows, grades, 1e-2)
    for k in range(22):
        step = 1e-6 * np.eye(22)[k]
        slope = (_loss(p + step, rows, grades, 1e-2)[0] - _loss(p - step, rows, grades, 1e-2)[0]) / 2e-6
        assert math.isclose(slope, gradient[k], abs_tol=1e-7)


def test_the_ordinal_loss_holds_few_features_at_once(monkeypatch):
    import tracemalloc

    from optabula.llm import ordinal

    rng = np.random.default_rng(1)
    p = rng.normal(size=1002) * 0.1
    owner = np.repeat(np.arange(2000, dtype=np.int32), rng.integers(0, 1000, 2000))
    rows, grades = (rng.integers(0, 1000, len(owner)).astype(np.int32), owner, 1000), rng.integers(0, 3, 2000)
    whole = _loss(p, rows, grades, 1e-2)
    monkeypatch.setattr(ordinal, "AT_ONCE", 20_000)
    tracemalloc.start()
    value, gradient = _loss(p, rows, grades, 1e-2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(owner)  # the features themselves take eight times that with their documents
    assert value == whole[0] and (gradient == whole[1]).all()


def test_ordered_grades_are_learned():
    rng = random.Random(0)
    sets, grades = [], []
    for _ in range(600):
        g = rng.randrange(3)
        text = prose(rng, 40) + " bad" * (g < 2) + " worse" * (g < 1)
        sets.append(features(text))
        grades.append(g)
    model = fit_ordinal(sets[:400], np.array(grades[:400]))
    above = model.above(np.array([model.weights[s].sum() for s in sets[400:]]))
    assert model.thresholds[0] < model.thresholds[1] and (above[:, 0] >= above[:, 1]).all()
    assert (((above > 0.5).sum(axis=1)) == grades[400:]).mean() > 0.95


def test_classifier_on_held_out_ratings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = classify(docs, labels.where("doc_id % 3 > 0"), sample=5000).join(
        labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "rated"), "doc_id").collect()
    clean = [r.quality.kept for r in out if r.rated == 1 and r.toxic == 0]
    junk = [r.quality.kept for r in out if r.rated == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.02


def brute_features(text):
    """Feature names of a text, one by one."""
    runs, run, kind = [], "", None
    for c in text:
        now = ("digit" if c.isdigit() and c.isdecimal() else "letter" if c.isalnum() else "low" if c == "_"
               else None if c.isspace() else "sign")
        if now != kind or now is None:
            if run:
                runs.append(run)
            run = ""
        if now:
            run += c
        kind = now
    runs += [run] if run else []
    letters = [r for r in runs if r[0].isalpha()]
    n = max(len(letters), 1)

    def tenth(x):
        return int(min(x, 1.0) * 10)

    names = {r.lower() for r in runs} | {
        f"\x01upper{tenth(sum(r.isupper() for r in letters) / n)}", f"\x01signs{tenth((len(runs) - len(letters)) / n)}",
        f"\x01distinct{tenth(len(set(letters)) / n)}", f"\x01length{len(letters).bit_length()}"}
    return sorted({zlib.crc32(x.encode()) % (1 << 18) for x in names})


def test_classify_against_a_plain_fit(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + " fine" * (i % 3 == 2) + " GOOD-" * (i % 3 > 0) + "z" * 40 + "q" * (i % 3 == 0))
            for i in range(90)]
    rows += [rows[0]] * 200 + [(5, "another text of a rated document"), (None, "fine"), (7, None)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(80)] + [(3, 1, 0), (None, 0, 0), (4, None, 0)]
    grades = {}
    for i, quality, toxic in labels:
        if None not in (i, quality, toxic):
            grades[i] = min(grades.get(i, 2), 0 if quality < 1 else 1 if toxic else 2)
    cases = sorted({(i, t or "") for i, t in rows if i in grades})
    model = fit_ordinal([np.array(brute_features(t), np.int32) for _, t in cases],
                        np.array([grades[i] for i, _ in cases]))
    got = classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for r in got:
        score = sum(float(model.weights[f]) for f in brute_features(r.text or ""))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert math.isclose(r.quality.p_keep, above[1], abs_tol=2e-3)
        assert math.isclose(r.quality.expected_grade, sum(above), abs_tol=2e-3)
        assert r.quality.kept == (r.quality.p_keep >= 0.5)
    kept = [r.quality.kept for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 3 == 2]
    assert sum(kept) > 0.9 * len(kept)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    from optabula.llm import ordinal

    seen = []
    monkeypatch.setattr(ordinal, "fit_ordinal", lambda sets, grades: seen.append(len(sets)))
    rows = [(1, f"text {i}") for i in range(50)] + [(1, "same")] * 30 + [(2, "a")]
    ordinal.train(spark.createDataFrame(rows, "doc_id long, text string"),
                  spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int"), sample=20)
    assert seen == [20]


@pytest.mark.parametrize("labelled", [True, False])
def test_classifier_of_awkward_rows(spark, labelled):
    rows = documents()
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (1, None, 1), (2, 1, None), (3, 1, 1), (3, 0, 0)]
        if labelled else [], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    out = classify(docs, labels)
    assert out.columns == [*docs.columns, "quality_"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert all(0 <= r.quality_.p_keep <= 1 and 0 <= r.quality_.expected_grade <= 2 for r in got)
    if not labelled:
        assert all(r.quality_.kept for r in got)
    assert classify(frame(spark, []), labels).count() == 0

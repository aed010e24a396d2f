"""The pipeline stage by stage against brute force, and registered queries against their SQL."""

import random

import pytest

import corpus_pipeline
from optabula.llm.ordinal import classify
from optabula.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.conftest import SMALL

from .cases import WORDS, prose
from .test_dedup import LAST, brute_components, brute_fingerprint, brute_lines, place
from .test_select import brute_contaminated
from .test_tokens_out import direct

EXPECTED = {f"op{n}" for n in range(1, 14)}


def test_one_query_for_each_operator():
    assert {name.split("_")[0] for name in QUERIES} == EXPECTED
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, con, name):
    assert differences(spark, con, SMALL, QUERIES[name], ORACLES[name]) == ""


def tables(spark, folder, empty=False):
    rng = random.Random(8)
    items = [(i, prose(rng, 30, WORDS[:300])) for i in range(4)]
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([12, 60, 150]), WORDS[:400])
        if i % 6 == 1:
            text = " ".join(rng.choice(["###", "%%%"]) for _ in range(40))
        if i % 10 == 3:
            text += "\nshared line one\nshared line two\n" + prose(rng, 9)
        if i % 10 == 5:
            text += " " + items[i % 4][1] + " tail"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(70, rows[2][1], "en", "s", 3), (71, rows[2][1] + " x", "en", "s", 3), rows[4], rows[4],
             (72, None, None, None, None), (None, rows[8][1] + " y", "en", None, 1), (73, "", "en", "s", 0)]
    labels = [(r[0], int("#" not in (r[1] or "") and "%" not in (r[1] or "")), 0) for r in rows if r[0] is not None]
    for name, data, schema in (
            ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", labels, "doc_id long, quality int, toxic int"),
            ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame([] if empty else data, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return items


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages(spark, tmp_path):
    sf_dir = str(tmp_path)
    items = tables(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{sf_dir}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        kept[name], before, docs = spark.read.parquet(out), docs, spark.read.parquet(out)
        given = [tuple(r) for r in before.collect()]
        if name == "quality classifier":
            rated = classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = sorted(repr(tuple(r)[:-1]) for r in rated.collect() if r.quality.kept)
            assert rows_of(docs) == want and 40 < len(want) < len(given)
        if name == "line dedup":
            new = brute_lines([(d, t) for d, t, *_ in given], 1)
            want = [(d, n, la, s, len(n) if gone else c) for (d, t, la, s, c), (_, n, _, gone) in zip(given, new)]
            assert rows_of(docs) == sorted(map(repr, want)) and any(g[3] for g in new)
        if name == "SimHash near-dedup":
            prints = {(d, t): brute_fingerprint(t) for d, t, *_ in given}
            roots = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
            found = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(found) == len(set(roots.values()))
            assert {roots[prints[x]] for x in found} == set(roots.values())
            for d, t in found:
                group = [place(x) for x, y in prints if roots[prints[x, y]] == roots[prints[d, t]]]
                assert place(d) == min(group, default=LAST)
        if name == "benchmark decontamination":
            dirty = {(d, t) for d, t, *_ in given if brute_contaminated([(d, t)], items)}
            assert dirty
            assert rows_of(docs) == sorted(repr(r) for r in given if r[:2] not in dirty)
        if k < 4:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        else:
            ids = sum(len(direct(t)) + 1 for _, t, *_ in given)
            assert docs.agg({"length": "sum"}).first()[0] == ids
    whole = corpus_pipeline.run(spark, sf_dir)
    assert rows_of(whole.select("doc_id", "piece", "ids_crc32")) == rows_of(
        docs.select("doc_id", "piece", "ids_crc32"))


def test_stages_of_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Each stage against plain Python on its own input, on the driver's smallest tables with planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from foliant.llm import decontaminate
from test_near_copies import groups
from tests_llm_helpers import brute_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [k for k, _ in C.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]
    assert all(stages[k][1].columns == columns for k, _ in C.STAGES[:-1])


def test_quality_keeps_clean_documents_and_rejects_junk(spark):
    """On a table with some hundred labels; the smallest one has too few for a model."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = C.quality(spark, docs, sf).collect()
    ids, labels = {r.doc_id for r in kept}, spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in ids for i in good) > 0.9 * len(good) and sum(i in ids for i in junk) < 0.1 * len(junk)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()}


def test_one_of_each_group_stays(stages):
    docs, kept = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[root][0] for root in groups([t for _, t in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_repeated_passages_go(stages):
    docs, kept = stages["repeated_passages"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {}
    for (i, t), spans in zip(rows, brute_spans([t for _, t in rows], C.PASSAGE_BYTES), strict=True):
        raw = t.encode()
        want[i] = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)), spans
    got = {r.doc_id: r for r in kept.collect()}
    for i, (raw, spans) in want.items():
        if i in got:
            assert abs(len(got[i].text.encode()) - len(raw)) <= 6 * len(spans) and got[i].n_chars == len(got[i].text)
            assert spans or got[i].text.encode() == raw
        else:
            assert spans and not raw.strip()


def test_leaks_go(stages, spark, sf_dir):
    docs, kept = stages["benchmark_leaks"]
    found = {r.doc_id for r in decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - found


def test_packing_holds_all(stages):
    from test_best_fit_packing import check_packing

    docs, packed = stages["packing"]
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packed.collect(), C.CAPACITY)


def test_stages_take_odd_rows(spark, sf_dir):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "c", None, "s", 1), (None, None, "en", None, None), (2, "", "en", "s", 0), (3, "w " * 40_000, "en", "s", 80_000)], "doc_id long, text string, lang string, source string, n_chars long")
    # columns that clash with names that the operators use
    clash = odd.select("*", *(F.lit(7).alias(c) for c in ("text_hash", "node", "key", "root", "low", "fp", "window", "piece", "carry", "_node", "_id", "model", "least", "sure")))
    for name, stage in C.STAGES:
        assert stage(spark, odd, sf_dir).count() >= 3, name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        assert stage(spark, clash, sf_dir).count() == stage(spark, odd, sf_dir).count(), name


def test_rows_without_an_id_or_with_a_shared_one_are_told_apart_by_text(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    texts = [(None, item), (None, "one clean text"), (1, "x " + item), (1, "another clean text"), (1, "a third text of its own"), (None, "one clean text"), (None, "another clean text")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in C.benchmark_leaks(spark, df, sf_dir).collect()) == sorted(t for _, t in texts if item not in t)
    kept = [(r.doc_id, r.text) for r in C.near_duplicates(spark, df, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(1, "another clean text"), (1, "a third text of its own"), (None, "one clean text"), (1, "x " + item) if (1, "x " + item) in kept else (None, item)], key=str)

import importlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from hushmap.llm import mixing
from hushmap.llm.shared import stored
from tests.llm.helpers import Groups, documents, words
from tests.llm.test_models_and_duplicates import plain_sets
from tests.llm.test_rules_and_mixing import plain_counts

pipeline = importlib.import_module("corpus_pipeline")


def test_stages_follow_plain_loops(spark, sf):
    from hushmap.llm import quality_crf

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_crf.score_quality(docs, labels).collect()
    good = stored(pipeline.keep_good(spark, docs, sf))
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored if r.predicted}

    ruled = stored(pipeline.keep_by_rules(spark, good, sf))
    assert ruled.columns == docs.columns
    kept = {r.doc_id for r in ruled.collect()}
    failed = {r.doc_id for r in good.collect() if plain_counts(r.text)[5]}
    assert kept and not kept & failed

    single = stored(pipeline.keep_one_of_each(spark, ruled, sf))
    rows = {r.doc_id: plain_sets(r.text) for r in ruled.collect()}
    groups, ids = Groups(), sorted(rows)
    for k, a in enumerate(ids):
        groups.find(a)
        for b in ids[k + 1 :]:
            if rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 75 * len(rows[a] | rows[b]):
                groups.join(a, b)
    assert {r.doc_id for r in single.collect()} == {groups.find(i) for i in ids}

    mixed = stored(pipeline.mix_sources(spark, single, sf))
    assert mixed.columns == docs.columns
    texts = {r.doc_id: r.text for r in single.collect()}
    taken = [r.doc_id for r in mixed.collect()]
    assert set(taken) <= set(texts) and max(map(taken.count, set(taken))) <= 3
    whole = sum(len(words(t)) for t in texts.values())
    assert 0.5 * whole <= sum(len(words(texts[i])) for i in taken) <= 1.5 * whole

    packed = pipeline.pack(spark, mixed, sf).collect()
    assert sorted(r.doc_id for r in packed) == sorted(taken)
    assert all(r.n_tokens == len(words(texts[r.doc_id])) for r in packed)


def test_names_of_the_stages():
    assert [n for n, _ in pipeline.STAGES] == [
        "quality classifier", "quality rules", "n-gram Jaccard join", "mixing", "packing",
    ]


def test_mixing_emits_rows_with_null_and_repeated_ids_as_often_as_mixed(spark):
    # Source a is taken less than once a row on average, b more than once.
    rows = [(None if i % 3 == 0 else i % 7, f"w{i} " * (5 + i % 9), "ab"[i % 2]) for i in range(120)]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.source, r.size] += r.copies
    got = pipeline.mix_sources(spark, docs, None)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter((r.doc_id, r.source, len(words(r.text))) for r in got) == +want
    assert any(r.doc_id is None and r.source == "a" for r in got)
    assert max(Counter(r.text for r in got).values()) <= 3
    with pytest.raises(ValueError):
        mixing.emit(docs, mixing.mix(docs))


def test_near_duplicates_are_rows_not_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [
        (None, two, "s"), (None, two, "s"), (None, three, "s"), (None, three, "s"),
        (5, one, "s"), (9, one, "s"), (9, two, "s"), (7, "z " + two, "t"),
    ]
    got = pipeline.keep_one_of_each(spark, documents(spark, rows).repartition(3), None).collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(5, one): 1, (7, "z " + two): 1, (None, three): 1}


def test_no_column_of_the_documents_is_lost_or_changed(spark, sf):
    names = (
        "score", "predicted", "held_out", "kept", "rejected_by", "n_words", "_other", "_row", "_row_id",
        "_doc", "component_id", "copies", "size", "target", "a`b", "_key",
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for _, stage in pipeline.STAGES[:-1]:
        wide = stored(stage(spark, wide, sf))
        assert wide.columns == [*docs.columns, *names]
        rows = wide.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert pipeline.pack(spark, wide, sf).count() == len(rows)

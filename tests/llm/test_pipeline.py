import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blipstream.llm.exact_dedup import exact_dedup
from blipstream.llm.mixing import mix_sources

from .helpers import awkward, frame, text, vocabulary
from .test_dedup import expected_groups, expected_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_take_effect(spark, stages):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    for df in stages[:-1]:
        assert df.dtypes == raw.dtypes
    kept, cut, alone, mixed, ids = stages
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum(i not in left for i, t in labels.items() if t == 0) <= 1
    before = [(r.doc_id, r.text) for r in kept.collect()]
    after = {r.doc_id: r.text for r in cut.collect()}
    assert after == expected_lines(before)
    groups = expected_groups(list(after.items()), 80)
    assert {r.doc_id for r in alone.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in alone.collect()}
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = ids.collect()
    assert len(rows) == mixed.count()
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] else docs
        assert docs.count() == 0


def test_exact_dedup_columns(spark):
    assert exact_dedup(frame(spark, [(1, "a")])).columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]


NAMES = ["score", "n_cut", "copies", "held_out", "__id", "__doc", "__row", "__text", "__copies", "a"]


def test_awkward_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns pass every stage with their values."""
    rows = [(i, t, None if k % 2 else "en", None if k % 3 == 0 else f"s{k % 4}", None) for k, (i, t) in enumerate(awkward())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.substring("text", 1, 9), F.lit("-"))) for c in NAMES} | {"n_cut": F.lit("mine"), "score": F.lit(99.0)})
    before = {str(tuple(r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert {str(tuple(r)) for r in out.collect()} <= before, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {i for i, _ in awkward()} and 7 in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_cut_texts_leave_other_columns_alone(spark):
    rng, lines = random.Random(21), [text(random.Random(i), vocabulary(), 6) for i in range(40)]
    rows = [(i, "\n".join(lines[:12] + [text(rng, vocabulary(), 5)]), "en", "s", -1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("n_cut", F.lit("mine")).withColumn("chars_cut", F.col("doc_id") * 2)
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got[0].text == rows[0][1] and got[0].n_chars == -1 and all(r.n_cut == "mine" and r.chars_cut == 2 * i for i, r in got.items())
    assert all(len(got[i].text) < len(rows[i][1]) and got[i].n_chars == len(got[i].text) for i in range(1, 6))


def test_mixing_stage_takes_what_the_mix_takes(spark):
    rng = random.Random(22)
    rows = [(None if k % 2 else k // 3, text(rng, vocabulary(), rng.randint(1, 30)), "en", rng.choice(["a", "b", None]), k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__id", F.lit(1))
    taken = mix_sources(docs).agg(F.sum("taken")).first()[0]
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == taken

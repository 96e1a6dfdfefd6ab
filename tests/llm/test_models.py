"""Learned operators: held-out results on the sample tables, and odd rows."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import langid, quality
from gleaner.llm.queries.corpus import HELD_OUT

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are missing")


@needs_tables
def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter(f"not {HELD_OUT}"))
    rows = quality.score(docs, model).join(labels.filter(HELD_OUT), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    pairs = [(g > b) + (g == b) / 2 for g in good for b in bad]
    assert len(bad) > 50 and sum(pairs) / len(pairs) > 0.97
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.98 * len(good)


@needs_tables
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs.filter(f"not {HELD_OUT}")), keep=("doc_id", "lang")).filter(HELD_OUT).collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    # calibrated: scores are about as high as the share of right ones
    assert abs(sum(r.score for r in rows) / len(rows) - sum(right) / len(right)) < 0.05


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (5, 1), (8, 0), (11, 0), (10, None), (99, 1), (None, 0), (4, 7)], "doc_id BIGINT, quality INT")
    rows = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and by[7] == by[5] > by[8]
    for model in (quality.fit(odd, labels.limit(0)), quality.fit(nothing, labels)):
        assert {r.score for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def test_language_of_odd_rows(spark, odd, nothing):
    rows = langid.predict(odd, langid.fit(odd)).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 11):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[9].lang_pred in ("de", "en", "es", "fr") and 0 < by[9].score <= 1
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0


def test_samples_are_bounded_in_rows(spark, odd):
    """An id in very many rows, with two texts, is one document to learn from."""
    many = spark.range(100_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a common text, often repeated").otherwise("another text of this id").alias("text"), F.lit("en").alias("lang"))
    docs = many.union(odd.select(F.col("doc_id").cast("bigint"), "text", "lang"))
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, 0)], "doc_id BIGINT, quality INT")
    model = quality.fit(docs, labels)
    assert len(model.labels) == 3
    rows = langid.sample(docs.filter("text is not null and lang is not null"), "doc_id", "text", "lang").collect()
    assert len(rows) == len({(r._id, r._lang) for r in rows}) and 5 in {r._id for r in rows}
    assert len(langid.fit(docs).langs) >= 1


def test_sample_of_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST", 60)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 30) AS lang")
    rows = langid.sample(docs, "doc_id", "text", "lang").groupBy("_lang").count().collect()
    assert len(rows) == 30 and {r["count"] for r in rows} == {2}


def test_votes_against_plain_python(spark, odd):
    """Each score is the vote of the nearest labelled vectors, weighted by e to the cosine times the sharpness."""
    texts = [f"{w} {w} story number {i} about {w}s and a {v}" for i, (w, v) in enumerate([("river", "boat"), ("train", "coast"), ("spam!!", "$$$"), ("cheap", "click")] * 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(0, 36) if i % 5], "doc_id BIGINT, quality INT")
    model = quality.fit(docs, labels)
    vectors, marks = model.vectors.astype(float).tolist(), model.labels.tolist()
    counts = {}
    def keep(batches):
        for batch in batches:
            for b in quality.blocks(batch.column(1)):
                rows = quality.term_counts(b).astype("float32")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "c"])
    for r in docs.mapInArrow(keep, "doc_id long, c binary").collect():
        counts[r.doc_id] = np.frombuffer(r.c, np.float32)[None]
    for r in quality.score(docs, model).collect():
        own = model.project(quality.weights(counts[r.doc_id].copy(), model.idf))[0].astype(float).tolist()
        sims = sorted(((sum(a * b for a, b in zip(own, v)), m) for v, m in zip(vectors, marks)), reverse=True)
        near = sims[: quality.NEIGHBOURS]
        votes = [(math.exp(quality.SHARPNESS * (s - near[0][0])), m) for s, m in near]
        want = sum(w * m for w, m in votes) / sum(w for w, _ in votes)
        assert abs(r.score - want) < 1e-3, r


def test_penalty_makes_weights_sparse(spark, odd):
    model = langid.fit(odd)
    assert model.weights.any() and (model.weights == 0).mean() > 0.5


def test_the_sample_is_not_sent_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(i, " ".join(f"w{i * j % 17}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id BIGINT, quality INT")
    sent = []
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: sent.append("toArrow") or _whole(df))
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: sent.extend(r for r in collect(df) if "counts" in r) or collect(df))
    model = quality.fit(docs, labels)
    assert not sent and len(model.labels) == 40 and model.vectors.shape == (40, 40)


def _whole(df):
    import pyarrow as pa

    return pa.Table.from_pandas(df.toPandas())

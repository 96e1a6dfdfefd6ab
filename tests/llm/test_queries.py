"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gleaner.llm import bpe
from gleaner.llm.queries import ORACLES, QUERIES
from tests.llm.test_jaccard import slow
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are missing")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same, message = compare(connect(SF), df, ORACLES[name])
        assert same, message
    elif name != "op6_prefix_forest":
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert df.count() == 50


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "quality":
            wrong = [i for i in before if labels.get(i) is not None and (i in after) != bool(labels[i])]
            assert len(wrong) <= 3
        elif name == "lines":
            lost = {i for i in before if i not in after or after[i].text != before[i].text}
            assert all(set(after[i].text.split("\n")) <= set(before[i].text.split("\n")) for i in lost & set(after))
            assert all(len(after[i].text) == after[i].n_chars for i in lost & set(after))
        elif name == "near_duplicates":
            want = slow([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif name == "mixture":
            words = lambda rows: sum(len((r.text or "").split()) for r in rows.values())
            assert 0.6 * words(before) < words(after) <= 0.8 * words(before)
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.ids == library.encode_ordinary(before[i].text) and r.text == before[i].text and r.n_tokens == len(r.ids)
        before = after


def test_pipeline_with_odd_rows(spark, odd, nothing):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF) if name != "tokens" else stage(spark, rows.select(columns), SF)
            assert out.count() <= rows.count()

"""The pipeline's stages against what they promise, and its rows against a second run."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tideline.llm import common, mixing, neardup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"]
    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.save(stage(spark, before, SF), "test")
        have, left = {r["doc_id"] for r in before.select("doc_id").collect()}, Counter(r["doc_id"] for r in after.select("doc_id").collect())
        assert set(left) <= have and left
        if name != "encoding":
            assert after.columns == columns
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()}
            assert set(left) == kept and max(left.values()) == 1
        if name == "mixing":
            assert left == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).where("copies > 0").collect()})
        if name == "encoding":
            tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            texts = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
            assert all(r["n_tokens"] == len(tk.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in after.collect())
            assert sum(left.values()) == before.count()
        before = after


def test_mix_is_written_in_the_order_of_its_schedule(spark):
    docs = common.table(spark, SF, "documents")
    want = [r["doc_id"] for r in mixing.schedule(mixing.mix(docs)).collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()] == want != sorted(want)


def test_mix_of_many_null_ids(spark):
    rows = [(None, f"{i} " * (1 + i % 7), "en", "abc"[i % 3], i) for i in range(300)] + [(None, "same text", "en", "c", 0)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        got[r["source"]] += len(r["text"].split())
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(got[r["source"]] - r["target"]) <= 3.5


def test_filters_reject_and_keep(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    by = {r["doc_id"]: r for r in labels.collect()}
    first = {r["doc_id"] for r in toxicity.drop_toxic(docs, toxicity.train(docs, labels)).select("doc_id").collect()}
    second = {r["doc_id"] for r in quality.keep_good(docs, quality.train(docs, labels)).select("doc_id").collect()}
    assert all(i in first for i, r in by.items() if not r["toxic"])
    assert sum(i in first for i, r in by.items() if r["toxic"]) < sum(r["toxic"] for r in by.values()) / 2
    assert sum(i in second for i, r in by.items() if r["quality"]) > 0.95 * sum(r["quality"] for r in by.values())
    assert sum(i in second for i, r in by.items() if not r["quality"]) < 0.2 * sum(1 - r["quality"] for r in by.values())


def test_runs_agree(spark):
    a, b = (Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b

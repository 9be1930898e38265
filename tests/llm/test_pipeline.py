"""The pipeline's rows against the stages' plain versions, on its smallest input."""

import os

import pytest

from weftline.llm import bpe_automaton, mixing, quality_rules, shingle_sets
from weftline.llm.common import read_table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_pipeline_takes_effect_stage_by_stage(spark):
    from test_quality import plain_kept
    from test_shingle_sets import plain_groups
    from tokenizers import Tokenizer

    documents = read_table(spark, SF, "documents")
    rows = documents.collect()
    rules = quality_rules.fit(documents, read_table(spark, SF, "labels"))
    good = [r for r in rows if plain_kept(r["text"], rules)[1]]
    group = plain_groups([r["text"] for r in good])
    least = {}
    for r, g in zip(good, group):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    single = spark.createDataFrame([r for r, g in zip(good, group) if least[g] == r["doc_id"]], documents.schema)
    copies = {r["key"]: r["copies"] for r in mixing.take(single).collect()}
    library = Tokenizer.from_file(bpe_automaton.word_model_path())
    wanted = []
    for r in single.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        wanted += [(r["doc_id"], tuple(ids))] * copies[r["doc_id"]]
    found = [(r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(found) == sorted(wanted)


def test_all_stages_but_the_last_keep_the_columns(spark, odd_documents):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").withColumn("kept", F.lit(1))
    for out in (quality_rules.keep_good(docs, quality_rules.fit(docs, labels)), shingle_sets.keep_one(docs), mixing.mix(docs)):
        assert out.dtypes == docs.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "source_mixing", "bpe_encoding",
    ]

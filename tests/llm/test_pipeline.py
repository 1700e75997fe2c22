"""The whole pipeline against a plain version of it."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from rubrica.llm import near_dedup, secrets, toxicity
from rubrica.llm.common import table
from tests.conftest import SMALL

from .test_llm import brute_exact, brute_near, checked


def test_pipeline_equals_plain_version(spark):
    network = toxicity.train(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    scores = network.score([t or "" for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    keep = {i for i, _ in brute_exact(rows).values()}
    rows = [r for r in rows if r[0] in keep]
    near = brute_near(rows, 5, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    docs = {i: secrets.redacted(t) for i, t in rows}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(docs)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    checked(pieces, docs, tokenizer)


def test_stages_keep_columns_and_edges(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, 5), (3, "secret: abcdefgh123 end", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
    assert [r.n_chars for r in corpus_pipeline.secret_scan_stage(spark, docs, SMALL).where("doc_id = 3").collect()] == [len("[SECRET] end")]
    assert corpus_pipeline.exact_dedup_stage(spark, docs, SMALL).count() == 3
    assert near_dedup.rows_a_band(0.8) == 6


def test_outer_stages_edges(spark):
    """The first and last stage on nulls, empty texts, repeats, an empty table and columns with clashing names."""
    rows = [(1, None, "en", "s", None, "x"), (2, "", "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, "a b c", None, None, 5, "x"), (4, "word " * 9000, "en", "s", 45000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    out = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert out.columns == docs.columns and out.where("doc_id IN (1, 2)").count() == 3
    assert corpus_pipeline.toxicity_stage(spark, docs.limit(0), SMALL).count() == 0
    pieces = corpus_pipeline.packing_stage(spark, docs.withColumnRenamed("score", "sequence_id"), SMALL).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 4, None} and all(p.offset + p.length <= 2048 for p in pieces)
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SMALL).count() == 0

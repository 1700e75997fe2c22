"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared scratch folder
and reads it again as the next one's docs. All stages but the last return the columns of documents.

- toxicity: rejects texts whose worst window scores 0.7 or more (``rubrica.llm.toxicity``);
- exact_dedup: one row of each group of equal texts stays (``rubrica.llm.exact_dedup``);
- near_dedup: one document of each group of near duplicates (five-word shingles, similarity 0.8) stays;
- secret_scan: secrets are replaced by a mark; n_chars follows, no document goes;
- packing: pieces of token sequences, as ``rubrica.llm.packing`` gives them.
Nulls, empty tables and clashing column names are handled as the operators' docstrings say.
"""

from __future__ import annotations

from rubrica.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from rubrica.llm.common import clear, mark, table, written


def toxicity_stage(spark, docs, sf_dir):
    network = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, network)


def exact_dedup_stage(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark, docs, sf_dir):
    return near_dedup.drop_near_duplicates(docs)


def secret_scan_stage(spark, docs, sf_dir):
    return secrets.redact_secrets(docs)


def packing_stage(spark, docs, sf_dir):
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: SQL can't express the scores of a network or the token ids.
ORACLE_SQL = None


def run(spark, sf_dir):
    start = mark()
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        clear(spark, start, (docs,))  # what the stage read and made is needed no more
    return STAGES[-1][1](spark, docs, sf_dir)

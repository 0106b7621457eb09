"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs; all but the last return the
columns of documents.
"""

from manybody.llm.bpe_sql import stage_bpe
from manybody.llm.common import new_path, table
from manybody.llm.language_id import stage_language
from manybody.llm.mixing import stage_mixing
from manybody.llm.ngram_join import stage_ngram_join
from manybody.llm.toxicity import stage_toxicity

STAGES = [
    ("language", stage_language),
    ("toxicity", stage_toxicity),
    ("near duplicates", stage_ngram_join),
    ("mixing", stage_mixing),
    ("tokens", stage_bpe),
]

#: SQL has no linear SVM, ordinal regression or projected gradient: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Applies all stages to the documents of sf_dir; each result is written to the shared work folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

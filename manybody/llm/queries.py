"""Registered queries of the training-data operators, and the SQL that some of them equal."""

from .audio import op8_audio_features
from .bpe_sql import op9_byte_bpe
from .embedding_dedup import ORACLE as DEDUP_SQL
from .embedding_dedup import op1_embedding_dedup
from .language_id import op7_language_id
from .license_scan import op3_license_scan
from .mixing import op6_mixing
from .ngram_join import ORACLE as JOIN_SQL
from .ngram_join import op10_ngram_jaccard_join
from .sstable import op2_token_shards
from .toxicity import op4_toxicity
from .warc_revisit import ORACLE as WARC_SQL
from .warc_revisit import op5_warc_revisit

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_warc_revisit": op5_warc_revisit,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_audio_features": op8_audio_features,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLES = {"op1_embedding_dedup": DEDUP_SQL, "op5_warc_revisit": WARC_SQL, "op10_ngram_jaccard_join": JOIN_SQL}

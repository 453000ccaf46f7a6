"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from inodelake.llm.ann import OP5_SQL, op5_nearest_neighbours
from inodelake.llm.idfiles import op3_token_ids
from inodelake.llm.langid import op9_language_id
from inodelake.llm.licenses import OP1_SQL, op1_license_scan
from inodelake.llm.lm_score import op2_lm_score
from inodelake.llm.mixing import OP10_SQL, op10_mixing
from inodelake.llm.ngram_join import OP6_SQL, op6_ngram_jaccard
from inodelake.llm.packing import op7_best_fit_packing
from inodelake.llm.vector_dedup import OP4_SQL, op4_vector_near_dedup
from inodelake.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_lm_score": op2_lm_score,
    "op3_token_ids": op3_token_ids,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
}
ORACLES = {"op1_license_scan": OP1_SQL, "op4_vector_near_dedup": OP4_SQL, "op5_nearest_neighbours": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lotwatch.llm.collocations import OP12_SQL, op12_phrase_collocations
from lotwatch.llm.fingerprints import op3_document_fingerprints
from lotwatch.llm.language_id import op5_language_id
from lotwatch.llm.nearest import op13_nearest_neighbours
from lotwatch.llm.near_duplicates import op8_minhash_near_dedup
from lotwatch.llm.packing import op9_best_fit_packing
from lotwatch.llm.quality_rules import OP4_SQL, op4_quality_rules
from lotwatch.llm.secret_scans import op6_secret_scans
from lotwatch.llm.sharding import op7_sharding
from lotwatch.llm.source_mixing import OP2_SQL, op2_source_mixing
from lotwatch.llm.token_counts import op1_token_counts
from lotwatch.llm.url_filters import op10_url_filters
from lotwatch.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_source_mixing, op3_document_fingerprints, op4_quality_rules, op5_language_id, op6_secret_scans, op7_sharding, op8_minhash_near_dedup, op9_best_fit_packing, op10_url_filters, op11_embedding_whitening, op12_phrase_collocations, op13_nearest_neighbours)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op2_source_mixing": OP2_SQL, "op4_quality_rules": OP4_SQL, "op12_phrase_collocations": OP12_SQL}

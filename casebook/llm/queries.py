"""The registered queries of this folder, and the SQL that gives the same rows."""

from __future__ import annotations

from casebook.llm.centroids import OP11_SQL, op11_centroid_clustering
from casebook.llm.chat import OP7_SQL, op7_chat_formatting
from casebook.llm.divergence import OP12_SQL, op12_source_divergence
from casebook.llm.fingerprints import op4_fingerprints
from casebook.llm.jaccard_join import op10_jaccard_join
from casebook.llm.packing import op1_best_fit_packing
from casebook.llm.personal import op13_personal_data
from casebook.llm.piece_codec import op2_sentencepiece
from casebook.llm.quality import OP5_SQL, op5_quality_rules
from casebook.llm.secrets import OP6_SQL, op6_secret_scans
from casebook.llm.token_files import op3_token_files
from casebook.llm.toxicity import op9_toxicity
from casebook.llm.url_filters import OP8_SQL, op8_url_filters

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_token_files, op4_fingerprints, op5_quality_rules, op6_secret_scans, op7_chat_formatting, op8_url_filters, op9_toxicity, op10_jaccard_join, op11_centroid_clustering, op12_source_divergence, op13_personal_data)}
ORACLES = {"op5_quality_rules": OP5_SQL, "op6_secret_scans": OP6_SQL, "op7_chat_formatting": OP7_SQL, "op8_url_filters": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_source_divergence": OP12_SQL}

"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .infill import OP13_SQL, op13_fill_in_middle
from .jaccard import op9_ngram_jaccard
from .licenses import OP1_SQL, op1_license_scan
from .mixing import OP4_SQL, op4_mixing
from .neardup_vectors import op6_embedding_neardup
from .packing import op12_best_fit_packing
from .search import op8_ann_search
from .store import op7_token_store
from .target_encoding import OP11_SQL, op11_target_encoding
from .toxicity import op2_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .warc import OP3_SQL, op3_warc

QUERIES = {"op1_license_scan": op1_license_scan, "op2_toxicity": op2_toxicity, "op3_warc": op3_warc, "op4_mixing": op4_mixing, "op5_byte_bpe": op5_byte_bpe, "op6_embedding_neardup": op6_embedding_neardup, "op7_token_store": op7_token_store, "op8_ann_search": op8_ann_search, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_url_filter": op10_url_filter, "op11_target_encoding": op11_target_encoding, "op12_best_fit_packing": op12_best_fit_packing, "op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op1_license_scan": OP1_SQL, "op3_warc": OP3_SQL, "op4_mixing": OP4_SQL, "op10_url_filter": OP10_SQL, "op11_target_encoding": OP11_SQL, "op13_fill_in_middle": OP13_SQL}

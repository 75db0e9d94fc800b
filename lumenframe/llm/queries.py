"""All queries of the subpackage and the SQL of those that SQL can express."""

from . import op1_token_counts, op2_warc, op3_quality_rules, op4_packing, op5_line_dedup, op6_mixing, op7_image_copies, op8_simhash, op9_token_store, op10_sentence_spans

MODULES = (op1_token_counts, op2_warc, op3_quality_rules, op4_packing, op5_line_dedup, op6_mixing, op7_image_copies, op8_simhash, op9_token_store, op10_sentence_spans)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}

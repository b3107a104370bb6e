"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from . import languages, minhash, mixing, packing, pages, secrets, spots, substrings, suffixes, topk

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_html_text": pages.op3_html_text,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_spot_fingerprints": spots.op8_spot_fingerprints,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_language_id": languages.op10_language_id,
}
SQL = {
    "op1_top_k": topk.OP1_SQL,
    "op2_substring_dedup": substrings.OP2_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_near_duplicates": minhash.OP7_SQL,
    "op9_suffix_dedup": suffixes.OP9_SQL,
}

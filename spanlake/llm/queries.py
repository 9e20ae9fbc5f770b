"""The operators' queries, each over its whole table with production parameters, and SQL for those it can express."""

from . import decontaminate, packing, pii, quality, sharding, simhash, suffix_tree, suffixes, toxicity, windows

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_reshard": sharding.op4_reshard,
    "op5_pii": pii.op5_pii,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_window_dedup": windows.op8_window_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {"op7_decontaminate": decontaminate.OP7_SQL, "op8_window_dedup": windows.OP8_SQL}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from brontide.llm import decontam, dialogs, fuzzyhash, langid, licenses, linededup, minhash, mixing, mpeg, pii, search, substrings, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_mpeg_audio": mpeg.op3_mpeg_audio,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_minhash_dedup": minhash.op5_minhash_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_pii": pii.op9_pii,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_wand_search": search.op11_wand_search,
    "op12_piecewise_hash": fuzzyhash.op12_piecewise_hash,
    "op13_conversation_repair": dialogs.op13_conversation_repair,
}

ORACLES = {
    "op2_decontamination": decontam.OP2_SQL,
    "op5_minhash_dedup": minhash.OP5_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_wand_search": search.OP11_SQL,
    "op13_conversation_repair": dialogs.OP13_SQL,
}

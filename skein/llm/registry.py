"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from skein.llm import bpe_codec, decontaminate, lang_id, licenses, neardup, oracles, quality, sharding, substrings, token_counts, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_bpe_codec": bpe_codec.op3_bpe_codec,
    "op4_language_id": lang_id.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_suffix_array_dedup": substrings.op6_suffix_array_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_warc": warc.op8_warc,
    "op9_minhash_neardup": neardup.op9_minhash_neardup,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)

"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillframe.llm import bpe, exact_dedup, language_id, merkle, mixing, quality, repeats, secrets, sharding, simhash, token_file, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_mixing": mixing.op2_mixing,
        "op3_repeats": repeats.op3_repeats,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language_id": language_id.op6_language_id,
        "op7_sharding": sharding.op7_sharding,
        "op8_simhash": simhash.op8_simhash,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_merkle": merkle.op11_merkle,
        "op12_token_file": token_file.op12_token_file,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_repeats": repeats.OP3_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op10_secret_scan": secrets.OP10_SQL, "op11_merkle": merkle.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}

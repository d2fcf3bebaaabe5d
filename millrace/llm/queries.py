"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import linededup, mixing, mpeg, packing, pfor, pii, simhash, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_pii": pii.op4_pii,
        "op5_warc": warc.op5_warc,
        "op6_mpeg": mpeg.op6_mpeg,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_topk": topk.op9_topk,
        "op10_token_files": pfor.op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.OP2_SQL, "op5_warc": warc.OP5_SQL, "op8_mixing": mixing.OP8_SQL, "op9_topk": topk.OP9_SQL}

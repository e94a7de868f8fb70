"""One query for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmlcut, langid, lexical, linedup, packing, pivots, probminhash, simhash, tokenfile, toxicity, urlcascade, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1,
        "op2_url_cascade": urlcascade.op2,
        "op3_pack": packing.op3,
        "op4_token_file": tokenfile.op4,
        "op5_near_dedup": probminhash.op5,
        "op6_vp_tree": vptree.op6,
        "op7_toxicity": toxicity.op7,
        "op8_main_text": htmlcut.op8,
        "op9_decontaminate": decontam.op9,
        "op10_line_dedup": linedup.op10,
        "op11_block_max": lexical.op11,
        "op12_hard_negatives": pivots.op12,
        "op13_simhash": simhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_cascade": urlcascade.OP2_SQL,
        "op9_decontaminate": decontam.OP9_SQL,
        "op11_block_max": lexical.OP11_SQL,
        "op12_hard_negatives": pivots.OP12_SQL,
    }

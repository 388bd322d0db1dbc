"""Queries of this subpackage and the SQL that expresses them, where SQL can."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, imatch, langid, licenses, merkle, neighbours, packing, quality, simhash, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_imatch": imatch.op2_imatch,
        "op3_quality": quality.op3_quality,
        "op4_simhash": simhash.op4_simhash,
        "op5_bpe": bpe.op5_bpe,
        "op6_licenses": licenses.op6_licenses,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_packing": packing.op8_packing,
        "op9_langid": langid.op9_langid,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_merkle": merkle.op11_merkle,
        "op12_alignment": alignment.op12_alignment,
        "op13_neighbours": neighbours.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL, "op10_suffix_dedup": suffix_dedup.SQL, "op11_merkle": merkle.SQL}

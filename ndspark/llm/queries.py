"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, langid, line_dedup, media, mixing, packing, pii, simhash, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_media": media.op2_media,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_langid": langid.op5_langid,
    "op6_pii": pii.op6_pii,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op9_warc": warc.SQL,
}

"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from . import ann, extract, licenses, mixing, neardup, pieces, quality, secrets, token_binary, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_token_binary": token_binary.op2_token_binary,
    "op3_warc": warc.op3_warc,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_html_extract": extract.op5_html_extract,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_minhash_dedup": neardup.op9_minhash_dedup,
    "op10_rabit_search": ann.op10_rabit_search,
}
SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op9_minhash_dedup": neardup.OP9_SQL,
    "op10_rabit_search": ann.OP10_SQL,
}

"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from tallyforge.llm.chat_views import OP6_SQL, op6_chat_views
from tallyforge.llm.filter_audit import OP12_SQL, op12_filter_audit
from tallyforge.llm.hash_search import op8_hash_search
from tallyforge.llm.lang_id import op5_lang_id
from tallyforge.llm.license_scan import OP11_SQL, op11_license_scan
from tallyforge.llm.lm_score import op1_lm_score
from tallyforge.llm.mixing import op2_mixing
from tallyforge.llm.multi_index import OP3_SQL, op3_multi_index
from tallyforge.llm.secret_scan import op9_secret_scan
from tallyforge.llm.simhash import op7_simhash
from tallyforge.llm.sp_codec import op4_sentencepiece, sentencepiece_unigram
from tallyforge.llm.warc import OP10_SQL, op10_warc
from tallyforge.llm.whitening import op13_whitening

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_mixing": op2_mixing,
    "op3_multi_index": op3_multi_index,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_lang_id": op5_lang_id,
    "op6_chat_views": op6_chat_views,
    "op7_simhash": op7_simhash,
    "op8_hash_search": op8_hash_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_warc": op10_warc,
    "op11_license_scan": op11_license_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
    "sentencepiece_unigram": sentencepiece_unigram,
}

ORACLE_SQL = {
    "op3_multi_index": OP3_SQL,
    "op6_chat_views": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op11_license_scan": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}

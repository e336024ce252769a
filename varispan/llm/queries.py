"""The operators' registered queries and their SQL counterparts."""

from __future__ import annotations

from . import decontaminate, langid, licences, mixing, neighbours, quality, simhash, suffixes, tokens, urlfilter

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_urlfilter": urlfilter.op2_urlfilter,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_licences": licences.op6_licences,
    "op7_langid": langid.op7_langid,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_tokens": tokens.op9_tokens,
    "op10_simhash": simhash.op10_simhash,
    "urls_redirected": urlfilter.redirected_urls,
}

SQL: dict[str, str] = {
    "op2_urlfilter": urlfilter.SQL,
    "urls_redirected": urlfilter.SQL_REDIRECTED,
    "op3_mixing": mixing.SQL,
    "op6_licences": licences.SQL,
}

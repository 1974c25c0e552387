"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import decontamination, flac, language, mixing, phrases, pii, quotes, repair, scoring, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_quotes": quotes.op3_quotes,
    "op4_language": language.op4_language,
    "op5_warc": warc.op5_warc,
    "op6_media": flac.op6_media,
    "op7_pii": pii.op7_pii,
    "op8_tokens": tokens.op8_tokens,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
    "op11_repair": repair.op11_repair,
    "op12_scoring": scoring.op12_scoring,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {"op3_quotes": quotes.OP3_SQL, "op5_warc": warc.OP5_SQL, "op10_mixing": mixing.OP10_SQL, "op11_repair": repair.OP11_SQL, "op13_phrases": phrases.OP13_SQL}

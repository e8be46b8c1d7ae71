"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from inkflow.llm.audit import OP12_SQL, op12_filter_audit
from inkflow.llm.decontaminate import OP4_SQL, op4_decontaminate
from inkflow.llm.language import op8_language
from inkflow.llm.licenses import op11_licenses
from inkflow.llm.merkle import OP13_SQL, op13_merkle
from inkflow.llm.mixing import OP3_SQL, op3_mix
from inkflow.llm.neardup_vectors import OP5_SQL, op5_vectors
from inkflow.llm.quality import op9_quality
from inkflow.llm.secrets import OP2_SQL, op2_secrets
from inkflow.llm.simhash import op7_simhash
from inkflow.llm.substrings import op6_substrings
from inkflow.llm.toxicity import op10_toxicity
from inkflow.llm.urls import OP1_SQL, op1_urls

QUERIES = {
    "op1_urls": op1_urls,
    "op2_secrets": op2_secrets,
    "op3_mix": op3_mix,
    "op4_decontaminate": op4_decontaminate,
    "op5_vectors": op5_vectors,
    "op6_substrings": op6_substrings,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_licenses": op11_licenses,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_urls": OP1_SQL,
    "op2_secrets": OP2_SQL,
    "op3_mix": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_vectors": OP5_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_merkle": OP13_SQL,
}

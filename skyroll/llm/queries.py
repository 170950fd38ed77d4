"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from skyroll.llm.binary_output import op9_binary_output
from skyroll.llm.collocations import ORACLE_OP11, op11_phrase_collocations
from skyroll.llm.decontamination import op7_decontamination
from skyroll.llm.exact_dedup import ORACLE_OP6, op6_exact_dedup
from skyroll.llm.jaccard_join import op4_jaccard_join
from skyroll.llm.langid import op8_language_id
from skyroll.llm.lexical_search import ORACLE_OP12, op12_lexical_search
from skyroll.llm.licenses import op2_license_scan
from skyroll.llm.packing import op1_best_fit_packing
from skyroll.llm.quality import op10_quality_rank
from skyroll.llm.simhash import op13_simhash_near_dedup
from skyroll.llm.tool_calls import ORACLE_OP3, op3_tool_calls
from skyroll.llm.toxicity import op5_toxicity


def queries():
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_license_scan": op2_license_scan,
        "op3_tool_calls": op3_tool_calls,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_language_id": op8_language_id,
        "op9_binary_output": op9_binary_output,
        "op10_quality_rank": op10_quality_rank,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_lexical_search": op12_lexical_search,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_tool_calls": ORACLE_OP3, "op6_exact_dedup": ORACLE_OP6,
            "op11_phrase_collocations": ORACLE_OP11, "op12_lexical_search": ORACLE_OP12}

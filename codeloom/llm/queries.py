"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from codeloom.llm.bpe import op6_bpe
from codeloom.llm.decontamination import op3_decontamination
from codeloom.llm.langid import op10_langid
from codeloom.llm.language_model import op5_language_model
from codeloom.llm.neardup import op4_neardup
from codeloom.llm.pii import op8_pii
from codeloom.llm.repetition import op2_repetition
from codeloom.llm.rollup import ORACLE as ROLLUP_SQL
from codeloom.llm.rollup import op7_rollup
from codeloom.llm.secrets import op9_secrets
from codeloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_repetition": op2_repetition,
    "op3_decontamination": op3_decontamination,
    "op4_neardup": op4_neardup,
    "op5_language_model": op5_language_model,
    "op6_bpe": op6_bpe,
    "op7_rollup": op7_rollup,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_langid": op10_langid,
}

ORACLES: dict[str, str] = {"op7_rollup": ROLLUP_SQL}

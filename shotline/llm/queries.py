"""The registered queries of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from shotline.llm.encoding import op9_encoding
from shotline.llm.fingerprints import op3_fingerprints
from shotline.llm.near_duplicates import op7_near_duplicates
from shotline.llm.packing import op6_packing
from shotline.llm.pii import op10_pii
from shotline.llm.quality_rules import OP8_SQL, op8_quality_rules
from shotline.llm.quality_vote import op2_quality_vote
from shotline.llm.token_counts import op4_token_counts
from shotline.llm.token_files import op5_token_files
from shotline.llm.toxicity import op1_toxicity

_ALL = (
    op1_toxicity, op2_quality_vote, op3_fingerprints, op4_token_counts, op5_token_files,
    op6_packing, op7_near_duplicates, op8_quality_rules, op9_encoding, op10_pii,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op8_quality_rules": OP8_SQL}

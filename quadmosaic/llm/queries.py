"""The queries of the text operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from quadmosaic.llm.decontam import OP5_SQL, op5_decontam
from quadmosaic.llm.divergence import OP13_SQL, op13_divergence
from quadmosaic.llm.langid import op4_langid
from quadmosaic.llm.license_scan import OP2_SQL, op2_license_scan
from quadmosaic.llm.line_dedup import OP6_SQL, op6_line_dedup
from quadmosaic.llm.packing import op3_packing
from quadmosaic.llm.pii import op8_pii
from quadmosaic.llm.quality_pu import op10_quality_pu
from quadmosaic.llm.quality_rules import ABLATIONS_SQL, OP1_SQL, op1_quality_rules, rule_ablations
from quadmosaic.llm.simhash import op9_simhash
from quadmosaic.llm.spelling import op11_spelling
from quadmosaic.llm.tokens import op12_tokens
from quadmosaic.llm.toxicity import op7_toxicity

_FUNCTIONS = (
    op1_quality_rules, op2_license_scan, op3_packing, op4_langid, op5_decontam, op6_line_dedup, op7_toxicity, op8_pii, op9_simhash, op10_quality_pu,
    op11_spelling, op12_tokens, op13_divergence, rule_ablations,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL, "op2_license_scan": OP2_SQL, "op5_decontam": OP5_SQL, "op6_line_dedup": OP6_SQL, "op13_divergence": OP13_SQL, "rule_ablations": ABLATIONS_SQL,
}

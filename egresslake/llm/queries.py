"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from egresslake.llm.brown import op6_brown_scores
from egresslake.llm.collocations import OP12_SQL, op12_collocations
from egresslake.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from egresslake.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from egresslake.llm.fingerprints import op4_fingerprints
from egresslake.llm.line_dedup import op2_line_dedup
from egresslake.llm.mixing import OP1_SQL, op1_curriculum_mix
from egresslake.llm.ngram_join import op5_ngram_join
from egresslake.llm.pii import op10_pii
from egresslake.llm.range_join import OP13_SQL, op13_embedding_dedup
from egresslake.llm.secrets import op3_secret_scan
from egresslake.llm.sentencepieces import op7_sentencepiece
from egresslake.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_curriculum_mix": op1_curriculum_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_ngram_join": op5_ngram_join,
    "op6_brown_scores": op6_brown_scores,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_collocations": op12_collocations,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLE_SQL = {
    "op1_curriculum_mix": OP1_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}

"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline

from . import op1_quality_rules as op1
from . import op2_minhash_dedup as op2
from . import op3_quality_classifier as op3
from . import op4_token_counts as op4
from . import op5_warc as op5
from . import op6_decontaminate as op6
from . import op7_shards as op7
from . import op8_licenses as op8
from . import op9_mix as op9
from . import op10_lm_score as op10
from . import op11_secrets as op11
from . import op12_conversations as op12
from . import op13_merkle as op13

QUERIES = {
    "op1_quality_rules": op1.op1_quality_rules,
    "op2_minhash_dedup": op2.op2_minhash_dedup,
    "op3_quality_classifier": op3.op3_quality_classifier,
    "op4_token_counts": op4.op4_token_counts,
    "op5_warc": op5.op5_warc,
    "op6_decontaminate": op6.op6_decontaminate,
    "op7_shards": op7.op7_shards,
    "op8_licenses": op8.op8_licenses,
    "op9_mix": op9.op9_mix,
    "op10_lm_score": op10.op10_lm_score,
    "op11_secrets": op11.op11_secrets,
    "op12_conversations": op12.op12_conversations,
    "op13_merkle": op13.op13_merkle,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_quality_rules": op1.ORACLE,
    "op2_minhash_dedup": op2.ORACLE,
    "op5_warc": op5.ORACLE,
    "op9_mix": op9.ORACLE,
    "op11_secrets": op11.ORACLE,
    "op12_conversations": op12.ORACLE,
    "op13_merkle": op13.ORACLE,
}

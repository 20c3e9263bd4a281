"""The queries of this folder, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tidecue.llm.decontam import op1_decontaminate
from tidecue.llm.html import op8_html_text
from tidecue.llm.linededup import op2_line_dedup
from tidecue.llm.lmscore import op9_lm_scores
from tidecue.llm.mixing import OP10_SQL, op10_mix_sources
from tidecue.llm.quality import op7_quality_rules
from tidecue.llm.secrets import op3_secret_scan
from tidecue.llm.sharding import op5_kd_shards
from tidecue.llm.simhash import op6_simhash_groups
from tidecue.llm.tokens import op4_token_counts

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_kd_shards": op5_kd_shards,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_lm_scores": op9_lm_scores,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL = {
    "op10_mix_sources": OP10_SQL,
}

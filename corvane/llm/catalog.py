"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from corvane.llm.chat import op3_chat_windows
from corvane.llm.decontaminate import op10_decontaminate
from corvane.llm.kneser_ney import op4_perplexity
from corvane.llm.minhash import op7_near_duplicates
from corvane.llm.mixing import OP5_SQL, op5_mix_sources
from corvane.llm.secrets import op2_secret_scan
from corvane.llm.suffix import op9_repeated_passages
from corvane.llm.toxicity import op6_toxicity
from corvane.llm.urls import op8_url_templates
from corvane.llm.vafile import OP1_SQL, op1_exact_top_k

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_secret_scan,
        op3_chat_windows,
        op4_perplexity,
        op5_mix_sources,
        op6_toxicity,
        op7_near_duplicates,
        op8_url_templates,
        op9_repeated_passages,
        op10_decontaminate,
    )
}
SQL = {"op1_exact_top_k": OP1_SQL, "op5_mix_sources": OP5_SQL}

"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from simgate.llm.bpe_codec import op4_bpe_codec
from simgate.llm.collocations import OP11_SQL, op11_collocations
from simgate.llm.flac_media import op1_flac_media
from simgate.llm.language import op5_language_rank
from simgate.llm.near_dedup import OP7_SQL, op7_minmax_dedup
from simgate.llm.pii import op6_pii_surrogates
from simgate.llm.quality import op8_mil_quality
from simgate.llm.suffix_dedup import op10_suffix_dedup
from simgate.llm.token_count import op2_token_count
from simgate.llm.token_files import op9_token_files
from simgate.llm.toxicity import op12_pu_toxicity
from simgate.llm.variants import op13_spelling_variants
from simgate.llm.winnowing import OP3_SQL, op3_winnowing

QUERIES = {
    "op1_flac_media": op1_flac_media,
    "op2_token_count": op2_token_count,
    "op3_winnowing": op3_winnowing,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_language_rank": op5_language_rank,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_minmax_dedup": op7_minmax_dedup,
    "op8_mil_quality": op8_mil_quality,
    "op9_token_files": op9_token_files,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_pu_toxicity": op12_pu_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op3_winnowing": OP3_SQL, "op7_minmax_dedup": OP7_SQL, "op11_collocations": OP11_SQL}

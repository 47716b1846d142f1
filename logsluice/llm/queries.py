"""The registered queries of this subpackage, and DuckDB SQL where SQL can state them."""

from .bpe import op12_bpe
from .dac import op7_token_files
from .decontaminate import op8_decontamination
from .digest import op9_digest
from .html import op2_html
from .packing import op10_packing
from .periodic import op11_runs
from .quality import op1_quality
from .rollup import op3_token_counts
from .secrets import op4_secrets
from .sentences import op5_sentences
from .simhash import op6_simhash
from .trie import op13_trie

QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_token_counts": op3_token_counts,
    "op4_secrets": op4_secrets,
    "op5_sentences": op5_sentences,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_digest": op9_digest,
    "op10_packing": op10_packing,
    "op11_runs": op11_runs,
    "op12_bpe": op12_bpe,
    "op13_trie": op13_trie,
}
ORACLES: dict[str, str] = {}

"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from .bitslice import OP6_SQL, op6_topk
from .decontam import op4_decontamination
from .divergence import OP13_SQL, op13_divergence
from .html_text import op8_html
from .packing import op3_packing
from .quality import op9_quality
from .repeats import op10_repeats
from .secrets import op7_secrets
from .sharding import op2_sharding
from .simhash import op1_simhash
from .toxicity import op5_toxicity
from .trie import OP11_SQL, op11_trie
from .warc import OP12_SQL, op12_warc

QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_packing": op3_packing, "op4_decontamination": op4_decontamination, "op5_toxicity": op5_toxicity, "op6_topk": op6_topk, "op7_secrets": op7_secrets, "op8_html": op8_html, "op9_quality": op9_quality, "op10_repeats": op10_repeats, "op11_trie": op11_trie, "op12_warc": op12_warc, "op13_divergence": op13_divergence}
ORACLES: dict[str, str] = {"op6_topk": OP6_SQL, "op11_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_divergence": OP13_SQL}

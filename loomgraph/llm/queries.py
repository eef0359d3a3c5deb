"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm.ann import op4_nearest_neighbours
from loomgraph.llm.decontaminate import OP1_SQL, op1_decontamination
from loomgraph.llm.fim import OP12_SQL, op12_fill_in_middle
from loomgraph.llm.html_extract import op3_html_extraction
from loomgraph.llm.lang_id import op8_language_id
from loomgraph.llm.line_dedup import OP2_SQL, op2_line_dedup
from loomgraph.llm.mixing import op10_mixing
from loomgraph.llm.ngram_join import op5_ngram_jaccard_join
from loomgraph.llm.secrets import op9_secret_scan
from loomgraph.llm.simhash import op13_simhash
from loomgraph.llm.token_rans import op6_token_output
from loomgraph.llm.toxicity import op7_toxicity
from loomgraph.llm.whitening import op11_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_output": op6_token_output,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash": op13_simhash,
}

ORACLES = {"op1_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op12_fill_in_middle": OP12_SQL}

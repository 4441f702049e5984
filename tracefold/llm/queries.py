"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op3_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .lm_scoring import op2_lm_scoring
from .merkle import OP13_SQL, op13_merkle
from .mixing import OP11_SQL, op11_mixing
from .neighbours import op9_neighbours
from .packing import op6_packing
from .pii import op5_pii
from .quality import op8_quality
from .simhash import op1_simhash
from .token_counts import op10_token_counts
from .token_files import op4_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_token_counts": op10_token_counts,
    "op11_mixing": op11_mixing,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op3_decontamination": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM documents),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM dw),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM iw),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles,
       count(*)::DOUBLE / any_value(item_shingles) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles) - 1e-9""",
    "op11_mixing": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_merkle": OP13_SQL,
}

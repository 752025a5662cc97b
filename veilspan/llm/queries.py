"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import substring_dedup, warc
from .decontamination import op2_decontamination
from .lm_scoring import op5_lm_scoring
from .mixing import op1_mixing
from .mpegts import op3_mpegts
from .near_dedup import op8_near_dedup
from .secrets import op6_secrets
from .substring_dedup import op10_substring_dedup
from .token_counts import op7_token_counts
from .toxicity import op4_toxicity
from .warc import op9_warc

_ALL = (
    op1_mixing, op2_decontamination, op3_mpegts, op4_toxicity, op5_lm_scoring,
    op6_secrets, op7_token_counts, op8_near_dedup, op9_warc, op10_substring_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
#: The others have no SQL form: knapsack, automata, media, learned models, tokenizers and signatures; tests hold them
#: against plain versions.
SQL: dict[str, str] = {"op9_warc": warc.SQL, "op10_substring_dedup": substring_dedup.SQL}

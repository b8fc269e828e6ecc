"""The registered queries of the numbered operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import op1_sharding as op1
from . import op2_chat_formatting as op2
from .op1_sharding import op1_sharding
from .op2_chat_formatting import op2_chat_formatting
from . import op3_topk_search as op3
from . import op5_warc as op5
from .op3_topk_search import op3_topk_search
from .op4_simhash_dedup import op4_simhash_dedup
from .op5_warc import op5_warc
from .op6_language_id import op6_language_id
from .op7_decontamination import op7_decontamination
from .op8_suffix_dedup import op8_suffix_dedup
from .op9_packing import op9_packing
from .op10_substring_dedup import op10_substring_dedup
from . import op12_conversation_repair as op12
from . import op13_collocations as op13
from .op11_fingerprints import op11_fingerprints
from .op12_conversation_repair import op12_conversation_repair
from .op13_collocations import op13_collocations

QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_chat_formatting, op3_topk_search, op4_simhash_dedup, op5_warc, op6_language_id, op7_decontamination, op8_suffix_dedup, op9_packing, op10_substring_dedup, op11_fingerprints, op12_conversation_repair, op13_collocations)
}
ORACLES: dict[str, str] = {"op1_sharding": op1.ORACLE, "op2_chat_formatting": op2.ORACLE, "op3_topk_search": op3.ORACLE, "op5_warc": op5.ORACLE, "op12_conversation_repair": op12.ORACLE, "op13_collocations": op13.ORACLE}

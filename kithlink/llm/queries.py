"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from kithlink.llm.decontaminate import op1_decontamination
from kithlink.llm.html_text import op3_html_text
from kithlink.llm.media import op9_media
from kithlink.llm.near_dups import op7_near_dups
from kithlink.llm.packing import op5_packing
from kithlink.llm.quality import op4_quality
from kithlink.llm.suffix_dedup import op6_suffix_dedup
from kithlink.llm.token_files import op10_token_files
from kithlink.llm.toxicity import op8_toxicity
from kithlink.llm.warc import OP2_SQL, op2_warc


def queries() -> dict:
    found = (op1_decontamination, op2_warc, op3_html_text, op4_quality, op5_packing, op6_suffix_dedup, op7_near_dups, op8_toxicity, op9_media, op10_token_files)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL}

"""Queries of this package and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .chat import op9_chat
from .decontaminate import OP2_SQL, op2_decontamination
from .langid import op6_language
from .licenses import op8_licenses
from .media import op10_media
from .quality import op3_quality
from .secrets import op7_secrets
from .simhash import op1_simhash
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_quality, op4_toxicity, op5_bpe, op6_language, op7_secrets, op8_licenses, op9_chat, op10_media)}
ORACLE_SQL = {"op2_decontamination": OP2_SQL}

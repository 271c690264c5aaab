"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, collocations, licenses, merkle, warc
from .chat import op7_chat_snapshots
from .collocations import op11_collocations
from .forest import op2_forest
from .languages import op5_languages
from .licenses import op10_license_digests
from .media import op1_webp
from .merkle import op13_merkle
from .near_copies import op4_bagminhash
from .packing import op8_pack
from .ppm import op9_ppm
from .sentence_pieces import op6_sentencepiece
from .suffixes import op3_suffix_dedup
from .warc import op12_warc

QUERIES = {f.__name__: f for f in (op1_webp, op2_forest, op3_suffix_dedup, op4_bagminhash, op5_languages, op6_sentencepiece, op7_chat_snapshots, op8_pack, op9_ppm, op10_license_digests, op11_collocations, op12_warc, op13_merkle)}
ORACLES = {"op7_chat_snapshots": chat.ORACLE, "op10_license_digests": licenses.ORACLE, "op11_collocations": collocations.ORACLE, "op12_warc": warc.ORACLE, "op13_merkle": merkle.ORACLE}

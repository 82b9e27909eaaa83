"""The queries of this subpackage and their SQL twins."""

from cellgauge.llm import bpe, chat, decontam, langid, licenses, lines, middle, quality, repeats, resample, simhash, toxicity, wrappers  # noqa: F401
from cellgauge.llm.common import ORACLES, QUERIES  # noqa: F401

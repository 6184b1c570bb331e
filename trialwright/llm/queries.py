"""All queries of the document operators."""

from trialwright.llm import decontaminate, jaccard, lines, packing, periodic, phrases, pii, quality, resample, simhash, store, suffixes, toxicity  # noqa: F401
from trialwright.llm.registry import ORACLES, QUERIES  # noqa: F401

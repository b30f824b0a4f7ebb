"""The queries of this subpackage; importing the operators registers them."""

from holdfast.llm import audit, bpe, jaccard, licenses, lm, packing, phrases, quality, search, secrets, sharding, toxicity, urls  # noqa: F401
from holdfast.llm.registry import ORACLES, QUERIES  # noqa: F401

"""All queries of the subpackage, the corpus pipeline included."""

from __future__ import annotations

import importlib

import corpus_pipeline
from murmur.llm.common import ORACLES, QUERIES

MODULES = ("sharding", "quality", "urls", "simhash", "packing", "toxicity", "mixing", "extraction", "neighbours", "secrets", "lines", "codes", "alignment")

for _name in MODULES:
    importlib.import_module(f"murmur.llm.{_name}")

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

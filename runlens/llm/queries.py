"""All queries of this package; importing the modules registers them."""

from __future__ import annotations

from runlens.llm import (
    decontamination,
    extraction,
    licences,
    linededup,
    mixing,
    periodic,
    quality_cnn,
    quality_rules,
    revisits,
    simhash,
    suffixdedup,
    toxicity,
    whitening,
)
from runlens.llm.common import CHECKS, QUERIES

__all__ = [
    "CHECKS",
    "QUERIES",
    "decontamination",
    "extraction",
    "licences",
    "linededup",
    "mixing",
    "periodic",
    "quality_cnn",
    "quality_rules",
    "revisits",
    "simhash",
    "suffixdedup",
    "toxicity",
    "whitening",
]

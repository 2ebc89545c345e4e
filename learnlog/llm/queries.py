"""Registered queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from learnlog.llm import (chat_format, decontamination, fingerprints, hardneg, language, licenses, neardup,
                          packing, prefixtrie, repeats, sharding, toxicity, urlfilter)

MODULES = (fingerprints, decontamination, toxicity, chat_format, neardup, repeats, language,
           sharding, licenses, packing, urlfilter, hardneg, prefixtrie)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}

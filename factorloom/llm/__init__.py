"""Training-data operators: chat formatting, packing, joins, archives, extraction, scoring.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` in
``factorloom.llm.catalog`` list what the driver entry registers.
"""

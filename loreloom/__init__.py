"""loreloom: a Spark-native engine for conversational knowledge bases.

The core covers ingest, path queries, retrieval, incremental maintenance, event
folding and nested/history/diff operators.  ``loreloom.llm`` is an optional
subpackage for corpus work; nothing in the core imports it.
"""

__version__ = "0.1.0"

"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers
``copyledger.llm.queries`` only where the subpackage is present.
"""

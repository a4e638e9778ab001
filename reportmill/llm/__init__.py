"""Training-data operators: counting, encoding, deduplicating, filtering and mixing text.

Nothing outside this subpackage imports it. Operators take and return DataFrames; the
``opN_`` queries in :mod:`reportmill.llm.queries` are thin wrappers over them.
"""

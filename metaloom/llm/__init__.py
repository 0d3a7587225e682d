"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module keeps a general
operator; the thin ``opN_*`` queries live in ``metaloom.llm.queries``.
"""

"""Operators for building language-model training corpora.

Every module holds one operator with a general interface and a thin
``opN_<name>(spark, sf_dir)`` query; :mod:`loomlens.llm.registry` lists them.
"""

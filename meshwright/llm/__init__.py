"""Operators for preparing training corpora at scale.

``meshwright.llm.queries`` registers one query per operator. Nothing outside
this package imports it.
"""

"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries`` registers one thin query per
operator; the operators themselves live in one module each.
"""

"""Operators for preparing language-model training data at scale.

Everything in this subpackage is optional: the rest of the library never imports it.
"""

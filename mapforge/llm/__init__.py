"""Operators for preparing large text corpora.

The subpackage is self-contained: nothing else in the library imports it.
"""

"""Corpus operators: names, splitting, tokenizing, packing, text quality.

The subpackage is optional: nothing outside it imports it.
"""

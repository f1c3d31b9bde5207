"""Operators for preparing training corpora.  Nothing else in the library imports this subpackage.

Modules are imported on demand so that a Python worker loads only the operator that it runs.
"""

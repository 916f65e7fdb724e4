"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Every operator is a function of DataFrames; scratch tables
that cut lineage or are read twice go to the shared folder given by :func:`siftwell.sources.scratch.scratch`.
"""

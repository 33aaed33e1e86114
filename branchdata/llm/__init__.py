"""Operators of a training-data pipeline at corpus scale.

Nothing else in the library imports this subpackage; its queries are in
``branchdata.llm.queries`` and its pipeline in ``corpus_pipeline.py``.
"""

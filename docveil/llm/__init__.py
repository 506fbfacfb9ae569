"""Operators for building training corpora.

Nothing else in the library imports this subpackage; ``queries()`` and
``oracle_sql()`` of :mod:`docveil.llm.queries` are picked up by
``__spark_entry__.py`` if the subpackage is there.
"""

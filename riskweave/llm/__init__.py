"""Operators for preparing large training corpora.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when the folder is present.
"""

"""Lodeworks: a Spark-native engine for entity snapshots, audit trails and training text.

The core (``operators``, ``sources``, ``functions``, ``plans``, ``streaming``) never
imports ``lodeworks.llm``; that subpackage may be removed without touching the rest.
"""

__version__ = "0.1.0"

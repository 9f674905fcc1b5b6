"""Operators of a training-data pipeline; nothing else imports this package.

One module per operator, ``queries`` registers them, ``corpus_pipeline.py``
at the repository top chains five of them.
"""

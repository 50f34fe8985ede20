"""Evaluation analytics for text-safety classifiers, expressed as Spark jobs.

Two logical tables drive everything: ``requests`` (labelled prompts) and
``responses`` (one verdict per request, model and iteration).  Every operator
is a ``DataFrame -> DataFrame`` function; pairing is always by key.
"""

__version__ = "0.1.0"

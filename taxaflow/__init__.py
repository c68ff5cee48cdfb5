"""Trend analytics for species occurrence records, written as Spark jobs.

Every operator takes and returns a ``DataFrame`` and carries group keys
(taxon, model, geography), so one job serves all groups at once.  All of them
can be chained with ``DataFrame.transform``.
"""

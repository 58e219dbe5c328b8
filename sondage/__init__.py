"""sondage: questionnaire analytics expressed as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); heavy work is a Spark aggregation, join or window, and the
only Python that runs inside tasks is Arrow-batched math over already
aggregated rows.
"""

__version__ = "0.1.0"

"""sparkmill: fine-tuning data preparation as Spark DataFrame and Structured Streaming jobs.

Subpackages: ``functions`` (column expressions), ``sources`` (readers, writers,
tables), ``operators`` (cleaning, sections, formatting, tokens, ordinals,
limits, registry), ``plans`` (pipeline compiler, lifecycle flows, registered
queries and their oracles), ``streaming`` (metric/control streams, keyed-state
limiter, cleaning stream).
"""

__version__ = "0.1.0"

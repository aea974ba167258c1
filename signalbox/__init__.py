"""signalbox: cost-aware model routing as Spark jobs.

A *panel* is a DataFrame with one row per query and an array column ``cells`` of
``struct<model, ...>`` sorted by model name.  Everything that concerns a single
query (reward, argmax, softmax, margins, pair losses) is a row-local projection
over that array and never shuffles; only statements across queries aggregate.
"""

__version__ = "0.1.0"

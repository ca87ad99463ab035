"""sparkloom: a Spark-first engine for knowledge retrieval over document corpora.

Every operator takes and returns DataFrames, so Catalyst plans the whole job;
nothing here keeps rows on the driver. ``sparkloom.llm`` holds training-data
operators and is a leaf: no other module imports it.
"""

__version__ = "0.1.0"

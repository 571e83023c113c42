"""fieldloom: space-time geostatistics on Spark, with a training-data toolbox beside it.

The geostatistics live in ``operators``, ``functions``, ``plans``, ``sources`` and
``streaming``.  Nothing in them imports the ``llm`` subpackage.
"""

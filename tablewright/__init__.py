"""Spark-native toolkit for tabular machine-learning data work.

Every operator takes Spark DataFrames and returns Spark DataFrames (or a small
fitted object whose ``transform`` does).  Sub-packages:

``sources``    tables, prediction tables, file listings, models, experience store
``operators``  profiling, cleaning, encoding, splitting, metrics, models, roll-ups
``functions``  column helpers shared by the operators
``plans``      the training loop and the registered queries with their SQL twins
"""

__version__ = "0.1.0"

"""quillwork: a Spark-native engine for building, auditing and ranking evidence tables.

Sub-packages: ``sources`` (readers, writers), ``functions`` (column expressions and
numerics), ``operators`` (DataFrame in, DataFrame out), ``plans`` (named queries with
their SQL) and ``streaming`` (incremental and Structured Streaming operators).
"""

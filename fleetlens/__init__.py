"""fleetlens: Spark jobs that explain what a distributed training fleet is doing.

Layout
------
``sources``    text, CSV, JSON and table readers, plus the report writers
``functions``  column expressions (parsing, topology arithmetic, alert fields)
``operators``  DataFrame -> DataFrame jobs (slow ranks, hangs, timing, links, alerts, rules)
``plans``      shared physical-plan helpers (hot-key splitting, exact quantiles, lineage cuts)
``streaming``  Structured Streaming twins of the live detectors
``catalog``    the registered queries and their SQL oracles
"""

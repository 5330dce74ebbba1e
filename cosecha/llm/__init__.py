"""Operations of a large-scale training-data pipeline, as Spark jobs.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the driver's tables.  Nothing
outside this subpackage imports it.
"""

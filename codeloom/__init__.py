"""codeloom: a PySpark engine that turns source trees into curated function corpora.

``functions``  Column -> Column text rules
``operators``  DataFrame -> DataFrame steps
``sources``    readers and writers
``plans``      whole jobs and the registered queries
``streaming``  resumable ingest
"""

"""labelweave: preparing labelled texts and judging classifiers, as Spark DataFrame jobs.

``functions``  column expressions (cleaning, hashing, array arithmetic)
``operators``  DataFrame -> DataFrame operators
``sources``    readers and writers
``plans``      whole pipelines built from the operators
``streaming``  the row-wise operators applied to streams
"""

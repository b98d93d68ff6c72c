"""Housing and neighbourhood analytics written with Spark DataFrames.

The layers, from the inside out:

* ``functions`` - column expressions (distances, address text, feature arrays)
* ``operators`` - DataFrame building blocks (radius join, prefix join, numbering,
  merge, filters, profiles, quality checks)
* ``sources``   - readers and writers for the feeds the jobs use
* ``plans``     - the jobs: walkability, violations, amenities, transit, saved
  listings, property intake and summaries
* ``streaming`` - Structured Streaming versions of the two incremental jobs
* ``catalog``   - every registered query over the given tables, with its SQL twin
"""

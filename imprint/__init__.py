"""imprint: a Spark-native engine for media fingerprints, near-duplicate groups and
capture-time organise plans.  Every operator takes DataFrames and returns DataFrames.

Subpackages
-----------
sources     listing, image decode, EXIF headers, the versioned fingerprint index
functions   column builders (Hamming distance, hex, capture time, names, sizes, dims)
operators   fingerprints, Hamming joins, greedy grouping, index reconciliation, ranking
plans       organise plan, group rename / undo plans, summaries
streaming   incremental fingerprint ingest with Structured Streaming
"""

__version__ = "0.1.0"

"""wordloom: text analytics over Spark DataFrames.

Every operator takes DataFrames and returns DataFrames with explicit key
columns.  Sub-packages:

* ``sources``   reading and writing texts and tables
* ``functions`` column expressions (no shuffle, no state)
* ``operators`` DataFrame operators: cleaning, tokens, counting, ranking,
  pairs, tf-idf, smoothing, document-term matrices, topics, clusters
* ``plans``     named analyses composed from the operators
"""

__version__ = "0.1.0"

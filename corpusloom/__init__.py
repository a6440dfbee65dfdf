"""corpusloom: bilingual (English/French) sentence-pair curation and translator evaluation on Spark.

Layout:
  functions/  row-local Column expressions (text checks and repairs, accent stripping, cosines)
  operators/  DataFrame operators: gates, accent vocabulary, profiling, evaluation, preparation,
              sampling, plug-ins for external models, distributed ordinals and exact percentiles
  sources/    readers and writers (Parquet pair tables, JSON-lines corpora, CSV scores, text reports)
  plans/      the curation stage chain, evaluation tables, registered queries and their SQL oracles
  streaming/  the row-local part of the chain on a file stream
"""

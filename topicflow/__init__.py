"""topicflow: topic-model corpus preparation, topic extraction, coherence
scoring and run analytics as Spark DataFrame jobs.

Layout
  sources/    readers and writers (corpora, tokenised datasets, topic files, run records)
  functions/  Column -> Column expressions (text normalisation, tokenisers, stop words)
  operators/  DataFrame -> DataFrame operators (vocabularies, topics, coherence, results)
  plans/      composed jobs (corpus preparation, topic pipelines, trainer grid)
  streaming/  Structured Streaming entry for incremental corpus preparation
"""

__version__ = "0.1.0"

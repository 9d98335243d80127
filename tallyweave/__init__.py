"""tallyweave: Spark-first analytics over ledgers, record graphs and text corpora."""

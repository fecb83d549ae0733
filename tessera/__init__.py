"""tessera: a Spark-first analytics engine for agent knowledge stores."""

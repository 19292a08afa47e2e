"""fintally: document-derived financial facts to verified numbers, as Spark DataFrame jobs."""

"""Document-form analytics expressed as Spark DataFrame and SQL plans."""

"""fathomline: contract-impact analytics expressed as Spark DataFrame and SQL plans."""

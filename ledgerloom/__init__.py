"""Document and invoice analytics expressed as Spark DataFrame jobs."""

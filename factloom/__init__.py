"""factloom: evidence-backed facts from document text, as Spark DataFrame jobs."""

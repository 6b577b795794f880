"""quillstone: evidence-grounded document analytics as Spark DataFrame operators."""

"""Detection and pseudonymisation of personal data in text, as Spark DataFrame operators."""

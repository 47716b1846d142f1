"""Log triage and analytics as Spark DataFrame operators."""

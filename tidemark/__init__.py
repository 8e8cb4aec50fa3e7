"""Media timeline, transcript and registry analytics as Spark DataFrame operators."""

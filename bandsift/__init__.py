"""Radio-spectrum analytics as Spark DataFrame operators."""

"""cairn: object-store analytics as Spark DataFrame plans."""

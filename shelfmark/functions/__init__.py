"""Column expressions: DataFrame-free, evaluated inside the JVM."""

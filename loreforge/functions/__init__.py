"""Column functions: text, vectors, dates. All stay in the JVM."""

"""Column expressions. All of them stay inside the JVM: no Python runs per row."""

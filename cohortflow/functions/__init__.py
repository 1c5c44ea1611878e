"""Column expressions (JVM-side) plus the small p-value tail helper."""

"""Column helpers: each takes Columns and returns a Column, all JVM-side."""

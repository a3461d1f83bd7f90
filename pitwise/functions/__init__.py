"""Column-expression factories (JVM-side, inside whole-stage codegen)."""

"""Column expressions built from ``pyspark.sql.functions`` only (JVM-side,
inside whole-stage codegen): dates, flags, labels and dataset names."""

"""tallygrove: user-level lakehouse analytics operators written on the Spark DataFrame API."""

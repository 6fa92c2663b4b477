"""Format parsers: plain functions of bytes, without Spark."""

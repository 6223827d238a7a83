"""Instruction-tuning data preparation and auditing as Spark DataFrame plans."""

"""Recitation analytics on Spark: plain DataFrame jobs over recordings, texts and practice history."""

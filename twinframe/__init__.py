"""Paired-sequence and paired-vector analytics on Spark DataFrames."""

# Neutral names of the three classes.
CLASS_NAMES = {0: "low", 1: "mid", 2: "high"}
CLASSES = tuple(CLASS_NAMES)

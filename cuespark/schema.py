"""Table shapes. Order is explicit: ``event_id`` rises with time."""

from __future__ import annotations

from pyspark.sql import types as T

_TOKENS = T.ArrayType(T.StringType())
CORPUS = T.StructType().add("doc_id", T.LongType()).add("line_no", T.LongType()).add("text", T.StringType())
EVENTS = T.StructType().add("event_id", T.LongType()).add("cues", _TOKENS).add("outcomes", _TOKENS)
ENCODED = T.StructType().add("event_id", T.LongType()).add("cue_ids", T.ArrayType(T.IntegerType())).add("outcome_ids", T.ArrayType(T.IntegerType()))
WEIGHTS = T.StructType().add("outcome", T.StringType()).add("cue", T.StringType()).add("weight", T.DoubleType())
VECTORS = T.StructType().add("label", T.StringType()).add("vec", T.ArrayType(T.DoubleType()))
COUNTER = T.StructType().add("key", T.StringType()).add("freq", T.LongType())

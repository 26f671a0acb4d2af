"""Schemas of the memory graph and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


NODES = _of(
    ("id", _S), ("label", _S), ("labels", T.ArrayType(_S)), ("text", _S), ("summary", _S), ("name", _S), ("name_norm", _S), ("occurred_at", _TS),
    ("valid_from", _TS), ("valid_until", _TS), ("tx_from", _TS), ("tx_until", _TS), ("forgotten_at", _TS), ("valid_horizon", _TS), ("content_vec", T.ArrayType(T.FloatType())),
)
EDGES = _of(("type", _S), ("src_id", _S), ("dst_id", _S), ("strength", _D), ("confidence", _D), ("signals", T.ArrayType(_S)), ("provenance", T.ArrayType(_S)), ("count", _L), ("created_at", _TS), ("valid_until", _TS))
TURN = _of(("role", _S), ("text", _S), ("occurred_at", _TS))
TOOL = _of(("tool", _S), ("input", _S), ("status", _S), ("output", _S), ("duration_ms", _L), ("occurred_at", _TS))
REFLECTION = _of(("turns", T.ArrayType(TURN)), ("tool_executions", T.ArrayType(TOOL)), ("observations", T.ArrayType(_S)), ("summary", _S), ("session_id", _S), ("lane", _S))
QUEUE = _of(("id", _L), ("job_type", _S), ("payload_json", _S), ("enqueued_at", _TS), ("attempts", T.IntegerType()), ("claimed_at", _TS), ("claimed_by", _S), ("last_error", _S), ("lane", _S), ("session_id", _S), ("lane_seq", _L))
EVENTS = _of(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S))

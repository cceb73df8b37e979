"""Table schemas, checked on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _L, _I, _D, _B = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
)

RAW_CONVERSATIONS = _struct(
    ("conversation_id", _S), ("company", _S), ("conversation", _S)
)
TURNS = _struct(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S))
EVENTS = _struct(
    ("event_id", _L), ("ts", T.TimestampNTZType()), ("user_id", _L),
    ("event_type", _S), ("value", _D), ("props", _S),
)
DOCUMENTS = _struct(
    ("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)
)
LABELS = _struct(("doc_id", _L), ("quality", _I), ("toxic", _I))
PAIRS = _struct(
    ("pair_id", _S), ("conversation_id", _L), ("pair_seq", _L),
    ("customer_msg", _S), ("support_reply", _S),
)
GOLDEN = _struct(
    *[(f.name, f.dataType) for f in PAIRS],
    ("intent_label", _S), ("should_escalate", _B),
    ("escalation_reason", _S), ("label_method", _S),
)
EVIDENCE = T.ArrayType(
    _struct(("customer_msg", _S), ("support_reply", _S), ("similarity", _D))
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, by name, when a table lacks columns an operator needs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df

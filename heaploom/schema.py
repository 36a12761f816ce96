"""Record schemas, precisions and constants of the object graph."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T

#: Rows of a listing page (fixed value).
PAGE_SIZE = 1000
#: The pseudo-type that stands for all objects (fixed value).
ALL_TYPES = "All Types"

#: One object per JSON line.
RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("references", T.ArrayType(T.LongType())),
        T.StructField("value", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("subtree_size", T.LongType()),
    ]
)
REQUIRED = ("id", "type", "references", "size")
SUMMARY = ("id", "type", "value", "size", "subtree_size")


class Precision(StrEnum):
    """How reachable sizes are worked out on import."""

    NONE = "none"
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"
    EXACT = "exact"

    @property
    def lanes(self) -> int | None:
        """Lanes of the sketch (fixed values); None where there is no sketch."""
        return {"low": 7, "medium": 31, "high": 127}.get(self.value)

    @classmethod
    def parse(cls, name: str | Precision | None) -> Precision:
        """Unknown names mean medium."""
        try:
            return cls(name)
        except ValueError:
            return cls.MEDIUM

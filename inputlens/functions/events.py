"""Event predicates and counts: the only place that knows key names and event types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inputlens.schema import COUNTS

#: Fixed values of the wire format.
KEY_DOWN, KEY_UP, MOVE, CLICK, SCROLL = "key_down", "key_up", "move", "click", "scroll"
WORD_KEYS = (" ", "Key.space")
CORRECTION_KEYS = ("Key.backspace", "Key.delete")


def event_count_exprs(type: str = "type", key: str = "key") -> list[Column]:
    """keystrokes, words, corrections, clicks. A click counts on press and on release."""
    down = F.col(type) == KEY_DOWN
    return [
        F.count_if(down).alias("keystrokes"),
        F.count_if(down & F.col(key).isin(*WORD_KEYS)).alias("words"),
        F.count_if(down & F.col(key).isin(*CORRECTION_KEYS)).alias("corrections"),
        F.count_if(F.col(type) == CLICK).alias("clicks"),
    ]


def mouse_moves(type: str = "type") -> Column:
    return F.count_if(F.col(type).isin(MOVE, SCROLL)).alias("mouse_moves")


def sums(suffix: str = "", source_suffix: str = "") -> list[Column]:
    return [F.sum(f"{c}{source_suffix}").cast("long").alias(f"{c}{suffix}") for c in COUNTS]


def is_active() -> Column:
    """Any of the four counts above zero; null counts as zero."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNTS), F.lit(0)) > 0


def cell(coordinate: str, size: int) -> Column:
    """Grid cell, truncated toward zero: -15..15 are all in cell 0 of a grid of 16."""
    return (F.col(coordinate) / F.lit(size)).cast("int")


def redacted_key(key: str, salt: str) -> Column:
    """A stable stand-in for printable keys; named control keys stay readable, so counts do not change."""
    named = F.col(key).startswith("Key.") | F.col(key).isin(*WORD_KEYS)
    return F.when(F.col(key).isNull() | named, F.col(key)).otherwise(F.sha2(F.concat(F.lit(salt), F.col(key)), 256))

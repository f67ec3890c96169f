"""A seeded table of automated input: jigglers, typers, keep-awake tools, clickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds between events by kind; ranges of jitter; share of events of another kind; share and size of
#: pauses; first position; factors of a pattern; moves of the patterns, walked in turn; keys.
CADENCE = {"jiggler": (1.0, 8.0), "typer": (0.10, 0.40), "keep_awake": (6.0, 12.0), "clicker": (0.3, 1.5)}
JITTER, CONTAMINATION, PAUSES, PAUSE_SIZE = (0.20, 0.50), 0.08, 0.10, (3.0, 12.0)
ANCHOR, DISTANCES = (800, 500), (1, 2, 3)
PATTERNS = {
    "normal": ((4, 4), (-4, -4)),
    "linear": ((4, 0), (-4, 0)),
    "circle": ((3, 2), (2, 3), (-2, 3), (-3, 2), (-3, -2), (-2, -3), (2, -3), (3, -2)),
}
TYPER_KEYS = ("a", "s", "d", "f", "j", "k", "l", "e")
AWAKE_KEYS = ("f15", "f13", "f14", "scroll_lock")
TYPES = {"jiggler": "move", "typer": "key_down", "keep_awake": "key_down", "clicker": "click"}


def _draw(seed: int, salt: int, *parts: str) -> Column:
    """A number in [0, 1) for each (session, event), the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *parts), F.lit(1 << 40)) / float(1 << 40)


def _between(u: Column, low: Column | float, high: Column | float) -> Column:
    return F.lit(low) + u * (F.lit(high) - F.lit(low))


def _pick(u: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1)


def _of(keys: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for p in values.items() for x in p]), keys)


def automation_events(
    spark: SparkSession, sessions_per_kind: int = 4, minutes_per_session: int = 30, user: str = "automation",
    start_ts: float = 1_700_000_000.0, seed: int = 42, slot_s: int = 14_400,
) -> DataFrame:
    """Events of ``sessions_per_kind`` sessions of every kind, each from the start of a time slot of its own, with kind,
    session and ``acted`` (the kind that an event is of).

    A session has as many events as its base gap fits into its minutes. Gaps are base * (1 ± jitter), base drawn once for
    each session within its kind's cadence; a tenth adds a pause of 3 to 12 bases. 8 percent of events are of one of the
    other kinds. Moves walk a fixed pattern in place; clicks are presses where the pointer is."""
    kinds = tuple(CADENCE)
    s = spark.range(sessions_per_kind * len(kinds)).withColumnRenamed("id", "session")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("session") / sessions_per_kind).cast("int") + 1)
    s = s.withColumn("kind", kind).withColumns({
        "base": _between(_draw(seed, 1, "session"), _of(F.col("kind"), {k: v[0] for k, v in CADENCE.items()}), _of(F.col("kind"), {k: v[1] for k, v in CADENCE.items()})),
        "jitter": _between(_draw(seed, 2, "session"), *JITTER), "pattern": _pick(_draw(seed, 3, "session"), tuple(PATTERNS)),
        "distance": _pick(_draw(seed, 4, "session"), DISTANCES), "awake": _pick(_draw(seed, 5, "session"), AWAKE_KEYS),
    })
    e = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(minutes_per_session * 60) / F.col("base"))))))
    draw = lambda salt: _draw(seed, salt, "session", "i")
    pause = F.when(draw(7) < PAUSES, F.col("base") * _between(draw(8), *PAUSE_SIZE)).otherwise(0.0)
    others = F.array_remove(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    other = F.element_at(others, F.floor(draw(9) * (len(kinds) - 1)).cast("int") + 1)
    e = e.withColumns({"gap": F.col("base") * (1 + F.col("jitter") * (2 * draw(6) - 1)) + pause, "acted": F.when(draw(10) < CONTAMINATION, other).otherwise(F.col("kind"))})
    by = Window.partitionBy("session").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.col("acted") == "jiggler"
    e = e.withColumns({"after": F.sum("gap").over(by), "turn": F.count_if(moved).over(by)})
    steps = _of(F.col("pattern"), {k: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in v]) for k, v in PATTERNS.items()})
    step = F.element_at(steps, ((F.col("turn") - 1) % F.size(steps)).cast("int") + 1)
    e = e.withColumn("step", F.when(moved, step))
    at = lambda axis, start: F.lit(start) + F.sum(F.coalesce(F.col(f"step.{axis}"), F.lit(0)) * F.col("distance")).over(by)
    placed, clicked = F.col("acted").isin("jiggler", "clicker"), F.col("acted") == "clicker"
    ts = F.round(F.lit(start_ts) + F.col("session") * slot_s + F.col("after"), 3)
    return e.withColumns({"px": at("x", ANCHOR[0]), "py": at("y", ANCHOR[1])}).select(
        _of(F.col("acted"), TYPES).alias("type"),
        F.when(F.col("acted") == "typer", _pick(draw(13), TYPER_KEYS)).when(F.col("acted") == "keep_awake", F.col("awake")).alias("key"),
        F.when(placed, F.col("px")).alias("x"), F.when(placed, F.col("py")).alias("y"), F.when(clicked, F.lit("Button.left")).alias("button"),
        F.when(clicked, F.lit(True)).alias("pressed"), F.lit(user).alias("user"), ts.alias("ts"), ts.cast("timestamp").alias("event_time"), "kind", "session", "acted",
    )

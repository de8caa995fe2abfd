"""Pairing of a card's two sides as they arrive, with state and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

SIDES = ("front", "back")
PAIRED = "card_id string, front_id string, back_id string, front string, back string, paired boolean, micros long"


def pair_sides(wait_millis: int) -> StatefulProcessor:
    """The processor, made here with all that it names: Spark also starts it in a process of the driver that has no packages shipped to it."""
    sides = SIDES
    state = StructType([StructField("side", StringType()), StructField("request_id", StringType()), StructField("micros", LongType()), StructField("payload", StringType())])

    def due(micros: int) -> int:
        return micros // 1_000 + wait_millis

    def card(card_id: str, held: dict[str, tuple]) -> Row:
        front, back = (held.get(s) for s in sides)
        return Row(
            card_id=card_id, front_id=front and front[1], back_id=back and back[1], front=front and front[3], back=back and back[3],
            paired=bool(front and back), micros=max(x[2] for x in held.values()),
        )

    class PairSides(StatefulProcessor):
        """One card at a time: the side that is in waits in a value state until the other comes or its timer fires.

        A side that comes again while it waits is dropped, the first stays. When both are out, or a lone
        one is, the card's state is empty, and the next side begins a new card. Sides further apart than
        the wait are no pair, whether or not the timer has fired by then.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", state)

        def handleInputRows(self, key, rows, timerValues):
            for row in sorted(rows, key=lambda r: (r["micros"], r["request_id"] or "")):
                side = (row["side"], row["request_id"], row["micros"], row["payload"])
                if not self.waiting.exists():
                    self.waiting.update(side)
                    self.handle.registerTimer(due(row["micros"]))
                    continue
                held = tuple(self.waiting.get())
                apart = due(side[2]) > due(held[2]) + wait_millis
                if held[0] == side[0] and not apart:
                    continue
                self.waiting.clear()
                self.handle.deleteTimer(due(held[2]))
                if apart:  # the timer would have fired between the two, but for the watermark
                    yield card(key[0], {held[0]: held})
                    self.waiting.update(side)
                    self.handle.registerTimer(due(side[2]))
                else:
                    yield card(key[0], {held[0]: held, side[0]: side})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.waiting.exists():
                held = tuple(self.waiting.get())
                self.waiting.clear()
                yield card(key[0], {held[0]: held})

        def close(self) -> None:
            pass

    return PairSides()


def paired_sides(stream: DataFrame, wait: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """stream(card_id, side, request_id, ts, payload) -> a row for each card: both sides together as soon as the second is in, or one alone `wait` after it came.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Time is the events': a lone side goes out when the watermark, `delay` behind the latest event, is
    past its wait. Rows later than the watermark are dropped, so are repeats of a waiting side, rows of
    neither side and rows without a card. State holds one side for each card that is waiting.
    """
    seconds = F.expr(f"INTERVAL {wait}")
    millis = int(stream.sparkSession.range(1).select((F.lit(0).cast("timestamp") + seconds).cast("double").alias("s")).first()["s"] * 1_000)
    rows = stream.select(F.col("card_id").cast("string").alias("card_id"), "side", F.col("request_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("payload").cast("string").alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    rows = rows.where(F.col("card_id").isNotNull() & F.col("ts").isNotNull() & F.col("side").isin(*SIDES)).withWatermark("ts", delay)
    cards = rows.groupBy("card_id").transformWithState(pair_sides(millis), PAIRED, "Append", "EventTime")
    return cards.withColumn("ts", F.timestamp_micros("micros")).drop("micros")

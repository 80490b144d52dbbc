"""Judges of pairs, and the known-truth pairs (canaries) that check them.

A judge is keyed by pair_id, never by position or by ids that it returns.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import prompts
from textloom.functions.vector import calibrate_score
from textloom.schemas import json_schema
from textloom.sources.shared import fresh, store

log = logging.getLogger(__name__)
VERDICT = "pair_id long, is_similar boolean, confidence double"
ANSWER = "pairs array<struct<pair_id:long,is_similar:boolean,confidence:double,reasoning:string>>"
KNOWN_PAIRS = [
    ("number of clients we serve", "how many clients are there", True),
    ("overall turnover", "all sales added together", True),
    ("typical size of an order", "average amount per order", True),
    ("number of clients we serve", "goods left in the warehouse", False),
    ("overall turnover", "share of earnings kept after costs", False),
]


class Judge(Protocol):
    def verdicts(self, pairs: DataFrame) -> DataFrame:
        """(pair_id, is_similar, confidence) of pairs (pair_id, ..., score)."""
        ...


@dataclass(frozen=True)
class RuleJudge:
    """Similar if the cosine reaches a threshold; confident as the calibrated cosine."""

    threshold: float = 0.7
    midpoint: float = 0.65
    steepness: float = 15.0

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("pair_id", (F.col("score") >= self.threshold).alias("is_similar"), calibrate_score(F.col("score"), self.midpoint, self.steepness).alias("confidence"))


@dataclass(frozen=True)
class RecordedJudge:
    """Verdicts of a table; a pair that it lacks has none."""

    table: DataFrame

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("pair_id").join(self.table.select("pair_id", "is_similar", "confidence"), "pair_id")


@dataclass(frozen=True)
class ChatJudge:
    """A chat model that answers a batch's prompt with JSON: {"pairs": [{"pair_id", "is_similar", "confidence", "reasoning"}, ...]}.

    chat: (system prompt, prompt, JSON schema) -> text. Malformed or missing JSON is an error of the batch; pairs are
    matched by pair_id, and ids that weren't asked for are ignored. on_error: raise, or drop the batch's verdicts.
    """

    chat: Callable[[str, str, dict], str]
    batch_size: int = 10
    concurrency: int = 8
    on_error: str = "raise"

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        chat, drop, size = self.chat, self.on_error == "drop", self.batch_size
        answer = json_schema(ANSWER)

        def ask(frame: pd.DataFrame) -> pd.DataFrame:
            said = chat(prompts.PAIR_SYSTEM, prompts.pair_prompt(frame.to_dict("records")), answer)
            if said is None:
                raise ValueError("the model gave no answer")
            found = parse_answer(said)
            return pd.DataFrame([(x["pair_id"], x["is_similar"], x["confidence"]) for x in found if x["pair_id"] in set(frame["pair_id"])], columns=["pair_id", "is_similar", "confidence"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                groups = [g for _, g in frame.groupby("batch_id", sort=True)] if "batch_id" in frame else [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
                for group in groups:
                    try:
                        yield ask(group)
                    except Exception:
                        if not drop:
                            raise
                        log.exception("a batch of %d pairs has no verdicts", len(group))

        return pairs.repartition(self.concurrency, "batch_id" if "batch_id" in pairs.columns else "pair_id").mapInPandas(run, VERDICT)


def parse_answer(said: str) -> list[dict]:
    """The pairs of a chat answer, each field of its type; anything else is a ValueError."""
    whole = json.loads(said)
    found = whole.get("pairs") if isinstance(whole, dict) else None
    if not isinstance(found, list):
        raise ValueError("the answer has no pairs")
    for x in found:
        ok = isinstance(x, dict) and isinstance(x.get("pair_id"), int) and isinstance(x.get("is_similar"), bool) and isinstance(x.get("confidence"), (int, float))
        if not ok or not 0 <= x["confidence"] <= 1:
            raise ValueError(f"not a verdict: {x}")
    return found


@dataclass(frozen=True)
class CallableJudge:
    """A function from a frame of pairs to a frame of verdicts. on_error: raise, or drop the batch's verdicts."""

    call: Callable[[pd.DataFrame], pd.DataFrame]
    concurrency: int = 8
    on_error: str = "raise"

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        call, drop = self.call, self.on_error == "drop"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                try:
                    yield call(frame)[["pair_id", "is_similar", "confidence"]]
                except Exception:
                    if not drop:
                        raise
                    log.exception("a batch of %d pairs has no verdicts", len(frame))

        return pairs.repartition(self.concurrency, "batch_id" if "batch_id" in pairs.columns else "pair_id").mapInPandas(run, VERDICT)


def accepted(pairs: DataFrame, verdicts: DataFrame, min_confidence: float) -> DataFrame:
    """The pairs judged similar with enough confidence; without a verdict, a pair isn't."""
    return pairs.join(verdicts.where(F.col("is_similar") & (F.col("confidence") >= min_confidence)).select("pair_id", "confidence"), "pair_id")


def validate_entities(terms: DataFrame, verdicts: DataFrame, failed_batches: DataFrame | None = None) -> DataFrame:
    """terms with is_valid_entity: a missing verdict rejects; a batch that failed as a whole accepts."""
    said, failed = fresh(terms.columns, "_verdict", "_failed")
    out = terms.join(verdicts.select("term", F.col("is_valid_entity").alias(said)), "term", "left")
    if failed_batches is None:
        return out.withColumn("is_valid_entity", F.coalesce(said, F.lit(False))).drop(said)
    out = out.join(failed_batches.select("batch_id", F.lit(True).alias(failed)), "batch_id", "left")
    return out.withColumn("is_valid_entity", F.coalesce(failed, said, F.lit(False))).drop(said, failed)


def dense_batches(pairs: DataFrame, batch_size: int = 10, rows: int | None = None) -> DataFrame:
    """pairs with batch_id: slices of batch_size in the order of pair_id (null last), for any pair_ids. rows: their number, if known.

    Ranges of pair_id are numbered one by one and written with their numbers, so no task sorts all pairs; how
    many rows come before each range is added afterwards.
    """
    n = pairs.count() if rows is None else rows
    ranges = max(1, -(-n // (batch_size * 10_000)))
    mark, place, before = fresh(pairs.columns, "_mark", "_place", "_before")
    order = F.asc_nulls_last("pair_id")
    numbered = store(pairs.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn(mark, F.monotonically_increasing_id()), "numbered-pairs")
    at, nth = F.shiftright(F.col(mark), 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    total, sums = 0, []
    for r in numbered.groupBy(at.alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect():
        sums.append((r["at"], total))
        total += r["n"]
    starts = pairs.sparkSession.createDataFrame(sums, f"{mark} long, {before} long")
    numbered = numbered.select(*pairs.columns, at.alias(mark), nth.alias(place)).join(F.broadcast(starts), mark)
    return numbered.select(*pairs.columns, F.floor((F.col(before) + F.col(place)) / batch_size).alias("batch_id"))


def assign_batches(pairs: DataFrame, batch_size: int = 10, key: str = "pair_id") -> DataFrame:
    """pairs with batch_id. Dense keys (0, 1, ...) make slices of batch_size; no global sort is needed."""
    return pairs.withColumn("batch_id", F.floor(F.col(key) / batch_size).cast("long"))


class SanityCheckError(Exception):
    def __init__(self, message: str, failed: list | None = None):
        super().__init__(message)
        self.failed = failed or []


@dataclass(frozen=True)
class SanityChecker:
    """mode: strict raises on a failed canary, warn logs, sample checks a share of the batches and does neither. Custom canaries replace the default ones."""

    mode: str = "strict"
    canaries: tuple[tuple[str, str, bool], ...] = tuple(KNOWN_PAIRS)
    sample_rate: float = 0.1
    per_batch: int = 1
    seed: int = 0

    def add(self, *more: tuple[str, str, bool]) -> SanityChecker:
        return SanityChecker(self.mode, (*self.canaries, *more), self.sample_rate, self.per_batch, self.seed)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *c) for i, c in enumerate(self.canaries)], "canary_no int, text_a string, text_b string, expected_similar boolean")

    def checks_batch(self, batch_id: Column) -> Column:
        """Whether a batch is checked: all, but in sample mode a share decided by a hash."""
        if self.mode != "sample":
            return F.lit(True)
        digest = F.md5(F.concat_ws(":", batch_id.cast("string"), F.lit(str(self.seed))).cast("binary"))
        return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 1_000_000 < int(self.sample_rate * 1_000_000)

    def select(self, batches: DataFrame) -> DataFrame:
        """(batch_id, canary_no, text_a, text_b, expected_similar): for each checked batch, per_batch canaries by hash, or all if there are fewer."""
        order = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.pmod(F.col("canary_no") - F.col("batch_id") - self.seed, F.lit(len(self.canaries))), "canary_no"))
        chosen = batches.select("batch_id").distinct().where(self.checks_batch(F.col("batch_id"))).crossJoin(F.broadcast(self.table(batches.sparkSession)))
        return chosen.withColumn("_n", order).where(F.col("_n") <= self.per_batch).drop("_n")

    def inject(self, pairs: DataFrame, batches: DataFrame | None = None) -> DataFrame:
        """(pair_id, batch_id, id_a, id_b, text_a, text_b, is_canary, expected_similar); canaries have negative pair_ids. Where in its batch a canary stands doesn't matter: verdicts are keyed. batches: a table of all batch_ids, if one is at hand that costs less than pairs."""
        own = self.select(pairs if batches is None else batches)
        number = -(F.col("batch_id") * len(self.canaries) + F.col("canary_no") + 1)
        canaries = own.select(number.alias("pair_id"), "batch_id", F.format_string("__canary_%d_a__", "canary_no").alias("id_a"), F.format_string("__canary_%d_b__", "canary_no").alias("id_b"), "text_a", "text_b", F.lit(True).alias("is_canary"), "expected_similar")
        return pairs.select("pair_id", "batch_id", "id_a", "id_b", "text_a", "text_b", F.lit(False).alias("is_canary"), F.lit(None).cast("boolean").alias("expected_similar")).unionByName(canaries)

    def stats(self, injected: DataFrame, verdicts: DataFrame) -> DataFrame:
        """One row: total_checks, passed, failed, skipped batches, pass_rate (1 without checks). A canary without a verdict counts in the total only."""
        checked = injected.where("is_canary").join(verdicts.select("pair_id", "is_similar"), "pair_id", "left")
        counts = checked.agg(F.count("*").alias("total_checks"), F.count_if(F.col("is_similar") == F.col("expected_similar")).alias("passed"), F.count_if(F.col("is_similar") != F.col("expected_similar")).alias("failed"))
        skipped = injected.groupBy("batch_id").agg(F.max("is_canary").alias("c")).agg(F.count_if(~F.col("c")).alias("skipped"))
        rate = F.when(F.col("total_checks") > 0, F.col("passed") / F.greatest("total_checks", F.lit(1))).otherwise(F.lit(1.0))
        return counts.crossJoin(skipped).withColumn("pass_rate", rate)

    def validate(self, injected: DataFrame, verdicts: DataFrame) -> DataFrame:
        """The verdicts of pairs proper. Strict mode raises SanityCheckError: a canary without a verdict has failed too.

        The error lists each known pair that failed, with how often: as many rows as there are known pairs at most.
        """
        if self.mode in ("strict", "warn"):
            said = injected.where("is_canary").join(verdicts.select("pair_id", "is_similar"), "pair_id", "left")
            wrong = ~F.col("is_similar").eqNullSafe(F.col("expected_similar"))
            failed = said.where(wrong).groupBy("text_a", "text_b", "expected_similar").agg(F.count("*").alias("times")).orderBy("text_a", "text_b").collect()
            times = sum(r["times"] for r in failed)
            if failed and self.mode == "strict":
                raise SanityCheckError(f"{times} canaries failed", failed)
            if failed:
                log.warning("%d canaries failed", times)
        return verdicts.where("pair_id >= 0")

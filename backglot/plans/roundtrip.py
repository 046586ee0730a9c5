"""The staged round trip: slice, substitute, translate, complete, take back, score, summarise.

Every stage is a table of cells (:mod:`backglot.operators.stages`): a run is a start index with its stage-1 and stage-2
sample counts, a stage-2 cell adds a model and a few-shot size. Stage-1 rows are the first of the slice and serve as the
examples; stage-2 rows are the held-out ones after them. A row's original and partial translation are stored once per run,
not once per stage-2 cell: who needs them beside a cell's rows joins them by ``ROW``. So is what a cell without an answer
keeps: its ``translated`` (``back``) is null where it is the row's own ``partial`` (``partial_back``), and its
``partial_back`` is null where it is the one of stage ``own``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.languages import language_name
from backglot.functions.lexing import Lexer, stage0_lexer, stage1_lexer
from backglot.functions.profiles import text_profile
from backglot.operators import fewshot as fs
from backglot.operators import metrics, reports
from backglot.operators.memory import translate_documents
from backglot.operators.positions import store_positions, stored_slice
from backglot.operators.stages import Stage
from backglot.operators.substitution import Lookup, substitute_documents
from backglot.plans import inputs
from backglot.sources.tables import delete_after, exists, hand_over

RUN = ["start_index", "stage1_samples", "stage2_samples"]
CELL = [*RUN, "model", "chunk_size"]
ROW = [*RUN, "row"]  # within a run, rows are numbered
MOST_RUNS = 1_000  # runs of one grid
TRANSLATOR = "memory"  # the model of stage 1


@dataclass(frozen=True)
class RoundTrip:
    """What a round trip reads: a corpus ``(doc_id, text)``, tables of words and phrases, and who answers requests."""

    spark: SparkSession
    corpus: DataFrame
    words: DataFrame | Lookup
    memory: DataFrame
    answers: Callable[[DataFrame], DataFrame]
    source: str = inputs.SOURCE
    target: str = inputs.TARGET
    range_rows: int = 1_000_000

    def _lexers(self, back: bool) -> tuple[Lexer, Lexer]:
        pair = (self.target, self.source) if back else (self.source, self.target)
        return stage0_lexer(*pair), stage1_lexer(*pair)

    def stages(self, folder: str) -> list[Stage]:
        run, cell = tuple(RUN), tuple(CELL)
        return [
            Stage("partial", run, lambda cells: self.partial(cells, f"{folder}/positions")),
            Stage("stage1", run, self.stage1, ("partial",)),
            Stage("back1", run, self.back1, ("stage1",)),
            Stage("details1", run, self.details1, ("back1",)),
            Stage("state1", run, lambda cells, details: reports.summary_state(details, RUN), ("details1",)),
            Stage("stage2", cell, self.stage2, ("partial", "stage1")),
            Stage("own", run, self.own, ("partial",)),
            Stage("back2", cell, self.back2, ("stage1", "stage2", "own")),
            Stage("details2", cell, self.details2, ("partial", "back2", "own")),
            Stage("state2", cell, lambda cells, details: reports.summary_state(details, CELL), ("details2",)),
        ]

    def partial(self, cells: DataFrame, positions: str) -> DataFrame:
        """Rows of every run's slice, numbered within it, with their partial translation.

        The numbered corpus goes when the stage is done: only runs that are added later number it again.
        """
        delete_after(positions, f"{positions}-schema", f"{positions}-total")
        if not exists(self.spark, f"{positions}-total/_SUCCESS"):
            store_positions(self.corpus, "doc_id", positions, self.range_rows)
        runs = [tuple(r) for r in cells.select(*RUN).limit(MOST_RUNS + 1).collect()]
        if len(runs) > MOST_RUNS:
            raise ValueError(f"more than {MOST_RUNS} runs in one grid")
        slices = []
        for start, stage1, stage2 in runs:
            rows = stored_slice(self.spark, positions, start, stage1 + stage2)
            named = {c: F.lit(v).cast("long") for c, v in zip(RUN, (start, stage1, stage2))}
            slices.append(rows.select("row", "doc_id", F.col("text").alias("original")).withColumns(named))
        rows = reduce(DataFrame.unionByName, slices)
        return substitute_documents(rows, "doc_id", "original", "partial", self.words, self._lexers(False)[0])

    def stage1(self, cells: DataFrame, partial: DataFrame) -> DataFrame:
        rows = partial.where("row < stage1_samples")
        return translate_documents(rows, "doc_id", "partial", "translated", self.memory, self._lexers(False)[1])

    def back1(self, cells: DataFrame, stage1: DataFrame) -> DataFrame:
        words, phrases = self._lexers(True)
        rows = stage1.select(*RUN, "row", "doc_id", "original", "translated")
        rows = hand_over(substitute_documents(rows, "doc_id", "translated", "partial_back", self.words, words), "partial")
        return translate_documents(rows, "doc_id", "partial_back", "back", self.memory, phrases)

    def details1(self, cells: DataFrame, back: DataFrame) -> DataFrame:
        scored = metrics.evaluate_pairs(back.select(*RUN, "row", "original", "partial_back", "back"), text_profile)
        index = (F.col("row") + 1).alias("index")
        return scored.select(*RUN, index, *[c for c in scored.columns if c not in (*RUN, "row")])

    def _sets(self, cells: DataFrame, stage1: DataFrame, reverse: bool) -> DataFrame:
        examples = stage1.select(*RUN, F.col("row").alias("pos"), F.col("original").alias("src"), F.col("translated").alias("tgt"))
        return fs.example_sets(examples, cells, reverse, RUN)

    def _answered(self, asked: DataFrame, sets: DataFrame, back: bool) -> DataFrame:
        """``asked`` with the ``response`` of every row's model, or null."""
        source, target = (self.target, self.source) if back else (self.source, self.target)
        requests = fs.with_requests(asked, sets, language_name(source), language_name(target), RUN)
        given = self.answers(requests)
        return fs.with_responses(requests, given, ["model", "request_id"], [*CELL, "row"]).drop("request_id")

    def stage2(self, cells: DataFrame, partial: DataFrame, stage1: DataFrame) -> DataFrame:
        """A row without an answer keeps its own text. Requests are answered without the texts."""
        rows = partial.where("row >= stage1_samples")
        digests = hand_over(rows.select(*ROW, "doc_id", F.sha2("partial", 256).alias("code_digest")), "digests")
        return fs.complete(self._answered(digests.join(cells, RUN), self._sets(cells, stage1, False), False), None, True)

    def own(self, cells: DataFrame, partial: DataFrame) -> DataFrame:
        """The way back by words of the held-out rows' own partial translation: once per run, however many cells keep it."""
        rows = partial.where("row >= stage1_samples").select(*ROW, "doc_id", "partial")
        return substitute_documents(rows, "doc_id", "partial", "partial_back", self.words, self._lexers(True)[0]).select(*ROW, "partial_back")

    def back2(self, cells: DataFrame, stage1: DataFrame, stage2: DataFrame, own: DataFrame) -> DataFrame:
        rows = stage2.select(*CELL, "row", "doc_id", "translated")
        digest = F.sha2("partial_back", 256).alias("code_digest")
        changed = rows.where("translated IS NOT NULL")
        changed = substitute_documents(changed, "doc_id", "translated", "partial_back", self.words, self._lexers(True)[0])
        kept = rows.where("translated IS NULL").join(own.select(*ROW, digest), ROW).withColumn("partial_back", F.lit(None).cast("string"))
        rows = hand_over(changed.select("*", digest).unionByName(kept).drop("translated"), "partial")
        found = self._answered(rows, self._sets(cells, stage1, True), True)
        return fs.complete(found, None, True).withColumnRenamed("translated", "back")

    def details2(self, cells: DataFrame, partial: DataFrame, back: DataFrame, own: DataFrame) -> DataFrame:
        """Scores by cell and row; every original is read once, however many cells score against it."""
        rows = partial.where("row >= stage1_samples").select(*ROW, "original")
        originals = metrics.read_originals(rows, text_profile).join(own.select(*ROW, F.col("partial_back").alias("own")), ROW, "left")
        pairs = back.select(*CELL, "row", F.coalesce("back", "partial_back").alias("back")).join(originals, ROW)
        pairs = pairs.withColumn("back", F.coalesce("back", "own")).drop("own")
        scored = metrics.evaluate_pairs(pairs, text_profile, kept=[*CELL, "row"])
        return scored.withColumn("index", F.col("row") - F.col("stage1_samples") + 1)


def stage2_texts(stage2: DataFrame, partial: DataFrame) -> DataFrame:
    """Stage-2 rows with their ``partial`` and their whole ``translated``."""
    rows = stage2.join(partial.select(*ROW, "partial"), ROW)
    return rows.withColumn("translated", F.coalesce("translated", "partial"))


def details2_texts(details: DataFrame, partial: DataFrame, back: DataFrame, own: DataFrame) -> DataFrame:
    """Stage-2 details beside their texts, in the columns of the stage-1 details. The rows' own texts come last: by run, not by cell."""
    originals = partial.where("row >= stage1_samples").select(*ROW, "original")
    originals = originals.join(own.select(*ROW, F.col("partial_back").alias("own")), ROW, "left")
    rows = details.join(back.select(*CELL, "row", "partial_back", "back"), [*CELL, "row"]).join(originals, ROW)
    rows = rows.withColumn("partial_back", F.coalesce("partial_back", "own"))
    return rows.withColumn("back", F.coalesce("back", "partial_back")).drop("row", "own")


def all_details(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detail rows of both stages, with the stage, its model and its few-shot size (stage 1: none, 0)."""
    named = {"model": F.lit(TRANSLATOR), "chunk_size": F.lit(0).cast("long"), "stage": F.lit(1)}
    return first.withColumns(named).unionByName(second.withColumn("stage", F.lit(2)))


def all_summaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Summaries of both stages from their stored states; no details are read."""
    both = all_details(first, second)
    return reports.finish_summary(reports.merge_states(both, ["stage", *CELL]), ["stage", *CELL])

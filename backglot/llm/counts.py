"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies.

A text is cut before every single space that a non-space follows, where no pre-token can span. The
frequencies of these units are counted per document; a unit is split into pre-tokens once, and a
pre-token's pieces are counted once, in a task's bounded table. No id list of a document is ever made,
and nothing is shuffled: a document's frequencies meet the piece counts in the task that reads it.

Defined results for odd inputs: null and empty texts have 0 bytes and 0 tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.arrow import text_slices
from backglot.llm.units import PATTERN, UNEVEN, split_units
from backglot.session import ship_package
from backglot.sources.tables import scan

VOCABULARY = "byte_bpe_50k.json"
TABLE_ENTRIES = 300_000  # units whose piece counts a task keeps; beyond, it starts afresh
BATCH = 4096  # pre-tokens encoded at once
LONG_UNIT = 200  # longer units are counted, but not kept

_PRE_TOKEN = regex.compile(PATTERN)


class PieceCounter:
    """Number of pieces of texts by a byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Longest first, as the library takes the longest of those that start at one place.
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.known: dict[str, int] = {}

    def units(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the units of a text, and its number of special strings."""
        if self.special is not None and any(s in text for s in self.marks):
            parts = self.special.split(text)
            found: Counter = Counter()
            for part in parts:
                found += self.units(part)[0]
            return found, len(parts) - 1
        if not text:
            return Counter(), 0
        if UNEVEN.search(text):
            return Counter(split_units(text)), 0
        head, *rest = text.split(" ")
        found = Counter({f" {u}": n for u, n in Counter(rest).items()})
        if head:
            found[head] += 1
        return found, 0

    def learn(self, units: set[str]) -> dict[str, int]:
        """Piece counts of units not seen before, each distinct pre-token encoded once."""
        split = {u: _PRE_TOKEN.findall(u) for u in units}
        distinct = list({p for parts in split.values() for p in parts})
        sizes = {}
        for i in range(0, len(distinct), BATCH):
            part = distinct[i : i + BATCH]
            sizes.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return {u: sum(sizes[p] for p in parts) for u, parts in split.items()}

    def count(self, texts: list[str]) -> list[int]:
        found = [self.units(t) for t in texts]
        if len(self.known) > TABLE_ENTRIES:
            self.known = {}
        wanted = {u for units, _ in found for u in units if u not in self.known}
        fresh = self.learn(wanted) if wanted else {}
        table = self.known
        table.update((u, n) for u, n in fresh.items() if len(u) <= LONG_UNIT)
        size = lambda u: table[u] if u in table else fresh[u]
        return [extra + sum(map(mul, units.values(), map(size, units))) for units, extra in found]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    ``vocabulary`` is the content of a tokenizers file; it travels to the tasks as a broadcast variable.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for part in text_slices(batch):
                counter = counter or PieceCounter(shared.value)
                tokens = pa.array(counter.count(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), tokens], ["key", "n_tokens"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sized = given.select("key", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    packed = sized.select(F.struct("key", "n_bytes").alias("key"), "text")
    counted = packed.mapInArrow(work, f"key struct<key:{dict(given.dtypes)['key']},n_bytes:bigint>, n_tokens long")
    return counted.select(
        F.col("key.key").alias(key), F.col("key.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        vocabulary = file.read()
    return count_tokens(scan(spark, folder, "documents"), vocabulary)

"""Periodic runs of words: stretches that repeat with one period four times or more, found and collapsed.

The sparse diagonal method: a word (later: a gram of ``span`` words) looks at its earlier occurrences, each occurrence
continues the diagonal of its lag, and a diagonal that ends long enough is a run. Taken literally a word that makes up
a whole text would meet all its earlier occurrences, which is quadratic. So lags are taken scale by scale: lags of
``span`` to ``2 * span - 1`` follow the earlier occurrences of grams of ``span`` words, since a run with such a period
matches itself over three periods. Grams inside a run of a period of at most ``span / 4`` are *dull*: they start no
diagonal, and the gaps that they leave are closed word by word. A gram that is not dull has fewer than 8 earlier
occurrences within ``2 * span`` words, and each period of a run holds one, so nothing is lost and the work of a text
of n words grows as n log n. All texts of a slice are worked on at once.

Memory follows the longest text (some 100 bytes a word), a text is never split. Words are compared by 64-bit hashes.

Defined results for odd inputs: a null or empty text has no words, no runs and an empty collapsed text; rows are judged
one by one, so null, tied and repeated ids change nothing; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.expr import bind
from backglot.llm.arrow import mix, text_bytes, text_slices, word_hashes, word_spans
from backglot.session import ship_package
from backglot.sources.tables import scan

FOLD = 4  # a run repeats its period so often at least
SHORTEST = 6  # words of a run at least
WORD_BREAK = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_U = np.uint64
_DOC, _LEFT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(start, length, period)`` rows of all runs of all texts, by start and period; starts count through all texts.

    ``words`` are word hashes, ``first`` says where each text's words start (one more entry than texts).
    """
    size = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, stop = first[:-1][text], first[1:][text]
    word = mix(words + (text.astype(_U) + _U(1)) * _DOC)  # words of different texts never match
    gram, known = word.copy(), np.zeros(size, bool)
    known_at = np.flatnonzero(stop - begin >= FOLD)
    found = np.zeros((0, 3), np.int64)  # start, end, period
    span = 1
    while len(known_at):
        order = known_at[np.argsort(gram[known_at], kind="stable")]
        equal = gram[order[1:]] == gram[order[:-1]]
        dull = _dull(found, span, size)
        made = _diagonals(word, gram, order[~dull[order]], dull, begin, stop, span)
        found = np.concatenate([found, made])
        # Only grams that occur twice in a text of eight spans or more can be part of a longer one that does.
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        again = order[twice]
        known[:] = False
        known[again] = True
        again = again[(again + 2 * span <= stop[again]) & (stop[again] - begin[again] >= 2 * FOLD * span)]
        again = again[known[again + span]]
        gram[again] = mix(gram[again] * _LEFT + gram[again + span])
        known_at = np.sort(again)
        span *= 2
    return _primitive(found)


def _dull(found: np.ndarray, span: int, size: int) -> np.ndarray:
    """Where a gram of ``span`` words lies inside a run of a period of at most ``span / 4``."""
    short = found[found[:, 2] * FOLD <= span]
    short = short[short[:, 1] - short[:, 0] >= span]
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, short[:, 0], 1)
    np.add.at(steps, short[:, 1] - span + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _diagonals(word, gram, order, dull, begin, stop, span: int) -> np.ndarray:
    """``(start, end, lag)`` of stretches of ``FOLD`` lags or more, for lags from ``span`` to ``2 * span - 1``."""
    at, lags, back = [], [], 1
    while back < len(order):
        lag = order[back:] - order[:-back]
        near = (gram[order[back:]] == gram[order[:-back]]) & (lag < 2 * span)
        if not near.any():
            break
        near &= lag >= span
        at.append(order[back:][near])
        lags.append(lag[near])
        back += 1
    if not sum(map(len, at)):
        return np.zeros((0, 3), np.int64)
    at, lags = np.concatenate(at), np.concatenate(lags)
    by = np.lexsort((at, lags))
    at, lags = at[by], lags[by]
    new = np.ones(len(at), bool)
    new[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    lag, left, right = lags[head], at[head], at[tail] + span  # words left..right match those a lag before
    open_ = (left - lag > begin[left]) & dull[np.maximum(left - 1, 0)]
    open_ |= (right < stop[left]) & dull[at[tail] + 1 - (at[tail] + 1 == len(word))]
    whole = ~open_ & (right - left >= (FOLD - 1) * lag)
    rows = [np.stack([left - lag, right, lag], axis=1)[whole]]
    closed = _closed(word, begin, stop, lag[open_], left[open_], right[open_])
    return np.concatenate([*rows, closed])


def _closed(word, begin, stop, lag, left, right) -> np.ndarray:
    """Diagonals beside dull grams, carried on word by word to both sides; pieces of one diagonal give one stretch."""
    rows, reached, of = [], -1, -1
    for q, a, b in zip(lag.tolist(), left.tolist(), right.tolist()):
        if q == of and a < reached:
            continue
        low, high = begin[a] + q, stop[a]
        b += _matching(word[b:high], word[b - q : high - q])
        a -= _matching(word[low:a][::-1], word[low - q : a - q][::-1])
        of, reached = q, b
        if b - a >= (FOLD - 1) * q:
            rows.append((a - q, b, q))
    return np.array(rows, np.int64).reshape(-1, 3)


def _matching(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning, looked for in growing pieces."""
    at, step = 0, 16
    while at < len(x):
        other = np.flatnonzero(x[at : at + step] != y[at : at + step])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 2
    return len(x)


def _primitive(found: np.ndarray) -> np.ndarray:
    """One row per stretch, with its smallest period, if it is long enough; as ``(start, length, period)``."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    length = found[:, 1] - found[:, 0]
    long_ = length >= np.maximum(SHORTEST, FOLD * found[:, 2])
    runs = np.stack([found[:, 0], length, found[:, 2]], axis=1)[long_]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key columns, runs, collapsed)`` of ``(key columns, text)``."""
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    for batch in batches:
        for part in text_slices(batch):
            texts = part.column("text")
            data, at = text_bytes(texts)
            starts, ends, first = word_spans(data, at)
            runs = find_runs(word_hashes(data, starts, ends, lower=False), first)
            dropped = np.zeros(len(starts) + 1, np.int32)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
            dropped = np.cumsum(dropped[:-1]) > 0
            held = np.searchsorted(runs[:, 0], first)
            kept = []
            for i, text in enumerate(texts):
                words = text.as_buffer().to_pybytes().split()  # splits at what ends a word
                if held[i] < held[i + 1]:
                    gone = dropped[first[i] : first[i + 1]]
                    words = [w for w, no in zip(words, gone.tolist()) if not no]
                kept.append(b" ".join(words).decode())
            start = runs[:, 0] - first[np.searchsorted(held, np.arange(len(runs)), side="right") - 1]
            fields = [pa.array(np.ascontiguousarray(c)) for c in (start, runs[:, 1], runs[:, 2])]
            listed = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))
            keys = [part.column(c) for c in part.schema.names if c != "text"]
            names = [c for c in part.schema.names if c != "text"] + ["runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([*keys, listed, pa.array(kept, pa.string())], names)


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, runs, collapsed)`` per row: its runs by start and period, and its words without all but the first period of each run."""
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = given.mapInArrow(run_batches, f"key {dict(docs.dtypes)[key]}, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | more(best, x), x).otherwise(best))


def plant_period(text: Column, doc_id: Column) -> Column:
    """One text in ten (by the crc32 of its id) with a periodic tail; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")

    def tail(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        one = lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        spun = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one)
        return F.when(n > 0, F.array_join(spun, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, bind(words, tail)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", plant_period(F.col("text"), F.col("doc_id")))
    found = collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

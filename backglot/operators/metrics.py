"""Pair metrics of a round trip: BLEU, structure, token mix, cosine, overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from backglot.functions import grams as counting
from backglot.functions.expr import bind
from backglot.functions.profiles import is_number, is_operator, is_string, text_tokens
from backglot.session import ship_package
from backglot.sources.tables import hand_over

MAX_N = 4
SMALLEST = 2.2250738585072014e-308  # fixed value: smallest normal double stands in for zero precision
KINDS = {"numbers": is_number, "strings": is_string, "ops": is_operator}


def gram_counts(rows: DataFrame, row: str, reference: str, candidate: str, most: int = MAX_N) -> DataFrame:
    """``(row, n, a, b, c, d, in_r, in_c)``: how often every n-gram (n = 1..``most``) stands in both token arrays of a row.

    The n-grams are exploded and counted by hash, however many rows share a ``row``; counts that outgrow memory spill. A row
    without tokens keeps one entry with a null gram. :func:`count_pair` counts within a row at a fraction of this.
    """
    sides = F.array(
        F.struct(F.lit(1).alias("r"), F.col(reference).alias("t")), F.struct(F.lit(0).alias("r"), F.col(candidate).alias("t"))
    )
    both = rows.select(row, F.inline(sides))
    shifted = [F.slice("t", k, F.greatest(F.size("t"), F.lit(0))) for k in range(1, MAX_N + 1)]
    placed = both.select(row, "r", F.inline_outer(F.arrays_zip(*shifted)).alias("a", "b", "c", "d"))
    names, none = ["a", "b", "c", "d"], F.lit(None).cast("string")
    gram = lambda n: F.struct(F.lit(n).alias("n"), *[(F.col(x) if i < n else none).alias(x) for i, x in enumerate(names)])
    grams = placed.select(row, "r", F.inline(F.array(*[gram(n) for n in range(1, most + 1)])))
    whole = (F.col("n") == 1) | F.when(F.col("n") == 2, F.col("b").isNotNull()).when(F.col("n") == 3, F.col("c").isNotNull()).otherwise(
        F.col("d").isNotNull()
    )
    counted = grams.where(whole).groupBy(row, "n", *names)
    return counted.agg(F.sum("r").alias("in_r"), F.sum(1 - F.col("r")).alias("in_c"))


def count_rows(rows: DataFrame, most: int = MAX_N, whole: bool = False) -> DataFrame:
    """``rows`` with clipped n-gram hits, token counts and token counts by kind of the token arrays ``_r`` and ``_c`` instead of these.

    Every row is counted where it lies. ``whole`` leaves out rows that lack an array.
    """
    ship_package(rows.sparkSession)
    schema = StructType([f for f in rows.schema.fields if f.name not in ("_r", "_c")])
    for name in counting.count_names(most):
        schema = schema.add(name, "long")
    return rows.mapInArrow(lambda batches: counting.count_batches(batches, most, whole), schema)


def _with_names(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"{s}_names": F.expr(f"{s}_len - {s}_numbers - {s}_strings - {s}_ops") for s in "rc"})


def pair_counts(rows: DataFrame, row: str, reference: str, candidate: str, most: int = MAX_N) -> DataFrame:
    """Per row: token counts, clipped n-gram hits and token counts by kind of both sides.

    A row is counted where it lies. Rows that share a ``row`` (one count of the ids finds them) are one pair: their n-grams
    are exploded and counted together.
    """
    twice = rows.groupBy(row).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    twice = hand_over(twice.select(F.col(row).alias("_twice")), "twice")
    shared = F.col(row).eqNullSafe(F.col("_twice"))
    tokens = [F.col(row), F.col(reference).alias("_r"), F.col(candidate).alias("_c")]
    if twice.isEmpty():
        return _with_names(count_rows(rows.select(*tokens), most))
    alone = count_rows(rows.join(twice, shared, "left_anti").select(*tokens), most)
    together = _grouped_counts(rows.join(twice, shared, "left_semi"), row, reference, candidate, most)
    return _with_names(alone.unionByName(together))


def _grouped_counts(rows: DataFrame, row: str, reference: str, candidate: str, most: int) -> DataFrame:
    grams = gram_counts(rows, row, reference, candidate, most)
    total = lambda keep, value: F.coalesce(F.sum(F.when(F.col("a").isNotNull() & keep, value)), F.lit(0))
    single, clipped = F.col("n") == 1, F.least("in_r", "in_c")
    wanted = [total(F.col("n") == n, clipped).alias(f"hit{n}") for n in range(1, most + 1)]
    for side in "rc":
        wanted.append(total(single, F.col(f"in_{side}")).alias(f"{side}_len"))
        wanted += [total(single & test(F.col("a")), F.col(f"in_{side}")).alias(f"{side}_{kind}") for kind, test in KINDS.items()]
    return grams.groupBy(row).agg(*wanted)


def bleu_score() -> Column:
    """BLEU-4 from the columns of :func:`pair_counts`: one reference, equal weights, no smoothing.

    No unigram hit scores 0; other zero counts use the smallest double.
    """
    logs = " + ".join(
        f"ln(CASE WHEN hit{n} > 0 THEN hit{n} / greatest(1, c_len - {n - 1}) ELSE {SMALLEST!r}D END) / {MAX_N}"
        for n in range(1, MAX_N + 1)
    )
    penalty = "CASE WHEN c_len > r_len THEN 1D ELSE exp(1 - try_divide(r_len, c_len)) END"
    return F.expr(f"CASE WHEN hit1 > 0 THEN {penalty} * exp({logs}) ELSE 0D END")


def mean_present(values: list[Column]) -> Column:
    """Mean of the non-null values, 0 when all are null."""

    def mean(present: Column) -> Column:
        total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
        return F.coalesce(F.try_divide(total, F.size(present)), F.lit(0.0))

    return bind(F.array_compact(F.array(*values)), mean)


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def structure_score(a: str, b: str) -> Column:
    """Mean Jaccard over the name sets of two profile structs."""
    return mean_present([jaccard(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in ("functions", "classes", "controls")])


def token_match() -> Column:
    """Mean min/max ratio over the token kinds present, from the columns of :func:`pair_counts`."""
    ratios = []
    for kind in ("names", "strings", "numbers", "ops"):
        left, right = F.col(f"r_{kind}"), F.col(f"c_{kind}")
        ratios.append(F.when(F.greatest(left, right) > 0, F.least(left, right) / F.greatest(left, right)))
    none_r, none_c = F.col("r_len") == 0, F.col("c_len") == 0
    return F.when(none_r & none_c, 1.0).when(none_r | none_c, 0.0).otherwise(mean_present(ratios))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 when undefined."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def overall_score() -> Column:
    """Mean of the five scores; validity counts as 0 or 1."""
    parts = [
        F.col("bleu_score"),
        F.col("syntax_valid").cast("double"),
        F.col("structure_score"),
        F.col("semantic_score"),
        F.col("token_match"),
    ]
    return sum(parts[1:], parts[0]) / len(parts)


def read_originals(rows: DataFrame, profile) -> DataFrame:
    """``original`` as its profile and tokens, to be joined to many back-translations."""
    original = F.col("original")
    return rows.withColumns({"_po": profile(original), "_r": text_tokens(original)}).drop("original")


def evaluate_pairs(pairs: DataFrame, profile, embeddings: tuple[str, str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Detail table of a run: all scores of every ``(original, back)`` row, beside its columns (or those ``kept``).

    Rows without an original or a back-translation are skipped. ``profile`` maps a text column to the profile struct of
    :mod:`backglot.functions.profiles`. Scores that cannot be computed count as zero. Every pair is scored where it lies.
    Pairs may hold what :func:`read_originals` made of the original instead of it.
    """
    semantic = cosine(F.col(embeddings[0]), F.col(embeddings[1])) if embeddings else F.lit(0.0)
    if kept is None:
        kept = [c for c in pairs.columns if c not in (*(embeddings or ()), "_po", "_r")]
    whole = pairs if "_r" in pairs.columns else pairs.select("*", profile(F.col("original")).alias("_po"), text_tokens(F.col("original")).alias("_r"))
    given = whole.select(
        F.struct(*kept).alias("_kept"),
        semantic.alias("semantic_score"),
        "_po",
        profile(F.col("back")).alias("_pb"),
        "_r",
        text_tokens(F.col("back")).alias("_c"),
    )
    scored = _with_names(count_rows(given, whole=True)).select(
        "_kept.*",
        F.coalesce(bleu_score(), F.lit(0.0)).alias("bleu_score"),
        F.coalesce(F.col("_pb.valid"), F.lit(False)).alias("syntax_valid"),
        F.coalesce(structure_score("_po", "_pb"), F.lit(0.0)).alias("structure_score"),
        "semantic_score",
        F.coalesce(token_match(), F.lit(0.0)).alias("token_match"),
    )
    return scored.withColumn("overall_score", overall_score())

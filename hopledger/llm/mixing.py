"""Mixing sources to target weights by thresholds on a hash.

Every document has a 60-bit hash. Words are summed per source and hash bucket; the running sum over buckets gives, per source, the bucket
in which the budget ends. Only documents of that bucket are summed again by the next ten bits, until the boundary is a single hash. A
document below the threshold is taken once more; nothing is sorted by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopledger.llm.common import kept, word_count

BITS, LEVELS = 10, 6


def document_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5 digest; a null id counts as empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Per source (src, source_size) its target: ``share`` of all words dealt by weight, at most ``most`` times the source.

    What a full source cannot take is dealt again by weight until nobody is above; only totals come to the driver.
    """
    order = W.orderBy(F.col("src").asc_nulls_last())
    cases = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    dealt = sources.withColumn("weight", cases)
    full = F.lit(False)
    seen = -1
    while True:
        totals = dealt.select(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, F.col("source_size"))).alias("full_words"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not totals.weight or totals.n == seen:
            break
        seen = totals.n
        rest = share * (totals.words or 0) - most * (totals.full_words or 0)
        fair = F.lit(rest) * F.col("weight") / F.lit(float(totals.weight))
        full = full | (fair > most * F.col("source_size"))
        target = F.when(full, most * F.col("source_size")).otherwise(fair)
    if seen < 0:
        target = most * F.col("source_size")
    return dealt.select("src", "source_size", target.cast("double").alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1).cast("int")


def _prefix(level: int) -> Column:
    """The hash above the bits of ``level``."""
    return F.shiftright("hash", BITS * (LEVELS - level)) if level else F.lit(0).cast("long")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the hash below which documents are taken once more than the rest.

    Returns (src, source_size, target, base, cut): ``base`` copies of every document, one more where hash < cut. The boundary
    hash is taken if that brings the source nearer to its target.
    """
    base = F.when((F.col("source_size") > 0) & (F.col("target") >= F.col("source_size")), F.floor(F.col("target") / F.col("source_size")))
    state = kept(
        targets.withColumn("base", F.coalesce(base, F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.lit(True)).withColumn("cut", F.lit(0).cast("long"))
    )
    rows = sized
    for level in range(LEVELS):
        rows = _inside(rows, state, level)
        sums = rows.groupBy("src", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        running = F.sum("words").over(W.partitionBy("src").orderBy("bucket"))
        ends = (
            sums.withColumn("upto", running)
            .join(state.select(F.col("src").alias("s"), "budget"), F.col("src").eqNullSafe(F.col("s")))
            .filter(F.col("upto") > F.col("budget"))
            .groupBy("src").agg(F.min(F.struct("bucket", "upto", "words", "docs")).alias("end"))
        )
        last = level == LEVELS - 1
        shift = BITS * (LEVELS - 1 - level)
        at = F.shiftleft(F.col("prefix"), BITS) + F.col("end.bucket")
        left = F.col("budget") - (F.col("end.upto") - F.col("end.words"))
        single = (F.col("end.docs") == 1) | F.lit(last)
        nearer = F.col("end.words") - left < left
        over = F.col("end").isNull()  # the budget covers all that is left
        whole = F.shiftleft(F.col("prefix") + 1, BITS + shift)
        state = kept(
            state.join(ends.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").select(
                "src", "source_size", "target", "base",
                F.when(F.col("open") & ~over, left).otherwise(F.col("budget")).alias("budget"),
                F.when(F.col("open") & ~over, at).otherwise(F.col("prefix")).alias("prefix"),
                (F.col("open") & ~over & ~single).alias("open"),
                F.when(~F.col("open"), F.col("cut")).when(over, whole)
                .when(single, F.shiftleft(at + F.when(nearer, 1).otherwise(0), shift)).otherwise(F.col("cut")).alias("cut"),
            )
        )
        if state.filter("open").isEmpty():
            break
    return state.select("src", "source_size", "target", "base", "cut")


def _inside(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Documents of the boundary buckets that are still open."""
    if level == 0:
        return rows
    open_at = state.filter("open").select(F.col("src").alias("s"), F.col("prefix").alias("p"))
    return rows.join(open_at, rows.src.eqNullSafe(F.col("s")) & (_prefix(level) == F.col("p")), "left_semi")


def _plan(docs: DataFrame, weights: Sequence[int], share: float, most: float) -> tuple[DataFrame, DataFrame, Column]:
    """Sizes of the documents, the thresholds of the sources (src as s), and the copies of a document beside its threshold."""
    sized = kept(docs.select("doc_id", F.col("source").alias("src"), word_count(F.col("text")).alias("size"),
                             document_hash(F.col("doc_id")).alias("hash")))
    targets = kept(source_targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most))
    cuts = thresholds(sized, targets).withColumnRenamed("src", "s")
    copies = F.least(F.col("base") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0), F.lit(int(most)))
    return sized, cuts, copies


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often each document enters the mix: (doc_id, source, size, source_size, target, taken, copies).

    ``size`` counts words (null text: 0). Sources are weighted in code-point order, null last. A document is taken 0, 1 or 2 times, whole;
    documents with one id share one hash and one fate. A source's taken words miss its target by at most half of one boundary document
    (or of the documents that share its hash). Sources without words have target 0 and take nothing. Extra columns do not matter; an
    empty table gives no rows.
    """
    sized, cuts, copies = _plan(docs, weights, share, most)
    return sized.join(cuts, F.col("src").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("src").alias("source"), "size", "source_size", "target",
        (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"),
    )


def draw(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Texts are not shuffled: a row needs its source's threshold only."""
    _, cuts, copies = _plan(docs, weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("src"), document_hash(F.col("doc_id")).alias("hash"))
    placed = rows.join(cuts.select("s", "base", "cut"), F.col("src").eqNullSafe(F.col("s")))
    return placed.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("copy")).select("row.*")

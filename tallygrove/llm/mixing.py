"""Mixing sources to target weights.

Every source gets a word budget; within a source documents are taken in the order of exponential keys scaled by
quality weights (Efraimidis and Spirakis), so a heavier document tends to come earlier and no document is drawn twice
in an epoch.  A budget of 2.3 times a source is two complete epochs and a weighted selection for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranking import running_total
from ..semantics import join_on
from ..session import cut_lineage
from .store import stored

WORD = r"[^\x20\x09-\x0D]+"
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def source_targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Budget of each source: ``_size`` shared by weight, none above ``cap`` times its own size.

    ``sources`` has one row per source (``_source``, ``_size``).  Sources weigh ``weights`` in turn, ordered by code
    point, null last.  What a capped source cannot take is shared again by weight: filling sources by rising
    cap / weight, the level that remains after the k smallest caps is the answer as soon as it lies below the next cap.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("_share", turn).withColumn("_ratio", F.lit(float(cap)) * F.col("_size") / F.col("_share"))
    rising = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({
        "_left": F.sum("_size").over(Window.partitionBy()) - F.lit(float(cap)) * F.coalesce(F.sum("_size").over(before), F.lit(0)),
        "_open": F.sum("_share").over(after)})
    s = s.withColumn("_level", F.when(F.col("_left") / F.col("_open") < F.col("_ratio"), F.col("_left") / F.col("_open")))
    s = s.withColumn("_level", F.first("_level", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    free = F.col("_level") <= F.col("_ratio")
    target = F.when(free, F.col("_level") * F.col("_share")).otherwise(F.lit(float(cap)) * F.col("_size"))
    return s.select("_source", "_size", target.alias("_target"))


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_words`` (its size) and ``_drawn``, a uniform number that depends on id and seed alone."""
    hexed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_words": words, "_drawn": (F.conv(hexed, 16, 10).cast("long") + 1) / F.lit(float((1 << 52) + 1))})


def _ranked(measured: DataFrame, id_col: str, weight: Column) -> DataFrame:
    """With ``_rank``, the total order in which a source gives its documents: exponential key scaled by weight, id, size."""
    weight = F.when(weight > 0, weight).otherwise(F.lit(1.0))
    return measured.withColumn("_rank", F.struct((-F.log("_drawn") / weight).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col("_words").alias("words")))


def mix_plan(sized: DataFrame, weights: list[float], cap: float, source_col: str) -> DataFrame:
    """One row per source: size, target, complete epochs, and the last rank of the fractional selection (``_last``)."""
    sums = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("_words").alias("_size"))
    targets = cut_lineage(source_targets(sums, weights, cap).withColumn(
        "_epochs", F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_size")))
    order = [F.col("_source").asc_nulls_last(), F.col("_rank")]
    run = running_total(sized.select(F.col(source_col).alias("_source"), "_rank", "_words"), order, "_words", "_upto").withColumn("_ahead", F.col("_upto") - F.col("_words"))
    start = run.groupBy("_source").agg(F.min("_ahead").alias("_start"))
    # middles of the documents rise along the order, so the selection is everything up to one rank
    middle = F.col("_ahead") - F.col("_start") + F.col("_words") / 2
    chosen = join_on(run, join_on(targets, start, ["_source"]), ["_source"]).where((F.col("_words") > 0) & (middle <= F.col("_rest")))
    # stored, so that Spark knows its size: a plan under its broadcast limit does not make the documents move
    return stored(join_on(targets, chosen.groupBy("_source").agg(F.max("_rank").alias("_last")), ["_source"], "left"), "plan")


def _with_plan(sized: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    planned = join_on(sized, plan.withColumnRenamed("_source", source_col), [source_col])
    extra = F.when(F.col("_words") > 0, F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False)).cast("int")).otherwise(0)
    return planned.withColumn("_copies", F.when(F.col("_words") > 0, F.col("_epochs") + extra).otherwise(0))


def mix_sources(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``copies`` is how often the mix holds the document and ``taken = copies * size``.  Whole documents only: at the
    edge of a budget the document that crosses it is taken when that ends nearer to the budget.  ``quality`` has a
    weight (``_weight``) for some ids (``_labelled``, once each); the others weigh 1, as do null and non-positive
    weights.  Null text has size 0 and is never taken; a null source is a source of its own; equal keys are ordered by
    id and size, so rows that still tie are interchangeable.  Other columns of the input are left out, whatever their
    names.  An empty table gives an empty result.
    """
    slim = stored(_measured(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), F.col(text_col).alias("_text")), seed, "_id", "_text").drop("_text"), "sizes")
    if quality is not None:
        slim = slim.join(quality, slim["_id"] == quality["_labelled"], "left").drop("_labelled")
    ranked = stored(_ranked(slim, "_id", F.col("_weight") if quality is not None else F.lit(1.0)).select("_id", "_of", "_words", "_rank"), "ranks")
    both = _with_plan(ranked, mix_plan(ranked, list(weights), cap, "_of"), "_of")
    return both.select(
        F.col("_id").alias(id_col), F.col("_of").alias(source_col), F.col("_words").alias("size"), F.col("_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_words")).alias("taken"), F.col("_copies").cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix_sources`` takes it with the same ``quality``.

    The plan is made from ids and sizes.  Of the weights only those of labelled documents that they bring in or keep out
    meet the texts.
    """
    sized = _measured(docs, seed, id_col, text_col)
    alike = _ranked(sized, id_col, F.lit(1.0))
    if quality is None:
        plan = mix_plan(stored(alike.select(source_col, "_words", "_rank"), "ranks"), list(weights), cap, source_col)
        copies = _with_plan(alike, plan, source_col)
    else:
        slim = stored(sized.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), "_words", "_drawn"), "sizes")
        slim = slim.join(quality, slim["_id"] == quality["_labelled"], "left").drop("_labelled")
        ranked = stored(_ranked(slim, "_id", F.col("_weight")).select("_id", "_of", "_words", "_drawn", "_weight", "_rank"), "ranks")
        plan = mix_plan(ranked.drop("_drawn", "_weight"), list(weights), cap, "_of")
        # a weight that does not change what a document's rank decides is left out
        plain = _ranked(ranked.withColumn("_own", F.col("_rank")), "_id", F.lit(1.0))
        both = join_on(plain, plan.withColumnRenamed("_source", "_of"), ["_of"])
        moved = both.where("_weight > 0 and _words > 0 and (_own <= _last) <> (_rank <= _last)")
        changed = stored(moved.groupBy(F.col("_id").alias("_labelled")).agg(F.max("_weight").alias("_weight")), "weights")
        weighed = sized.join(changed, sized[id_col] == changed["_labelled"], "left").drop("_labelled")
        copies = _with_plan(_ranked(weighed, id_col, F.col("_weight")), plan, source_col)
    copies = copies.where("_copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(*docs.columns)


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weight of every labelled document: 2 for good, 0.5 for poor; several labels of one document count as the best."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality"))
    return best.select("_labelled", F.when(F.col("_quality") == 1, QUALITY_WEIGHT[1]).when(F.col("_quality") == 0, QUALITY_WEIGHT[0]).alias("_weight"))

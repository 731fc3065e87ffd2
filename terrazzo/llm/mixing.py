"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations.

Everything here is DataFrame expressions: two aggregations over the documents and one pass that compares each
document's permutation key with its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrazzo.plans.durable import broadcast_if_small, materialize

#: Halvings of the exponent's interval [0, 1].
STEPS = 50


def permutation_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """A 60-bit key: ascending order of it is the permutation of a source in one epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, doc_id.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bisect(fits: str) -> str:
    """SQL for the largest exponent in [0, 1] that ``fits`` (a predicate on ``t``), to 2**-STEPS."""
    return (
        f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (z, i) -> "
        f"transform(array((z.lo + z.hi) / 2), t -> if({fits}, named_struct('lo', t, 'hi', z.hi), named_struct('lo', z.lo, 'hi', t)))[0], "
        "z -> z.lo)"
    )


def source_weights(
    sizes: DataFrame, budget: float, target_entropy: float | None = None, max_repeats: float | None = None
) -> DataFrame:
    """Temperature-mixed weights of ``sizes(source, n_tokens)``: adds ``weight`` and ``alpha``.

    The exponent ``alpha`` in [0, 1] is the largest whose weights ``share**alpha`` (normalised) have at least
    ``target_entropy`` times the entropy of uniform weights; or, with ``max_repeats``, the smallest whose most repeated
    source is used at most that often in a budget of ``budget`` tokens.  1 keeps the corpus's shares, 0 is uniform.
    When the bound can't be met in [0, 1], the nearest end is taken.  Sources without tokens get no weight.
    """
    one = sizes.where("n_tokens > 0").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "source"))).alias("s"))
    one = one.select("s", F.expr("aggregate(s, 0D, (a, x) -> a + x.n_tokens)").alias("total"))
    one = one.select("s", F.expr("transform(s, x -> ln(x.n_tokens / total))").alias("lp"))
    z = "aggregate(lp, 0D, (a, x) -> a + exp(t * x))"
    if max_repeats is not None:
        worst = f"aggregate(s, 0D, (a, x) -> greatest(a, exp(t * ln(x.n_tokens / total)) / ({z}) * {float(budget)!r} / x.n_tokens))"
        one = sizes.where("n_tokens > 0").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "source"))).alias("s"))
        one = one.select("s", F.expr("aggregate(s, 0D, (a, x) -> a + x.n_tokens)").alias("total"))
        one = one.select("s", "total", F.expr("transform(s, x -> ln(x.n_tokens / total))").alias("lp"))
        # the smallest exponent that fits is one minus the largest that fits on the mirrored scale
        alpha = "1 - " + _bisect(f"({worst.replace('(t *', '((1 - t) *')}) <= {float(max_repeats)!r}")
    else:
        entropy = f"ln({z}) - ({z.replace('exp(t * x)', 't * x * exp(t * x)')}) / ({z})"
        goal = 0.9 if target_entropy is None else float(target_entropy)
        alpha = _bisect(f"({entropy}) >= {goal!r} * ln(size(lp))")
    one = one.withColumn("alpha", F.round(F.expr(alpha), 9))
    one = one.withColumn("z", F.expr(z.replace("t *", "alpha *")))
    return one.select("alpha", "z", F.posexplode(F.arrays_zip("s", "lp"))).select(
        F.col("col.s.source").alias("source"),
        F.col("col.s.n_tokens").alias("n_tokens"),
        (F.exp(F.col("alpha") * F.col("col.lp")) / F.col("z")).alias("weight"),
        "alpha",
    )


def word_count(text: Column) -> Column:
    """Words: runs outside space and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_plan(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = 0.95,
    max_repeats: float | None = None,
    seed: int = 1,
    block_docs: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """``(plan, sized)``: per source its weight, quota, whole epochs and cut; per document its size.

    Source quotas are ``floor(weight * budget)`` tokens (``budget``: all tokens, by default).  A source is used
    ``epochs`` times as a whole, then by a prefix of a fresh permutation: documents with ``(key, doc_id)`` up to
    ``(cut_key, cut_id)`` fill the rest of the quota without exceeding it.

    A null source is a source of its own.  Documents without tokens (null or empty text) follow their keys like
    others and cost nothing.  Rows repeating a ``doc_id`` share a key and stand or fall together.  Without tokens at
    all, or on an empty table, the plan is empty.

    A hot source isn't gathered: its documents are dealt by permutation key to blocks of about ``block_docs`` rows,
    running sums are taken within blocks, and the blocks' totals are summed per source.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("n_tokens")), "sizes"
    )
    per = materialize(sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")), "sources")
    total = per.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    weights = source_weights(per.select("source", "n_tokens"), budget, target_entropy, max_repeats)
    quota = F.floor(F.round(F.col("weight") * F.lit(float(budget)), 3)).cast("long")
    plan = (
        weights.withColumn("quota", quota)
        .withColumn("epochs", F.expr("quota div n_tokens"))
        .withColumn("rest", F.expr("quota % n_tokens"))
        .join(per.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("n_blocks", F.greatest(F.lit(1), F.expr(f"n_docs div {int(block_docs)}")))
    )
    plan = materialize(plan, "plan")
    few = broadcast_if_small(plan)
    keyed = (
        sized.join(few.select(F.col("source").alias("s"), "epochs", "rest", "n_blocks"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("key", permutation_key(F.col("doc_id"), seed, F.col("epochs")))
        .withColumn("block", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("n_blocks")).cast("long"))
    )
    blocks = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("b_tokens"), F.max("rest").alias("rest"))
    ahead = F.sum("b_tokens").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    # the block in which the quota ends, and whole blocks before it
    edge = materialize(blocks.where("ahead <= rest and ahead + b_tokens > rest"), "edges")
    at = broadcast_if_small(edge.select(F.col("source").alias("s"), F.col("block").alias("e"), "ahead"))
    inside = keyed.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("e")))
    upto = F.sum("n_tokens").over(W.partitionBy("s", "block").orderBy("key", "doc_id")) + F.col("ahead")
    over = inside.withColumn("upto", upto).where("upto > rest")
    cut = over.groupBy(F.col("s")).agg(F.min(F.struct("key", "doc_id")).alias("cut"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(plan, "mix"), sized


def _copies(docs: DataFrame, plan: DataFrame, seed: int, doc_id: str, source: str) -> DataFrame:
    """``docs`` with ``epochs``, ``key`` and ``copies``."""
    few = broadcast_if_small(plan.select(F.col("source").alias("__mix_s"), F.col("epochs").alias("__mix_epochs"), F.col("cut").alias("__mix_cut")))
    key = permutation_key(F.col(doc_id), seed, F.col("__mix_epochs"))
    rest = F.col("__mix_cut").isNull() | (F.struct(key.alias("key"), F.col(doc_id).alias("doc_id")) < F.col("__mix_cut"))
    return (
        docs.join(few, F.col(source).eqNullSafe(F.col("__mix_s")))
        .withColumn("__mix_copies", (F.col("__mix_epochs") + rest.cast("long")))
        .where("__mix_copies > 0")
        .drop("__mix_s", "__mix_cut")
    )


def mix_documents(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """``docs`` (all its columns) resampled to the mix: documents of scarce sources repeat, one row a copy."""
    plan, _ = mix_plan(docs, seed=seed, doc_id=doc_id, source=source, **how)
    out = _copies(docs, plan, seed, doc_id, source).withColumn("__mix_e", F.explode(F.expr("sequence(1L, __mix_copies)")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_schedule(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The mix as a schedule: ``(doc_id, source, n_tokens, epoch, block, key)`` for every copy of every document.

    Reading a source's rows by ``(epoch, block, key)`` gives its permutations one after another.
    """
    plan, sized = mix_plan(docs, seed=seed, **how)
    picked = _copies(sized, plan, seed, "doc_id", "source").join(
        broadcast_if_small(plan.select(F.col("source").alias("s"), "n_blocks")), F.col("source").eqNullSafe(F.col("s"))
    )
    picked = picked.withColumn("epoch", F.explode(F.expr("sequence(0L, __mix_copies - 1)")))
    key = permutation_key(F.col("doc_id"), seed, F.col("epoch"))
    return picked.select(
        "doc_id", "source", "n_tokens", "epoch",
        F.floor(key / F.lit(float(1 << 60)) * F.col("n_blocks")).cast("long").alias("block"), key.alias("key"),
    )

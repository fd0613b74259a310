"""Problem 9: mixing sources to target weights.

Documents are never sorted. A document's place in its source is a hash of its id; a source's share is all documents
below a threshold. The threshold comes from histograms: tokens summed by source and hash bucket, the bucket in which
the budget runs out, then the same within that bucket only, until a bucket is one hash value. Thresholds nest: a
larger budget keeps every document of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import count_tokens
from siltstone.session import materialise, spread

BITS = 12
LEVELS = 5
SOURCES_AT_ONCE = 200_000  # targets that are broadcast, about 10 MB


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, budget): a row a target. ``sizes``: source, docs, tokens.

    budget = the target share of ``total`` tokens (None: of all tokens there are), or ``max_repeats`` times the source if
    that is less. The missing share of a capped source isn't given to others: their ratios to each other stay as asked."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = t.join(sizes, "source", "left").fillna(0, ["docs", "tokens"])
    whole = F.lit(total) if total is not None else F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    want = F.round(F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0))) * whole).cast("long")
    cap = F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))) * F.col("tokens")
    return joined.withColumn("budget", F.least(want, cap.cast("long")))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total: int | None = None,
    tokenizer: str | None = None,
    seed: int = 0,
    size: str | None = None,
) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture and how often each is used, never over max_repeats.

    A source's last, partly used round takes the documents whose hash is below its threshold, in whole documents: it
    stays within its budget by less than the documents of one hash value. Null texts or sources, empty texts, and
    sources without a target aren't used. Repeated rows of an id count once. ``size``: a column with the documents' sizes, where
    they are known already or aren't tokens; then no text is read."""
    return _mix(docs, targets, doc_id, source, text, total, tokenizer, seed, size)[0]


def mixture_report(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, budget, used_docs, used_tokens, actual_share): a row a target."""
    args = {"doc_id": "doc_id", "source": "source", "text": "text", "total": None, "tokenizer": None, "seed": 0, "size": None} | options
    chosen, plan = _mix(docs, targets, *args.values())
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    out = plan.join(used, "source", "left").fillna(0, ["used_docs", "used_tokens"])
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy(F.lit(1))))
    return out.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 9)).select(
        "source", "target_share", "max_repeats", "docs", "tokens", "budget", "used_docs", "used_tokens", "actual_share"
    )


def _mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str, total: int | None, tokenizer: str | None, seed: int, size: str | None) -> tuple[DataFrame, DataFrame]:
    goal = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")).filter("source is not null")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(size or text).cast("long" if size else "string").alias("tokens" if size else "text"))
    rows = rows.filter(f"doc_id is not null and source is not null and {'tokens' if size else 'text'} is not null")
    counted = rows if size else count_tokens(spread(rows), "text", tokenizer)
    sized = counted.filter("tokens > 0").groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens"), F.struct("source", "tokens")).alias("s"))
    # 60 bits of an MD5, the same in every engine
    h = F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit(seed)).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    sized = materialise(sized.select("doc_id", "s.source", "s.tokens", h.alias("h")))
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    plan = budgets(sizes, goal, total)
    plan = materialise(plan)
    small = plan.count() <= SOURCES_AT_ONCE
    each = (lambda d: F.broadcast(d)) if small else (lambda d: d)  # beyond that bound Spark joins by shuffle and splits skewed sources
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    # left: what the last round may use; below: the threshold so far, documents under it are in
    state = materialise(plan.select("source", full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("left")).withColumn("below", F.lit(0).cast("long")).withColumn("open", F.lit(True)))
    for level in range(LEVELS):
        step = 1 << (BITS * (LEVELS - 1 - level))
        inside = F.col("open") & (F.col("h") >= F.col("below")) & (F.col("h") < F.col("below") + F.lit(step << BITS))
        hist = sized.join(each(state.filter("open and left > 0")), "source").filter(inside)
        hist = hist.groupBy("source", F.floor((F.col("h") - F.col("below")) / F.lit(step)).cast("long").alias("bucket")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        running = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = hist.withColumn("run", running).join(state.select("source", "left"), "source").filter(F.col("run") > F.col("left"))
        edge = edge.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("run") - F.col("t")).alias("before"), "n"), "bucket").alias("e"))
        state = state.join(edge, "source", "left").select(
            "source",
            "full",
            (F.col("left") - F.coalesce("e.before", F.lit(0))).alias("left"),
            F.when(F.col("e").isNotNull(), F.col("below") + F.col("e.bucket") * step).otherwise(F.when(F.col("open") & (F.col("left") > 0), F.col("below") + F.lit(step << BITS)).otherwise(F.col("below"))).alias("below"),
            (F.col("open") & F.col("e").isNotNull() & (F.col("e.n") > 1)).alias("open"),  # a bucket of one document is settled
        )
        state = materialise(state)
        if not state.filter("open").head(1):
            break
    copies = F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    chosen = sized.join(each(state.select("source", "full", "below")), "source").withColumn("copies", copies).filter("copies > 0")
    return chosen.select("doc_id", "source", "tokens", "copies"), plan

"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: the total (a share of all words) is dealt by weight, a source stops at ``most``
times its own size, and the excess is reshared by weight among the others. That is water-filling: the level rises as
sources reach their limit, until none is above. Weights go by the place of a source in the order of all.

Within a source a document's expected number of copies is e = min(most, theta * w), with w rising slowly with the
document's length class, and theta chosen so that the expected words equal the target (in closed form over at most 64
length classes a source). floor(e) whole copies are certain. The rest p = e - floor(e) is drawn by Pareto sampling:
documents are ranked by the odds of a hashed uniform number over the odds of p, and the first of the order are taken.
The sample's size is fixed in words: the order is cut where the source's words come closest to the target.

Nothing that grows is gathered in one task, but for the last of these: sources are numbered and levelled by sums over
all tasks; words are summed over (source, rank bin), BINS rows a source, and the cut's bin is found on those sums; only
the documents of that bin, one in BINS of a source, are put in order.

Defined results: a null or empty text has size 0 and contributes nothing. A null source is a source of its own, the
last. A null id is drawn by its text. Repeated rows share one draw; if the cut falls among them, only so many of them
are taken as come closest to the target. Ties of rank are broken by id and size. A very long text is counted whole.
Empty input gives an empty result. Input columns whose names clash with the outputs are not carried;
``mixed_documents`` carries them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import discard, materialize, small

#: Production parameters: weights in the order of sources, the share of all words, and the limit on copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bins of the rank in which a source's cut is searched.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: str, text: str) -> Column:
    """A uniform number in (0, 1) from the id, or from the text where there is none."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t:"), F.coalesce(F.col(text), F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def _class(size: str) -> Column:
    """The number of binary digits of the size."""
    return F.length(F.bin(F.col(size))).cast("int")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    # as a generator's output, size is worked out once: no filter on it is pushed below, where it would be once more
    found = F.inline(F.array(F.struct(word_count(text).alias("size"), _draw(doc_id, text).alias("u"))))
    return docs.select(*more, F.col(doc_id).alias("id"), F.col(source).alias("source"), found).withColumn("k", _class("size"))


def _ranked(df: DataFrame) -> DataFrame:
    """Adds w, whole copies, p, and the rank and its bin, from theta."""
    e = F.least(F.lit(float(MOST)), F.col("theta") * F.col("w"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return (
        df.withColumn("w", 1 + F.col("k") / F.lit(16.0))
        .withColumn("e", e)
        .withColumn("whole", F.floor("e"))
        .withColumn("p", F.col("e") - F.col("whole"))
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
        .withColumn("bin", F.floor(F.lit(float(BINS)) * (F.col("rank") / (1 + F.col("rank")))))
    )


def _placed(sources: DataFrame) -> DataFrame:
    """sources with at, their place by code point, null last, without gathering them in one task."""
    order = (F.col("source").isNull(), F.col("source").cast("binary"))
    dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id() % (1 << 33)), "mix-placed")
    parts = rows.groupBy("part").agg(F.count("*").alias("many"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select("part", F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("offset"))
    out = rows.join(small(parts), "part").select(*sources.columns, (F.col("offset") + F.col("own")).alias("at"))
    out._quarry_path = rows._quarry_path
    return out


def source_targets(by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Discarding the result discards its places."""
    s = _placed(by_source)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight, limit = F.element_at(listed, (F.col("at") % len(weights) + 1).cast("int")), F.col("source_size") * most
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    full, level = F.lit(False), 0.0
    while True:  # the level rises as sources reach their limit
        capped, left = s.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, weight))).first()
        if not left or (total - (capped or 0)) / left == level:
            break
        level = (total - (capped or 0)) / left
        full = F.lit(level) * weight > limit
    out = s.select("source", "source_size", F.when(full, limit.cast("double")).otherwise(F.lit(level) * weight).alias("target"))
    out._quarry_path = s._quarry_path
    return out


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a source: source, source_size, target, theta, the last (rank, id, size) that the draw takes, and how many of its rows, if not all."""
    sized = materialize(_sized(docs, doc_id, text, source), "mix-sizes")
    classes = materialize(sized.groupBy("source", "k").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # theta: the longest classes are at the limit up to the first that stays below it
    fill = Window.partitionBy("source").orderBy(F.col("k").desc())
    c = classes.withColumn("w", 1 + F.col("k") / F.lit(16.0)).join(targets, classes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    c = (
        c.withColumn("before", F.coalesce(F.sum("words").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
        .withColumn("rest", F.sum(F.col("w") * F.col("words")).over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("theta", F.when(F.col("rest") > 0, (F.col("target") - F.col("before")) / F.col("rest")))
        .withColumn("fits", F.col("theta") * F.col("w") <= most)
    )
    per_source = c.groupBy("source", "source_size", "target").agg(F.coalesce(F.max_by("theta", F.when(F.col("fits"), F.col("k"))), F.lit(float(most))).alias("theta"))
    per_source = materialize(per_source, "mix-sources")
    sources = per_source.count()
    ranked = _ranked(_with_sources(sized, per_source.select("source", "target", "theta"), sources))
    bins = ranked.groupBy("source", "bin", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("whole_words"), F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = (
        bins.withColumn("need", F.col("target") - F.sum("whole_words").over(Window.partitionBy("source")))
        .where("bin IS NOT NULL")
        .withColumn("before", F.coalesce(F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("before < need")
    )
    cuts = materialize(bins.groupBy("source").agg(F.max_by(F.struct("bin", "before", "need"), "bin").alias("cut")).select("source", "cut.*"), "mix-cuts")
    edge = _with_sources(ranked.drop("target"), cuts.withColumnRenamed("bin", "cut_bin"), sources).where("bin = cut_bin")
    # equal rows are summed first, and the cut among them is worked out, so a group of any size is one row here
    edge = edge.groupBy("source", "rank", "id", "size", "before", "need").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size")
    edge = edge.withColumn("words", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.withColumn("fit", F.least(F.col("rows"), F.floor((F.col("need") - F.col("words")) / F.col("size") + 0.5)))
    last = edge.where("fit > 0").groupBy("source").agg(F.max_by(F.struct(F.struct("rank", "id", "size").alias("last"), F.when(F.col("fit") < F.col("rows"), F.col("fit")).alias("fit")), F.struct("rank", "id", "size")).alias("found"))
    last = last.select("source", "found.*")
    s, x, y = per_source.alias("s"), cuts.alias("x"), last.alias("y")
    plan = s.join(x, F.expr("s.source <=> x.source"), "left").join(y, F.expr("s.source <=> y.source"), "left")
    plan = materialize(plan.select("s.source", "s.source_size", "s.target", "s.theta", F.expr("x.bin AS cut_bin"), "y.last", "y.fit"), "mix-plan")
    discard(sized, classes, targets, per_source, cuts)
    return plan


def _with_sources(df: DataFrame, per_source: DataFrame, sources: int) -> DataFrame:
    """df with the columns of its source; nulls match."""
    right = small(per_source.withColumnRenamed("source", "its_source"), sources)
    return df.join(right, df["source"].eqNullSafe(right["its_source"])).drop("its_source")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, their number within their source, without gathering a source in one task."""
    rows = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mix-ties")
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("many"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("its_source"), F.col("part").alias("its_part"), F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy("place"))
    met = rows.withColumn("own", own).join(parts, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("part") == F.col("its_part")))
    return met.withColumn("nth", F.col("offset") + F.col("own")).drop("part", "place", "own", "its_source", "its_part", "offset")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Whole copies plus the drawn one: all bins before the cut's, and in it the order up to its last."""
    rows = _ranked(_with_sources(rows, plan, plan.count()))
    at = F.struct("rank", "id", "size")
    drawn = F.col("rank").isNotNull() & F.col("cut_bin").isNotNull() & ((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (at <= F.col("last"))))
    copies = lambda taken: (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("int")).cast("long")
    if plan.where("fit IS NOT NULL").isEmpty():
        return rows.withColumn("copies", copies(drawn))
    tied = F.coalesce(drawn & (F.col("bin") == F.col("cut_bin")) & F.col("fit").isNotNull() & (at >= F.col("last")), F.lit(False))
    cut = _numbered(rows.where(tied)).withColumn("copies", copies(F.col("nth") <= F.col("fit"))).drop("nth")
    return rows.where(~tied).withColumn("copies", copies(drawn)).unionByName(cut)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    plan = plan_mix(docs, weights, share, most, doc_id, text, source)
    out = _with_copies(_sized(docs, doc_id, text, source), plan)
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, with the columns of docs."""
    plan = plan_mix(docs, weights, share, most)
    out = _with_copies(_sized(docs, "doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), plan)
    return out.where("copies > 0 AND size > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")

"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents should have. The whole part is given; the
fractions are rounded so that the words of a source stay what they were: two fractions meet, and words move from one to the other (which way is drawn, so
that each fraction keeps its expectation) until one of them is 0 or 1; the other goes on to the next. Fractions meet within buckets of about a hundred documents of like length,
one of a bucket's is left, and what is left of neighbouring buckets meets in the next round: a reduction tree, whose depth grows with the
logarithm of a source's documents. Last meet the length classes of a source, from long to short, so that the one fraction left, which is drawn,
is mostly that of a short document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import boxed, checkpoint, pick, unboxed

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Units of a bucket, about; children of a node of the tree; what the draws hang on.
BUCKET = 96
FAN = 64
SEED = 11


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, n) with ``rank`` and ``target``.

    All sizes are shared by weight; a source stops at MOST_COPIES times its size, and what it can't take goes to the others by weight. In the order of
    cap / weight the sources that stop come first, so that running sums tell where they end: no iteration is needed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", weigh).withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy()
    runs = ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    runs = runs.withColumn("w_before", F.coalesce(F.sum("w").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    runs = runs.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("w_all", F.sum("w").over(every))
    runs = runs.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    # The level is reached at the first source that takes its share at it; all that come later take theirs at the same level.
    runs = runs.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    runs = runs.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return runs.select("source", "source_size", "n", "rank", target.alias("target"))


#: One meeting of the fraction carried so far (a) and the next (b); up and dn: the words that can move to a, and from it.
_MEET = """
transform(array(named_struct('a', st.c, 'b', b,
    'up', least((1 - st.c.p) * st.c.w, b.p * b.w), 'dn', least(st.c.p * st.c.w, (1 - b.p) * b.w),
    'u', shiftrightunsigned(xxhash64({seed}, st.c.h, b.h), 11) * 1.1102230246251565e-16D)), x ->
  transform(array(CASE
    WHEN x.u * (x.up + x.dn) < x.dn THEN named_struct(
      'pa', CASE WHEN x.up >= (1 - x.a.p) * x.a.w THEN 1.0D ELSE x.a.p + x.up / x.a.w END,
      'pb', CASE WHEN x.up >= x.b.p * x.b.w THEN 0.0D ELSE x.b.p - x.up / x.b.w END)
    ELSE named_struct(
      'pa', CASE WHEN x.dn >= x.a.p * x.a.w THEN 0.0D ELSE x.a.p - x.dn / x.a.w END,
      'pb', CASE WHEN x.dn >= (1 - x.b.p) * x.b.w THEN 1.0D ELSE x.b.p + x.dn / x.b.w END) END), q ->
    CASE WHEN q.pa <= 0 OR q.pa >= 1 THEN named_struct(
      'c', named_struct('h', x.b.h, 'p', q.pb, 'w', x.b.w, 'r', x.b.r),
      'd', concat(st.d, array(named_struct('h', x.a.h, 'p', q.pa, 'w', x.a.w, 'r', x.a.r))))
    ELSE named_struct(
      'c', named_struct('h', x.a.h, 'p', q.pa, 'w', x.a.w, 'r', x.a.r),
      'd', concat(st.d, array(named_struct('h', x.b.h, 'p', q.pb, 'w', x.b.w, 'r', x.b.r)))) END)[0])[0]
"""

_ROUND = "aggregate(slice(us, 2, size(us)), named_struct('c', us[0], 'd', slice(us, 1, 0)), (st, b) -> {meet}, st -> concat(st.d, array(st.c)))"


def _round(units: DataFrame, *keys: str) -> DataFrame:
    """units (keys, u) with the fractions of each group rounded but for one; long documents meet first, so that what is left over is short."""
    meet = _ROUND.format(meet=_MEET.format(seed=SEED))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("u.w")).alias("o"), "u")))
    return units.groupBy(*keys).agg(F.transform(listed, lambda x: x["u"]).alias("us")).select(*keys, F.explode(F.expr(meet)).alias("u"))


def copies(sized: DataFrame) -> DataFrame:
    """doc_id, source, size, m (rows alike), source_size, target, total (copies of these rows together).

    sized: doc_id, source, size of every row. Rows alike in all three are one unit with m times the copies; units without words get none.
    """
    units = checkpoint(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    sources = checkpoint(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("bigint").alias("source_size"), F.count("*").alias("n"))))
    # Documents of about one length meet among themselves first: a class for each eighth of a doubling.
    units = units.withColumn("class", F.when(F.col("size") > 0, F.floor(8 * F.log2("size"))).otherwise(-1).cast("int"))
    classes = units.groupBy("source", "class").agg(F.count("*").alias("n"))
    sources = sources.drop("n").withColumnRenamed("source", "s").join(classes, F.col("s").eqNullSafe(F.col("source"))).withColumnRenamed("class", "k").drop("source")
    sources = checkpoint(sources)
    most = sources.agg(F.max("n")).first()[0] or 0
    both = units.join(sources, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))).drop("s", "k")
    share = F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("m")
    both = both.withColumn("want", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0))).withColumn("base", F.floor("want").cast("bigint"))
    rest = F.struct("doc_id", "source", "size", "m", "source_size", "target", "base")
    h = F.xxhash64(F.lit(SEED), "doc_id", "source", "size")
    u = F.struct(h.alias("h"), (F.col("want") - F.col("base")).alias("p"), F.col("size").cast("double").alias("w"), rest.alias("r"))
    node = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "size"), F.ceil(F.col("n") / BUCKET)).cast("bigint")
    open_, nodes = both.select("rank", "class", node.alias("node"), u.alias("u")), -(-most // BUCKET)
    whole = "u.p <= 0 or u.p >= 1"
    done = [open_.where(whole)]
    open_ = open_.where(f"not ({whole})")
    while True:
        now = checkpoint(_round(open_, "rank", "class", "node"))
        done.append(now.where(whole))
        open_ = now.where(f"not ({whole})")
        if nodes <= 1:
            break
        open_, nodes = open_.withColumn("node", F.expr(f"node div {FAN}")), -(-nodes // FAN)
    now = checkpoint(_round(open_, "rank"))
    done.append(now.where(whole))
    open_ = now.where(f"not ({whole})")
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 2), "u.h"), 11) * F.lit(2.0**-53)) < F.col("u.p")
    done.append(open_.withColumn("u", F.col("u").withField("p", F.when(draw, 1.0).otherwise(0.0))))
    out = done[0].select("u")
    for more in done[1:]:
        out = out.unionByName(more.select("u"))
    return out.select("u.r.*", (F.col("u.r.base") + F.col("u.p").cast("bigint")).alias("total")).drop("base")


def _sized(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row.

    Null texts and texts without words have size 0 and give nothing; null is a source of its own, the last; null doc_ids are a
    doc_id like any other. Rows alike in doc_id, source and size share their copies as evenly as whole numbers can; an empty table gives an empty
    result; other columns are not read. The draws hang on doc_id, source and size only, so that reruns agree.
    """
    units = copies(_sized(docs)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    each = F.expr("total div m") + F.when(F.col("i") <= F.col("total") % F.col("m"), 1).otherwise(0)
    return units.select("doc_id", "size", "source_size", "target", (each * F.col("size")).cast("bigint").alias("taken"), each.cast("bigint").alias("copies"))


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The rows as often as the mixture takes them, with the columns they came with."""
    size = n_words(F.col("text").cast("string"))
    rows = boxed(docs, kd=F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), kh=F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), size), h=F.xxhash64("text"))
    units = copies(_sized(docs)).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("kd"), F.xxhash64("doc_id", "source", "size").alias("kh"), "m", "total")
    taken = rows.join(units, ["kd", "kh"])
    nth = F.when(F.col("m") > 1, F.row_number().over(Window.partitionBy("kd", "kh").orderBy("h"))).otherwise(1)
    each = F.expr("total div m") + F.when(nth <= F.col("total") % F.col("m"), 1).otherwise(0)
    return unboxed(taken.withColumn("each", each.cast("int")).where("each > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("each")))), docs.columns)

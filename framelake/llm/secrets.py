"""Secret scans: spans of credentials, and the linking of credentials that come in parts.

Strong spans stand for themselves: assignments to a telling name, access identifiers, long hexadecimal runs. Weak candidates look like parts of a
credential and are as often something else: user or client names, mixed runs of letters and digits, addresses of services. A weak candidate is
reported only when the parts that complete it lie in its scope, REACH code points to either side: a name needs a secret, a secret a name (or an
access identifier), an address needs both. The interval join of parts and scopes is a sweep over a document's parts in order
of their places, both ways, which carries the nearest part of each kind along: no pairs are made, however many parts a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import boxed, pick, unboxed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex")
#: Weak candidates: a named identity, a mixed run, an address.
NAME = r"""(?i:client_id|user_?name|user_?id|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
MIXED = r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]*[0-9])(?=[A-Z0-9/+]*[a-z])(?=[a-z0-9/+]*[A-Z])[A-Za-z0-9/+]{20,}={0,2}"
ADDRESS = r"""[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]{3,}"""
WEAK = ("name", "mixed", "address")
REACH = 256
_STEP = 256


def running(sizes: Column) -> Column:
    """The sums of all entries up to each, in blocks, so that long arrays don't cost the square of their length."""

    def sums(xs: Column) -> Column:
        grown = F.aggregate(xs, F.struct(F.lit(0).cast("bigint").alias("s"), F.expr("cast(array() as array<bigint>)").alias("a")), lambda st, x: F.struct((st["s"] + x).alias("s"), F.concat(st["a"], F.array(st["s"] + x)).alias("a")))
        return grown["a"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int")), lambda i: sums(F.slice(sizes, i * _STEP + 1, F.lit(_STEP))))

    def shifted(inner: Column) -> Column:
        ends = sums(F.transform(inner, lambda b: F.element_at(b, -1)))
        return F.flatten(F.transform(inner, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(0))))

    return F.element_at(F.transform(F.array(blocks), shifted), 1)


def spans(text: Column, pattern: str, kind: int, test: Column, keep, groups: bool = False) -> Column:
    """array of (start, kind, end, ok) of all matches, leftmost and apart; keep(match, last group) tells which stand.

    What lies between matches gives their places: the text is split by the pattern only where ``test`` finds it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if groups else 0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    sizes = F.transform(whole, lambda x: F.length(x).cast("bigint"))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(sizes)), sizes, lambda a, b: a + b)
    ends = running(steps)
    made = F.transform(F.arrays_zip(ends.alias("e"), whole.alias("m"), last.alias("g")), lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), F.lit(kind).alias("kind"), z["e"].alias("end"), keep(z["m"], z["g"]).alias("ok")))
    found = F.transform(F.filter(made, lambda z: z["ok"]), lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind"), z["end"].alias("end")))
    return F.when(test, found).otherwise(F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))


def strong_spans(text: Column) -> list[Column]:
    return [
        spans(text, ASSIGN, 0, text.rlike(ASSIGN), lambda m, g: F.length(g) >= 8, groups=True),
        spans(text, ACCESS, 1, text.contains("AKIA"), lambda m, g: F.length(m) >= 16),
        spans(text, HEX, 2, text.rlike("[0-9a-f]{32}"), lambda m, g: F.length(m) >= 32),
    ]


def weak_spans(text: Column) -> list[Column]:
    return [spans(text, p, 3 + i, text.rlike(p), lambda m, g: F.lit(True)) for i, p in enumerate((NAME, MIXED, ADDRESS))]


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS + WEAK])
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def linked(docs: DataFrame) -> DataFrame:
    """kd, kh, weak: the weak spans that are reported, by document key. docs: kd, kh, text."""
    some_name = F.col("text").contains("AKIA") | F.col("text").rlike(NAME)
    some_weak = F.col("text").rlike(MIXED) | F.col("text").rlike(NAME) | F.col("text").rlike(ADDRESS)
    parts = docs.where(some_name & some_weak).select("kd", "kh", F.concat(*strong_spans(F.col("text")), *weak_spans(F.col("text"))).alias("parts"))
    parts = parts.dropDuplicates(["kd", "kh"]).select("kd", "kh", F.explode("parts").alias("s")).select("kd", "kh", "s.start", "s.kind", "s.end")
    strong, mixed = F.col("kind").isin(0, 1, 2), F.col("kind") == 4
    one = Window.partitionBy("kd", "kh")
    ahead = one.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = one.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def last(which: Column) -> Column:
        return F.max(F.when(which, F.col("end"))).over(ahead)

    def following(which: Column) -> Column:
        return F.min(F.when(which, F.col("start"))).over(back)

    parts = parts.withColumn("covered", F.coalesce(last(strong) > F.col("start"), F.lit(False)) | F.coalesce(following(strong) < F.col("end"), F.lit(False)))
    names, secrets = F.col("kind").isin(1, 3), F.col("kind").isin(0, 2) | (mixed & ~F.col("covered"))

    def near(which: Column) -> Column:
        return F.coalesce(F.col("start") - last(which) <= REACH, F.lit(False)) | F.coalesce(following(which) - F.col("end") <= REACH, F.lit(False))

    found = parts.withColumns({"by_name": near(names), "by_secret": near(secrets)})
    stands = (F.col("kind") == 3) & F.col("by_secret") | mixed & F.col("by_name") | (F.col("kind") == 5) & F.col("by_name") & F.col("by_secret")
    return found.where(stands & ~F.col("covered")).groupBy("kd", "kh").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal keys have equal doc_ids and texts: links hang on the text, so that repeated rows may share them."""
    return docs.withColumns({"text": F.coalesce("text", F.lit("")), "kd": F.coalesce("doc_id", F.lit(-(2**63)))}).withColumn("kh", F.xxhash64("text", F.col("doc_id").isNull()))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans for every row.

    Null and empty texts have no spans; null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns are not
    read. Only spans are shuffled, no texts.
    """
    keyed = _keyed(pick(docs, "doc_id", "text"))
    made = strong_spans(F.col("text"))
    base = keyed.select("doc_id", "kd", "kh", *[m.alias(k) for m, k in zip(made, KINDS, strict=True)])
    both = base.join(linked(keyed.select("kd", "kh", "text")), ["kd", "kh"], "left")
    strong = F.concat(*KINDS)
    weak = F.coalesce("weak", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    return both.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.size(weak).cast("bigint").alias("n_linked"), F.sha2(_written(strong), 256).alias("base_sha256"), _written(F.concat(strong, weak)).alias("spans"))


MARK = "[REDACTED]"


def secrets_stage(docs: DataFrame) -> DataFrame:
    """The rows with strong and linked spans replaced by MARK, with the columns they came with; texts without spans stay as they are.

    Spans of a text that overlap are replaced together. No row is dropped.
    """
    from_text = F.col("text").cast("string")
    rows = boxed(docs, text=F.coalesce(from_text, F.lit("")), kd=F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), kh=F.xxhash64(F.coalesce(from_text, F.lit("")), F.col("doc_id").isNull()))
    rows = rows.join(linked(_keyed(pick(docs, "doc_id", "text")).select("kd", "kh", "text")), ["kd", "kh"], "left")
    weak = F.coalesce("weak", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*strong_spans(F.col("text")), weak)))
    # Overlapping spans become one; a text's pieces between them are joined by the mark.
    nothing = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    start = F.struct(F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), nothing.alias("out"))

    def step(st: Column, s: Column) -> Column:
        joined = F.struct(st["a"].alias("a"), F.greatest(st["b"], s["end"]).alias("b"), st["out"].alias("out"))
        apart = F.struct(s["start"].alias("a"), s["end"].alias("b"), F.concat(st["out"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b")))).alias("out"))
        return F.when(s["start"] < st["b"], joined).otherwise(apart)

    runs = F.aggregate("spans", start, step, lambda st: F.concat(st["out"], F.array(F.struct(st["a"].alias("a"), st["b"].alias("b")))))
    rows = rows.withColumn("runs", F.when(F.size("spans") > 0, F.filter(runs, lambda r: r["a"] >= 0)))

    def before(i: Column) -> Column:
        return F.when(i > 0, F.element_at(F.col("runs"), F.greatest(i, F.lit(1)))["b"]).otherwise(0)

    between = F.transform("runs", lambda r, i: F.substring("text", (before(i) + 1).cast("int"), (r["a"] - before(i)).cast("int")))
    tail = F.substring("text", (F.element_at(F.col("runs"), -1)["b"] + 1).cast("int"), F.lit(2**31 - 1))
    clean = F.when(F.size("spans") > 0, F.array_join(F.concat(between, F.array(tail)), MARK)).otherwise(F.col("row").getField("text"))
    return unboxed(rows, docs.columns, text=clean)

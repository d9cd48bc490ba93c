"""Document fingerprints from closed syncmers, with their places.

Letters are words of up to LONG code points; a longer run without blanks gives a letter at each of its code points, that with the up to GRAM - 1 that
follow. So no letter hangs on an offset from anything: one more code point in front of a long run moves its letters and changes none. A window of K
letters is a closed syncmer when the least of its inner pairs of letters stands at its first or last place: whether it is chosen hangs on nothing around
it, so that a passage gives the same anchors wherever it stands. A text is padded at both ends, so that texts of any length have anchors.

The fingerprint holds every different anchor of the text, whatever its length, each with the place of its first occurrence. Two fingerprints are matched
by place: common anchors are laid out in the order of the first text, and one counts where it is shifted as its neighbour there is, give or take SLACK
letters, so that chance meetings don't count and passages that moved as a whole do. The likeness is the share of both texts' anchors that so match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import pick

K = 5
LONG = 16
GRAM = 6
SLACK = 5
_WORD = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{LONG}}}+(?![^\x20\x09-\x0D])"
LETTER = rf"(?=({_WORD}|[^\x20\x09-\x0D]{{1,{GRAM}}}))(?:{_WORD}|[^\x20\x09-\x0D])"
_PAD = 2**63 - 1
_PLACE = 2**31 - 1
_NONE = "cast(array() as array<bigint>)"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambda variables are the only names inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(ordered: Column, bits: int) -> Column:
    """The first of each run of values that are equal above their low bits."""
    return let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(F.shiftright(x, bits) != F.shiftright(F.get(s, i - 1), bits), F.lit(True))))


def anchors(text: Column, k: int = K) -> Column:
    """The different closed syncmers of a text in the order of their hashes: a set top bit, 31 bits of hash, 32 bits of the first place."""
    letters = F.transform(F.regexp_extract_all(text, F.lit(LETTER), F.lit(1)), lambda x: F.xxhash64(x))
    pad = F.array_repeat(F.lit(_PAD).cast("bigint"), k - 1)

    def pairs(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.xxhash64(F.get(p, i), F.get(p, i + 1)))

    def packed(p: Column, q: Column) -> Column:
        at = lambda x, i, d: F.get(x, i + d if d else i)
        closed = F.filter(F.sequence(F.lit(0), F.size(p) - k), lambda i: F.least(at(q, i, 0), at(q, i, k - 2)) <= F.least(*[at(q, i, d) for d in range(1, k - 2)]))
        value = lambda i: F.xxhash64(*[at(q, i, d) for d in range(0, k - 1, 2)], *([at(p, i, k - 1)] if k % 2 else []))
        return F.transform(closed, lambda i: F.shiftleft(value(i), 32).bitwiseOR(F.lit(-(2**63))).bitwiseOR(i.cast("bigint")))

    whole = let(F.concat(pad, letters, pad), lambda p: F.when(F.size(p) > 2 * (k - 1), let(pairs(p), lambda q: packed(p, q))).otherwise(F.expr(_NONE)))
    return _once(F.sort_array(whole), 32)


def matches(a: Column, b: Column) -> Column:
    """The places (in a << 32 | in b) of anchors that are in both, in the order of the first."""
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(2**31)))))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))

    def met(s: Column) -> Column:
        follower = lambda x, i: F.when(F.shiftright(x, 32) == F.shiftright(F.get(s, i + 1), 32), F.shiftleft(place(x), 32).bitwiseOR(place(F.get(s, i + 1))))
        return F.sort_array(F.array_compact(F.transform(s, follower)))

    return let(both, met)


def likeness(a: Column, b: Column, slack: int = SLACK) -> Column:
    """0 to 1: the share of the anchors of both that match by place; two texts without words are alike, one without and one with are not. A single common anchor counts."""
    shift = lambda v: F.shiftright(v, 32) - v.bitwiseAND(F.lit(_PLACE))

    def counted(m: Column) -> Column:
        near = lambda v, i: F.coalesce(F.abs(shift(v) - shift(F.get(m, i))) <= slack, F.lit(False))
        return F.when(F.size(m) < 2, F.size(m)).otherwise(F.size(F.filter(m, lambda v, i: near(v, i - 1) | near(v, i + 1))))

    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * let(matches(a, b), counted) / F.greatest(total, F.lit(1)))


def written(s: Column) -> Column:
    """Sixteen hexadecimal digits an anchor: a set bit, the hash, the place."""
    return F.lower(F.concat_ws("", F.transform(s, lambda x: F.hex(x))))


def _bucket(o: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below o: first among every g-th bound, then among the g that follow."""
    g = max(1, int(len(bounds) ** 0.5))
    coarse, every = bounds[::g], F.array(*[F.lit(b) for b in bounds])
    at = F.size(F.filter(F.array(*[F.lit(b) for b in coarse]), lambda b: b <= o))
    fine = F.size(F.filter(F.slice(every, F.greatest(at - 1, F.lit(0)) * g + 1, F.lit(g)), lambda b: b <= o))
    return F.when(at == 0, 0).otherwise((at - 1) * g + fine)


def followed(rows: DataFrame, parts: int | None = None, **made: Column) -> DataFrame:
    """rows (doc_id, text, ...), columns made of them, and next_<column> of text and of those from the next row, by doc_id ascending (null first), then the
    text's hash; the first follows the last.

    Rows are dealt out by ranges of doc_id. The bounds, one per shuffle partition, and the least doc_id of each range are all that the driver
    sees; the least row of a range goes to the range before as well, where it follows the last. Each range is a
    partition of its own. Columns are made after the exchange: only texts travel.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.coalesce("doc_id", F.lit(-(2**63)))
    found = rows.agg(F.percentile_approx(o, [(i + 1) / parts for i in range(parts - 1)] or [1.0], 20_000)).first()[0]
    bounds = sorted(set(found or []))
    keyed = rows.withColumn("__o", o).withColumn("__b", _bucket(F.col("__o"), bounds) if bounds else F.lit(0))
    least = dict(keyed.groupBy("__b").agg(F.min("__o")).collect())
    filled = sorted(least)
    before = {least[b]: filled[i - 1] for i, b in enumerate(filled)}
    guard = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__o")) if before else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct(F.col("__b").cast("int").alias("b"), F.lit(0).alias("late")), F.when(guard.isNotNull(), F.struct(guard.cast("int").alias("b"), F.lit(1).alias("late")))))
    dealt = keyed.withColumn("__p", F.explode(places)).withColumns({"__b": F.col("__p.b"), "__late": F.col("__p.late")}).drop("__p").withColumn("__t", F.xxhash64("text"))
    order = Window.partitionBy("__b").orderBy("__late", "__o", "__t")
    nexts = dealt.repartitionById(parts, F.col("__b").cast("int")).withColumns(made).withColumns({f"next_{c}": F.lead(c).over(order) for c in ["text", *made]})
    return nexts.where("__late = 0").drop("__o", "__b", "__late", "__t")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null texts are empty; an empty fingerprint is that of a text without words. A table of one row follows itself. Null doc_ids come first; rows
    with one doc_id follow each other by their texts' hashes; an empty table gives an empty result; other columns are not read. Each text is
    shuffled once.
    """
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = followed(rows, s=anchors(F.col("text")))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "s", "next_s", anchors(F.col("edited")).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))

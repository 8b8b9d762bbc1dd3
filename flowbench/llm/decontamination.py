"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

A window has as many words as a benchmark item (a shorter text is one window). All windows of all texts are considered:
the places where a text holds an item's word shingles give, for every start, the weight of the item's shingles in the
window, and windows below the least similarity are left out exactly (of the union, the item's own weight is a part).
The others and the items get 64-bit SimHash fingerprints: each shingle gives its words their length as weight. A
fingerprint is cut into radius + 1 blocks: two fingerprints within the radius agree in one at least, so an equi-join on
block number and value finds every such pair; the exact weighted Jaccard similarity of the shingles then decides. A
shingle weighs as many code points as its words have. A window meets the blocks of those items alone whose shingles it
holds enough of, so the block join grows with these pairs and not with all windows times all items.

Shingles leave the texts only if a sieve of the items' hashes lets them through. It has a fixed number of bits, so it is
broadcast however many items there are; with 10,000,000 of their shingles about one in seven others passes, and ends in
the join.

The radius is the only step that can lose a similar window: of windows with similarity 0.8 or more that words replaced,
put in, taken out or moved had left, 99.9 percent were within 12 bits, of those below 0.85 too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.llm.common import fresh, saved, small
from flowbench.llm.pii import text_key

#: Words in a shingle; least similarity, in percent; bits in which fingerprints may differ.
SHINGLE, LEAST, RADIUS = 5, 80, 12
#: The sieve has 2 ** SIEVE bits, in 2 ** (SIEVE - 6) rows of 64.
SIEVE = 26


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(words: Column, n: int) -> Column:
    """Hash of each shingle of n words, by position; empty where there are fewer words."""
    each = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), each)).otherwise(F.array().cast("array<bigint>"))


def weighted(words: Column, n: int) -> Column:
    """Distinct shingles as hash and weight."""
    weight = lambda i: sum((F.length(F.get(words, i + k)) for k in range(1, n)), F.length(F.get(words, i)))
    return F.array_distinct(F.transform(hashes(words, n), lambda h, i: F.named_struct(F.lit("h"), h, F.lit("w"), weight(i).cast("int"))))


def fingerprint(words: str, n: int) -> Column:
    """SimHash of the words of shingles of n: bit b is set where the weights of words with it outweigh those without.

    A word weighs its length in each shingle that holds it.
    """
    held = f"(least(i, size({words}) - {n}) - greatest(0, i - {n - 1}) + 1)"
    return F.expr(f"""
        aggregate(array(transform({words}, (w, i) -> named_struct('h', xxhash64(w), 'w', length(w) * {held}))), 0L, (none, marks) ->
            aggregate(sequence(0, 63), 0L, (print, b) -> print | if(
                aggregate(marks, 0L, (s, x) -> s + if((shiftright(x.h, b) & 1L) = 1L, x.w, -x.w)) > 0,
                shiftleft(1L, b), 0L)))""")


def blocks(print_: str, radius: int) -> Column:
    """Number and value of each of radius + 1 blocks that make up a fingerprint."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    cut = [f"struct({k} AS block, shiftrightunsigned({print_}, {a}) & {(1 << (b - a)) - 1}L AS value)" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.expr(f"array({', '.join(cut)})")


def total(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + x["w"])


def sieved(seen: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of seen whose ``h`` is, by SIEVE of its bits, one of items' ``h``: no such row is lost, some others pass."""
    cell, bits = fresh(seen, "_cell", "_bits")
    number = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << SIEVE) - 1), 6)
    marks = items.select(number.alias(cell), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy(cell).agg(F.bit_or("bit").alias(bits))
    passed = seen.withColumn(cell, number).join(F.broadcast(marks), cell)
    return passed.where(F.expr(f"shiftright({bits}, cast(h & 63 AS int)) & 1L = 1L")).select(seen.columns)


def likely_windows(docs: DataFrame, items: DataFrame, text: str, shingle: int, least: int) -> DataFrame:
    """Rows ``text_key, item_key, start, n_words``: windows in which an item's shingles weigh enough, repeated ones counted too.

    items has ``item_key, n_words, weight, h, w``. Only shared shingles leave the texts. The weight in a window changes
    where a shingle comes in or goes out, so a sum over these places, by text and item, gives it for all starts.
    """
    keyed = docs.select(text_key(F.coalesce(F.col(text), F.lit(""))), words_of(F.col(text)).alias("words"))
    seen = keyed.select("text_key", F.size("words").alias("n"), F.posexplode(hashes(F.col("words"), shingle)).alias("pos", "h"))
    items = saved(items)
    shared = saved(sieved(seen, items).join(small(items), "h").select("text_key", "n", "pos", "item_key", "n_words", "weight", "h", "w").distinct())
    # the whole text must hold enough of the item
    enough = shared.select("text_key", "item_key", "weight", "h", "w").distinct().groupBy("text_key", "item_key", "weight").agg(F.sum("w").alias("held"))
    enough = enough.where(F.col("held") * 100 >= F.col("weight") * least).select("text_key", "item_key")
    within = (F.col("n_words") - shingle).cast("int")  # a window's last shingle, from its start
    change = F.explode(F.array(F.struct((F.col("pos") - within).alias("at"), F.col("w").alias("by")), F.struct((F.col("pos") + 1).alias("at"), (-F.col("w")).alias("by"))))
    key = ("text_key", "item_key", "n", "n_words", "weight")
    changes = shared.join(enough, ["text_key", "item_key"]).select(*key, change.alias("c")).groupBy(*key, "c.at").agg(F.sum("c.by").alias("by"))
    order = Window.partitionBy("text_key", "item_key").orderBy("at")
    runs = changes.select(*key, "at", F.sum("by").over(order).alias("held"), F.lead("at").over(order).alias("next"))
    runs = runs.where((F.col("held") > 0) & (F.col("held") * 100 >= F.col("weight") * least))
    last = F.greatest(F.lit(0), F.col("n") - F.col("n_words"))
    inside = lambda at: F.greatest(F.lit(0), F.least(at, last))
    starts = F.explode(F.sequence(inside(F.col("at")), inside(F.col("next") - 1)))
    return runs.select("text_key", "item_key", "n_words", starts.alias("start")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE, least: int = LEAST, radius: int = RADIUS) -> DataFrame:
    """Rows ``text_key, item_id, start, n_words, hamming, similarity``: each text's best window for an item.

    Equal texts are looked at once, under their key, and equal items too. Items of fewer words than a shingle (null ones
    too) match nothing; a text shorter than an item is one window. Of equally similar windows the first is given.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= shingle)
    items = saved(items.select("item_id", text_key(F.concat_ws(" ", "words")).alias("item_key"), "words"))
    item = items.select("item_key", "words").dropDuplicates(["item_key"]).select("item_key", F.size("words").alias("n_words"), "words", weighted(F.col("words"), shingle).alias("item_shingles"))
    item = saved(item.withColumn("weight", total(F.col("item_shingles"))))
    windows = saved(likely_windows(docs, item.select("item_key", "n_words", "weight", F.inline("item_shingles")), text, shingle, least))
    keyed = docs.select(text_key(F.coalesce(F.col(text), F.lit(""))), F.col(text).alias("text"))
    texts = keyed.join(small(windows.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
    place = ["text_key", "start", "n_words"]
    cut = windows.select(place).distinct().join(texts.select("text_key", words_of(F.col("text")).alias("words")), "text_key").select(
        "text_key", "start", "n_words", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("words")
    )
    cut = saved(cut.withColumn("window_key", text_key(F.concat_ws(" ", "words"))))
    asked = windows.join(cut.select(*place, "window_key"), place).select("window_key", "n_words", "item_key").distinct()
    # equal windows are compared once
    own = cut.select("window_key", "n_words", "words").dropDuplicates(["window_key", "n_words"]).withColumn("print", fingerprint("words", shingle))
    own = saved(own.withColumn("b", F.explode(blocks("print", radius))).select("window_key", "n_words", "words", "print", "b.block", "b.value"))
    other = item.withColumn("item_print", fingerprint("words", shingle)).withColumn("b", F.explode(blocks("item_print", radius)))
    other = saved(other.select("item_key", "n_words", "item_print", "b.block", "b.value"))
    near = asked.join(own.drop("words"), ["window_key", "n_words"]).join(small(other), ["item_key", "n_words", "block", "value"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    near = near.where(F.col("hamming") <= radius).select("window_key", "n_words", "item_key", "hamming").distinct()
    own = own.where("block = 0").select("window_key", "n_words", weighted(F.col("words"), shingle).alias("shingles"))
    shared = total(F.array_intersect("shingles", "item_shingles"))
    union = total(F.col("shingles")) + total(F.col("item_shingles")) - F.col("shared")
    verified = saved(
        near.join(own, ["window_key", "n_words"]).join(small(item.select("item_key", "item_shingles")), "item_key")
        .withColumn("shared", shared).withColumn("union", union).where(F.col("shared") * 100 >= F.col("union") * least)
        .select("window_key", "n_words", "item_key", "hamming", (F.col("shared") / F.col("union")).alias("similarity"))
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming")).alias("best")
    found = cut.select("text_key", "start", "n_words", "window_key").join(small(verified), ["window_key", "n_words"]).groupBy("text_key", "item_key").agg(best)
    return found.join(small(items.select("item_id", "item_key").distinct()), "item_key").select(
        "text_key", "item_id", "best.start", "best.n_words", "best.hamming", (-F.col("best.s")).alias("similarity")
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document with each item that it holds, and the most similar window; repeated rows each have theirs."""
    found = saved(hits(docs, benchmark))
    keyed = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(small(found), "text_key").select(
        "doc_id", "item_id", F.col("start").cast("long"), F.col("n_words").cast("long"), F.col("hamming").cast("long"), F.round("similarity", 6).alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; columns and all other rows as they are, whatever their names."""
    key, = fresh(docs, "_text_key")
    bad = saved(hits(docs, benchmark, text).select(F.col("text_key").alias(key)).distinct())
    keyed = docs.withColumn(key, text_key(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(small(bad), key, "left_anti").select(docs.columns)

"""Personal data: base patterns, and terms that disclose an entity by corpus co-occurrence. DataFrame functions only.

An entity is a distinct matched value. A term (a word of four or more letters or digits) discloses an entity c as far
as knowing it gives c away: PMI(c; t) = log2(N n_ct / (n_c n_t)) over documents, at most the entity's information
IC(c) = log2(N / n_c). All terms of a document occur with all entities in it, wherever they stand. n_ct / n_t is drawn
down where few documents hold both, by n_ct^2 / (n_ct^2 + DOUBT). Terms whose PMI reaches the share REMOVE of IC(c) are
removed, those that reach GENERALISE give way to their class; everywhere in the documents of that entity, and only
there. The base matches are always replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.llm.common import fresh, saved, small

#: Fixed kinds and their order. Possessive repetition matches the same texts as plain repetition here (what follows a
#: run can't begin inside it) and needs no stack; \G lets a match begin where the one before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{4,}+(?![\p{L}\p{N}])"
KINDS = (*PATTERNS, "term")
#: Weight of the doubt in few documents; shares of IC(c).
DOUBT, GENERALISE, REMOVE = 2, 0.8, 0.95
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that matches no empty string, with code point offsets.

    The parts between matches, from a split at the same pattern, give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.struct((begin + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(
        F.filter(places, lambda x: x["d"].isNotNull()),
        lambda x: F.when(x["i"] % 2 == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and then by start; text must not be null."""

    def keep(kind: str, test) -> Column:  # noqa: ANN001
        return F.filter(matches(text, PATTERNS[kind], kind), lambda s: test(s["value"]))

    none = F.array().cast(f"array<{SPAN}>")
    byte = F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")
    number = lambda v: digits(v)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS["email"], "email")).otherwise(none),
        F.when(F.contains(text, F.lit(".")), keep("ip", lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_like(p, byte)))).otherwise(none),
        keep("card", lambda v: F.length(number(v)).between(16, 19) & luhn(number(v))),
        F.when(F.contains(text, F.lit("+")), keep("phone", lambda v: F.length(number(v)).between(8, 15))).otherwise(none),
    )


def text_key(text: Column) -> Column:
    """128 bits of hash by which equal texts meet."""
    return F.concat_ws("-", F.hex(F.xxhash64(text, F.lit(0))), F.hex(F.xxhash64(text, F.lit(1)))).alias("text_key")


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower))


def places(texts: DataFrame) -> DataFrame:
    """Rows ``text_key, term, start, end`` of all words of ``text_key, entity_text``, linear in a text's length."""
    found = F.regexp_extract_all("entity_text", F.lit(f"({WORD})"), F.lit(1))
    gaps = F.transform(F.split("entity_text", WORD, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    rows = texts.select("text_key", F.posexplode(pairs).alias("pos", "word"))
    end = F.sum(F.col("word.gap") + F.length("word.value")).over(Window.partitionBy("text_key").orderBy("pos"))
    return rows.withColumn("end", end).select("text_key", F.lower("word.value").alias("term"), (F.col("end") - F.length("word.value")).alias("start"), "end")


def disclosures(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Rows ``text_key, start, end, level`` of all occurrences of terms that disclose an entity of their document.

    found has ``text_key, base, entity_text`` a document. Equal texts are read once each and counted as often as
    they occur, so no hot text gathers rows; counts of pairs are summed before they are shuffled, so no hot entity does.
    """
    once = saved(
        found.where(F.size("base") > 0).groupBy("text_key")
        .agg(F.first("base").alias("base"), F.first("entity_text").alias("entity_text"), F.count(F.lit(1)).alias("copies"))
    )
    n = found.count()

    def most(n_c: Column) -> Column:
        """Documents that a term of an entity in n_c of them can be in and still disclose it, as n_ct <= n_c."""
        return n_c * F.pow(F.lit(float(n)) / n_c, F.lit(1 - GENERALISE)) * (1 + 1e-9)

    name = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(digits(s["value"])))
    mentions = saved(once.select("text_key", "copies", F.explode(F.array_distinct(F.transform("base", name))).alias("entity")))
    held = mentions.groupBy("entity").agg(F.sum("copies").alias("n_c"))
    mentions = saved(mentions.join(small(held), "entity"))
    # a term is in no fewer documents than those with an entity that hold it: terms that this bound rules out for all
    # entities of their text go at once, and with them common words
    terms_held = saved(once.select("text_key", "copies", F.explode(terms(F.col("entity_text"))).alias("term")))
    near = terms_held.groupBy("term").agg(F.sum("copies").alias("n_near"))
    bound = mentions.groupBy("text_key").agg(most(F.max("n_c")).alias("most"))
    asked = saved(terms_held.drop("copies").join(bound, "text_key").join(near, "term").where(F.col("n_near") <= F.col("most")).select("text_key", "term"))
    words = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    spread = words.join(small(asked.select("term").distinct()), "term")
    pairs = saved(asked.join(spread, "term").join(mentions, "text_key").where(F.col("n_t") <= most(F.col("n_c"))))
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    agreed = F.col("n_ct") * F.col("n_ct")
    pmi = F.log2(n * F.col("n_ct") * agreed / ((agreed + DOUBT) * F.col("n_c") * F.col("n_t")))
    share = pmi / F.greatest(F.log2(n / F.col("n_c")), F.lit(1e-9))
    telling = counted.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE - 1e-9)
    marked = saved(pairs.join(telling, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("share").alias("share")))
    where = places(once.join(marked.select("text_key").distinct(), "text_key", "left_semi"))
    free = ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return where.join(marked, ["text_key", "term"]).join(once.select("text_key", "base"), "text_key").where(free).select(
        "text_key", "start", "end", F.when(F.col("share") >= REMOVE - 1e-9, "remove").otherwise("generalise").alias("level")
    )


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``text_key``, ``base`` and ``terms``: spans of a null text as of an empty one.

    ``base`` has the pattern matches by kind and start, ``terms`` the disclosing terms by start with their level as
    value. Rows stay as many as they are, whatever their ids.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(*keep, text_key(whole), base_spans(whole).alias("base"), whole.alias("entity_text"))
    found = saved(marked.withColumn("entity_text", F.when(F.size("base") > 0, F.col("entity_text"))))
    marks = disclosures(docs, found, text).groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("level").alias("value")))).alias("terms")
    )
    return found.drop("entity_text").join(small(marks), "text_key", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select(
        "doc_id", *map(n, PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "terms")).alias("spans"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """text with each span's mark in its place, from the left; of overlapping spans the first to start gives the mark.

    A term that is generalised gives way to its class: number, code (letters and digits) or word.
    """

    def mark(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        wider = F.when(F.regexp_like(word, F.lit(r"^\p{N}+$")), "[NUMBER]").when(F.regexp_like(word, F.lit(r"\p{N}")), "[CODE]").otherwise("[WORD]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", "[REMOVED]").otherwise(wider)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), mark(s).alias("mark"))))

    def step(acc: Column, s: Column) -> Column:
        fresh_ = s["start"] >= acc["at"]
        out = F.when(fresh_, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data and disclosing terms replaced in ``text``; all other columns and rows as they are.

    Only texts with something to replace are joined to their spans; nulls stay null.
    """
    key, spans = fresh(docs, "_text_key", "_spans")
    found = find(docs, text, keep=())
    dirty = found.where((F.size("base") > 0) | (F.size("terms") > 0)).groupBy("text_key").agg(
        F.first(F.concat("base", "terms")).alias(spans)
    ).withColumnRenamed("text_key", key)
    whole = docs.withColumn(key, text_key(F.coalesce(F.col(text), F.lit(""))))
    out = whole.join(small(dirty), key, "left").withColumn(
        text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col(spans)))
    )
    return out.select(docs.columns)

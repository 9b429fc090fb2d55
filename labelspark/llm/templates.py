"""Benchmark decontamination by template windows (DataFrame functions only).

Words are canonicalised: numbers become ``<num>``, units ``<unit>``, names
``<name>``; everything else is the lower-cased word without outer punctuation.
Documents and benchmark items meet in a hash join on windows of five canonical
words, so a question whose numbers, names or units were exchanged still meets
its original.  A meeting counts only if its slots are consistent: one value of
the item's placeholders maps to one value in the document throughout the
aligned passage (``12 apples and 12 pears`` matches ``15 ... 15``, not
``15 ... 16``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as units of measure or money.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "cent", "cents", "dollar", "dollars",
    "euro", "euros", "mph", "km/h", "kg/m",
]
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
WINDOW = 5
MIN_SHARE = 0.8
#: An item table below this many bytes (window rows, measured) is broadcast.
BROADCAST_BYTES = 32 << 20


#: Fixed value: outer punctuation that is not part of a word.
PUNCT = "\n.,;:!?()[]{}<>\"'`*_#%$&|/\\+=~^@-–—‘’“”…«»¿¡"


def _tokens(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, ``raw`` (lower-cased bare words), ``h`` (hash of the canonical
    word).  A line's first word keeps a leading newline until it is judged as
    the start of a sentence."""
    spaced = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(" \n"))
    words = F.filter(F.split(spaced, "[ \\t\\x0B\\f\\r]+"), lambda w: (w != "") & (w != "\n"))
    df = df.select(*keys, words.alias("w"))

    def strip(w: Column) -> Column:
        core = F.btrim(w, F.lit(PUNCT))
        return F.when(core == "", w).otherwise(core)

    def canonical(core: Column, i: Column) -> Column:
        low, first, word = F.lower(core), F.substring(core, 1, 1), F.get("w", i)
        before = F.get("w", i - 1)
        inside = ((i > 0) & ~word.startswith("\n") & ~F.substring(before, -1, 1).isin(".", "!", "?", ":"))
        # a capitalised word of two letters or more inside a sentence; the
        # first word of a sentence is capitalised anyway and stays a word
        name = (first != F.lower(first)) & (F.concat(first, F.substring(low, 2, 1 << 20)) == core) & (F.length(core) > 1)
        return F.xxhash64(
            F.when(first.between("0", "9") & core.rlike(r"^[0-9]+([.,:/-][0-9]+)*$"), F.lit(NUM))
            .when(low.isin(UNITS), F.lit(UNIT))
            .when(name & inside, F.lit(NAME))
            .otherwise(low))

    df = df.select(*keys, "w", F.transform("w", strip).alias("core"))
    return df.select(*keys, F.transform("core", F.lower).alias("raw"), F.transform("core", canonical).alias("h"))


def _windows(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window of five canonical words (fewer words: one window of
    all): keys, ``pos``, ``wh`` and ``slots``, the raw words at placeholders
    (null elsewhere; null as a whole for a window without placeholder)."""
    def is_slot(x: Column) -> Column:
        return x.isin(*[F.xxhash64(F.lit(s)) for s in (NUM, UNIT, NAME)])

    def window(i: Column) -> Column:
        at = [F.get("h", i + k) for k in range(WINDOW)]
        slotted = is_slot(at[0])
        for x in at[1:]:
            slotted = slotted | is_slot(x)
        values = F.array(*[F.when(is_slot(x), F.get("raw", i + k)) for k, x in enumerate(at)])
        return F.struct(i.alias("pos"), F.xxhash64(*at).alias("wh"), F.when(slotted, values).alias("slots"))

    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))))
    rows = tokens.select(*keys, F.transform(starts, window).alias("ws"))
    # explode() would push a filter on the whole nested expression into the
    # scan and evaluate it there once more; the join drops the null windows
    return rows.select(*keys, F.explode_outer("ws").alias("x")).select(*keys, "x.pos", "x.wh", "x.slots")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Pairs (document, item) where the document holds at least ``min_share``
    of the item's distinct template windows on slot-consistent alignments.

    Columns: ``doc_id, item_id, n_windows`` (distinct windows of the item),
    ``n_matched`` and ``share``.  Null and empty texts have no windows and
    match nothing, an item of fewer than five words is one window and matches
    a text of just these words.  Rows that share an id count as one text.
    Rows with a null id are skipped: they can't be named.  Extra columns are
    not read.
    """
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    b = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("b"), F.col(item_text).alias("t"))
    dw = _windows(_tokens(d, "t", ["d"]), ["d"])
    bw = _windows(_tokens(b, "t", ["b"]), ["b"]).withColumnsRenamed({"pos": "ipos", "slots": "islots"})
    bw = bw.where(F.col("wh").isNotNull())
    size = bw.agg(F.count(F.lit(1)).alias("n")).first()["n"] * 160
    if size <= BROADCAST_BYTES:
        bw = F.broadcast(bw)
    met = dw.join(bw, "wh").withColumn("shift", F.col("pos") - F.col("ipos"))
    pairs = F.filter(F.arrays_zip("islots", "slots"), lambda x: x["islots"].isNotNull())
    line = met.groupBy("d", "b", "shift").agg(
        F.collect_set("wh").alias("whs"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("islots").isNotNull(), pairs)))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["islots"])))
    found = line.where(consistent).groupBy("d", "b").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("whs")))).alias("n_matched"))
    totals = bw.groupBy("b").agg(F.countDistinct("wh").alias("n_windows"))
    if size <= BROADCAST_BYTES:
        totals = F.broadcast(totals)
    share = F.col("n_matched") / F.col("n_windows")
    return (found.join(totals, "b")
            .select(F.col("d").alias(doc_id), F.col("b").alias(item_id), F.col("n_windows").cast("long").alias("n_windows"),
                    F.col("n_matched").cast("long").alias("n_matched"), share.alias("share"))
            .where(F.col("share") >= min_share))


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that leak an item; rows with a null id stay."""
    doc_id = kw.get("doc_id", "doc_id")
    bad = leaks(docs, items, **kw).select(doc_id).distinct()
    return docs.join(bad, doc_id, "left_anti").select(*docs.columns)

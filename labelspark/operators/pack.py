"""Token-budget packing (J-8 .. J-10, G-2) as a row-local corpus job.

Tokens are whitespace tokens (the subword vocabulary is the user's model's
business and is not rebuilt).  A packed row is
``[CLS] text [SEP] label_1 [LAB] label_2 [LAB] ...`` with a label mask that
is 0 for text / special tokens and i for the tokens of the i-th label.
Everything is array expressions on one row: no shuffle, stream-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE_CLASS
from .normalize import limit_labels

# Special tokens and per-label token cap of the packing format.
CLS, SEP, LAB, PAD = "[CLS]", "[SEP]", "[LAB]", "[PAD]"
LABEL_TOKEN_CAP = 128
OVERHEAD = 2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whitespace_tokens(c, cap: int | None = None) -> Column:
    """Whitespace tokens of a text (Python ``str.split()`` semantics).  With a
    ``cap`` only the leading part of the text that holds the first ``cap``
    tokens is matched (possessive regex, no backtracking), so a 20 000-word
    document costs as much as a 64-word one."""
    ws = PY_WHITESPACE_CLASS
    nws = "[^" + ws[1:]
    src = _c(c)
    if cap:
        src = F.regexp_extract(src, f"^(?:{ws}*+{nws}++){{0,{int(cap)}}}", 0)
    return F.filter(F.split(src, f"{ws}+"), lambda t: t != "")


def fit_budget(costs: Column, budget: Column) -> Column:
    """G-2: how many leading items fit while the running cost stays within the
    budget (every cost is >= 1, so this is the first-overflow stop)."""
    n = F.size(costs)
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    fits = F.filter(idx, lambda i: (i <= n) & (
        F.aggregate(F.slice(costs, 1, i), F.lit(0), lambda a, x: a + x) <= budget))
    return F.size(fits)


def pack(df: DataFrame, max_length: int, text: str = "text", labels: str = "ltext",
         out_tokens: str = "input_tokens", out_mask: str = "lmask") -> DataFrame:
    """J-8: pack text + labels under ``max_length`` tokens.

    If everything fits it is kept; otherwise the text gets
    ``max((max_length - 2) // 2, 10)`` tokens and the labels the rest, whole
    labels only, in order, stopping at the first that does not fit.  Adds
    ``n_fit`` (labels kept) and ``attention_mask``.
    """
    avail = max_length - OVERHEAD
    text_budget = max(avail // 2, 10)
    label_budget = avail - text_budget
    tt = whitespace_tokens(text, max_length)
    lt = F.transform(_c(labels), lambda l: whitespace_tokens(l, LABEL_TOKEN_CAP))
    d = df.withColumn("_tt", tt).withColumn("_lt", lt)
    costs = F.transform("_lt", lambda x: F.size(x) + 1)
    total = F.aggregate(costs, F.lit(0), lambda a, x: a + x)
    over = F.size("_tt") + total + OVERHEAD > max_length
    n_fit = F.when(over, fit_budget(costs, F.lit(label_budget))).otherwise(F.size("_lt"))
    d = d.withColumn("n_fit", n_fit.cast("int")).withColumn(
        "_tt", F.when(over, F.slice("_tt", 1, text_budget)).otherwise(F.col("_tt"))).withColumn(
        "_lt", F.slice("_lt", 1, F.col("n_fit")))
    seq = F.concat(F.array(F.lit(CLS)), F.col("_tt"), F.array(F.lit(SEP)),
                   F.flatten(F.transform("_lt", lambda x: F.concat(x, F.array(F.lit(LAB))))))
    mask = F.concat(F.array_repeat(F.lit(0), F.size("_tt") + 2),
                    F.flatten(F.transform("_lt", lambda x, i: F.concat(
                        F.array_repeat((i + 1).cast("int"), F.size(x)), F.array(F.lit(0))))))
    d = d.withColumn(out_tokens, seq).withColumn(out_mask, mask.cast("array<int>"))
    d = d.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(out_tokens)))
    return d.drop("_tt", "_lt")


def pad(df: DataFrame, length: int, tokens: str = "input_tokens", mask: str = "lmask",
        attention: str = "attention_mask") -> DataFrame:
    """J-9: right-pad (or cut) every packed row to ``length``; padding has
    attention 0 and label id 0."""
    def padded(c, value):
        n = F.greatest(F.lit(length) - F.size(c), F.lit(0))
        return F.slice(F.concat(F.col(c), F.array_repeat(value, n)), 1, length)
    return (df.withColumn(tokens, padded(tokens, F.lit(PAD)))
              .withColumn(mask, padded(mask, F.lit(0)))
              .withColumn(attention, padded(attention, F.lit(0))))


def pad_to_max(df: DataFrame, cap: int, tokens: str = "input_tokens", mask: str = "lmask",
               attention: str = "attention_mask") -> DataFrame:
    """J-9 dynamic padding: pad every row to the longest packed row of the
    data set, capped at ``cap``.  The longest length is a one-row aggregate
    (partial max per task) joined back, never a driver round trip."""
    m = df.agg(F.least(F.max(F.size(tokens)), F.lit(cap)).alias("_len"))
    j = df.crossJoin(F.broadcast(m))

    def padded(c, value):
        n = F.greatest(F.col("_len") - F.size(c), F.lit(0))
        return F.slice(F.concat(F.col(c), F.array_repeat(value, n)), 1, F.col("_len"))
    return (j.withColumn(tokens, padded(tokens, F.lit(PAD)))
             .withColumn(mask, padded(mask, F.lit(0)))
             .withColumn(attention, padded(attention, F.lit(0))).drop("_len"))


def pad_batches(df: DataFrame, cap: int, batch: str = "batch", tokens: str = "input_tokens", mask: str = "lmask",
                attention: str = "attention_mask") -> DataFrame:
    """J-9 as a collator does it: rows of one ``batch`` (numbered by
    :func:`labelspark.sources.sinks.batch_numbers`) are padded, or cut, to the
    longest of that batch, at most ``cap``.  One exchange on the batch, whose
    size the caller chose; no length of the whole corpus is involved."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    j = df.withColumn("_len", F.least(longest, F.lit(cap)))

    def padded(c, value):
        n = F.greatest(F.col("_len") - F.size(c), F.lit(0))
        return F.slice(F.concat(F.col(c), F.array_repeat(value, n)), 1, F.col("_len"))
    return (j.withColumn(tokens, padded(tokens, F.lit(PAD)))
             .withColumn(mask, padded(mask, F.lit(0)))
             .withColumn(attention, padded(attention, F.lit(0))).drop("_len"))


def pack_training(samples: DataFrame, max_length: int, max_labels: int,
                  shuffle: bool = False, remove_underscores: float = 0.9,
                  seed: int = 42) -> DataFrame:
    """J-10: limit labels (B-9), pack (J-8), cut the truth to the labels that
    fitted and report how many did."""
    lim = limit_labels(samples, max_labels, shuffle, remove_underscores, seed)
    p = pack(lim, max_length)
    return p.withColumn("lint", F.slice("lint", 1, F.col("n_fit")))

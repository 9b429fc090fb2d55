"""Near-duplicate groups by SuperMinHash, banding, verification and union.

1. Every text becomes its set of word shingles; texts with equal sets are one
   class, and the smallest id of a class stands for it (a *node*).
2. A SuperMinHash signature per node is cut into bands.  Nodes that share a
   band meet in a bucket; each is paired with the bucket's smallest node only,
   so a bucket of any size gives one pair per node.
3. Pairs are confirmed on the full sets, confirmed links are united into
   components.
4. What the stars may have missed: a bucket that still holds more than one
   component has links to look for between them.  Its nodes go through an exact
   prefix join (shingles ordered by rarity; two sets of the wanted similarity
   share one of their rarest few), restricted to nodes of different components
   and pruned by length and position, again confirmed on the full sets.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.shared import keep, values
from labelspark.llm.superminhash import Shingler, signature

BANDS, ROWS = 48, 6
_RECENT = 1024


def _signer(shingle: int, bands: int, rows: int, with_set: bool):
    """Task function: id, n, set key (16 bytes), and the bands or the set."""
    import hashlib

    def run(batches):
        shingles, seen = Shingler(shingle), OrderedDict()
        for batch in batches:
            ns, keys, out = [], [], []
            for t in values(batch.column("text")):
                s = shingles(t)
                raw = s.tobytes()
                key = hashlib.blake2b(raw, digest_size=16).digest()
                ns.append(len(s))
                keys.append(key)
                if with_set:
                    out.append(s.view(np.int64))
                    continue
                if key not in seen:  # copies often come in a row
                    seen[key] = _bands(s, bands, rows) if len(s) else np.empty(0, np.int64)
                    if len(seen) > _RECENT:
                        seen.popitem(last=False)
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "key", "hashes"])

    return run


def _bands(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    import xxhash

    sig = signature(items, bands * rows)
    return np.array([xxhash.xxh64_intdigest(sig[b * rows : (b + 1) * rows].tobytes(), seed=b)
                     for b in range(bands)], np.uint64).view(np.int64)


def _mapped(rows: DataFrame, shingle: int, bands: int, per_band: int, with_set: bool) -> DataFrame:
    schema = f"id {dict(rows.dtypes)['id']}, n bigint, key binary, hashes array<bigint>"
    return rows.select("id", "text").mapInArrow(_signer(shingle, bands, per_band, with_set), schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those with 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(right, "b").join(left, "a").withColumn("both", both)
    union = F.size("sa") + F.size("sb") - F.col("both")
    return met.where(100 * F.col("both") >= percent * union).select("a", "b")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected links (a, b): component is
    the smallest node reachable.

    Every round each node takes the smallest label among itself and its
    neighbours, then the label's own label; labels spread along paths in
    steps that double.  Each round is checkpointed."""
    both = keep(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(max_rounds):
        around = (both.join(label.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        near = label.join(around, "node").select("node", F.least("component", "near").alias("near"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = keep(near.join(jump, "near").select("node", F.least("near", "far").alias("component"), "old"))
        changed = new.where("component != old").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def _prefix_pairs(active: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that pass the prefix,
    length and position filters.  ``active``: node, component, n, hashes."""
    tokens = active.select("node", F.explode("hashes").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # rarest first; a shingle that no other node has only takes up a place
    ranked = (tokens.join(df, "token").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")))
    ranked = active.select("node", "component", "n").join(ranked, "node")
    lone = F.col("n") - F.size("shared")
    width = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lone
    prefix = F.slice("shared", F.lit(1), F.greatest(width, F.lit(0)).cast("int"))
    posts = ranked.select("node", "component", "n", lone.alias("lone"), F.posexplode_outer(prefix).alias("at", "x"))
    posts = keep(posts.where("x is not null").select(
        F.col("x.token").alias("token"), "node", "component", "n", (F.col("n") - F.col("lone") - F.col("at")).alias("rest")))
    # within a token's nodes, those of its largest component need no pairs
    # among themselves
    share = posts.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    top = share.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k"))
    posts = posts.join(top.where("k > 1").select("token", "top"), "token")

    def side(s: str) -> DataFrame:
        return posts.select("token", "top", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n", "rest")])

    x, y = side("x").where("component_x != top"), side("y").drop("top")
    reach = F.least("rest_x", "rest_y")  # shingles from here on, an upper bound of what they share
    fits = ((F.col("component_x") != F.col("component_y"))
            & ((F.col("component_y") == F.col("top")) | (F.col("node_x") < F.col("node_y")))
            & ((100 + percent) * reach >= percent * (F.col("n_x") + F.col("n_y")))
            & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
    met = x.join(y, "token").where(fits)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = ROWS,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Component of every row under links of Jaccard >= percent / 100.

    Columns: the id (an integer or text), ``n_shingles`` (size of the set of
    distinct ``shingle``-word shingles of the text, A-Z lower-cased; a text
    with fewer words is one shingle), ``component_id`` (smallest id reachable)
    and ``kept`` (the id is that of the component).  Null and empty texts have
    no shingles and are linked with nothing.  Rows that share an id are one
    document for linking.  A row with a null id can't stand for others: it gets
    the component of the rows with its very set of shingles, if there are any,
    and null otherwise, where it is kept.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = keep(_mapped(rows, shingle, bands, band_rows, False))
    classes = signed.where("n > 0").groupBy("key").agg(F.min("id").alias("node"))
    classes = keep(classes)
    firsts = signed.where("n > 0").join(classes.withColumnRenamed("node", "id"), ["key", "id"])
    firsts = firsts.dropDuplicates(["key", "id"])
    posts = firsts.select(F.col("id").alias("node"), F.explode_outer("hashes").alias("band"))
    hubs = posts.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub != other")
    met = posts.join(hubs.select("band", "hub"), "band").select("band", "hub", "node")
    met = keep(met)
    stars = met.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = keep(stars)
    ends = stars.select(F.col("a").alias("id")).unionAll(stars.select(F.col("b").alias("id"))).distinct()
    sets = keep(_mapped(rows.join(ends, "id"), shingle, bands, band_rows, True)
                .join(classes, "key").where("id = node").select("node", "n", "hashes"))
    links = keep(_confirmed(stars, sets, percent))
    label = components(links)
    # buckets that still hold several components
    labelled = met.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    active = labelled.join(mixed.select("band"), "band").select("node", "component").distinct()
    active = keep(active.join(sets, "node"))
    more = _confirmed(_prefix_pairs(active, percent), sets, percent)
    name = label.select("node", "component")
    more = keep(more.join(name.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
                .join(name.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
                .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    if more.limit(1).count():
        merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        both = label.select("node", "component").unionAll(merged.select(F.col("component").alias("node"), "component")).distinct()
        label = both.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")).distinct()
    named = classes.join(label, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n", "key").join(named, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, **kw) -> DataFrame:
    """One document of each group: the one with the smallest id.  Rows that
    share a kept id are thinned to one; rows with a null id stay."""
    doc_id = kw.get("doc_id", "doc_id")
    ids = groups(docs, **kw).where("kept").groupBy(F.col(doc_id).alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = docs.join(keep(ids), F.col(doc_id) == F.col("kept_id"))
    single = kept.where("kept_rows = 1").select(*docs.columns)
    several = kept.where("kept_rows > 1").select(*docs.columns).dropDuplicates([doc_id])
    return single.unionAll(several).unionAll(docs.where(F.col(doc_id).isNull()))

"""Best-fit packing of documents into training bins, under conflicts.

A document of more words than a bin holds is cut: full pieces are bins of their own, the rest is packed. Pieces are
packed longest first into the open bin with the least room that still fits (bins are ordered by room left; from the
first that fits, successors are tried until one is compatible; none: a new bin). A bin carries bitmaps of the sources
and of the duplicate clusters in it. A bin never holds two pieces of one cluster, and at most ``per_source`` pieces of
one source (one bitmap for each further piece).

Rows are dealt into shards by their hash, each of about ``shard_rows`` rows, whatever the input's size; a shard is packed
by itself and costs at most one unfilled bin's tail. A source or cluster that a third of all rows share is spread over all
shards, and so are rows that are the same. Equal texts without blanks and case are one cluster, so they never share a bin;
near copies are for the caller's ``cluster`` to tell. Null and empty texts have no words and get no bin (piece -1). Null
sources count as one source, null ids are ids like others. Other columns are not looked at; bins are the same however rows
are dealt over tasks. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BLANK, lowered, n_words, stored

CAPACITY = 2048
SHARD_ROWS = 2048


def cluster_of(text: Column) -> Column:
    """Duplicate cluster of a text: its words in lower case, hashed."""
    return F.xxhash64(F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), BLANK, " ")))


def pack(sizes, sources, clusters, capacity: int, per_source: int) -> list[int]:
    """Bin of each piece, pieces in the order given; best fit with successor search."""
    bit_s = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    bit_c = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    order: list[tuple[int, int]] = []  # (room left, bin)
    held: list[list[int]] = []  # of each bin: cluster bits, then source bits of the first, second, ... piece of a source
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit_s[source], bit_c[cluster]
        i = bisect_left(order, (size, -1))
        while i < len(order) and (held[order[i][1]][0] & c or held[order[i][1]][per_source] & s):
            i += 1
        if i < len(order):
            room, b = order.pop(i)
        else:
            room, b = capacity, len(held)
            held.append([0] * (per_source + 1))
        held[b][0] |= c
        layer = next(k for k in range(1, per_source + 1) if not held[b][k] & s)
        held[b][layer] |= s
        if room > size:
            insort(order, (room - size, b))
        out.append(b)
    return out


def _packer(capacity: int, per_source: int):
    def shard(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["words", "doc_id", "cluster", "source_key", "copy"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        rows["bin"] = pack(rows["words"].tolist(), rows["source_key"].tolist(), rows["cluster"].tolist(), capacity, per_source)
        rows["bin_id"] = [f"s{key[0]}-{b}" for b in rows["bin"]]
        return rows[["doc_id", "source", "cluster", "piece", "first_word", "words", "bin_id"]]

    return shard


OUT = "doc_id long, source string, cluster long, piece int, first_word long, words long, bin_id string"


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = 4, shard_rows: int = SHARD_ROWS, text: str = "text", doc_id: str = "doc_id", cluster: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, source, cluster, piece (from 0), first_word (from 0), words, bin_id (null for a text without words).

    cluster: duplicate cluster of a row, a long; by default equal texts but for case and blanks."""
    own = cluster if cluster is not None else cluster_of(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.cast("long").alias("cluster"), n_words(F.col(text)).alias("size"))
    # Rows that are the same count once until here, and are told apart by a number from here on, whatever task has them.
    sizes = stored(rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    shards = max(1, -(-(sizes.agg(F.sum("times").alias("n")).first()["n"] or 0) // shard_rows))
    each = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    whole = F.floor(F.col("size") / capacity)
    name = F.concat_ws("-", F.lit("f"), F.hex(F.xxhash64("doc_id", "source", "cluster", "size")), F.col("copy").cast("string"), F.col("piece").cast("string"))
    full = each.filter(F.col("size") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))))
    full = full.select("doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).cast("long").alias("first_word"), F.lit(capacity).cast("long").alias("words"), name.alias("bin_id"))
    rest = each.filter((F.col("size") % capacity > 0)).select("doc_id", "source", "cluster", "copy", whole.cast("int").alias("piece"), (whole * capacity).cast("long").alias("first_word"), (F.col("size") % capacity).cast("long").alias("words"))
    dealt = rest.withColumns({"shard": F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)), "source_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))})
    packed = dealt.groupBy("shard").applyInPandas(_packer(capacity, per_source), OUT)
    none = each.filter(F.col("size") == 0).select("doc_id", "source", "cluster", F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("string").alias("bin_id"))
    return packed.union(full).union(none)

"""Best-fit packing of documents into training sequences, with conflicts.

A document longer than ``capacity`` is cut into full pieces, which fill a bin
each, and a rest.  Rests go, longest first, into the bin whose remaining room is
the tightest that fits and that holds no document of the same source and none of
the same duplicate cluster.  Bins are kept by remaining room; each carries a
bitmap of its sources and one of its clusters.  The search starts at the smallest
room that fits and goes on to the next larger one until a compatible bin is
found; if there is none, a bin is opened.

Rows are numbered once in a written table and dealt to shards by a hash of the
number, ``SHARD_ROWS`` on average, so a source or cluster with very many rows is
spread evenly; each shard packs its own bins in one task.

Defined cases: null and empty texts (length 0) are in no bin (null bin_id); rows
without source or cluster conflict with none; repeated rows are packed one by
one, and share a cluster; ties in length go by row number; columns other than the
named ones are not looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import staged

CAPACITY = 4096
SHARD_ROWS = 4_000
#: Identifiers cross to pandas as text: a column with nulls would become floating point there.
OUT = "doc_id string, piece long, start long, n_tokens long, bin_id string, bin_offset long"


class Bins:
    """Open bins of one shard, by remaining room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set where a bin has room r
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _shelve(self, k: int) -> None:
        room = self.room[k]
        if room:
            self.by_room.setdefault(room, []).append(k)
            self.rooms |= 1 << room

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest compatible bin; source and cluster are bits, 0 for none."""
        larger = self.rooms >> size << size
        while larger:
            room = (larger & -larger).bit_length() - 1  # the successor
            shelf = self.by_room[room]
            for at, k in enumerate(shelf):
                if not (self.sources[k] & source or self.clusters[k] & cluster):
                    del shelf[at]
                    if not shelf:
                        self.rooms ^= 1 << room
                    self.room[k] = room - size
                    self.sources[k] |= source
                    self.clusters[k] |= cluster
                    self._shelve(k)
                    return k, self.capacity - room
            larger &= larger - 1
        self.room.append(self.capacity - size)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._shelve(len(self.room) - 1)
        return len(self.room) - 1, 0


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs twice or more; the others cannot conflict."""
    counts = values.value_counts()
    place = {v: 1 << k for k, v in enumerate(counts.index[counts > 1])}
    return [place.get(v, 0) for v in values]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``rows`` (row, length, source, cluster) with their bin and offset."""
    rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    bins = Bins(capacity)
    placed = [bins.place(int(n), s, c) for n, s, c in zip(rows["length"], _bits(rows["source"]), _bits(rows["cluster"]))]
    return rows.assign(bin=[k for k, _ in placed], bin_offset=[o for _, o in placed])


def pack(docs: DataFrame, length_col: str = "n_tokens", id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start in the document, n_tokens, bin_id, bin_offset."""
    rows = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length"),
        F.xxhash64(F.when(F.col(source_col).isNotNull(), F.col(source_col))).alias("source_hash"), F.col(source_col).isNotNull().alias("has_source"),
        F.col(cluster_col).cast("long").alias("cluster")), "packing-rows").select(
        "row", "doc_id", "length", F.when(F.col("has_source"), F.col("source_hash")).cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    full = (rows.where(F.col("length") >= capacity)
            .select("row", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / capacity) - 1)).alias("piece"))
            .select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"),
                    F.concat(F.lit("full:"), F.col("row").cast("string"), F.lit(":"), F.col("piece").cast("string")).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset")))
    rests = rows.where(F.col("length") % capacity > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", F.col("doc_id").cast("string"), F.floor(F.col("length") / capacity).alias("piece"),
        (F.col("length") % capacity).alias("length"), "source", "cluster")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        done = pack_shard(group, capacity)
        return pd.DataFrame({
            "doc_id": done["doc_id"], "piece": done["piece"], "start": done["piece"] * capacity, "n_tokens": done["length"],
            "bin_id": [f"shared:{key[0]}:{k}" for k in done["bin"]], "bin_offset": done["bin_offset"]})

    packed = rests.groupBy("shard").applyInPandas(run, OUT).withColumn("doc_id", F.col("doc_id").cast("long"))
    none = rows.where(F.col("length") == 0).select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"),
                                                   F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return full.unionByName(packed).unionByName(none)


def pack_documents(docs: DataFrame, model_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   near: bool = True) -> DataFrame:
    """Packs whole documents by their token counts; near duplicates (a SimHash group of op3) are a duplicate cluster.

    ``near`` may be false where each group has one document left: then equal texts are one.
    """
    from .simhash import fingerprint_column, fingerprint_components
    from .tokens import batch_token_count

    text = F.col(text_col)
    mark = fingerprint_column(text) if near else F.xxhash64(text)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), batch_token_count(text, model_path).alias("tokens"), mark.alias("cluster"))
    if near:
        sized = staged(sized, "packing-sized")
        groups = staged(fingerprint_components(sized.select(F.col("cluster").alias("fp")).distinct()), "packing-groups")
        sized = sized.join(groups, F.col("cluster") == F.col("fp"), "left").select("id", "source", "tokens", F.coalesce("component", "cluster").alias("cluster"))
    return pack(sized, "tokens", "id", "source", "cluster", capacity)

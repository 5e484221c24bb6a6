"""Sum-of-squares packing of items into containers of fixed capacity, in parallel shards.

A shard keeps a level array: the number of open containers per fill level. Each item goes to the level (or into a new
container) for which the sum of the squared counts of partially filled containers becomes smallest; of equal ones, the
fullest. Items come in a fixed random order, as they would online. What the shards leave in containers far from full is
packed once more, many shards' leftovers together and the largest pieces first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronoscene.storage import materialized

#: An empty level; smaller than any number of containers in the score.
_NONE = -1e12


class LevelArray:
    """Open containers of one capacity by fill level."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)
        self.count[capacity] = -0.5  # a full container leaves the sum
        self.held = np.full(capacity + 1, _NONE)
        self.open: dict[int, list[int]] = {}
        self.containers = 0

    def place(self, size: int) -> int:
        """Container for an item of ``size`` (1 to capacity)."""
        b, top = self.capacity, self.capacity - size
        level, least = 0, self.count[size] - 0.5 if top else -1.0
        if top and self.open:
            # change of the sum / 2 - 1 for levels top .. 1, fullest first
            change = self.count[b : size : -1] - self.held[top:0:-1]
            at = int(change.argmin())
            if change[at] <= least:
                level = top - at
        if level:
            stack = self.open[level]
            container = stack.pop()
            self.count[level] -= 1
            if stack:
                self.held[level] -= 1
            else:
                del self.open[level]
                self.held[level] = _NONE
        else:
            container = self.containers
            self.containers += 1
        to = level + size
        if to < b:
            self.open.setdefault(to, []).append(container)
            self.count[to] += 1
            self.held[to] = self.count[to]
        return container


def pack_shard(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces ``(id, piece, start, size, container)``; items beyond the capacity are cut into full pieces and a rest."""
    full, rest = sizes // capacity, sizes % capacity
    order = np.lexsort((ids, ids * np.int64(-7046029254386353131)))
    order = order[rest[order] > 0]
    levels = LevelArray(capacity)
    packed = np.fromiter((levels.place(int(s)) for s in rest[order]), np.int64, len(order))
    many = np.repeat(np.arange(len(ids)), full)
    number = np.arange(len(many)) - np.repeat(np.cumsum(full) - full, full)
    return (
        np.concatenate([ids[order], ids[many]]),
        np.concatenate([full[order], number]) + 1,
        np.concatenate([full[order] * capacity, number * capacity]),
        np.concatenate([rest[order], np.full(len(many), capacity, np.int64)]),
        np.concatenate([packed, levels.containers + np.arange(len(many))]),
    )


PIECES = "pack_id int, doc_id long, piece_no long, token_start long, n_tokens long, container string"


def pack(items: DataFrame, capacities: DataFrame, shard_items: int = 30_000, open_share: float = 0.97, joined_shards: int = 256) -> DataFrame:
    """``(pack_id, doc_id, piece_no, token_start, n_tokens, container)`` for each capacity.

    ``items (doc_id, lang, n_tokens)``, ``capacities (pack_id, capacity_tokens, by_lang)``, a few rows. Items of null or no
    size and capacities of null or no size are left out; a repeated ``doc_id`` is packed as often as it occurs. An item is
    split only if it exceeds the capacity: into full containers and one rest. With ``by_lang`` a container holds one
    language. Each (pack, language) is cut by hash into shards of about ``shard_items`` items, the unit of a task. The pieces in
    containers filled to less than ``open_share`` are taken out and packed again for ``joined_shards`` shards together.
    """
    sized = items.where("doc_id is not null and n_tokens > 0").select("doc_id", "lang", "n_tokens")
    packs = capacities.where("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.coalesce("by_lang", F.lit(False)).alias("by_lang"))
    rows = sized.crossJoin(F.broadcast(packs)).select("pack_id", "capacity", F.when(F.col("by_lang"), F.coalesce("lang", F.lit("und"))).otherwise("all").alias("part"), "doc_id", "n_tokens")
    # One row per language: a few, whatever the corpus.
    by_lang = sized.groupBy(F.coalesce("lang", F.lit("und")).alias("part")).agg(F.count("*").alias("n"))
    shards = by_lang.union(by_lang.agg(F.lit("all"), F.sum("n"))).select("part", F.ceil(F.col("n") / shard_items).alias("shards"))
    placed = rows.join(shards, "part").withColumn("shard", F.pmod(F.xxhash64("doc_id", "pack_id"), "shards")).drop("shards")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, part, shard = key
        ids, piece, start, size, container = pack_shard(pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        names = f"{pack_id}/{part}/{shard}/" + pd.Series(container).astype(str)
        capacity = int(pdf["capacity"].iloc[0])
        used = np.bincount(container, size)[container] if len(container) else size
        return pd.DataFrame({"pack_id": pack_id, "doc_id": ids, "piece_no": piece, "token_start": start, "n_tokens": size, "container": names, "part": part, "shard": shard, "capacity": capacity, "open": used < open_share * capacity})

    first = materialized(placed.groupBy("pack_id", "part", "shard").applyInPandas(packed, f"{PIECES}, part string, shard long, capacity long, open boolean"))

    def repacked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, part, joined = key
        rows = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True])
        levels = LevelArray(int(rows["capacity"].iloc[0]))
        rows["container"] = [f"{pack_id}/{part}/r{joined}/{levels.place(int(n))}" for n in rows["n_tokens"]]
        return rows[["pack_id", "doc_id", "piece_no", "token_start", "n_tokens", "container"]]

    left = first.where("open").withColumn("joined", F.floor(F.col("shard") / joined_shards))
    names = [f.split(" ")[0] for f in PIECES.split(", ")]
    return first.where("not open").select(*names).union(left.groupBy("pack_id", "part", "joined").applyInPandas(repacked, PIECES))


def fill_report(pieces: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(pack_id, capacity_tokens, containers, least_containers, n_tokens, fill)``; ``fill`` is the used share of the room."""
    per = pieces.groupBy("pack_id").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    room = capacities.select("pack_id", "capacity_tokens")
    return per.join(room, "pack_id").select(
        "pack_id", "capacity_tokens", "containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "n_tokens",
        F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )


def soundness(pieces: DataFrame, items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: documents placed, and whether all their tokens are (``complete``), no container exceeds the capacity
    (``within``), only larger documents are split (``whole``), and containers hold one language where asked (``one_language``)."""
    packs = capacities.where("capacity_tokens > 0").select("pack_id", "capacity_tokens", "by_lang")
    sized = items.where("doc_id is not null and n_tokens > 0").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.col("n_tokens").alias("size"))
    rows = pieces.join(sized, "doc_id", "left").join(packs, "pack_id")
    docs = rows.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.first("size").alias("size"), F.count("*").alias("n"), F.first("capacity_tokens").alias("c"))
    docs = docs.groupBy("pack_id").agg(F.count("*").alias("documents"), F.bool_and(F.coalesce(F.col("got") == F.col("size"), F.lit(False))).alias("complete"), F.bool_and((F.col("n") == 1) | (F.col("size") > F.col("c"))).alias("whole"))
    boxes = rows.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"), F.first("capacity_tokens").alias("c"), F.count_distinct("lang").alias("langs"), F.first("by_lang").alias("by_lang"))
    boxes = boxes.groupBy("pack_id").agg(F.bool_and(F.col("used") <= F.col("c")).alias("within"), F.bool_and(~F.col("by_lang") | (F.col("langs") == 1)).alias("one_language"))
    return docs.join(boxes, "pack_id").select("pack_id", "documents", "complete", "within", "whole", "one_language")

"""Filling fixed-capacity containers with texts: bounded-space online packing.

Texts are sized in tokens of a public tokenizer. A text beyond the capacity is cut into full containers and a rest, which is
an item like any other; no other item is cut. Items come in an order that has nothing to do with their size (by hash), in
as many partitions as the number of items needs. Each partition keeps at most OPEN containers open, puts an item where
least room is left after it (best fit), and, when it fits nowhere, closes the fullest and opens a new one. What is open at
the end of a partition is merged: open containers are items of the next level, with a SHRINK-th of the partitions, until
one partition is left. A partition's state is OPEN numbers per capacity, whatever the size of the table.

Defined results: a null text is no item; an empty text is an item of no tokens and lies in some container; equal texts are
items each; capacities of null, 0 or less take nothing; an empty table gives no container; the result is the same for any
partitioning of the input, as items are ordered by hash and id.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = 256  # open containers per partition and capacity
ITEMS = 50_000  # items per partition
SHRINK = 16
TOKENIZER = os.environ.get("FERROLITH_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k.json"


def sizes(documents: DataFrame, folder: str = TOKENIZER, name: str = NAME) -> DataFrame:
    """doc_id, tokens of every text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{folder}/{name}")
        t.encode_special_tokens = True
        for p in parts:
            n: list[int] = []
            texts = p["text"].tolist()
            at = 0
            while at < len(texts):  # a few texts at a time, as some are long
                step, held = at, 0
                while step < len(texts) and (held < 400_000 or step == at):
                    held += len(texts[step])
                    step += 1
                n += [len(e) for e in t.encode_batch(texts[at:step], add_special_tokens=False)]
                at = step
            yield pd.DataFrame({"doc_id": p["doc_id"], "tokens": n})

    return documents.select("doc_id", "text").filter("text is not null and doc_id is not null").mapInPandas(run, "doc_id long, tokens long")


class Packer:
    """Open containers of one capacity: best fit, the fullest closed when nothing fits and OPEN are open."""

    def __init__(self, capacity: int, open_: int = OPEN):
        self.capacity, self.most = capacity, open_
        self.room: list[tuple[int, int]] = []  # (room left, number), sorted
        self.made = 0

    def put(self, size: int) -> tuple[int, list[tuple[int, int]]]:
        """The container's number and the closed ones as (number, filled)."""
        closed = []
        i = bisect.bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, number = self.room.pop(i)
        else:
            if len(self.room) >= self.most:
                left, full = self.room.pop(0)
                closed.append((full, self.capacity - left))
            left, number = self.capacity, self.made
            self.made += 1
        bisect.insort(self.room, (left - size, number))
        return number, closed

    def rest(self) -> list[tuple[int, int]]:
        return [(n, self.capacity - left) for left, n in self.room]


def _level(items: DataFrame, parts: int, level: int, open_: int) -> DataFrame:
    """items (size_name, capacity, item string, size): with `into`, its container of this level, and container rows (item null) with what they hold."""
    x = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(parts)).cast("int")).withColumn("turn", F.xxhash64("item"))
    x = x.repartitionById(parts, F.col("bucket")).sortWithinPartitions("size_name", "bucket", "turn", "item")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, packer = None, None
        cols = ["size_name", "capacity", "item", "size", "into", "open"]

        def left() -> list[tuple]:
            return [] if packer is None else [(key[0], packer.capacity, None, n, f"{level}-{key[1]}-{c}", True) for c, n in packer.rest()]

        for p in frames:
            rows: list[tuple] = []
            for name, cap, item, size, bucket in zip(p["size_name"], p["capacity"], p["item"], p["size"], p["bucket"]):
                if (name, bucket) != key:
                    rows += left()
                    key, packer = (name, bucket), Packer(int(cap), open_)
                number, closed = packer.put(int(size))
                rows.append((name, cap, item, size, f"{level}-{bucket}-{number}", False))
                rows += [(name, cap, None, n, f"{level}-{bucket}-{c}", False) for c, n in closed]
            yield pd.DataFrame(rows, columns=cols)
        yield pd.DataFrame(left(), columns=cols)

    return x.select("size_name", "capacity", "item", "size", "bucket").mapInPandas(run, "size_name string, capacity long, item string, size long, into string, open boolean")


def pack(tokens: DataFrame, capacities: DataFrame, open_: int = OPEN, per_part: int = ITEMS) -> DataFrame:
    """tokens (doc_id, tokens) and capacities (size_name, capacity_tokens): size_name, container, doc_id, piece, tokens.

    Pieces of a cut text are numbered in its order; all but the last fill a container of their own.
    """
    from ferrolith.session import checkpoint

    # capacities are a fixed list of a few rows, which is checked
    caps = [(r[0], int(r[1])) for r in capacities.filter("capacity_tokens > 0 and size_name is not null").select("size_name", "capacity_tokens").distinct().limit(101).collect()]
    if len(caps) > 100:
        raise ValueError("more than 100 capacities")
    tokens = checkpoint(tokens.select("doc_id", "tokens"))
    lists = [F.struct(F.lit(n).alias("size_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(caps)]
    kind = "array<struct<size_name:string,capacity:bigint>>"
    each = tokens.withColumn("c", F.explode(F.array(*lists).cast(kind))).select("doc_id", "tokens", "c.*")
    full = each.filter("tokens > capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast(tokens div capacity - 1 as int)"))))
    full = full.select("size_name", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    rest = each.filter("tokens <= capacity or tokens % capacity > 0")
    rest = rest.withColumn("piece", F.when(F.col("tokens") > F.col("capacity"), F.expr("cast(tokens div capacity as int)")).otherwise(0))
    rest = rest.withColumn("size", F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")))
    rest = rest.withColumn("item", F.concat_ws("-", "doc_id", "piece"))
    n = tokens.count()
    parts, level = max(1, -(-n // per_part)), 0
    items = rest.select("size_name", "capacity", "item", "size")
    maps = []
    while True:
        done = checkpoint(_level(items, parts, level, open_))
        maps.append(done.filter("item is not null").select("size_name", "item", "into"))
        if parts == 1:
            break
        items = done.filter("item is null and open").select("size_name", "capacity", F.col("into").alias("item"), "size")
        parts, level = max(1, parts // SHRINK), level + 1
    where = maps[0].withColumnRenamed("into", "c0")
    for k, m in enumerate(maps[1:], 1):
        m = m.select("size_name", F.col("item").alias(f"c{k - 1}"), F.col("into").alias(f"c{k}"))
        where = where.join(m, ["size_name", f"c{k - 1}"], "left")
    where = where.select("size_name", "item", F.coalesce(*[F.col(f"c{k}") for k in reversed(range(len(maps)))]).alias("container"))
    packed = where.join(rest.select("size_name", "item", "doc_id", "piece", F.col("size").alias("tokens")), ["size_name", "item"])
    return packed.select("size_name", "container", "doc_id", "piece", "tokens").unionByName(full.select("size_name", "container", "doc_id", "piece", "tokens"))


def packing(documents: DataFrame, pack_sizes: DataFrame, folder: str = TOKENIZER, name: str = NAME) -> DataFrame:
    return pack(sizes(documents, folder, name), pack_sizes)


def report(documents: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Per capacity: items, containers, tokens, and the share of the containers' room that is used."""
    p = packing(documents, pack_sizes)
    c = p.groupBy("size_name", "container").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    g = c.groupBy("size_name").agg(F.sum("n").alias("items"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    g = g.join(pack_sizes, "size_name")
    return g.select("size_name", "capacity_tokens", "items", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 5).alias("used"))

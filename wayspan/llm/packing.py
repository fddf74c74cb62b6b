"""Pages put into containers of fixed capacity, neighbours on a space-filling curve together."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayspan.llm.tokens import TOKENIZERS, VOCABULARY, codec, encoded
from wayspan.operators.blocks import with_rank
from wayspan.session import cut

#: The curve: dimensions of the projected vectors and bits of each.
DIMENSIONS, BITS = 4, 8
#: Neighbours on the curve that are packed at a time, and the share of a container that counts as
#: full; what is in less full ones is packed again with the neighbours that come next.
BLOCK, FULL = 8_192, 0.995
SCHEMA = "kind_id int, container string, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"


@functools.lru_cache(1)
def _directions(size: int) -> np.ndarray:
    """A fixed direction of +-1 in each dimension for every token, from a hash of its id."""
    x = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integers from 0 to below 2 ** bits.

    Bit by bit from the top: within each half-cube the axes are reflected or exchanged so that
    consecutive cells share a face, then the bits are interleaved and Gray decoded.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in range(dims):
            set_ = (x[axis] >> bit) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(set_, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> bit) & 1
    return key


def page_keys(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and curve (key of the page's place on the curve) of every page.

    A page's vector is the sum of the directions of its tokens over the root of their number.
    Pages without tokens are in the middle of the cube.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions(codec(folder, vocabulary).size)
        for batch in batches:
            for start, part in encoded(batch, "text", folder, vocabulary):
                counts = np.array([len(x) for x in part], np.int64)
                sums = np.array([directions[x].sum(0) if len(x) else np.zeros(DIMENSIONS) for x in part])
                cell = np.tanh(sums / np.sqrt(np.maximum(counts, 1))[:, None] / 4)
                cell = np.clip((cell + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), pa.array(counts), pa.array(hilbert(cell, BITS))], ["doc_id", "n_tokens", "curve"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, curve bigint")


def containers(documents: DataFrame, kinds: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """The container of every page or piece, for each kind: kind_id, container, doc_id, piece, first_token, n_tokens.

    kinds: kind_id and capacity; a row with a null in either, or a capacity below 1, is no kind,
    and there must be at most 1000. A page of more tokens than the capacity is cut into pieces,
    numbered from 0, of which all but the last fill a container of their own; other pages are
    piece 0. Pages without tokens (null and empty texts too) go into containers like any other.
    Every row of documents comes out once for each kind, with its pieces; a null doc_id stays
    null. container is unique over kinds. No documents or no kinds: no rows.

    Pieces are range-sorted by kind and curve key, ties by doc_id, piece and size, and ranked; a
    task packs the block pieces of neighbouring ranks: in falling size, each into the fullest
    container that still takes it. What is in less than full containers is ranked again and packed
    with its neighbours on the curve, round by round, until a block holds it all; a round leaves at
    most half of its pieces. Blocks are ranges of ranks and name their containers, so the
    result doesn't depend on partitions, and a task that is run again gives the same rows.
    """
    known = kinds.select(F.col("kind_id").cast("int"), F.col("capacity").cast("bigint")).dropna().where("capacity >= 1").distinct().limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("too many kinds of containers")
    if not known:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    kind = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("kind_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in sorted(known)])
    left = cut(pieces_of(cut(page_keys(documents, folder, vocabulary)), kind))
    done, number = [], 0
    while True:
        n = left.count()
        packed = left.select(*_ORDER, "capacity")
        packed = with_rank(packed, _ORDER).withColumn("block", F.floor(F.col("rank") / F.lit(block)).cast("bigint"))
        packed = cut(packed.groupBy("kind_id", "block").applyInPandas(_packer(number, n <= block), _PACKED))
        done.append(packed.where("container IS NOT NULL").select("kind_id", "container", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "n_tokens"))
        left, number = packed.where("container IS NULL"), number + 1
        if n <= block:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pieces_of(keys: DataFrame, kind: Column) -> DataFrame:
    """A row for each piece of each page and kind: kind_id, capacity, curve, doc_id, piece, n_tokens."""
    sized = keys.select("doc_id", "n_tokens", "curve", F.explode(kind).alias("k")).select("k.*", "doc_id", "n_tokens", "curve")
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint") - 1)
    rows = sized.select("kind_id", "capacity", "curve", "doc_id", F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return rows.withColumn("n_tokens", F.least("capacity", F.col("_all") - F.col("piece") * F.col("capacity"))).drop("_all")


_ORDER = ["kind_id", "curve", "doc_id", "piece", "n_tokens"]
_PACKED = "kind_id int, container string, curve bigint, doc_id bigint, piece bigint, n_tokens bigint, capacity bigint"


def _packer(number: int, last: bool):
    """Packs a block of round `number`; pieces to be packed again have no container."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable", ignore_index=True)
        kind, capacity, here = int(pdf["kind_id"].iloc[0]), int(pdf["capacity"].iloc[0]), int(pdf["block"].iloc[0])
        done, _ = settle(list(zip(pdf["n_tokens"].tolist(), range(len(pdf)))), capacity, last)
        names = [None] * len(pdf)
        for k, c in enumerate(sorted(done, key=lambda c: min(x[1] for x in c))):
            for _, at in c:
                names[at] = f"{kind}-{number}-{here}-{k}"
        pdf["container"] = pd.Series(names, dtype=object)
        return pdf[["kind_id", "container", "curve", "doc_id", "piece", "n_tokens", "capacity"]]

    return pack


def settle(items: list[tuple], capacity: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Containers that are done, and the items to be packed again with others.

    Items are tuples that begin with the size. All containers are done at the last call, else
    those that are full; of the others the fullest are done as well if they hold more than half
    of the items, until a quarter is left.
    """
    filled = best_fit(items, capacity)
    if last:
        return [c for _, c in filled], []
    done = [c for room, c in filled if room <= (1 - FULL) * capacity]
    rest = [c for room, c in filled if room > (1 - FULL) * capacity]
    left = sum(map(len, rest))
    if left > len(items) // 2:
        rest.sort(key=lambda c: -sum(x[0] for x in c))
        at = 0
        while at < len(rest) and left > len(items) // 4:
            left -= len(rest[at])
            at += 1
        done, rest = done + rest[:at], rest[at:]
    return done, [x for c in rest for x in c]


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, list[tuple]]]:
    """Items in falling size, each into the container with the least room that takes it: (room left, items)."""
    rooms: list[tuple[int, int]] = []  # (room, container), ascending
    out: list[list] = []
    for item in sorted(items, key=lambda x: -x[0]):
        k = bisect.bisect_left(rooms, (item[0], -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            room, at = capacity, len(out)
            out.append([])
        out[at].append(item)
        bisect.insort(rooms, (room - item[0], at))
    left = {at: room for room, at in rooms}
    return [(left[k], c) for k, c in enumerate(out)]

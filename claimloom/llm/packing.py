"""Documents into containers of fixed token capacity by bound-certified repacking (problem 7).

Method.  Documents are measured in tokens where they are read; those longer than the capacity, and only those, are cut into full pieces and
a rest.  Pieces are spread over partitions by a hash, and each partition packs its own by best-fit decreasing.  Lower bounds from
dual-feasible functions on the partition's sizes certify the number of containers: a partition that meets its bound cannot be improved.
The others, the partitions with a gap, and everybody's poorly filled containers give their pieces back; these are mixed anew under
another hash and best-fit decreasing runs again, until no gap is left or no container is saved.  A bound over all sizes
certifies the whole.

A partition holds about ``partition_pieces`` pieces, whatever the corpus; copies of one text are spread like any others, because the hash is of the
document's id.  The partitions' figures stay a written table that is joined back; single totals and one row per size (at most the capacity) reach the driver.

Defined cases: null and empty texts have no tokens and take a container of their partition without using room; a text as long as the
capacity fills one container; repeated rows of one id count once (the smallest count).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "doc_id {id}, part int, tokens int, home long, bin int, room int"
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every row."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(count(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, tokens long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and the room left in each container.

    Containers are kept by their room; a bit set of the rooms in use finds the tightest one that fits in a few operations.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    rooms = 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            c = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            r, c = capacity, len(room)
            room.append(capacity)
        left = r - s
        where[i], room[c] = c, left
        by_room[left].append(c)
        rooms |= 1 << left
    return where, np.array(room, dtype=np.int64)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int, most_k: int = 50) -> int:
    """Containers that any packing of the sizes needs: the best of the total and two families of dual-feasible functions."""
    live = sizes > 0
    s, n = sizes[live].astype(np.int64), counts[live].astype(np.int64)
    if not len(s):
        return 0
    best = -(-int((s * n).sum()) // capacity)
    for e in np.unique(s[s <= capacity // 2]).tolist():  # small items dropped, large ones rounded up to a container
        value = np.where(s > capacity - e, capacity, np.where(s < e, 0, s))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, most_k + 1):  # sizes rounded to multiples of capacity / (k + 1)
        whole = (s * (k + 1)) % capacity == 0
        value = np.where(whole, s * k, (s * (k + 1) // capacity) * capacity)  # times k
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best



def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, partition_pieces: int = 20_000, open_share: float = 0.02) -> tuple[DataFrame, dict]:
    """(doc_id, part, start_token, tokens, container, room) of every piece, and the certificate: containers, lower bound, partitions with a gap."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = PACKED.format(id=id_type)
    scratch = Scratch(spark, "packing")
    sized = token_counts(documents, tokenizer).groupBy("doc_id").agg(F.min("tokens").alias("tokens"))
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int")
    pieces = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("doc_id", F.col("part").cast("int").alias("part"), F.least(F.col("tokens") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    pieces = scratch.write(pieces, "pieces")
    total = pieces.count()

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        where, room = best_fit_decreasing(pdf["tokens"].to_numpy(), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "part": pdf["part"], "tokens": pdf["tokens"], "home": key[0], "bin": where, "room": room[where]})

    def run(pool: DataFrame, count: int, r: int) -> DataFrame:
        homes = max(1, math.ceil(count / partition_pieces))
        home = F.pmod(F.xxhash64("doc_id", "part", F.lit(r)), F.lit(homes))
        spread = pool.withColumn("home", F.lit(r * 2**40) + home).repartition(homes, "home")
        return scratch.write(spread.groupBy("home").applyInPandas(solve, schema), f"packed-{r}")

    def figures(packed: DataFrame) -> pd.DataFrame:
        """One row per partition: containers, lower bound."""

        def bound(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            lb = lower_bound(pdf["tokens"].to_numpy(), pdf["n"].to_numpy(), capacity)
            return pd.DataFrame({"home": [key[0]], "bound": [max(lb, 1)]})

        sizes = packed.groupBy("home", "tokens").agg(F.count(F.lit(1)).alias("n"))
        bins = packed.groupBy("home").agg((F.max("bin") + 1).alias("bins"), F.count(F.lit(1)).alias("pieces"))
        return bins.join(sizes.groupBy("home").applyInPandas(bound, "home long, bound long"), "home")

    current = run(pieces, total, 0)
    kept: list[DataFrame] = []
    report = {"capacity": capacity, "pieces": total, "rounds": 0}
    r = 0
    while True:
        r += 1
        stats = scratch.write(figures(current), f"figures-{r}")  # one row per partition, joined back below
        if stats.limit(2).count() <= 1:
            break
        poor = F.col("room") > F.lit(int(capacity * open_share))
        gaps = stats.where("bins > bound").select("home", F.lit(True).alias("gap"))
        marked = current.join(gaps, "home", "left").withColumn("given", (F.col("gap").isNotNull() & (F.col("room") > 0)) | poor).drop("gap")
        marked = scratch.write(marked, f"marked-{r}")
        pool = marked.where("given").drop("given")
        count, before = pool.agg(F.count(F.lit(1)), F.count_distinct("home", "bin")).first()
        if count == 0 or before <= 1:
            break
        again = run(pool.select("doc_id", "part", "tokens"), count, r)
        after = again.select("home", "bin").distinct().count()
        if after >= before:
            break
        kept.append(marked.where("not given").drop("given"))
        current = again
        report["rounds"] = r
    done = current
    for k in kept:
        done = done.unionByName(k)
    histogram = pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most capacity + 1 rows
    used = done.agg(F.count_distinct("home", "bin")).first()[0]
    report |= {"containers": int(used), "bound": lower_bound(histogram["tokens"].to_numpy(), histogram["n"].to_numpy(), capacity), "tokens": int((histogram["tokens"].astype("int64") * histogram["n"]).sum())}
    out = done.select("doc_id", "part", (F.col("part") * capacity).alias("start_token"), "tokens", F.concat_ws("-", F.floor(F.col("home") / 2**40).cast("string"), F.pmod(F.col("home"), F.lit(2**40)).cast("string"), F.col("bin").cast("string")).alias("container"), "room")
    return out, report

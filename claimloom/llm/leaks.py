"""Evaluation passages inside training text, by a prefix-filtered set join (problem 8).

Method.  Every window of ten words of an item's passage (twenty signs for Chinese) is a set to be contained whole in a document
window of the same length.  Words are ordered by rarity, counted over the whole corpus.  For containment of all n words the
necessary prefix has length one: a document that holds the window holds its rarest word.  The windows are filed under their rarest word.  A document
word that is one of these fixes where the window must lie (positional bound), whether it fits (length bound), and the window is then compared
word by word (exact check).

Windows are built in a distributed pass over the items.  Up to ``block_windows`` of them the index is broadcast, and documents are never shuffled.  Beyond, both
sides meet in a shuffle join on the rarest word: documents send the words that pass a bitmap of these (2 MB whatever their number), each with its
neighbourhood, and words that are hot in the corpus are salted.  Either way the corpus is read twice: for the counts and for the matches.

Words are maximal runs of letters and digits, case folded, in Unicode normal form C; Chinese counts single signs.  Null texts and texts
shorter than a window contain nothing; an item without passage or with a passage shorter than a window never leaks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import salted_join

WORDS, SIGNS = 10, 20
_WORD = re.compile(r"[^\W_]+")
_WORD_WIDE = re.compile(r"[^\W_぀-ヿ㐀-鿿]+")


def tokens(text: str, signs: bool) -> list[str]:
    """Words, or single signs, of a text apart from case, punctuation and white space."""
    if text.isascii():
        low = text.lower()
        return [c for c in low if c.isalnum()] if signs else _WORD.findall(low)
    low = unicodedata.normalize("NFC", text).casefold()
    return [c for c in low if c.isalnum()] if signs else _WORD_WIDE.findall(low)


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, signs, toks) of every window of every passage."""
    item_type = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, rows = [], [], []
            for item, lang, passage in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                signs = (lang or "").lower().startswith("zh")
                n, toks = SIGNS if signs else WORDS, tokens(passage, signs)
                for i in range(len(toks) - n + 1):
                    ids.append(item)
                    kinds.append(signs)
                    rows.append(toks[i : i + n])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(kinds, pa.bool_()), pa.array(rows, pa.list_(pa.string()))], ["item_id", "signs", "toks"])

    listed = items.where("passage is not null and item_id is not null").select("item_id", "lang", "passage")
    return listed.mapInArrow(run, f"item_id {item_type}, signs boolean, toks array<string>").distinct()


def corpus_counts(texts: DataFrame, kinds: list[bool]) -> DataFrame:
    """(signs, token, n): in how many documents each word or sign occurs; combined per batch, then map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[bool, Counter] = {s: Counter() for s in kinds}
            for text in b.column(1).to_pylist():
                for s in kinds:
                    total[s].update(set(tokens(text, s)))
            rows = [(s, t, n) for s, c in total.items() for t, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["signs", "token", "n"])

    return texts.mapInArrow(run, "signs boolean, token string, n long").groupBy("signs", "token").agg(F.sum("n").alias("n"))


def leaks(documents: DataFrame, items: DataFrame, block_windows: int = 200_000) -> DataFrame:
    """(doc_id, item_id): documents that hold ten consecutive words (zh: twenty signs) of an item's passage."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    texts = documents.where("text is not null").select("doc_id", "text")
    windows = scratch.write(item_windows(items), "windows")
    sizes = {r["signs"]: r["n"] for r in windows.groupBy("signs").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return documents.select("doc_id").join(items.select("item_id"), F.lit(False)).distinct()
    kinds = sorted(sizes)
    words = windows.select("signs", F.explode("toks").alias("token")).distinct()
    ranks = scratch.write(words.join(corpus_counts(texts, kinds), ["signs", "token"]), "ranks")  # a window with a word of no document matches nothing and drops out below
    at = windows.select("item_id", "signs", "toks", F.posexplode("toks").alias("k", "token")).join(ranks, ["signs", "token"])
    width = F.when(F.col("signs"), SIGNS).otherwise(WORDS)
    rarest = at.groupBy("item_id", "signs", "toks").agg(F.min(F.struct("n", "token", "k")).alias("r"), F.count(F.lit(1)).alias("held")).where(F.col("held") == width)
    index = scratch.write(rarest.select("signs", F.col("r.token").alias("token"), F.col("r.k").alias("k"), "toks", "item_id"), "index")
    found = _by_broadcast(texts, index, kinds) if sum(sizes.values()) <= block_windows else _by_join(texts, index, kinds)
    return found.distinct()


def _by_broadcast(texts: DataFrame, index: DataFrame, kinds: list[bool]) -> DataFrame:
    """Matches of documents against an index of bounded size."""
    entries: dict[bool, dict[str, list]] = {s: {} for s in kinds}
    for r in index.collect():
        entries[r["signs"]].setdefault(r["token"], []).append((r["k"], tuple(r["toks"]), r["item_id"]))
    held = texts.sparkSession.sparkContext.broadcast(entries)
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), index.schema["item_id"].dataType.simpleString()
    item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = set()
                for s in kinds:
                    known, n = held.value[s], SIGNS if s else WORDS
                    toks = tokens(text, s)
                    last = len(toks) - n
                    if last < 0 or known.keys().isdisjoint(toks):
                        continue
                    for p, t in enumerate(toks):
                        for k, window, it in known.get(t, ()):
                            if 0 <= p - k <= last and it not in hits and tuple(toks[p - k : p - k + n]) == window:
                                hits.add(it)
                docs += [doc] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(found, item)], ["doc_id", "item_id"])

    return texts.mapInArrow(find, f"doc_id {id_type}, item_id {item_type}")


BITS, PER_BUCKET = 2**24, 32_768


def _by_join(texts: DataFrame, index: DataFrame, kinds: list[bool]) -> DataFrame:
    """Matches of documents against an index of any size: a join on the rarest word."""
    h = F.pmod(F.crc32(F.encode("token", "utf-8")), F.lit(BITS)) + 1
    bits = index.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()  # at most BITS / PER_BUCKET rows of 4 kB
    mask = texts.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in bits})
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = mask.value

        def passes(t: str) -> bool:
            bucket, bit = divmod(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BITS, PER_BUCKET)
            held = known.get(bucket + 1)
            return held is not None and bool(held[bit // 8] >> bit % 8 & 1)

        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in kinds:
                    n, toks = SIGNS if s else WORDS, tokens(text, s)
                    if len(toks) < n:
                        continue
                    wanted = {t for t in set(toks) if passes(t)}
                    for p, t in enumerate(toks):
                        if t in wanted:
                            lo = max(0, p - n + 1)
                            for c, x in zip(cols, (doc, s, t, p - lo, toks[lo : p + n]), strict=True):
                                c.append(x)
                            if len(cols[0]) >= 20_000:  # bounded batches, whatever the texts
                                yield _batch(cols, b.schema.field(0).type)
                                cols = ([], [], [], [], [])
            yield _batch(cols, b.schema.field(0).type)

    sent = texts.mapInArrow(send, f"doc_id {id_type}, signs boolean, token string, at int, near array<string>")
    key = F.concat(F.when(F.col("signs"), "s").otherwise("w"), "token").alias("key")
    left = sent.select(key, "doc_id", "at", "near")
    right = index.select(key, "k", "toks", "item_id")
    j = salted_join(left, right, "key", "inner")
    fits = (F.col("at") >= F.col("k")) & (F.col("at") - F.col("k") + F.size("toks") <= F.size("near"))
    return j.where(fits).where(F.slice("near", F.greatest(F.col("at") - F.col("k"), F.lit(0)) + 1, F.size("toks")) == F.col("toks")).select("doc_id", "item_id")


def _batch(cols: tuple, id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "signs", "token", "at", "near"])

"""Free-entered labels to a canonical list (problem 5).

Method.  The words of the canonical labels and aliases form a symmetric-delete dictionary: every word is filed under all strings that
up to two deletions in its first letters leave, so a lookup generates deletions of the query alone and never scans the list.  What it finds
is checked with the Damerau-Levenshtein distance (bounded by the length of the word) and weighted: swaps and doubled letters cost less than
other edits, a plural ending or a cut-off word less still.  An entry matches if all its words are matched one to one, in any order, and nothing but
filler words is left over; labels run together, or spelled out as single letters, are looked up without blanks.  Among matches the cheapest
wins, then the entry with most support, then the smaller id.  Everything else is reported as unmatched.

The dictionary is broadcast in blocks of at most ``block_entries`` entries and ``block_bytes`` of text, so its size is bounded whatever the list.  Each block is one narrow
pass with a written table behind it, so a worker holds one block at a time and builds it once; the best match of all blocks is kept.  Nothing is shuffled for matching.

A null or blank label is unmatched.  Entries without label and malformed alias lists count as having none.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

UNMATCHED = "unmatched"
# Words that add nothing to a label.
FILLERS = frozenset("the a an of in on for to and level levels degree extent amount".split())
PREFIX, EDITS, LEAST_CUT = 7, 2, 4
_WORD = re.compile(r"[^\W_]+")
_SHORT_NAME = re.compile(r"\(\s*[^()\s]+\s*\)")
VOWELS = frozenset("aeiouy")


def words_of(label: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", label).casefold())


def deletions(word: str, edits: int) -> set[str]:
    """``word`` and all that up to ``edits`` deletions in its first letters leave."""
    head = word[:PREFIX]
    out = level = {head}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def allowed(word: str) -> int:
    """Edits allowed in a canonical word: none up to two letters, one up to five, two beyond."""
    n = len(word)
    return 0 if n <= 2 else 1 if n <= 5 else EDITS


def distance(a: str, b: str, most: int) -> tuple[int, float] | None:
    """(edits, weighted cost) of the restricted Damerau-Levenshtein distance from typed ``a`` to canonical ``b``, or None beyond ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    before: list[tuple[int, float]] = []
    row = [(j, 1.0 * j) for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[i - 1]
        now = [(i, 1.0 * i)]
        for j in range(1, m + 1):
            y = b[j - 1]
            p = row[j - 1]
            if x == y:
                best = p
            else:
                best = (p[0] + 1, p[1] + (0.9 if x in VOWELS and y in VOWELS else 1.0))
            p = row[j]
            extra = 0.3 if x == "s" and i == n and j == m else 0.6 if i > 1 and a[i - 2] == x else 1.0
            best = min(best, (p[0] + 1, p[1] + extra))
            p = now[j - 1]
            lost = 0.3 if y == "s" and j == m and i == n else 0.6 if j > 1 and b[j - 2] == y else 1.0
            best = min(best, (p[0] + 1, p[1] + lost))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                p = before[j - 2]
                best = min(best, (p[0] + 1, p[1] + 0.7))
            now.append(best)
        if min(now)[0] > most:
            return None
        before, row = row, now
    return row[m] if row[m][0] <= most else None


class Dictionary:
    """Symmetric-delete dictionary over one block of entries (id, label, aliases, support)."""

    def __init__(self, entries: list[tuple[str, "str | None", list[str], int]]):
        self.forms: list[tuple[tuple[str, ...], int, str]] = []  # words, -support, id
        self.joined: dict[str, tuple[int, str]] = {}
        self.with_word: dict[str, set[int]] = defaultdict(set)
        self.letters: dict[str, list[int]] = defaultdict(list)
        ordered: dict[str, tuple[int, str]] = {}
        for ident, label, aliases, support in entries:
            rank = (-(support or 0), ident)
            for text in [label, *aliases]:
                if not isinstance(text, str):
                    continue
                every = words_of(text)
                words = [w for w in every if w not in FILLERS] or every
                if not words:
                    continue
                self._keep(self.joined, "".join(every), rank)
                if len(words) == 1 and text is not label and text.isupper():
                    continue  # a code in capitals is looked up as it is
                k = len(self.forms)
                self.forms.append((tuple(words), *rank))
                for w in words:
                    self.with_word[w].add(k)
                self._keep(ordered, "".join(words), rank)
                self.letters["".join(sorted("".join(words)))].append(k)
        self.ordered = ordered
        self.longest = max(map(len, self.with_word), default=0)
        self.near: dict[str, list[str]] = defaultdict(list)
        self.cut: dict[str, list[str]] = defaultdict(list)
        for w in self.with_word:
            for x in deletions(w, allowed(w)):
                self.near[x].append(w)
            for i in range(LEAST_CUT, len(w)):
                self.cut[w[:i]].append(w)
        self.near_joined: dict[str, list[str]] = defaultdict(list)
        for w in ordered:
            for x in deletions(w, EDITS):
                self.near_joined[x].append(w)
        self.known: dict[str, dict[str, tuple[int, float]]] = {}

    @staticmethod
    def _keep(to: dict, key: str, rank: tuple[int, str]) -> None:
        if key not in to or rank < to[key]:
            to[key] = rank

    def candidates(self, word: str) -> dict[str, tuple[int, float]]:
        """Canonical words near a typed word, with edits and cost."""
        got = self.known.get(word)
        if got is None:
            if word in self.with_word:
                got = {word: (0, 0.0)}
            else:
                got = {}
                for x in deletions(word, EDITS):
                    for w in self.near.get(x, ()):
                        if w not in got and (d := distance(word, w, allowed(w))):
                            got[w] = d
                for w in self.cut.get(word, ()):
                    got[w] = min(got.get(w, (9, 9.0)), (1, 0.5))
            if len(self.known) < 200_000:  # a cache only
                self.known[word] = got
        return got

    def segmented(self, text: str) -> bool:
        """Whether a run-together text is made of canonical words throughout."""
        reach = [True] + [False] * len(text)
        for e in range(1, len(text) + 1):
            reach[e] = any(reach[s] and text[s:e] in self.with_word for s in range(max(0, e - self.longest), e))
        return reach[-1]

    def shuffled(self, text: str) -> tuple[int, str] | None:
        """(-support, id) of the best entry whose words, in any order, make up a run-together text."""
        found = (self.forms[k] for k in self.letters.get("".join(sorted(text)), ()))
        return min(((f[1], f[2]) for f in found if _made_of(text, list(f[0]))), default=None)

    def match(self, label: str | None) -> tuple[float, int, str] | None:
        """(cost, -support, id) of the best entry, or None."""
        if not label:
            return None
        every = words_of(label)
        if not every:
            return None
        hit = self.joined.get("".join(every)) or self.shuffled("".join(every))
        if hit:
            return (0.0, *hit)
        words = [w for w in every if w not in FILLERS]
        if not words:
            return None
        best = self._by_words(words)
        if best is None and (rest := _SHORT_NAME.sub(" ", label)) != label:  # a short name in brackets repeats the label
            best = self.match(rest)
        if best is None and not all(map(self.candidates, words)):  # a word that is near none may be several run together
            best = self._joined(words)
        return best

    def _by_words(self, words: list[str]) -> tuple[float, int, str] | None:
        near = [self.candidates(w) for w in words]
        if not all(near):
            return None
        forms: set[int] | None = None
        for c in sorted(near, key=len):
            having = set().union(*(self.with_word[w] for w in c))
            forms = having if forms is None else forms & having
            if not forms:
                return None
        best = None
        for k in forms or ():
            target, support, ident = self.forms[k]
            if len(target) == len(words) and (cost := self._assign(near, list(target))) is not None:
                got = (cost[1], support, ident)
                best = got if best is None or got < best else best
        return best

    def _assign(self, near: list[dict], target: list[str]) -> tuple[int, float] | None:
        """Least (edits, cost) of matching the typed words to the words of an entry one to one."""
        if not near:
            return (0, 0.0)
        best = None
        for i, w in enumerate(target):
            d = near[0].get(w)
            if d is not None and w not in target[:i]:
                rest = self._assign(near[1:], target[:i] + target[i + 1 :])
                if rest is not None:
                    got = (d[0] + rest[0], d[1] + rest[1])
                    best = got if best is None or got[1] < best[1] else best
        return best

    def _joined(self, words: list[str]) -> tuple[float, int, str] | None:
        text = "".join(words)
        hit = self.joined.get(text) or self.shuffled(text)
        if hit:
            return (0.1, *hit)
        if self.segmented(text):
            return None
        best = None
        near = {w for x in deletions(text, EDITS) for w in self.near_joined.get(x, ()) if abs(len(w) - len(text)) <= EDITS}
        for w in near:
            d = distance(text, w, allowed(w))
            if d and (best is None or (d[1], *self.ordered[w]) < best):
                best = (d[1], *self.ordered[w])
        return best


def _made_of(text: str, words: list[str]) -> bool:
    """Whether a text is the given words in some order."""
    if not words:
        return not text
    return any(text.startswith(w) and _made_of(text[len(w) :], words[:i] + words[i + 1 :]) for i, w in enumerate(words) if w not in words[:i])


def _aliases(text: str | None) -> list[str]:
    try:
        got = json.loads(text) if text else []
    except ValueError:
        return []
    return [x for x in got if isinstance(x, str)] if isinstance(got, list) else []


def map_labels(labels: DataFrame, concepts: DataFrame, block_entries: int = 100_000, block_bytes: int = 16 << 20) -> DataFrame:
    """``labels`` (any columns and ``label``) with ``concept_id``, the entry each label names, or ``unmatched``."""
    spark = labels.sparkSession
    scratch = Scratch(spark, "canonical")
    out = labels.withColumn("_best", F.lit(None).cast("struct<cost:double,rank:bigint,id:string>"))
    block: list = []
    blocks = size = 0

    def add(df: DataFrame, entries: list) -> DataFrame:
        held, name = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

        @F.pandas_udf("struct<cost:double,rank:bigint,id:string>")
        def look(col):
            import pandas as pd

            index = _dictionary(name, held)
            seen: dict = {}
            rows = []
            for x in col:
                if x not in seen:
                    seen[x] = index.match(x)
                rows.append(seen[x] or (None, None, None))
            return pd.DataFrame(rows, columns=["cost", "rank", "id"]).astype({"rank": "Int64"})

        found = look(F.col("label"))
        df = df.withColumn("_new", found).withColumn("_new", F.when(F.col("_new.id").isNotNull(), F.col("_new")))
        return df.withColumn("_best", F.coalesce(F.least("_best", "_new"), "_best", "_new")).drop("_new")

    for r in concepts.where("concept_id is not null").select("concept_id", "preferred_label", "aliases_json", "instance_support").toLocalIterator():
        if block and (len(block) >= block_entries or size >= block_bytes):
            out = scratch.write(add(out, block), f"block-{blocks}")
            if blocks:
                scratch.drop(f"block-{blocks - 1}")
            block, blocks, size = [], blocks + 1, 0
        block.append((r[0], r[1], _aliases(r[2]), r[3]))
        size += len(r[1] or "") + len(r[2] or "")
    if block or not blocks:
        out = add(out, block)
    return out.withColumn("concept_id", F.coalesce("_best.id", F.lit(UNMATCHED))).drop("_best")


_BUILT: dict[str, Dictionary] = {}


def _dictionary(name: str, held) -> Dictionary:
    """The dictionary of a broadcast block, built once per worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Dictionary(held.value)
    return _BUILT[name]


def unresolved_labels(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(custom_id, node_id, label): one row per key without concept; the node's own label stands in for a null one.

    Of several labels of one key the smallest counts.  Only keys without a label are joined with ``nodes``.
    """
    keys = mappings.where("concept_id is null or concept_id = ''").groupBy("custom_id", "node_id").agg(F.min("normalized_label").alias("label"))
    own = nodes.where("label is not null").groupBy("custom_id", "node_id").agg(F.min("label").alias("own"))
    bare = keys.where("label is null").drop("label").join(own, ["custom_id", "node_id"], "left").select("custom_id", "node_id", F.col("own").alias("label"))
    return keys.where("label is not null").unionByName(bare)

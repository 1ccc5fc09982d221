"""Template residue, filler and error-page text by a trained linear classifier (problem 3).

Method.  A text is read in overlapping windows, so that residue inside a real abstract counts as much as a page that is nothing else.  A
window's features are hashed character n-grams (folded text, and its shape of letters, digits and signs), the length of the whole text and
how many words of the work's title it uses.  Weak labels come from the stored response status and from a short list of generic phrases: windows of
texts whose status calls them a placeholder, and windows that hold a phrase, are positive; all other windows are negative.  Both are noisy: the status is
missing for many cases and wrong for some real texts, the phrases name few kinds.  A logistic regression with an L2 penalty is fitted on four fifths of
the hosts.  A first fit on a sample finds the windows near or beyond its border; among these, two fits, each on half of the works, judge the labels of the other
half: flagged windows whose like is rarely flagged are dropped, unflagged ones whose like often is are dropped or, where that is sure, turned.  The rest, with the real
windows far from the border, makes the model.

The threshold comes from the unseen fifth of the hosts.  Among cases a share ``a`` of texts is flagged, among real texts a share ``b``; ``a`` is read off
the texts with a phrase, ``b`` off the low-scoring half, and with both the number of cases above any score follows from the number of flagged texts there, though
nobody labelled them.  Of the thresholds within a standard error of the best F1 so estimated, the one nearest to even odds is taken.  Every text is then scored as a whole, window by window.

The fit sees about ``sample_texts`` texts of each status, those of the smallest hash, and of their windows at most ``sample_windows`` of each label, so it is bounded and the
same on every run; everything else (scores, threshold, use of the threshold) covers all rows.  Null and blank texts are no case.  Of several rows of one work
each is judged; one case makes the work a case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import topn_per_key

BITS = 18
WINDOW, STRIDE = 64, 16
TEXT_GRAMS, SHAPE_GRAMS = (3, 4, 5), (3, 5)
_DIGIT, _SPACE = re.compile(r"\d"), re.compile(r"\s")
STRETCH = 200_000
#: A window whose like is flagged at better odds than this is taken for residue when labels are cleaned.
FLAG_ODDS = 0.25
#: A window without flag whose like is flagged at odds exp(SURE) times as good counts as residue.
SURE = 2.0

# Generic phrases by family, as (what every hit contains, pattern), over lower-cased text.
FAMILIES = {
    "marker": [("{{", r"\{\{\s*[\w.]+\s*\}\}"), ("${", r"\$\{[a-z_][\w.]+\}"), ("<%", r"<%=?\s*[\w.]+\s*%>"), ("{%", r"\{%\s*[\w.]+\s*%\}"), ("[[", r"\[\[\s*[\w.]+\s*\]\]"), ("<!--", r"<!--.{1,60}?-->")],
    "filler": [("lorem ipsum", r"lorem ipsum"), ("text here", r"your text here"), ("replace this text", r"replace this text"), ("goes here", r"\b(?:abstract|text) goes here"), ("click to add", r"click to add"), ("type your", r"\btype your (?:abstract|text)"), ("todo:", r"todo:")],
    "error": [("error ", r"\berror [45]\d\d\b"), ("page not found", r"page not found"), ("http/", r"http/\d\.\d [45]\d\d"), ("traceback (", r"traceback \(most recent"), ("unexpected error", r"an unexpected error has occurred"), ("went wrong", r"something went wrong"), ("undefined variable", r"undefined variable"), ("timed out", r"connection timed out"), ("could not be", r"could not be (?:loaded|displayed)"), ("longer exists", r"no longer exists"), ("database connection", r"error establishing a database connection")],
    "access": [("javascript", r"(?:enable javascript|javascript is disabled)"), ("scripts", r"(?:enable scripts|turn on scripts|scripts to be turned on)"), ("use cookies", r"we use cookies"), ("has expired", r"session has expired"), ("are human", r"you are human"), ("permission to", r"do(?:es)? not have permission to"), ("browser before", r"checking your browser")],
    "other languages": [("nicht gefunden", r"seite nicht gefunden"), ("introuvable", r"page introuvable"), ("no encontrada", r"p[áa]gina no encontrada"), ("не найдена", r"страница не найдена"), ("页面", r"页面不存在"), ("javascript", r"(?:aktivieren sie javascript|activer javascript|habilite javascript|включите javascript|请启用 ?javascript)")],
    "stand-in": [("abstract", r"(?:no abstract (?:is )?available|abstract (?:is )?not (?:available|supplied|provided))"), ("to be completed", r"to be completed by the author")],
}
# Whole texts that stand in for an absent one.
STAND_INS = frozenset(["n/a", "n.a", "na", "tba", "tbd", "none", "null", "nan", "undefined", "no abstract", "not available", "to be added", "to be announced", "string", "object object", "#ref", "#value", "#name"])
_EDGES = " \t\r\n.,;:!?()[]<>-_*\"'"
_PATTERNS = {k: [(n, re.compile(p, re.S)) for n, p in v] for k, v in FAMILIES.items()}


def lowered(text: str) -> str:
    """The text in lower case, of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] or c for c in text)  # a few capitals fold to two signs


def repeats(low: str) -> bool:
    """Whether a text is nothing but one to three words said over and over."""
    words = [w.strip(_EDGES) for w in low.split()]
    return any(len(words) >= 3 * p - (p == 1) and words[p:] == words[:-p] for p in (1, 2, 3))


def phrases(text: str, without: frozenset = frozenset()) -> list[tuple[int, int]]:
    """Spans of the generic phrases in a text, those of the families ``without`` left out."""
    low = lowered(text)
    out = [m.span() for k, v in _PATTERNS.items() if k not in without for n, p in v if n in low for m in p.finditer(low)]
    if ("stand-in" not in without and low.strip(_EDGES) in STAND_INS) or ("filler" not in without and repeats(low)):
        out.append((0, len(text)))
    return sorted(out)


def fold(text: str) -> tuple[str, str]:
    """The folded text (lower case, digits as 0, white space as one blank each) and the text itself, of equal length."""
    low = lowered(text)
    return _SPACE.sub(" ", _DIGIT.sub("0", low)), text


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def grams(points: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashed n-grams, one per position."""
    m = len(points)
    h = np.full(m, salt * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for i in range(n):
        part = points[i:]
        h[: len(part)] = (h[: len(part)] ^ (part + np.uint64(i + 1))) * np.uint64(0x100000001B3)
        h[: len(part)] ^= h[: len(part)] >> np.uint64(29)
    return (h >> np.uint64(64 - BITS - 8) & np.uint64(2**BITS - 1)).astype(np.int32)


def positions_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Features of each text: one row per channel, one column per sign.  Texts are hashed in one stretch, each followed by end signs."""
    folded, plain = zip(*(fold(t) for t in texts), strict=True) if texts else ((), ())
    gap = "\0" * (max(TEXT_GRAMS + SHAPE_GRAMS) - 1)
    points, raw = points_of("".join(t + gap for t in folded)), points_of("".join(t + gap for t in plain))
    shape = raw.copy()
    upper, lower, digit = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    shape[upper], shape[lower], shape[digit], shape[raw > 127] = 65, 97, 48, 128
    every = np.stack([grams(points, n, n) for n in TEXT_GRAMS] + [grams(shape, n, 10 + n) for n in SHAPE_GRAMS])
    at = 0
    for t in plain:
        yield every[:, at : at + len(t)]
        at += len(t) + len(gap)


def positions(text: str) -> np.ndarray:
    return next(positions_of([text]))


def about(text: str, title: str | None) -> tuple[int, int]:
    """Number of words of a text, and how many quarters of the title's words it uses (-1: no title)."""
    words = text.split()
    named = {w.strip(".,;:").lower() for w in (title or "").split() if len(w) > 3}
    if not named:
        return len(words), -1
    return len(words), min(3, 4 * len(named & {w.strip(".,;:").lower() for w in words}) // len(named))


def context(words: int, shared: int) -> list[int]:
    """Features of the text as a whole: its length, and its use of the title."""
    return [hash_of(f"len{min(9, words.bit_length())}"), hash_of(f"few{min(words, 8)}"), hash_of(f"title{shared}")]


def hash_of(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h % 2**BITS


def starts(length: int) -> list[int]:
    return [0] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def window_scores(features: np.ndarray, s: np.ndarray, ctx: list[int], weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of the windows that start at ``s``, from the features of the text's positions and of the text as a whole."""
    total = np.concatenate([[0.0], np.cumsum(weights[features].sum(axis=0, dtype=np.float64))])
    e = np.minimum(s + WINDOW, features.shape[1])
    return bias + weights[ctx].sum() + (total[e] - total[s]) / np.sqrt(np.maximum(5 * (e - s), 1))


def scores(texts: list[str], titles: list, weights: np.ndarray, bias: float) -> list[float]:
    """Largest window score of each text."""
    out: list[float] = []
    at = 0
    while at < len(texts):
        part, size = at, 0
        while at < len(texts) and (at == part or size + len(texts[at]) <= STRETCH):  # bounded memory, whatever the texts
            size += len(texts[at])
            at += 1
        for text, title, features in zip(texts[part:at], titles[part:at], positions_of(texts[part:at]), strict=True):
            out.append(float(window_scores(features, np.array(starts(len(text))), context(*about(text, title)), weights, bias).max()))
    return out


def padded(rows: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, scale) of (window features, context features): one line each, padded with an extra feature; window features weigh 1 / sqrt of their number."""
    width = 5 * WINDOW
    x = np.full((len(rows), width + 3), 2**BITS, dtype=np.int32)
    scale = np.ones((len(rows), 1), dtype=np.float32)
    for i, (window, ctx) in enumerate(rows):
        x[i, : len(window)], x[i, width:] = window, ctx
        scale[i] = 1 / np.sqrt(max(len(window), 1))
    return x, scale


def margins(x: np.ndarray, scale: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    g = w[x]
    return g[:, :-3].sum(axis=1) * scale[:, 0] + g[:, -3:].sum(axis=1) + bias


def fit(x: np.ndarray, scale: np.ndarray, y: np.ndarray, balanced: bool = True, l2: float = 1e-6, rate: float = 0.3, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by AdaGrad; ``balanced``: both labels weigh alike.  The last weight is that of the padding, 0."""
    w, g2 = np.zeros(2**BITS + 1, dtype=np.float32), np.full(2**BITS + 1, 1e-6, dtype=np.float32)
    weight_of = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced and len(y) else np.ones(len(y))
    bias, bias2 = 0.0, 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs if len(y) else 0):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
            z = margins(x[part], scale[part], w, bias)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight_of[part] / len(part)).astype(np.float32)
            grad = np.bincount(x[part].ravel(), (err[:, None] * np.concatenate([np.repeat(scale[part], x.shape[1] - 3, axis=1), np.ones((len(part), 3), dtype=np.float32)], axis=1)).ravel(), minlength=len(w)).astype(np.float32) + l2 * w
            g2 += grad**2
            w -= rate * grad / np.sqrt(g2)
            w[-1] = 0
            bias2 += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(bias2)
    return w, float(bias)


def fit_noisy(x: np.ndarray, scale: np.ndarray, label: np.ndarray, fold: np.ndarray, cut: float) -> tuple[np.ndarray, float]:
    """The fit without labels that a fit on other texts contradicts.  label: 0 no flag, 1 flagged, 2 holds a phrase, -1 surely real (the last two kept as they are); fold: 0 or 1, by work."""
    y = (label > 0).astype(int)
    keep = np.ones(len(y), dtype=bool)
    for f in (0, 1):
        own, other = fold == f, fold != f
        if len(set(y[other])) == 2:
            z = margins(x[own], scale[own], *fit(x[other], scale[other], y[other], balanced=False))
            keep[own] = (label[own] == 2) | (label[own] == -1) | ((z >= cut) == (label[own] == 1)) | (z >= cut + SURE)
            y[own] |= (label[own] == 0) & (z >= cut + SURE)
    return fit(x[keep], scale[keep], y[keep])


def best_threshold(hist: pd.DataFrame, step: float) -> tuple[float, float, float]:
    """(threshold, precision, recall) from texts counted by score bin ``k``, with ``flagged`` and ``seeded`` (texts with a phrase) among them.

    Precision and recall are estimates from two noisy labels, see the module's text.  Where the flag says nothing, phrases alone count.
    """
    h = hist.groupby("k", as_index=False)[["n", "flagged", "seeded", "both"]].sum().sort_values("k", ascending=False)
    if not len(h):
        return 0.0, 0.0, 0.0
    n, flagged, seeded = (h[c].to_numpy().astype(float).cumsum() for c in ("n", "flagged", "seeded"))
    low = n > n[-1] / 2
    b = (flagged[-1] - flagged[~low].max(initial=0.0)) / max(n[-1] - n[~low].max(initial=0.0), 1.0)
    a = h["both"].sum() / max(1.0, h["seeded"].sum())
    cases = np.clip((flagged - b * n) / (a - b), seeded, n) if a - b > 0.1 else seeded
    cases = np.maximum.accumulate(cases)
    precision, recall = cases / np.maximum(n, 1), cases / max(cases[-1], 1e-9)
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-9)
    error = np.sqrt(f1.max() * max(1 - f1.max(), 0.01) / max(cases[-1], 1.0))
    near = np.flatnonzero(f1 >= f1.max() - error)
    i = near[np.argmin(np.abs(h["k"].to_numpy()[near]))]
    return float(h["k"].to_numpy()[i] * step), float(precision[i]), float(recall[i])


def residue_scores(abstracts: DataFrame, works: DataFrame, sample_texts: int = 40_000, sample_windows: int = 12_000, unseen_share: int = 5, without: frozenset = frozenset()) -> tuple[DataFrame, dict]:
    """(work_id, host, score, is_case, seeded, withheld, unseen) of every text, and the report of the fit: windows, threshold, precision and recall on unseen hosts.

    ``without`` withholds families of phrases from the labels and the threshold; ``withheld`` marks the texts that hold one of them and no other phrase.
    If the training hosts hold no window of one label, the windows of all hosts teach; every text is scored all the same, but precision and
    recall are null then, as no host is unseen.  Where all texts are labelled alike, all are judged alike.
    """
    spark = abstracts.sparkSession
    scratch = Scratch(spark, "residue")
    named = works.where("work_id is not null").groupBy("work_id").agg(F.min("display_name").alias("title"), F.min("source_id").alias("host"))
    texts = abstracts.where("trim(abstract_text) <> ''").select("work_id", F.col("abstract_text").alias("text"), (F.coalesce("abstract_is_placeholder", F.lit(0)) == 1).alias("flagged"))
    bare = texts.where("work_id is null").withColumns({"title": F.lit(None).cast("string"), "host": F.lit(None).cast("string")})  # rows that match no work are no key to join on
    texts = texts.where("work_id is not null").join(named, "work_id", "left").unionByName(bare)
    texts = scratch.write(texts.withColumn("unseen", F.pmod(F.xxhash64(F.coalesce("host", F.lit(""))), F.lit(unseen_share)) == 0), "texts")
    reach = max(TEXT_GRAMS + SHAPE_GRAMS) - 1  # signs beyond a window that its n-grams touch

    def label(batches: Iterator[pd.DataFrame], first=None) -> Iterator[pd.DataFrame]:
        """Labelled windows; with a first model and a margin, only those that it scores above the margin."""
        for b in batches:
            rows = []
            for work, text, title, flagged in zip(b["work"], b["text"], b["title"], b["flagged"], strict=True):
                spans = phrases(text, without)
                words, shared = about(text, title)
                at = np.array(starts(len(text)))
                if first is not None:
                    at = at[window_scores(positions(text), at, context(words, shared), *first.value[:2]) >= first.value[2]]
                for s in at.tolist():
                    e = min(s + WINDOW, len(text))
                    held = any(min(e, y) - max(s, x) >= 0.9 * min(y - x, WINDOW) for x, y in spans)
                    if held or flagged or not spans:
                        rows.append((text[s : e + reach], e - s, words, shared, flagged, held, work + s, work % 2))
            yield pd.DataFrame(rows, columns=["window", "width", "words", "shared", "flagged", "held", "at", "fold"])

    def sample(hosts: DataFrame, first=None) -> tuple[list, float]:
        """Labelled windows (0: no flag, 1: flagged, 2: with a phrase), and how much likelier a flagged one was to be drawn than one without flag."""
        held = {r["flagged"]: r["n"] for r in hosts.groupBy("flagged").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = {k: min(1.0, sample_texts / max(1, held.get(k, 0))) for k in (False, True)}
        draw = F.pmod(F.xxhash64("text", "work_id", F.lit(3)), F.lit(2**30)) / 2**30
        few = hosts.where(draw < F.when(F.col("flagged"), F.lit(share[True])).otherwise(F.lit(share[False])))
        windows = few.select(F.pmod(F.xxhash64("work_id"), F.lit(2**40)).alias("work"), "text", "title", "flagged").mapInPandas(lambda batches: label(batches, first), "window string, width int, words int, shared int, flagged boolean, held boolean, at long, fold int")
        # the windows of the smallest hash: bounded, the same on every run
        labelled = windows.select(F.xxhash64("window", "at").alias("h"), "fold", F.struct("window", "width", "words", "shared").alias("w"), F.when(F.col("held"), 2).when(F.col("flagged"), 1).otherwise(0).alias("label"))
        rows = topn_per_key(labelled, ["label"], [F.asc("h"), F.asc("w")], sample_windows).orderBy("label", "h", "w").collect()
        drawn = {}
        for k in (0, 1):
            h = [r["h"] for r in rows if r["label"] == k]
            drawn[k] = share[k == 1] * ((max(h) + 2.0**63) / 2.0**64 if len(h) >= sample_windows else 1.0)
        return rows, drawn[1] / drawn[0]

    def features(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, scale = padded([(f[:, : r["w"]["width"]].ravel(), context(r["w"]["words"], r["w"]["shared"])) for r, f in zip(rows, positions_of([r["w"]["window"] for r in rows]), strict=True)])
        return x, scale, *(np.array([r[c] for r in rows], dtype=int) for c in ("label", "fold"))

    hosts = texts.where(~F.col("unseen"))
    taken, odds = sample(hosts)
    held_out = len({r["label"] > 0 for r in taken}) == 2
    if not held_out:  # windows of one label only on the training hosts: all hosts teach
        hosts = texts
        taken, odds = sample(hosts)
    x, scale, marks, fold = features(taken)
    weights, bias = fit(x, scale, (marks > 0).astype(int), balanced=False)
    if len(set(marks > 0)) == 2:
        margin = float(np.log(FLAG_ODDS * odds)) - 2
        far = (marks == 0) & (margins(x, scale, weights, bias) < margin)
        near, odds = sample(hosts, spark.sparkContext.broadcast((weights[:-1], bias, margin)))
        x2, scale2, marks2, fold2 = features(near)
        keep = far | (marks == 2)
        marks[far] = -1
        weights, bias = fit_noisy(np.concatenate([x[keep], x2]), np.concatenate([scale[keep], scale2]), np.concatenate([marks[keep], marks2]), np.concatenate([fold[keep], fold2]), float(np.log(FLAG_ODDS * odds)))
        taken = taken + near
    model = spark.sparkContext.broadcast((weights[:-1], bias))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts_ = c["text"].to_pylist()
            got = scores(texts_, c["title"].to_pylist(), w, b0)
            seeded = [bool(phrases(t, without)) for t in texts_]
            withheld = [bool(without) and not s and bool(phrases(t)) for t, s in zip(texts_, seeded, strict=True)]
            yield pa.RecordBatch.from_arrays([c["work_id"], c["host"], c["unseen"], c["flagged"], pa.array(seeded, pa.bool_()), pa.array(withheld, pa.bool_()), pa.array(got, pa.float64())], ["work_id", "host", "unseen", "flagged", "seeded", "withheld", "score"])

    judged = scratch.write(texts.mapInArrow(judge, "work_id string, host string, unseen boolean, flagged boolean, seeded boolean, withheld boolean, score double"), "judged")
    # the threshold from a histogram of the unseen hosts' scores: bounded, whatever the number of texts
    step = 1 / 20
    k = F.floor(F.least(F.greatest(F.col("score"), F.lit(-50.0)), F.lit(50.0)) / step).alias("k")
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    hist = judged.where("unseen" if held_out else "true").groupBy(k).agg(F.count(F.lit(1)).alias("n"), count("flagged").alias("flagged"), count("seeded").alias("seeded"), count("seeded and flagged").alias("both")).toPandas()
    threshold, precision, recall = best_threshold(hist, step) if held_out else (0.0, None, None)
    out = judged.select("work_id", "host", "score", (F.col("score") >= F.lit(threshold)).alias("is_case"), "seeded", "withheld", "unseen")
    return out, {"windows": len(taken), "threshold": threshold, "precision": precision, "recall": recall}


def residue(abstracts: DataFrame, works: DataFrame, **options) -> DataFrame:
    """(work_id) of the works whose abstract, or part of it, is residue."""
    scored, _ = residue_scores(abstracts, works, **options)
    return scored.where("is_case and work_id is not null").select("work_id").distinct()

"""Sentence units of texts in any language or script (problem 9).

Method.  Blank lines part a text into blocks; numbered headings and list entries are one unit each.  In a block, quotation marks and
brackets are paired first.  Spaced scripts go through a *terminator lattice*: every run of terminators, with the closing marks it
takes along, is a possible end, and it is kept or dropped by what stands before (abbreviations, initials, ordinals, numbers), around (an open
quotation or bracket inside a longer sentence) and after (lower case continues).  Spaceless scripts are segmented by a *word
lattice*: the span before a gap and the span after it, whole, each take their cheapest path through a dictionary (the words of a public vocabulary
in that script, and function words).  A gap inclines one way by its kind (a Thai blank parts sentences, a Thai line break and a closed quotation do not); a final
particle before it and an opening word after it speak for an end, a particle or conjunction on either side against it.  Every Thai blank and line break and every
closed quotation in Chinese and Japanese is decided so.

Offsets are code points from 0, end exclusive.  The units cover everything but white space.  Null and blank texts have no units; a text
is cut by what it is, not by its language tag, which may be missing or wrong.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A public vocabulary for many languages; its words in spaceless scripts are the dictionary of the lattices.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLANK_LINE = re.compile(r"(?:\r\n?|\n| )[^\S\r\n]*(?:\r\n?|\n| )\s*| \s*")
END = re.compile("[.!?…。！？｡؟۔।॥‼⁇⁈]+")
#: Terminators that need no white space after them.
SELF_SPACED = frozenset("。！？｡।॥۔؟‼⁇⁈")
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", "„": "“", "‹": "›", "‚": "‘"}
MARKS = re.compile("[()\\[\\]{}«»“”„\"「」『』（）【】《》〈〉［］‹›]")
OPENING = frozenset("([{«“„\"「『（【《〈［¿¡‹'‘‚”")
CLOSING = frozenset(")]}»”“\"」』）】》〉］›’")
LIST_ENTRY = re.compile(r"(?:\(?\d{1,3}[.)]|(?:\d{1,3}\.)+\d{0,3}\.?|\(?[A-Za-z][.)]|[A-Z]\.\d+(?:\.\d+)*\.?|\(?[ivxIVX]{1,5}[.)]|[-*•–—·▪◦])\s+\S")
THAI = "฀-๿"
THAI_GAP = re.compile(f"(?<=[{THAI}])\\s+(?=\\S)|(?<=\\S)\\s+(?=[{THAI}])")
CJK = re.compile("[々-ヿ㐀-鿿豈-﫿]")

# Abbreviations that always go on.
GOES_ON = frozenset(
    "e.g i.e cf vs viz approx ca c resp incl excl esp al ibid ed eds trans dept est"
    " dr prof mr mrs ms st sr sra jr messrs rev hon gen col capt lt sgt"
    " z.b d.h u.a i.d.r bzw vgl ggf evtl sog inkl exkl zzgl abzgl max min insb mind etw zb dh"
    " env p.ex ex c.-à-d mme mlle mm"
    " aprox ej p.ej dn ud uds"
    " т.е т.к т.н им ул рис табл гл стр см ср напр тыс млн млрд пп"
    " रु डॉ श्री".split()
)
# Abbreviations that go on before a number or a bracket.
NUMBERED = frozenset("no nos nr fig figs tab tabs eq eqs sec secs sect ch chap vol vols p pp art arts par n nn ref refs app abschn abb kap s bd hrsg éq pág págs núm cap fasc №".split())
# Abbreviations that may also end a sentence.
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec okt dez janv févr avr juil déc ene abr ago dic".split())
# What follows a German ordinal.
ORDINAL_NOUNS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrtausend quartal auflage kapitel januars klasse band tag mal platz rang stock etage woche monat jahr hälfte".split())
# What stands before a German ordinal.
ORDINAL_LEADS = frozenset("am im vom zum zur beim der die das dem den des bis ab seit dieser dieses jeder".split())

# Words that a letter names, so that the letter is no initial.
LETTERED = frozenset("panel plan class type group table figure model part appendix option case column row step phase series grade vitamin".split())

# Function words of the spaceless scripts, by what they do at a gap.
#: Words that carry a sentence on: particles, conjunctions, prepositions.
CARRY = {
    "zh": "的 地 得 并 并且 而 而后 随后 然后 接着 之后 后 来 等 这样 一样 一词 一语 似的 就 便 才 说 道 写道 问道 答道 表示 指出 称 为由".split(),
    "ja": "と って という といった との とも とは とか とする として は が を に で も の から まで へ や など だけ ばかり について".split(),
    "th": "และ หรือ ที่ ซึ่ง โดย ของ ใน เพื่อ กับ แก่ จาก ต่อ ว่า เป็น คือ ได้แก่ เช่น ถึง ตาม อัน".split(),
}
#: Words that open a sentence: pronouns, demonstratives, question words, connectors.
OPEN = {
    "zh": "我 我们 你 你们 他 她 它 他们 她们 这 这些 那 那些 该 此 其 本文 因此 所以 然而 但 但是 不过 可是 此外 另外 同时 首先 其次 再次 最后 总之 例如 比如 如果 虽然 尽管 由于 为了 随着 根据 为什么 为何 怎么 结果 对于 关于".split(),
    "ja": "したがって しかし だが また さらに なお そして それ それで そこで これ この その あの ここ 本稿 我々 私 私たち 彼 彼女 なぜ どう いつ もし たとえば 例えば まず 次に 最後に つまり すなわち ただし 一方 ところが".split(),
    "th": "เหตุใด ทำไม ดังนั้น อย่างไรก็ตาม นอกจากนี้ แต่ เมื่อ หาก ถ้า เพราะ เรา ผม ฉัน เขา เธอ มัน นี่ นั่น อย่างไร ต่อมา สุดท้าย ใคร อะไร".split(),
}
#: Words that end a sentence: final particles and endings.
FINAL = {"zh": "吗 呢 吧 啊 呀 啦 嘛 哦 了".split(), "ja": "か ね よ わ さ ぞ です ます でした ました だ である た ない".split(), "th": "ครับ ค่ะ คะ นะ แล้ว ด้วย เลย จ้ะ สิ หรอก มั้ย ไหม เถอะ".split()}
#: Inclination of a gap to be an end before any word is looked at: a Thai blank parts sentences, a Thai line break or a closed quotation does not.
PRIOR = {"blank": 3.0, "break": -1.0, "quotation": -1.0}
BEFORE, AFTER = {"final": 2.0, "carry": -2.0}, {"open": 2.0, "carry": -2.0}
_SPACELESS = {"zh": re.compile("[々㐀-鿿豈-﫿]+"), "ja": re.compile("[々-ヿ㐀-鿿豈-﫿]+"), "th": re.compile(f"[{THAI}]+")}


class WordLattice:
    """Cheapest path through the dictionary words that match a span; single signs are the costly way out."""

    def __init__(self, cost: dict[str, float]):
        self.cost = cost
        self.longest = max(map(len, cost), default=1)

    def path(self, span: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]  # cost, start of the last word
        for e in range(1, len(span) + 1):
            options = [(best[e - 1][0] + 24.0, e - 1)]
            for s in range(max(0, e - self.longest), e):
                c = self.cost.get(span[s:e])
                if c is not None:
                    options.append((best[s][0] + c, s))
            best.append(min(options))
        out, e = [], len(span)
        while e:
            s = best[e][1]
            out.append(span[s:e])
            e = s
        return out[::-1]


def dictionaries(vocabulary: str = VOCABULARY) -> dict[str, dict[str, float]]:
    """Words with their costs, for each spaceless script: the entries of a public vocabulary in that script, the dearer the later they come, and the function words."""
    out: dict[str, dict[str, float]] = {k: {} for k in _SPACELESS}
    with open(vocabulary, "rb") as f:
        for rank, line in enumerate(f):
            try:
                word = base64.b64decode(line.split()[0]).decode().strip()
            except (ValueError, IndexError):  # part of a sign, or an empty line
                continue
            for k, signs in _SPACELESS.items():
                if signs.fullmatch(word):
                    out[k].setdefault(word, 3 + math.log2(rank + 2))
    for k, words in out.items():
        for w in CARRY[k] + OPEN[k] + FINAL[k]:
            words[w] = 7.0 + (len(w) == 1)
    return out


class Gaps:
    """Classifier of the gaps of spaceless scripts: what the lattice words beside a gap do, over the whole spans up to the next marks or blanks."""

    def __init__(self, words: dict[str, dict[str, float]]):
        self.lattices = {k: WordLattice(c) for k, c in words.items()}
        self.does = {k: {w: "carry" for w in CARRY[k]} for k in words}
        self.opens, self.finals = ({k: frozenset(x[k]) for k in words} for x in (OPEN, FINAL))

    def is_end(self, kind: str, gap: str, before: str, after: str) -> bool:
        """Whether a sentence ends at a gap between two spans of a script."""
        score = PRIOR[gap]
        if before:
            last = self.lattices[kind].path(before)[-1]
            score += BEFORE["final"] if last in self.finals[kind] else BEFORE["carry"] if gap != "quotation" and last in self.does[kind] else 0.0
            score -= 1.0 if gap == "quotation" and last in self.finals[kind] else 0.0  # what is quoted ends there anyway: half as telling
        if after:
            first = self.lattices[kind].path(after)[0]
            score += AFTER["open"] if first in self.opens[kind] else AFTER["carry"] if first in self.does[kind] else 0.0
        return score > 0


@functools.cache
def default_gaps() -> Gaps:
    return Gaps(dictionaries())


def span_before(text: str, start: int, end: int, kind: str) -> str:
    """The signs of a script that end at ``end``, marks and blanks in between skipped once."""
    e = end
    while e > start and not _SPACELESS[kind].match(text[e - 1]):
        e -= 1
    s = e
    while s > start and _SPACELESS[kind].match(text[s - 1]):
        s -= 1
    return text[s:e]


def span_after(text: str, at: int, kind: str) -> str:
    m = _SPACELESS[kind].match(text, at)
    return m.group() if m else ""


def script(c: str) -> str:
    """A coarse script of one sign."""
    o = ord(c)
    if 0x0E00 <= o <= 0x0E7F:
        return "th"
    if 0x3040 <= o <= 0x30FF:
        return "ja"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or o == 0x3005:
        return "han"
    if 0x0900 <= o <= 0x097F:
        return "hi"
    if 0x0600 <= o <= 0x06FF or 0x0750 <= o <= 0x077F:
        return "ar"
    return "cased" if c.lower() != c.upper() else "other"


def pair_marks(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets as (open, close) positions; marks without partner are left out."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in MARKS.finditer(text):
        i, c = m.start(), m.group()
        closes = False
        if c == '"':
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < len(text) else " "
            is_open = any(x == '"' for x, _ in stack)
            opens = (before.isspace() or before in OPENING) and not after.isspace()
            closes = is_open and not (opens and not (before in ".!?…" or not before.isspace()))
            want = '"'
        else:
            closes = any(PAIRS.get(x) == c for x, _ in stack)
            want = c
        if closes:
            k = next((j for j in range(len(stack) - 1, -1, -1) if (PAIRS.get(stack[j][0]) or stack[j][0]) == want), None)
            if k is not None:
                out.append((stack[k][1], i))
                del stack[k:]
                continue
        if c == '"' or c in PAIRS:
            stack.append((c, i))
    out.sort()
    return out


def word_before(text: str, i: int) -> str:
    """The word before position ``i`` and the white space there."""
    e = i
    while e and text[e - 1].isspace():
        e -= 1
    s = e
    while s and (text[s - 1].isalnum() or text[s - 1] == "_"):
        s -= 1
    return text[s:e] if e < i else ""


def _goes_on(text: str, dot: int, k: int) -> bool:
    """Whether a single full stop at ``dot`` belongs to an abbreviation, initial or ordinal that the sentence goes on after; ``k``: next sign."""
    i = dot
    while i > 0 and not text[i - 1].isspace() and text[i - 1] not in "([{«“„\"（":
        i -= 1
    word = text[i:dot]
    if "'" in word or "’" in word:
        word = re.split("['’]", word)[-1]
    low = word.lower()
    nxt = text[k]
    if not low:
        return False
    if low in GOES_ON:
        return True
    if low in NUMBERED:
        return (nxt.isdigit() or nxt in "(.[" or nxt in "IVXivx") and not (low == "no" and word == "no")
    if low in MONTHS:
        return nxt.isdigit()
    if low == "г":
        before = text[:i].rstrip()
        return not (before and before[-1].isdigit())
    if len(low) == 1 and low.isalpha():
        return script(low) == "cased" and word_before(text, i).lower() not in LETTERED
    if low.isdigit() and len(low) <= 2 and nxt.isupper():
        after = re.match(r"\w+", text[k:])
        if after and after.group().lower() in ORDINAL_NOUNS:
            return True
        return word_before(text, i).lower() in ORDINAL_LEADS
    return False


def _opens_low(text: str, k: int) -> bool:
    """Whether the next word, past opening marks, begins in lower case (names like eGovernment do not count)."""
    n = len(text)
    while k < n and (text[k] in OPENING or text[k].isspace() or text[k] in "-–—"):
        k += 1
    if k >= n or not text[k].islower():
        return k < n and text[k] in ",;:)%"
    return not (k + 2 < n and (text[k + 1].isupper() or (text[k + 1].islower() and text[k + 2].isupper())))


def _ends(text: str, classify: Gaps) -> list[tuple[int, int]]:
    """(end, next start) of every sentence but the last of one block."""
    n = len(text)
    pairs = pair_marks(text) if MARKS.search(text) else []
    closers = {c: o for o, c in pairs}
    found: list[tuple[int, int]] = []
    start = 0  # of the sentence at hand

    def outer(s: int, e: int) -> list[tuple[int, int]]:
        return [(o, c) for o, c in pairs if o < s and c >= e]

    marks = [(m.start(), m.end()) for m in END.finditer(text)]
    gaps = [(m.start(), m.end()) for m in THAI_GAP.finditer(text)] if re.search(f"[{THAI}]", text) else []
    for s, e0, gap in sorted([(s, e, None) for s, e in marks] + [(s, s, k) for s, k in gaps], key=lambda x: (x[0], x[2] is not None)):
        if s < start:
            continue
        if gap is not None:
            if outer(s, gap):
                continue
            kind = "break" if "\n" in text[s:gap] or "\r" in text[s:gap] else "blank"
            before = span_before(text, s - 1, s, "th") and span_before(text, start, s, "th")
            if not classify.is_end("th", kind, before, span_after(text, gap, "th")):
                continue
            found.append((s, gap))
            start = gap
            continue
        e = e0
        while e < n:  # closing marks and terminators that follow belong to the sentence
            if text[e] in CLOSING and (e in closers or text[e] not in '"“'):
                e += 1
            elif text[e] in "   " and e + 1 < n and text[e + 1] == "»" and e + 1 in closers:
                e += 2
            elif e > e0 and END.match(text[e]):
                e += 1
            else:
                break
        k = e
        while k < n and text[k].isspace():
            k += 1
        if k >= n:
            break
        run, spaced = text[s:e0], k > e
        self_spaced = any(c in SELF_SPACED for c in run)
        if not spaced and not self_spaced and not (run[-1] in "!?" and s and CJK.match(text[s - 1])):
            continue
        around = outer(s, e)
        if around:  # inside: only a quotation that is a whole sentence or more may be cut
            o, c = around[0]
            whole = text[start:o].strip() == "" and len(around) == 1 and text[o] not in "([（［{"
            tail = text[max(o, c - 2) : c].strip()
            rest = c + 1
            while rest < n and text[rest].isspace():
                rest += 1
            if not (whole and tail and END.search(tail) and (rest >= n or not _opens_low(text, rest)) and (rest >= n or script(text[rest]) in ("cased", "other"))):
                continue
        if set(run) <= {"…"} and not spaced:
            continue
        if _opens_low(text, k):
            continue
        if run == "." and e == e0 and _goes_on(text, s, k):
            continue
        inner = [closers[x] for x in range(e0, e) if x in closers]
        if inner and min(inner) > start and text[start : min(inner)].strip():  # a quotation or bracket inside the sentence has just closed
            to = script(text[k])
            frm = script(next((c for c in reversed(text[start : min(inner)]) if c.isalnum()), "0"))
            if to in ("han", "ja") and frm in ("han", "ja"):
                ja = to == "ja" or frm == "ja" or bool(re.search("[぀-ヿ]", text[start:e]))
                kind = "ja" if ja else "zh"
                if not classify.is_end(kind, "quotation", span_before(text, start, e, kind), span_after(text, k, kind)):
                    continue
            elif to in ("ar", "hi", "th") and to == frm:
                continue
        found.append((e, k))
        start = k
    return found


def sentences(text: str | None, classify: Gaps | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text, in order."""
    if not text:
        return []
    classify = classify or default_gaps()
    out: list[tuple[int, int]] = []
    blocks, at = [], 0
    for m in BLANK_LINE.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for lo, hi in blocks:
        block = text[lo:hi]
        left = len(block) - len(block.lstrip())
        block = block.strip()
        if not block:
            continue
        base = lo + left
        m = LIST_ENTRY.match(block)
        if m and not (block[m.end() - 1].isupper() and re.match(r"\w+", block[m.end() - 1 :]) and re.match(r"\w+", block[m.end() - 1 :]).group().lower() in ORDINAL_NOUNS):
            out.append((base, base + len(block)))
            continue
        begin = 0
        for e, k in _ends(block, classify):
            out.append((base + begin, base + e))
            begin = k
        out.append((base + begin, base + len(block)))
    return out


def sentence_units(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start_char, end_char) of all documents; a narrow map, without any shuffle.

    ``vocabulary``: a public vocabulary (base64 entry and rank on each line), read by the driver; its words in spaceless scripts, some thousands, are broadcast.
    """
    words = documents.sparkSession.sparkContext.broadcast(dictionaries(vocabulary))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Gaps(words.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            docs, starts, ends = [], [], []
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                for s, e in sentences(text, classify):
                    docs.append(doc)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start_char long, end_char long")

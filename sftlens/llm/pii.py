"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds to them.

Base spans come from four patterns (emails, IPv4 addresses, payment cards by Luhn, phone
numbers), leftmost and non-overlapping per kind, with code-point offsets.  The CRF labels the
words of each line (Viterbi, many lines at a time in numpy) with the four kinds or none; it
is trained from the small labelled table below, which a caller can replace.  Its spans are
kept where they overlap no base span.  Word features are shapes: digit counts, separators,
checks such as Luhn, case, cue words, and the coarse shapes of both neighbours.

Edge cases: null or empty text gives no spans (sha256 of nothing, empty string); repeated rows
give equal rows; an empty table an empty result; very long lines are chains of any length.
Patterns need linear time in the text's length.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

# Labelled lines: [kind|words] marks personal data.
LABELLED = (
    "write to [email|anna.berg@mail.example.org] for details",
    "contact [email|joe_92@web.example.com], or call [phone|+1 (212) 555-0143] today",
    "und.34 schrieb an [email|kai.7@post.example.de] gestern",
    "[email|x+list@lists.example.net] replied to [email|me@home.example.net].",
    "mail me today please", "my address is long", "email the contact list", "call me at home", "call the host at the server",
    "e-mail: [email|info(at)example.com]", "e-mail [email|desk[at]example.org] now",
    "look at the dot on that page", "he was at home and at work", "meet me at noon in the com room",
    "the server [ip|10.20.30.40] is down", "from [ip|192.168.0.17]: refused", "ping [ip|8.8.4.4] twice",
    "host [ip|172.16.254.1] and host [ip|203.0.113.9], port 8080", "le [ip|97.51.17.173] ueadoos",
    "[ip|10.1.2.3]", "seen [ip|44.55.66.77] and left", "or [ip|198.51.100.23] or", "ether anon [ip|64.147.79.24] inon it",
    "[email|q.w@e.example.com]", "[card|30569309025904]", "a [card|4222222222222220] b", "[phone|+7 495 123 45 67]",
    "is at [phone|(415) 555-0101] now", "[phone|(646) 555-0155]", "was (see) there", "in (1999) and (42) of",
    "version 4.0.1 of the tool", "see section 3.2.1.4000 below", "licensed under version 2.0.", "BY-NC 4.0.",
    "card [card|4111111111111111] was charged", "pay with [card|5500 0055 5555 5559] now",
    "la carte [card|4012-8888-8888-1881] est", "number [card|378282246310005] on file", "leurre [card|6011111111111117] esllra",
    "order 1234567890123456 was sent", "tracking 9807915762804491 arrived", "id 20231231235959 logged", "at 1700000000000 ms",
    "call [phone|+44 20 7946 0958] or [phone|+49-30-901820-11]", "tel. [phone|+1 (017) 555-7713] rethsh on",
    "phone: [phone|(212) 555-0199] after six", "tel [phone|030 901820 77] bitte", "ring [phone|+33 1 70 18 99 00].",
    "my number is [phone|212-555-0123] ok", "phone [phone|555 867 5309] ask for her", "[phone|+1 (136) 555-7479] ció",
    "room 212 floor 3", "in 1999 and 2004 we met", "on 2021-05-17 at 10:30", "it cost 1,299.00 or 15 %", "pages 120-145 of 300",
    'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" here', 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" on',
    "the quick brown fox jumps over the lazy dog", "Das ist ein Haus und der Garten.", "THIS IS ALL CAPS!! OK!!",
    "la casa de los niños | una | tabla |", "the&&& words### with%%% noise$$$ after***", "a + b = c", "C++ and C# in 2020", "", "ok",
    "under the Apache License, Version 2.0.", "1. first 2. second 3. third", "GET /index.html 200 512", "30 40 50 60 70",
)

CUES = {w: f"cue_{k}" for k, ws in {
    "mail": "mail e-mail email address contact", "phone": "call tel tel. phone phone: ring number mobile fax",
    "card": "card carte visa pay charged", "ip": "ip host server ping"}.items() for w in ws.split()}

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed run of digits fails from each of its digits, so starts inside a run need no try
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
TRIM = re.compile(r"^[^\w+(\[]*(.*?)[^\w)\]]*$", re.S)


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four patterns, by start and then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in EMAIL_TAIL.finditer(text):
            i = m.start()
            while i > last and text[i - 1] in LOCAL:
                i -= 1
            if i < m.start():
                found.append((i, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def coarse(w: str) -> str:
    """Shape class of a neighbour."""
    if w.isalpha():
        return CUES.get(w.lower(), "alpha")
    core = w.strip(".,;:!?\"'#$%&*|")
    if w.lower() in CUES:
        return CUES[w.lower()]
    if not DIGIT.search(w):
        return "at" if "@" in w else "sign" if not any(map(str.isalpha, w)) else "alpha"
    if core.isdigit():
        return f"d{min(len(core), 5)}"
    if core.startswith("+"):
        return "plus"
    if core.startswith("("):
        return "paren"
    return "hyphen" if re.fullmatch(r"[0-9]+(-[0-9]+)+", core) else "mixed"


def shape(w: str) -> tuple[str, ...]:
    """Features of a word."""
    c = coarse(w)
    out = ["bias", "c_" + c]
    if w.isalpha():
        out.append("upper" if w.isupper() else "title" if w[0].isupper() else "lower")
        return tuple(out)
    core = w.strip(".,;:!?\"'#$%&*|")
    digits = sum(x in "0123456789" for x in w)
    out.append("digits_" + ("0" if not digits else "1-3" if digits < 4 else "4" if digits == 4 else "5-6" if digits < 7
                            else "7-9" if digits < 10 else "10-13" if digits < 14 else "14-19" if digits < 20 else "20"))
    if "@" in w:
        out.append("at_dotted" if EMAIL_TAIL.search(w) else "at_bare")
    if re.search(r"[(\[]at[)\]]", w.lower()):
        out.append("at_word")
    if core.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        out.append("quad" if all(len(p) < 4 and int(p) < 256 for p in core.split(".")) else "quad_bad")
    if 14 <= digits <= 19 and not any(map(str.isalpha, w)):
        out.append("luhn" if luhn("".join(x for x in w if x in "0123456789")) else "no_luhn")
    if digits and any(map(str.isalpha, core)):
        out.append("alnum")
    if re.fullmatch(r"[0-9]{3,4}-[0-9]{3,4}(-[0-9]{3,4})?", core):
        out.append("pairs")
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}", core):
        out.append("date")
    return tuple(out)


def parse_labelled(rows) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of marked lines; label 0 is none."""
    out = []
    for row in rows:
        words, labels, last = [], [], 0
        for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\])*)\]", row):
            plain = row[last:m.start()].split()
            words += plain
            labels += [0] * len(plain)
            inside = m.group(2).split()
            words += inside
            labels += [KINDS.index(m.group(1)) + 1] * len(inside)
            last = m.end()
        tail = row[last:].split()
        if last and row[last:last + 1] not in ("", " ") and tail and words:  # punctuation after a mark belongs to its word
            words[-1] += tail.pop(0)
        words += tail
        labels += [0] * len(tail)
        if words:
            out.append((words, labels))
    return out


class Tagger:
    """CRF labels for words; word shapes are memoised (bounded)."""

    MEMO = 200_000

    def __init__(self, rows=LABELLED):
        data = parse_labelled(rows)
        names = sorted({f for ws, _ in data for w in ws for f in self._all(ws)} | {"bias"})
        self.index = {f: i for i, f in enumerate(names)}
        kinds: dict[tuple, int] = {}
        chains, labels = [], []
        for words, ys in data:
            chains.append(np.array([kinds.setdefault(d, len(kinds)) for d in self._describe(words)]))
            labels.append(np.array(ys))
        feats = np.zeros((len(kinds), len(names)))
        for d, i in kinds.items():
            feats[i, [self.index[f] for f in d]] = 1
        self.chain = crf.fit(feats, crf.pad(chains), crf.pad(labels), len(KINDS) + 1)
        self.memo: dict[str, int] = {}
        self.own: list[np.ndarray] = []
        self.by_shape: dict[tuple, int] = {}
        self.around: dict[str, int] = {}
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.coarse_of: list[int] = []

    @staticmethod
    def _describe(words):
        c = ["edge", *map(coarse, words), "edge"]
        return [(*shape(w), "l_" + c[i], "r_" + c[i + 2]) for i, w in enumerate(words)]

    @classmethod
    def _all(cls, words):
        return {f for d in cls._describe(words) for f in d}

    def _weight(self, feature: str) -> np.ndarray:
        i = self.index.get(feature)
        return self.chain.weights[i] if i is not None else np.zeros(len(KINDS) + 1)

    def _around(self, c: str) -> int:
        i = self.around.get(c)
        if i is None:
            i = self.around[c] = len(self.left)
            self.left.append(self._weight("l_" + c))
            self.right.append(self._weight("r_" + c))
        return i

    def number(self, w: str) -> int:
        """Number of the word's shape."""
        i = self.memo.get(w)
        if i is None:
            s = (coarse(w), *shape(w))
            i = self.by_shape.get(s)
            if i is None:
                i = self.by_shape[s] = len(self.own)
                self.own.append(sum(self._weight(f) for f in s[1:]))
                self.coarse_of.append(self._around(s[0]))
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[w] = i
        return i

    def label(self, lines: list[list[str]]) -> np.ndarray:
        """Labels of all words of ``lines``, end to end."""
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        number = self.number
        ids = np.fromiter((number(w) for ws in lines for w in ws), np.int64, int(lengths.sum()))
        if not len(ids):
            return np.zeros(0, np.int8)
        edge = self._around("edge")
        near = np.array(self.coarse_of)[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        prev = np.concatenate([[edge], near[:-1]])
        prev[starts[lengths > 0]] = edge
        nxt = np.concatenate([near[1:], [edge]])
        nxt[ends[lengths > 0] - 1] = edge
        em = np.array(self.own)[ids] + np.array(self.left)[prev] + np.array(self.right)[nxt]
        return crf.decode(em, starts, lengths, self.chain)


def merge(text: str, base: list[tuple[int, int, str]], words: list[tuple[int, int]], labels) -> list[tuple[int, int, str]]:
    """Base spans plus the runs of labelled words that overlap none of them."""
    runs: list[list] = []
    for (s, e), y in zip(words, labels, strict=True):
        if y:
            kind = KINDS[y - 1]
            if runs and runs[-1][2] == kind and runs[-1][3] and text[runs[-1][1]:s].isspace() and "\n" not in text[runs[-1][1]:s] and kind != "email" and kind != "ip":
                runs[-1][1] = e
            else:
                runs.append([s, e, kind, True])
        elif runs:
            runs[-1][3] = False
    out = list(base)
    for s, e, kind, _ in runs:
        m = TRIM.match(text[s:e])
        s, e = s + m.start(1), s + m.end(1)
        if e > s and not any(s < b[1] and b[0] < e for b in base):
            out.append((s, e, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find(texts: list[str | None], tagger: Tagger) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) per text; the lines of a batch of texts are decoded together."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= 2_000_000:
            yield from _find(group, tagger)
            group, size = [], 0
    if group:
        yield from _find(group, tagger)


def _find(texts: list[str], tagger: Tagger) -> Iterator[tuple[list, list]]:
    lines, counts = [], []
    for t in texts:
        own = [ws for line in t.split("\n") if (ws := line.split())]
        lines += own
        counts.append(sum(map(len, own)))
    labels = tagger.label(lines)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        ys = labels[at:at + n]
        at += n
        base = base_spans(t)
        if ys.any():
            words = [m.span() for m in WORD.finditer(t)]
            yield base, merge(t, base, words, ys.tolist())
        else:
            yield base, base


def told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled=LABELLED) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as text."""
    tagger = Tagger(labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(find(b[text_col].tolist(), tagger))
            kinds = [[k for _, _, k in base] for base, _ in found]
            yield pd.DataFrame({
                id_col: b[id_col], **{f"n_{k}": np.array([x.count(k) for x in kinds], np.int64) for k in KINDS},
                "base_sha256": [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found],
                "spans": [told(every) for _, every in found]})

    kind = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", labelled=LABELLED) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; null stays null.
    Overlapping spans become one mark of the first one's kind."""
    small_batches(docs.sparkSession)
    tagger = Tagger(labelled)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in texts:
            out = []
            for t, (_, every) in zip(b, find(b.tolist(), tagger), strict=True):
                if every:
                    parts, at = [], 0
                    for s, e, k in every:
                        if s >= at:
                            parts += [t[at:s], f"[{k}]"]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))

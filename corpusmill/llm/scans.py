"""Text of scanned pages made readable: page furniture, broken words, misread characters, paragraphs.

Words that aren't in the vocabulary of the corpus are looked up in it with Levenshtein automata over a
trie, which gives all words within two edits; these are ranked by how scanners misread characters, by
their frequency, and by how often the words next to them stand beside them in the corpus. A word of the
corpus may be a misreading too, if it never stands in such a place and another word often does. Page
furniture is then removed and lines are reflowed.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter
from contextlib import contextmanager
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.automata import Trie
from corpusmill.llm.lookalikes import _LATIN_LIKE, _LIKE, prototype, script
from corpusmill.plans.lineage import written

#: A word belongs to the vocabulary if it is in at least this share of the documents, and in LEAST_DOCS.
#: With at most D distinct words a document on average, it has at most D / VOCABULARY_SHARE words.
VOCABULARY_SHARE, LEAST_DOCS = 1e-4, 3
#: Words and pairs of words at most, and their letters, which bounds the broadcast (about 100 MB).
MOST_WORDS, MOST_LETTERS = 2_000_000, 50_000_000
#: How many times more documents the word meant must be in than the misreading.
TIMES = 8
#: Weight of the context in the ranking, and documents a neighbour must be met in beside the word meant for a word of
#: the corpus that isn't TIMES rarer.
CONTEXT, LEAST_PAIR = 0.25, 3
#: Words of the vocabulary, the most common ones, that are looked up once for all workers; others each looks up itself.
#: The driver builds no trie of a vocabulary (words and their hyphenated forms) of more than ten times as many.
MOST_AHEAD = 20_000
#: Letters from which a capitalised word that recurs in its document, but isn't the corpus's, may be a misreading.
LEAST_NAME = 8

# What a scanner makes of characters, and what they are.
_MISREAD = [
    ("c", "e"), ("e", "c"), ("@", "a"), ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("q", "g"), ("g", "q"), ("9", "g"), ("6", "b"), ("b", "6"), ("li", "h"), ("h", "li"), ("\\/", "v"), ("m", "in"), ("in", "m"), ("vv", "w"),
    ("8", "b"), ("l", "i"), ("i", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("h", "b"), ("b", "h"), ("2", "z"), ("$", "s"), ("6", "é"), ("6", "ó"), ("b", "ß"), ("B", "ß"), ("q", "ç"), ("nn", "m"), ("iii", "m"), ("ni", "m"), ("€", "e"),
    ("н", "и"), ("и", "н"), ("н", "п"), ("п", "н"), ("п", "л"), ("л", "п"), ("8", "в"), ("3", "з"), ("ь1", "ы"), ("ы", "ь1"), ("6", "б"), ("0", "о"), ("4", "ч"), ("ш", "щ"), ("щ", "ш"), ("c", "е"), ("с", "е"), ("е", "с"), ("ц", "и"), ("и", "ц"), ("@", "а"), ("нi", "ш"), ("1", "г"), ("ii", "п"),
]

_PAGE_WORD = r"(?:p|pp|pg|page|seite|s|página|pagina|pág|pag|стр|с|страница|folio)\.?"
_PAGE_OF = r"(?:of|von|sur|de|di|из|/)"
_D = r"[\dlIOo|S]"
_N = rf"(?:{_D}{{1,4}}|[ivxl]{{1,7}})"
#: Lines that are a page number and nothing else, and heads or feet with a number beside a title.
_NUMBER = regex.compile(rf"^(?:(?P<plain>{_N})|(?P<sign>[\[(<{{]\s*{_N}\s*[\])>}}]|[-–—~•*·]+\s*{_N}\s*[-–—~•*·]+)|(?P<word>\p{{L}}{{1,9}}\.?\s*{_D}{{1,4}}(?:\s+\p{{L}}{{1,4}}|\s*/)\s+{_D}{{1,4}}|{_PAGE_WORD}\s*{_D}{{1,4}}))$", regex.I)
_TITLED = regex.compile(rf"^(?:(?P<a>{_N})(?:\s{{2,}}|\s*[|·•]\s*)(?P<ta>\p{{L}}.*\S)|(?P<tb>\p{{L}}.*?\S)(?:\s{{2,}}|\s*[|·•]\s*)(?P<b>{_N}))$")
_FOLD_DIGITS = str.maketrans("lI|OoS", "111005")
_ENDS = regex.compile(r"[.!?…:;,][\"»”’')\]]*$")
_STOPS = regex.compile(r"[.!?…][\"»”’')\]]*$")
#: Marks of a broken word at a line's end; only the common hyphen may be the word's own.
_MARKS = "-¬=‐\xad"
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


_LETTERLESS = re.compile(r"[\W\d_]*$")
_ROMAN = regex.compile(r"^(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")


def _number(text: str) -> int | None:
    """Value of a page number: digits, with letters read for them, or small Roman numerals."""
    n = text.translate(_FOLD_DIGITS)
    if n.isdigit():
        return int(n)
    if not _ROMAN.match(text):
        return None
    v = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


_TO_CYRILLIC = {v: k for k, v in _LIKE.items() if v in _LATIN_LIKE and "А" <= k <= "я"}


@lru_cache(maxsize=1 << 17)
def fold(word: str) -> str:
    """Lower case, composed, look-alikes of another script undone by the script of most letters; what a
    reader would see, so that only misread characters remain."""
    if word.isascii():
        return word.lower()
    word = unicodedata.normalize("NFC", word)
    cyr = sum(script(c) == "CYRILLIC" for c in word)
    if cyr * 2 <= sum(c.isalpha() for c in word):
        return unicodedata.normalize("NFC", "".join(map(prototype, word)).lower())
    return "".join(_TO_CYRILLIC.get(c, c) for c in unicodedata.normalize("NFKC", word)).lower()


def misread_cost(seen: str, meant: str, most: int = 2) -> int:
    """How many known misreadings make `seen` of `meant`; 99 if more than `most`, or other edits, are needed."""
    a, n = 0, min(len(seen), len(meant))
    while a < n and seen[a] == meant[a]:
        a += 1
    if a == len(seen) == len(meant):
        return 0
    best = 99
    if most and a < len(seen):
        for s, m in _BY_FIRST.get(seen[a], ()):
            if meant.startswith(m, a) and seen.startswith(s, a):
                best = min(best, 1 + misread_cost(seen[a + len(s) :], meant[a + len(m) :], most - 1))
    return best


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _s, _m in _MISREAD:
    _BY_FIRST.setdefault(_s[0], []).append((_s, _m))


def likeness(a: str, b: str) -> bool:
    """Whether two lines are the same but for a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 3 or len(a) < 5:
        return False
    x, y = fold(a).split(), fold(b).split()
    if len(x) != len(y):
        return False
    differ = [(p, q) for p, q in zip(x, y) if p != q]
    if len(differ) > max(1, len(x) // 2) or any(abs(len(p) - len(q)) > 3 for p, q in differ):
        return False
    return all(min(misread_cost(p, q), misread_cost(q, p)) <= 2 for p, q in differ)


def _other_form(strip: list[str], i: int, others: list[int]) -> bool:
    """Whether a number stands between other signs than those of the page numbers."""
    form = lambda s: regex.sub(r"[\p{L}\p{N}|\s]+", "", s)[:1]
    return bool(others) and form(strip[i]) not in {form(strip[k]) for k in others}


def _longest_runs(cand: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(length, candidate before or -1) of the longest run that ends in each candidate (line, number, kind), in which
    the number rises by one or two, or stays the same some lines on; the earliest of equally long ones. The best
    runs met so far are kept by number and kind, so all candidates before are looked at."""
    best, back = [1] * len(cand), [-1] * len(cand)
    met: dict[int, dict[str, tuple[list[int], list[int]]]] = {}  # number: kind: lines and candidates, each better than those before
    for b, (line, v, kind) in enumerate(cand):
        found = []
        for w in (v - 1, v - 2, v):
            for other, (at, which) in met.get(w, {}).items():
                k = len(at) if w != v else bisect_left(at, line - (1 if other != kind else 3))
                if k:
                    found.append(which[k - 1])
        if found:
            back[b] = min(found, key=lambda a: (-best[a], a))
            best[b] = best[back[b]] + 1
        at, which = met.setdefault(v, {}).setdefault(kind, ([], []))
        if not which or best[b] > best[which[-1]]:
            at.append(line)
            which.append(b)
    return best, back


def furniture(lines: list[str], title: str | None = None) -> list[bool]:
    """Which lines are running heads or feet or page numbers.

    Page numbers rise by one from page to page; lines that look like one count if they belong to the
    longest such run (or are in the form of a page number and the only one), so a lone year or a number
    of the text stays. Of the lines next to a page break, those are heads that bear the page's number,
    recur, are the title, or stand short and unfinished in the midst of a sentence."""
    n = len(lines)
    drop = [False] * n
    strip = [x.strip(" \t\r\f\xad") for x in lines]
    full = [i for i, s in enumerate(strip) if s]
    if len(full) < 2 or sum(len(strip[i]) > 8 and not _LETTERLESS.match(strip[i]) for i in full) < 2:
        return drop
    cand: list[tuple[int, int, str]] = []  # line, number, kind
    for i in full:
        s = strip[i]
        if len(s) > 120 or len(s) > 28 and "  " not in s and "|" not in s and "·" not in s and "•" not in s:
            continue  # no number alone and no title set apart from one
        if m := _NUMBER.match(s):
            kind = "plain" if m["plain"] else "sign" if m["sign"] else "word"
            digits = regex.findall(rf"(?<![^\W\d_]){_D}{{1,4}}(?![^\W\d_])", s) if kind == "word" else regex.findall(_N, s)
            if digits and (v := _number(digits[0])) is not None and (kind != "plain" or any(c.isdigit() for c in s) or s in ("l", "I", "O", "ll", "lO") or _ROMAN.match(s)):
                cand.append((i, v, kind))
        elif (m := _TITLED.match(s)) and not _STOPS.search(s):
            d = m["a"] or m["b"]
            if any(c.isdigit() for c in d) or len(d) <= 2 or _ROMAN.match(d):
                if (v := _number(d)) is not None:
                    cand.append((i, v, "titled"))
    best, back = _longest_runs(cand)
    run: set[int] = set()
    if cand:
        at = max(range(len(cand)), key=lambda k: (best[k], cand[k][2] != "plain", k))
        strong = best[at] >= 2 or cand[at][2] == "word" or cand[at][2] == "sign" and strip[cand[at][0]][0] not in "([{" or cand[at][0] == full[-1] and cand[at][1] < 1500 or cand[at][2] == "titled" and cand[at][0] == full[0]
        while strong and at >= 0:
            run.add(at)
            at = back[at]
    # a misread number in the form the pages use, and others that fit between the numbers of the run
    forms = {cand[k][2] for k in run}
    for k, (i, v, kind) in enumerate(cand):
        low = max((cand[r][1] for r in run if r < k), default=None)
        high = min((cand[r][1] for r in run if r > k), default=None)
        fits = low is not None and high is not None and low <= v <= high and (kind == "titled" or kind in forms)
        if k in run or kind in ("sign", "word") and kind in forms and (kind == "word" or fits or not _other_form(strip, i, [cand[r][0] for r in run if cand[r][2] == kind])) or fits:
            drop[i] = True
    # a title that recurs on lines of its own
    titles: list[list[int]] = []
    long = sorted(len(strip[i]) for i in full)[int(len(full) * 0.8)]
    exact: dict[str, list[int]] = {}
    for i in full:
        t = strip[i]
        if drop[i] or not t[0].isupper() or len(t) > 70 or t.rstrip("\"»”’)]")[-1:] in ".!?…:;,":
            continue
        if len(t) < 0.9 * long or t.isupper():
            exact.setdefault(t, []).append(i)
    for t, at in sorted(exact.items(), key=lambda x: -len(x[1])):
        group = next((g for g in titles if likeness(t, strip[g[0]])), None)
        if group is None:
            titles.append(list(at))
        else:
            group += at
    for alone in titles:
        if len(alone) >= 2 or alone and title and any(drop) and likeness(strip[alone[0]], title):
            for i in alone:
                drop[i] = True
    if not any(drop) and not any("\f" in x for x in lines):
        return drop
    # heads: the first line with text after a page number or form feed, and the first of all
    pages = [i for i in full if drop[i]]
    width = sorted(len(lines[i].rstrip()) for i in full)[int(len(full) * 0.8)]
    tops = {full[0]} if pages else set()
    for prev, i in zip(full, full[1:]):
        if drop[prev] or "\f" in lines[i]:
            tops.add(i)
    if "\f" in lines[full[0]]:
        tops.add(full[0])
    after_foot = {}
    for i in tops:
        after_foot[i] = next((k for k in range(i + 1, n) if strip[k]), None)
    text = {i: strip[i] for i in tops if not drop[i]}
    for i, s in text.items():
        if _ENDS.search(s) and not s.endswith(",") or not any(c.isalpha() for c in s) or s[0] in "=*#":
            continue
        again = any(k != i and likeness(s, t) for k, t in text.items())
        named = bool(title) and likeness(s, title)
        caps = s.upper() == s and any(c.isalpha() for c in s) and not all(x.upper() == x for x in strip if len(x) > 20)
        nxt = after_foot[i]
        prev = next((k for k in range(i - 1, -1, -1) if strip[k] and not drop[k]), None)
        begins = s[:1].isupper() or not s[:1].isalpha()
        broken = prev is not None and not _STOPS.search(strip[prev])  # a sentence goes on over the page
        goes_on = nxt is not None and strip[nxt][:1].islower()
        short = len(s) < 0.75 * width
        # a first line of a paragraph fills the column: the next word would not have fitted
        word = len(strip[nxt].split()[0]) if nxt is not None and strip[nxt] else 0
        unfilled = len(lines[i].rstrip()) + 1 + word < width - 1
        if begins and (again or named or caps or unfilled and (broken and short or goes_on and broken or nxt is None or short and not lines[i][:1].isspace())):
            drop[i] = True
    return drop


class Reader:
    """Repairs texts with a vocabulary of (word, documents); keeps what it has looked up."""

    def __init__(self, vocabulary: dict[str, int], documents: int, pairs: dict[str, int] | None = None):
        self.df, self.docs, self.pairs = vocabulary, documents, pairs or {}
        self.floor = max(LEAST_DOCS, VOCABULARY_SHARE * documents)
        plain = [w for w in vocabulary if regex.fullmatch(r"[\p{L}\p{M}]{2,}", w)]
        self.trie = Trie(plain)
        self.plain = set(plain)
        self.starts = {w[:i] for w in plain for i in range(len(w) + 1)}
        self.known: dict[str, list[tuple[float, str]]] = {}
        self.rivals: dict[str, list[str]] = {}
        self.fine: set[str] = set()
        # tokens that stand in any place, or (risky) beside neighbours with which they are settled
        self.okay: set[str] = set()
        self.risky: set[str] = set()
        self.settled: set[tuple[str, str]] = set()
        self.seen: set = set()

    def common(self, word: str) -> bool:
        """Whether a word is in too many documents for any other to be TIMES as common."""
        return self.df.get(word, 0) * TIMES > self.docs

    def candidates(self, words: set[str]) -> None:
        """Looks up all words within two edits of each of `words`, and those further off by two known misreadings,
        keeps those of which it may be a misreading, and ranks them by misreadings, then by documents; `rivals` of a word of the corpus are those one misreading
        away that aren't that much more common. Words of the corpus without other candidates are `fine`."""
        if len(self.known) > 300_000:
            self.known, self.rivals, self.fine, self.okay, self.risky, self.settled, self.seen = {}, {}, set(), set(), set(), set(), set()
        new = [w for w in words if w not in self.known]
        for w, near in zip(new, self.trie.within(new, 2)):
            own = self.df.get(w, 0)
            least = TIMES * (own or self.floor / 3)
            odd, rank, rivals = not w.isalpha(), [], []
            explained = self.explained(w)
            for v in explained.union(v for v, _ in near):
                if v not in explained:  # its misreadings are more than two, or unknown ones
                    continue
                if v != w and self.df[v] >= least:
                    c = misread_cost(w, v)
                    if c == 1 or c == 2 and (odd or len(v) >= 5):
                        rank.append((c - 0.35 * math.log10(self.df[v]), v))
                elif v != w and own and self.df[v] > self.floor and misread_cost(w, v, 1) == 1:
                    rivals.append(v)
            self.known[w] = sorted(rank)
            if rivals and self.pairs:
                self.rivals[w] = rivals
            if not rank and own >= self.floor:
                self.fine.add(w)

    def explained(self, seen: str, most: int = 2) -> set[str]:
        """All words of the vocabulary of which at most `most` known misreadings make `seen`, whatever edits these are."""
        out: set[str] = set()

        def go(meant: str, i: int, left: int) -> None:
            while meant in self.starts:
                if i == len(seen):
                    if meant in self.plain:
                        out.add(meant)
                    return
                if left:
                    for s, m in _BY_FIRST.get(seen[i], ()):
                        if seen.startswith(s, i):
                            go(meant + m, i + len(s), left - 1)
                meant += seen[i]
                i += 1

        go("", 0, most)
        return out

    def stands(self, word: str) -> bool:
        """Whether no neighbour could make a word a misreading."""
        return len(word) < 2 or self.common(word) or word in self.fine and word not in self.rivals

    def skips(self, tokens: list[str]) -> bool:
        """Whether a line of these tokens needs no look: all are okay, and those with rivals beside known neighbours."""
        return self.okay.issuperset(tokens) and (self.risky.isdisjoint(tokens) or self.settled.issuperset(zip(tokens, tokens[1:])))

    def learn(self, page: Page) -> None:
        """Tokens of the page all of whose words are fine need no second look, and pairs of tokens in which each
        word with rivals is met in the corpus beside the other."""
        if len(self.okay) + len(self.settled) > 600_000:
            self.okay, self.risky, self.settled, self.seen = set(), set(), set(), set()
        rows = [page.lines[i].split() for i in page.parts]
        for t in {t for r in rows for t in r} - self.okay - self.seen:
            words = [fold(x[2]) for x in _parts(t)]
            if t[-1] not in _MARKS and all(map(self.stands, words)):
                self.okay.add(t)
            elif t[-1] not in _MARKS and len(words) == 1 and words[0] in self.fine:
                self.okay.add(t)
                self.risky.add(t)
            else:
                self.seen.add(t)
        for a, b in {p for r in rows for p in zip(r, r[1:])} - self.settled - self.seen:
            if self.risky.isdisjoint((a, b)):
                self.settled.add((a, b))
                continue
            x, y = _parts(a), _parts(b)
            if x and y and self.pairs.get(f"{fold(x[-1][2])} {fold(y[0][2])}", 0):
                self.settled.add((a, b))
            else:
                self.seen.add((a, b))

    @staticmethod
    def _open(seen: str, near: list[tuple[float, str]]) -> bool:
        """Whether several words explain `seen` with as few misreadings."""
        cost = [misread_cost(seen, v) for _, v in near]
        return cost.count(min(cost)) > 1

    def beside(self, left: str, word: str, right: str) -> int:
        """Documents of the corpus in which `word` stands after `left` or before `right`, added up."""
        return (self.pairs.get(f"{left} {word}", 0) if left else 0) + (self.pairs.get(f"{word} {right}", 0) if right else 0)

    def meant(self, part: str, seen: str, times: int, names: list[str], left: str = "", right: str = "") -> str | None:
        """The word that `seen` (folded) was misread from, or None if it stands. Candidates are ranked with the words
        `left` and `right` of it; a word of the corpus stands if it is met beside them at least as often as the
        best. A capitalised word that recurs in its document is a name if it is short or several words may be
        meant alike; one that doesn't recur may be a misreading of such a name."""
        near, own = self.known.get(seen, ()), self.df.get(seen, 0)
        name = part[:1].isupper() and seen.isalpha() and own < self.floor
        if near and not (name and times > 1 and (len(seen) < LEAST_NAME or self._open(seen, near))):
            if len(near) == 1 and own < self.floor:
                return near[0][1]
            met = {v: self.beside(left, v, right) for _, v in near}
            best = min(near, key=lambda x: x[0] - CONTEXT * math.log2(1 + met[x[1]]))[1]
            return None if own >= self.floor and self.beside(left, seen, right) > met[best] else best
        if seen in self.rivals and not part[:1].isupper() and self.beside(left, seen, right) == 0:  # names have no fixed place
            met = {v: self.beside(left, v, right) for v in self.rivals[seen]}
            best = max(met, key=lambda v: (met[v], v))
            return best if met[best] >= max(LEAST_PAIR, 2 * self.floor) else None
        if times == 1 and own < self.floor and len(seen) >= 4:
            return next((v for v in names if abs(len(v) - len(seen)) <= 2 and v != seen and misread_cost(seen, v, 1) == 1), None)
        return None


_PART = re.compile(r"[\w@\\|$€][\w@\\/|$€!]*")
_LETTER = re.compile(r"[^\W\d_]|@")


def _parts(line: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the parts of a line's words that hold a letter: runs of letters, digits and signs read
    for letters, without signs at their end. Web and mail addresses are left out."""
    out = []
    address = "://" in line or "www." in line
    for m in _PART.finditer(line):
        t = m.group()
        if not t.isalpha():
            t = t.rstrip("!/|")
            if not _LETTER.search(t):
                continue
            if address or "@" in t and "." in line:
                a, b = line.rfind(" ", 0, m.start()) + 1, line.find(" ", m.end())
                token = line[a : b if b >= 0 else len(line)]
                if "://" in token or token.startswith("www.") or "@" in token and "." in token.strip(".,;:!?)"):
                    continue
        out.append((m.start(), m.start() + len(t), t))
    return out


def _wrapped(lines: list[str]) -> bool:
    """Whether lines are broken at a width, as on a page."""
    n = [len(x.strip()) for x in lines if x.strip()]
    if len(n) < 3:
        return False
    top = sorted(n)[int(len(n) * 0.85)]
    return 20 <= top <= 100 and sum(x >= 0.6 * top for x in n) >= 0.45 * len(n)


_INVISIBLE = regex.compile(r"\p{Cf}(?<!\xad(?=\s*$))")
_UNSEEN = regex.compile(r"\p{Cf}|[\p{Zs}--\ ]|[！-～]", regex.V1)
_SPACES = regex.compile(r"[\p{Zs}--\ ]", regex.V1)


class Page:
    """One text: its lines, which of them are furniture, and whether it is a scan."""

    def __init__(self, text: str, title: str | None):
        self.lines = text.split("\n")
        self.scan = len(self.lines) > 2 and ("\f" in text or _wrapped(self.lines))
        if self.scan and not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _UNSEEN.search(text):
                text = "\n".join(_INVISIBLE.sub("", _SPACES.sub(" ", x)) for x in text.translate(_WIDE).split("\n"))
            self.lines = text.split("\n")
        self.drop = furniture(self.lines, title) if self.scan else [False] * len(self.lines)

    def breaks(self) -> list[tuple[int, int]]:
        """(line, next line of text) where a line ends in a letter and a mark."""
        out = []
        kept = [i for i, x in enumerate(self.lines) if x.strip(" \t\r\f") and not self.drop[i]]
        for i, k in zip(kept, kept[1:]):
            e = self.lines[i].rstrip(" \t\r\f")
            if len(e) > 1 and e[-1] in _MARKS and e[-2].isalpha() and self.lines[k].lstrip(" \t\r\f")[:1].isalpha():
                out.append((i, k))
        return out


_LEFT = regex.compile(r"[\p{L}\p{M}\p{N}@\\/|]+(?:[-’'][\p{L}\p{M}\p{N}@\\/|]+)*$")
_RIGHT = regex.compile(r"^[\p{L}\p{M}\p{N}@\\/|]+(?:-[\p{L}\p{M}\p{N}@\\/|]+)*")


def _doubtful(reader: Reader, page: Page) -> None:
    """Takes apart the lines of a page that hold more than words known to be fine, and what it says of them."""
    p = page
    p.join, p.edge, p.parts, p.folded = [], set(), {}, {}
    beside = set()
    breaks = p.breaks()
    for i, k in breaks:
        beside |= {i, k}
    for i, x in enumerate(p.lines):
        if not p.drop[i] and (i in beside or not reader.skips(x.split())):
            p.parts[i] = _parts(x)
            p.folded[i] = [y[2].lower() if y[2].isascii() else fold(y[2]) for y in p.parts[i]]
    p.local = Counter(w for f in p.folded.values() for w in f)
    for i, k in breaks:
        a, b = _LEFT.search(p.lines[i].rstrip(" \t\r\f")[:-1]), _RIGHT.match(p.lines[k].lstrip(" \t\r\f"))
        if a and b:
            p.join.append((i, k, fold(a.group()), fold(b.group())))
            p.edge |= {(i, len(p.parts[i]) - 1), (k, 0)}
    # a capitalised word that recurs and isn't the corpus's is a name as a rule (see Reader.meant)
    named = {w for i, f in p.folded.items() for w, x in zip(f, p.parts[i]) if x[2][:1].isupper() and p.local[w] > 1 and w.isalpha() and reader.df.get(w, 0) < reader.floor}
    p.names = [w for w in named if len(w) >= 4]


def _last(word: str) -> str:
    return re.split("[-’']", word)[-1]


def _belongs(reader: Reader, page: Page, i: int, k: int, a: str, b: str) -> bool:
    """Whether the mark at the end of line i is one of the word's own: of a compound the corpus has, or before a
    capital; else the parts joined are a word of the corpus, near one, or of the document."""
    last, first, df = _last(a), b.split("-")[0], reader.df
    mark = page.lines[i].rstrip(" \t\r\f")[-1]
    if page.lines[k].lstrip(" \t\r\f")[:1].isupper() and not page.lines[i].isupper():
        return True
    whole = df.get(last + first, 0)
    compound = max(df.get(x, 0) for x in (a + "-" + b, last + "-" + first, a + "-" + first, last + "-" + b))
    if whole or compound:
        return compound >= whole
    known = min(df.get(last, 0), df.get(first, 0)) >= reader.floor and len(last) > 1 and len(first) > 1
    if mark == "\xad":  # mostly a stray one between two words
        return known
    return mark == "-" and known and not reader.known.get(last + first) and not page.local.get(last + first, 0)


def repair(reader: Reader, texts: list[str | None], titles: list[str | None]) -> list[tuple[Page, list[int], dict[int, list[tuple[int, int, str]]], dict[int, int]] | None]:
    """For each text its Page, the lines broken within a word, the misread parts by line as (start, end,
    word meant), and for broken lines the line where the word goes on; None for null texts."""
    pages = [Page(t, ti) if t is not None else None for t, ti in zip(texts, titles)]
    ask: set[str] = set()
    for p in pages:
        if p is not None and p.scan:
            _doubtful(reader, p)
            ask |= {w for w in p.local if len(w) > 1 and w not in reader.fine and not reader.common(w)}
            ask |= {_last(a) + b.split("-")[0] for _, _, a, b in p.join}
    reader.candidates(ask)
    out: list = []
    for p in pages:
        if p is None or not p.scan:
            out.append(None if p is None else (p, [], {}, {}))
            continue
        at = {i: k for i, k, a, b in p.join if not _belongs(reader, p, i, k, a, b)}
        wrong: dict[int, list] = {}
        for i, parts in p.parts.items():
            for j, ((s, e, part), w) in enumerate(zip(parts, p.folded[i])):
                if w in reader.fine and w not in reader.rivals or len(w) < 2 or reader.common(w) or (i, j) in p.edge and w.isalpha():
                    continue
                if len(w) > 2 and not w.isalpha() and sum(c.isdigit() for c in w) * 2 > len(w):
                    continue
                f = p.folded[i]
                if v := reader.meant(part, w, p.local[w], p.names, f[j - 1] if j else "", f[j + 1] if j + 1 < len(f) else ""):
                    wrong.setdefault(i, []).append((s, e, v))
        # a broken word is judged as a whole; a misreading counts on the line that holds it
        for i, k, a, b in p.join:
            last, first = _last(a), b.split("-")[0]
            if i not in at or reader.common(last + first) or not p.parts[i] or not p.parts[k]:
                continue
            if v := reader.meant(last, last + first, 1, p.names):
                left = v.startswith(last)
                s, e, _ = p.parts[k][0] if left else p.parts[i][-1]
                n = len(last)
                wrong.setdefault(k if left else i, []).append((s, e, v[n:] if left else v[: len(v) - len(first)] if v.endswith(first) else v[:n]))
        reader.learn(p)
        out.append((p, list(at), wrong, at))
    return out


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def reflowed(page: Page, hyphen: list[int], wrong: dict[int, list[tuple[int, int, str]]]) -> str:
    """The text in paragraphs, one a line with an empty line between: without furniture, words joined,
    misreadings replaced. A paragraph ends at an empty line, before an indented line, and at a line that
    ends a sentence well before the width. Texts that aren't scans come out as they are."""
    if not page.scan:
        return "\n".join(page.lines)
    lines = []
    for i, x in enumerate(page.lines):
        for s, e, v in sorted(wrong.get(i, ()), reverse=True):
            x = x[:s] + _cased(v, x[s:e]) + x[e:]
        lines.append(x.rstrip(" \t\r\f").replace("\f", ""))
    width = sorted(len(x) for x in lines)[int(len(lines) * 0.85)]
    out, now, glue, after_drop = [], "", False, False
    for i, x in enumerate(lines):
        if page.drop[i]:
            after_drop = True
            continue
        s = x.strip()
        if not s:
            if now and not after_drop and not glue:
                out.append(now)
                now = ""
            continue
        indent = len(x) - len(x.lstrip()) >= 2
        if now and not glue and (indent and _STOPS.search(now) or _STOPS.search(now) and len(lines[i - 1]) < 0.75 * width and not after_drop):
            out.append(now)
            now = ""
        now = now + s if glue or not now else now + " " + s
        glue, after_drop = False, False
        if i in hyphen:
            now, glue = now[:-1], True
        elif s[-1] == "-" and len(s) > 1 and s[-2].isalpha():
            glue = True
    return "\n\n".join(out + [now] if now else out)


_BREAK = re.compile(r"(?<=[\w-])[-¬=‐\xad][ \t\f]*\r?\n\s*\w+")
_TAIL = re.compile(r"[\w-]*$")
_BREAKS = [m + e for m in "-¬=‐\xad" for e in ("\n", "\r", " \n")]
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Words a task counts before it hands them on.
COUNTED_WORDS = 500_000


def _words_of(token: str) -> tuple[str, ...]:
    low = token.lower() if token.isascii() else unicodedata.normalize("NFC", token.lower())
    out = _WORDS.findall(low)
    return tuple({*out, *(x for w in out if "-" in w for x in w.split("-"))})


def _unbroken(text: str) -> str:
    """The text without words broken at a line's end, found from their marks."""
    if not any(x in text for x in _BREAKS):
        return text
    parts = _BREAK.split(text)
    for i in range(len(parts) - 1):
        x, n = parts[i], 80
        while (start := _TAIL.search(x, max(0, len(x) - n)).start()) and start == len(x) - n:
            n *= 8  # all of it is the word, which may go on before
        parts[i] = x[:start]
    return " ".join(parts)


def _counts(batches):
    """Words and pairs of a task with the documents they are in. A word has a number in the task; what isn't one word
    has 0 as a neighbour. Words and pairs are counted as numbers, each document's once."""
    words: dict[str, tuple[int, ...]] = {}
    number: dict[str, int] = {}
    names: dict[str, int] = {"": 0}
    single: list[np.ndarray] = []
    pairs: list[np.ndarray] = []
    held = docs = 0

    def handed():
        name = list(names)
        code, n = np.unique(np.concatenate(pairs), return_counts=True)
        both = [f"{name[x]} {name[y]}" for x, y in zip((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist())]
        count = np.bincount(np.concatenate(single), minlength=len(name))
        count[0] = docs
        return pa.RecordBatch.from_pydict({"w": [*name, *both], "n": [*count.tolist(), *n.tolist()]})

    for b in batches:
        for t in b.column("text").to_pylist():
            row = _unbroken(t).split()
            tokens = set(row)
            for new in tokens.difference(number):
                w = tuple(names.setdefault(x, len(names)) for x in _words_of(new))
                number[new] = w[0] if len(w) == 1 else 0
                if len(w) > 1:
                    words[new] = w
            at = np.fromiter(map(number.__getitem__, row), np.int64, len(row))
            more = [x for m in words.keys() & tokens for x in words[m]] if not words.keys().isdisjoint(tokens) else []
            one = np.unique(np.concatenate([at, np.array(more, np.int64)]) if more else at)
            two = np.unique((at[:-1] << 32 | at[1:])[(at[:-1] > 0) & (at[1:] > 0)])
            single.append(one[one > 0])
            pairs.append(two)
            held += len(one) + len(two)
            docs += 1
        if docs and (len(number) > COUNTED_WORDS or held > 8 * COUNTED_WORDS):
            yield handed()
            words, number, names, single, pairs, held, docs = {}, {}, {"": 0}, [], [], 0, 0
    if docs:
        yield handed()


def vocabulary(docs: DataFrame) -> tuple[dict[str, int], int, dict[str, int]]:
    """Words, and words joined by hyphens, with the number of documents they are in; the documents; and pairs of
    words next to each other ("a b") with the documents of these.

    All documents are counted, each task adding up its own before the shuffle; only words and pairs in a set
    share of them reach the driver, which bounds their number (see VOCABULARY_SHARE); it and their letters are checked
    against MOST_WORDS and MOST_LETTERS before they are fetched. Words broken at a line's end aren't counted."""
    text = docs.where(F.col("text").isNotNull()).select("text")
    count = written(text.mapInArrow(_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    n = (count.where("w = ''").first() or (None, 0))[1]
    kept = count.where((F.col("w") != "") & (F.col("n") >= max(LEAST_DOCS, VOCABULARY_SHARE * n)))
    size, letters = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    if size > MOST_WORDS or letters > MOST_LETTERS:
        raise ValueError(f"{size} words and pairs of {letters} letters are in a share of {VOCABULARY_SHARE} of the documents; raise VOCABULARY_SHARE")
    kept = kept.toArrow()
    every = dict(zip(kept.column("w").to_pylist(), kept.column("n").to_pylist()))
    return {w: k for w, k in every.items() if " " not in w}, n, {w: k for w, k in every.items() if " " in w}


@contextmanager
def _rare_collections():
    """Leaves the reader's tables out of the searches for cyclic garbage, and has fewer of them, until the end."""
    usual = gc.get_threshold()
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)
    try:
        yield
    finally:
        gc.set_threshold(*usual)
        gc.unfreeze()


def _runner(docs: DataFrame, schema: pa.Schema, ddl: str, rows_of, only=None):
    """`rows_of` each repaired text, of the rows for which `only` holds; the vocabulary is of all."""
    sc = docs.sparkSession.sparkContext
    box, name = sc.broadcast(_prepared(*vocabulary(docs))), uuid.uuid4().hex

    def run(batches):
        reader = _reader(box, name)
        with _rare_collections():
            for b in batches:
                s = 0
                while s < b.num_rows:
                    p = b.slice(s, 400 if reader.okay else 60)  # few before it has learnt which words are fine
                    s += p.num_rows
                    got = repair(reader, p.column("text").to_pylist(), p.column("title").to_pylist())
                    rows = [r for key, x in zip(p.column("doc_id").to_pylist(), got) for r in rows_of(key, x)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    docs = docs if only is None else docs.where(only)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "title").mapInArrow(run, ddl)


_READERS: dict = {}


def _prepared(words: dict[str, int], documents: int, pairs: dict[str, int]) -> tuple:
    """What a reader is made of, and what it knows of MOST_AHEAD words of the vocabulary, at most."""
    if len(words) > 10 * MOST_AHEAD:
        return words, documents, pairs, {}, {}, set()
    r = Reader(words, documents, pairs)
    ahead = nlargest(MOST_AHEAD, (w for w in words if len(w) > 1 and not r.common(w)), key=words.get)
    for s in range(0, len(ahead), 256):
        r.candidates(set(ahead[s : s + 256]))
    return words, documents, pairs, r.known, r.rivals, r.fine


def _reader(box, name: str) -> Reader:
    """One reader a worker and vocabulary."""
    if name not in _READERS:
        _READERS.clear()
        words, documents, pairs, known, rivals, fine = box.value
        r = _READERS[name] = Reader(words, documents, pairs)
        r.known, r.rivals, r.fine = dict(known), dict(rivals), set(fine)
    return _READERS[name]


def line_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of the lines of each text: `drop`, `hyphen`, `ocr` (see the module). Null,
    empty and one-line texts have none; a missing title is as none; repeated rows count once."""

    def rows(key, x):
        if x is None:
            return []
        p, hyphen, wrong, _ = x
        return [(key, i, "drop") for i, d in enumerate(p.drop) if d] + [(key, i, "hyphen") for i in hyphen] + [(key, i, "ocr") for i in wrong]

    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string())])
    return _runner(docs, schema, "doc_id long, line_no int, kind string", rows, F.col("text").contains("\n"))


def repaired(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every row's text in readable paragraphs; null for null, empty for empty."""

    def rows(key, x):
        return [(key, None if x is None else reflowed(*x[:3]))]

    return _runner(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string", rows)


SQL: dict = {}
QUERIES = {
    "p2_repaired": lambda spark, d: repaired(spark.read.parquet(f"{d}/documents.parquet")),
    "p2_found": lambda spark, d: line_findings(spark.read.parquet(f"{d}/documents.parquet")),
}

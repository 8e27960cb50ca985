"""One form for text that looks the same but differs in its characters.

The skeleton of a text: decompose it, replace every character by the prototype it looks like,
decompose again. Originals with equal skeletons look alike. The prototypes are those of the Unicode
consortium's confusables data, read from the ICU library that comes with Spark, for all letters, marks
and numbers; compatibility forms, invisible characters and other spaces are undone first.

Stand-ins are found by comparing a text with its skeleton: a character that the skeleton keeps stands
for itself; one that differs is cleared only where it is properly in its own script.
"""

from __future__ import annotations

import bisect
import glob
import os
import struct
import unicodedata as U
import zipfile
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
_LIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    # Greek
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # other Latin signs
    "ı": "i", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ꞵ": "ß",
}

#: Latin letters that stand in for letters of the Russian alphabet, by the table read the other way.
_LATIN_LIKE = {v for k, v in _LIKE.items() if "А" <= k <= "я"}
#: Kinds of compatibility forms (names of the Unicode standard) whose letters are replaced.
_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")


@lru_cache(maxsize=1 << 16)
def prototype(ch: str) -> str:
    """What a character is replaced by: nothing for invisible ones, a common space for other spaces, the
    letters of full-width, joined, styled and letter-like forms, the Latin letter for its look-alikes;
    anything else, dashes, quotes and symbols among them, stays."""
    if ch.isascii():
        return ch
    if ch in _LIKE:
        return _LIKE[ch]
    kind = U.category(ch)
    if kind == "Cf" or ch in "͏᠎" or "︀" <= ch <= "️":
        return ""
    if kind == "Zs":
        return " "
    d = U.decomposition(ch)
    if d and (kind[0] == "L" or "＀" <= ch <= "￯" or d.startswith("<font>")) and (not d.startswith("<") or d.split()[0] in _KINDS):
        return "".join(prototype(c) for c in U.normalize("NFKD", ch))
    return ch


def _confusables() -> dict[str, str]:
    """Character -> prototype of the confusables data among Spark's jars; empty if there is none.

    The file has a header, sorted keys (code point and length of the prototype), an index for each (the
    prototype itself if it is one unit, else its place in the strings), and the strings in UTF-16."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jars = sorted(glob.glob(f"{home}/jars/icu4j-*.jar")) or sorted(glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/icu4j-*.jar"))
    if not jars:
        return {}
    with zipfile.ZipFile(jars[-1]) as z:
        name = next((n for n in z.namelist() if n.endswith("/confusables.cfu")), None)
        raw = z.read(name) if name else b""
    if not raw:
        return {}
    data = raw[struct.unpack_from(">H", raw)[0] :]
    key_at, keys, index_at, _, text_at, _ = struct.unpack_from(">6i", data, 12)
    out = {}
    for k, i in zip(struct.unpack_from(f">{keys}I", data, key_at), struct.unpack_from(f">{keys}H", data, index_at)):
        n = (k >> 24) + 1
        out[chr(k & 0xFFFFFF)] = chr(i) if n == 1 else data[text_at + 2 * i : text_at + 2 * (i + n)].decode("utf-16-be")
    return out


#: What a character that differs from its prototype is: codes that stand for it in Table.kinds.
_GONE, _SPACE, _FORM, _ACCENT, _RARE = (chr(0xE000 + k) for k in range(5))
#: Phonetic signs among the Latin letters, which no word of common letters holds.
_PHONETIC = regex.compile(r"[ıƄƍƖƦƽǀ\u0250-\u02af\u1d00-\u1dbf\ua720-\ua7ff\uab30-\uab6f]")


class Table:
    """The look-alike table: `full` for str.translate on decomposed text; `like` the letters that imitate one
    Latin letter; `latin` the Latin letters that Russian ones imitate; `kinds` the characters that differ
    from their skeleton by themselves, with what they are. Common (ASCII) characters are no stand-ins."""

    def __init__(self):
        seen = _confusables()
        held = {c for c in seen if U.category(c)[0] in "LNM" or c == "|"}
        self.full: dict[int, str] = {}
        self.kinds: dict[int, str] = {}
        self.like: dict[str, str] = {}
        # all assigned characters; ideographs and syllables in order have no prototypes but in the data
        for n in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200), *(ord(c) for c in held)):
            c = chr(n)
            kind = U.category(c)
            if kind in ("Cn", "Co", "Cs") or n in self.full:
                continue
            one, plain = prototype(c), U.normalize("NFD", c)
            p = U.normalize("NFD", "".join(seen.get(x, x) if x in held else x for x in U.normalize("NFD", one)))
            if 0x2100 <= n < 0x2150 and kind[0] == "L" and plain != c:
                self.kinds[n] = _FORM  # letter-like signs that decompose to the letter itself
            if p == plain:
                continue
            self.full[n] = p
            if n < 128:
                continue
            d = U.decomposition(c)
            if not p:
                if kind == "Cf" or c in "͏᠎":
                    self.kinds[n] = _GONE
            elif p == " ":
                self.kinds[n] = _SPACE
            elif d.startswith("<") and one != c:
                if n > 0x17F or c in "Ĳĳ":  # below: letters of alphabets
                    self.kinds[n] = _FORM
            elif kind[0] == "L" and len(p) == 1 and p.isascii() and p.isalpha():
                self.like[c] = p
        self.like |= {k: v for k, v in _LIKE.items() if len(v) == 1}
        self.kinds |= {ord(c): _RARE for c in self.like if script(c) not in _MAIN or _PHONETIC.match(c)}
        self.kinds |= {n: _ACCENT for n in range(0x300, 0x370)}
        self.latin = {v for k, v in self.like.items() if "А" <= k <= "я"}
        letters = regex.escape("".join(sorted({*self.like, *self.latin})), special_only=True)
        self.whole = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[{letters}]+(?![\p{{L}}\p{{M}}\p{{N}}])")
        self.foreign = regex.compile(rf"[\p{{Cyrillic}}\p{{Greek}}\p{{Armenian}}{regex.escape(''.join(sorted(self.like)), special_only=True)}]")


@lru_cache(maxsize=1)
def table() -> Table:
    return Table()


def skeleton(text: str) -> str:
    """Decomposed, every character replaced by its prototype, decomposed again."""
    return U.normalize("NFD", U.normalize("NFD", text).translate(table().full))


_MAIN = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_SURE = regex.compile(f"[{_GONE}-{_ACCENT}]")
_ODD_IN_WORD = regex.compile(rf"{_RARE}\p{{M}}*(?=\p{{Latin}})|(?<=\p{{Latin}}\p{{M}}*){_RARE}")
_MIXED = regex.compile("|".join(rf"\p{{{a}}}\p{{M}}*(?=\p{{{b}}})" for a in ("Latin", "Cyrillic", "Greek", "Armenian") for b in ("Latin", "Cyrillic", "Greek", "Armenian") if a != b))
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_MATH = set("=≥≤<>±×·+≈≠−∈~")


@lru_cache(maxsize=1 << 14)
def script(ch: str) -> str:
    """The script of a letter, the first word of its Unicode name; '' for other characters."""
    return U.name(ch, "").split(" ")[0] if U.category(ch)[0] == "L" else ""


def _main_script(word: str) -> str:
    n: dict[str, int] = {}
    for c in word:
        if s := script(c):
            n[s] = n.get(s, 0) + 1
    return max(n, key=n.get) if n else ""


def _sure(text: str, kinds: str) -> tuple[int, str] | None:
    """The first character that stands in for another wherever it is: one that the skeleton drops or makes a
    space, letters of a compatibility form, accents of their own."""
    for m in _SURE.finditer(kinds):
        i = m.start()
        ch, near = text[i], text[max(0, i - 1) : i] + text[i + 1 : i + 2]
        if ch in "‌‍" and any(U.category(c) in ("So", "Sk") or "֐" <= c <= "෿" for c in near):
            continue  # proper in emoji sequences and in scripts that join letters
        if "Ⅰ" <= ch <= "ⅿ" and not any(c.isalpha() and not "Ⅰ" <= c <= "ⅿ" for c in near):
            continue  # a numeral of its own
        if m.group() == _ACCENT and (not i or script(text[i - 1]) not in _MAIN and not U.combining(text[i - 1])):
            continue  # no letter's
        return i, ch
    return None


def _in_word(text: str, kinds: str, t: Table) -> tuple[int, str] | None:
    """The first letter that differs from its skeleton in a word otherwise of another script, or a phonetic sign
    in a word of common letters."""
    for m in _MIXED.finditer(text, overlapped=True):
        a, b = text[m.start()], text[m.end()]
        if a in t.like and script(b) == "LATIN" or a in t.latin and script(b) == "CYRILLIC" and b not in t.like:
            return m.start(), a
        if b in t.like and script(a) == "LATIN" or script(a) == "CYRILLIC" and b in t.latin:
            return m.end(), b
        if a in t.like or b in t.like:
            return (m.start(), a) if a in t.like else (m.end(), b)
    if _RARE in kinds:
        for m in _ODD_IN_WORD.finditer(kinds):
            s, e = m.start(), m.end()
            while s and (text[s - 1].isalpha() or U.combining(text[s - 1])):
                s -= 1
            while e < len(text) and (text[e].isalpha() or U.combining(text[e])):
                e += 1
            word = text[s:e]
            if text[s - 1 : s] in ("/", "[", "ˈ") and s or any(_PHONETIC.match(c) and c not in t.like for c in word):
                continue  # a transcription
            return m.start(), text[m.start()]
    return None


def stand_in(text: str | None, before: str = "", after: str = "") -> tuple[int, str] | None:
    """(position, character) of the first character found to stand in for another, or None.

    The text is compared with its skeleton: where no character differs, none stands in. Those that do are
    cleared only as properly in their script: full-width forms, separate accents, invisible characters,
    other spaces, joined letters and letter-like signs never are; a letter of another script isn't inside
    a word of two scripts, nor in a word all of whose letters have look-alikes if the words around it are
    of the script it imitates. `before` and `after` are such neighbours where `text` itself is a single
    token."""
    if not text or text.isascii() and not (before or after):
        return None
    t = table()
    kinds = text.translate(t.kinds)
    if (m := _sure(text, kinds) if kinds != text else None) is not None:
        return m
    around = text + before + after
    if not t.foreign.search(around):
        return None
    if (m := _in_word(text, kinds, t)) is not None:
        return m
    words = None
    for m in t.whole.finditer(text):
        own = _main_script(m.group())
        if own == "GREEK" and len(m.group()) == 1:
            rest = text[m.end() :].lstrip()[:1] or after[:1]
            prior = text[: m.start()].rstrip()[-1:] or before[-1:]
            if rest in _MATH or prior in _MATH or text[m.end() : m.end() + 1] == "-" or text[max(0, m.start() - 1) : m.start()] == "-":
                continue  # a variable
        if words is None:
            words = [(w.start(), w.end(), _main_script(w.group())) for w in _WORD.finditer(text) if w.end() - w.start() > 1]
            starts = [w[0] for w in words]
            total = _main_script(text if words else before + after)
        i = bisect.bisect_left(starts, m.start())
        left = words[i - 1][2] if i else _main_script(before) or total
        while i < len(words) and words[i][0] < m.end():
            i += 1
        right = words[i][2] if i < len(words) else _main_script(after) or total
        if not left or left != right or left == own:
            continue
        # a Latin word among Cyrillic ones is mostly a name; only the shortest are words of that script
        if left == "LATIN" or own == "LATIN" and left == "CYRILLIC" and m.end() - m.start() <= 2:
            return m.start(), m.group()[0]
    return None


#: Texts of these characters only can hold no stand-in: ASCII, precomposed Latin, typographic signs.
HARMLESS = r"^[\x00-\x7F¡-¬®-İĴ-ſ‐-‧‰-⁞₠-₿←-⋿]*$"


def skeletons(df: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """`df` with a column `out`, the skeleton of `text`; null for null, empty for empty. Texts of any
    length are taken whole; rows keep their other columns and their number."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(skeleton, na_action="ignore")

    return df.withColumn(out, run(F.col(text)))


def look_alike_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """(skeleton_hash, rows, forms): groups of at least two different texts with equal skeletons, the
    number of their rows and of their forms. Copies are counted before the shuffle."""
    one = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("f"), text)
    s = skeletons(one, text).select("f", F.sha2("skeleton", 256).alias("skeleton_hash")).groupBy("skeleton_hash", "f").count()
    return s.groupBy("skeleton_hash").agg(F.sum("count").alias("rows"), F.count("*").alias("forms")).where("forms > 1")


def found_in_documents(docs: DataFrame) -> DataFrame:
    """doc_id of the rows whose text holds a stand-in; null texts hold none."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: stand_in(t) is not None)

    return docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~F.col("text").rlike(HARMLESS)).where(run("text")).select("doc_id")


def found_in_tokens(tok: DataFrame) -> DataFrame:
    """(doc_id, token_i), each once, of the tokens whose text holds a stand-in.

    A token all of whose letters have look-alikes is judged by the two tokens on either side of it, which
    are joined to it by their position, so no document is gathered in one task."""
    tok = tok.where("doc_id IS NOT NULL AND token_i IS NOT NULL AND text IS NOT NULL").select("doc_id", "token_i", "text")
    odd = tok.where(~F.col("text").rlike(HARMLESS) | F.col("text").rlike(f"^[{''.join(sorted(table().latin))}]{{1,2}}$")).distinct()

    @F.pandas_udf("int")
    def judge(s: pd.Series) -> pd.Series:
        return s.map(lambda t: 1 if not t.isascii() and stand_in(t) is not None else 2 if table().whole.fullmatch(t) else 0)

    odd = odd.withColumn("j", judge("text")).where("j > 0")
    sure = odd.where("j = 1").select("doc_id", "token_i")
    open_ = odd.where("j = 2").select("doc_id", "token_i", "text")
    side = open_.select("doc_id", F.col("token_i").alias("at"), "text", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("k"))
    near = side.withColumn("token_i", F.col("at") + F.col("k")).join(tok.withColumnRenamed("text", "w"), ["doc_id", "token_i"], "left")
    near = near.groupBy("doc_id", "at", "text").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("k") < 0, F.struct("k", "w")))), lambda x: x["w"]), " ").alias("before"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("k") > 0, F.struct("k", "w")))), lambda x: x["w"]), " ").alias("after"))

    @F.pandas_udf("boolean")
    def with_context(t: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([stand_in(x, y or "", z or "") is not None for x, y, z in zip(t, b, a)], dtype=bool)

    return sure.union(near.where(with_context("text", "before", "after")).select("doc_id", F.col("at").alias("token_i"))).distinct()


def p5_skeletons(spark, d):
    """The skeleton of every document text and every token (each doc_id and token_i once)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("document").alias("record"), "doc_id", F.lit(-1).alias("token_i"), "text")
    tok = spark.read.parquet(f"{d}/idx_doc_token_info_recs.parquet").select(F.lit("token").alias("record"), "doc_id", "token_i", "text").distinct()
    return skeletons(docs.union(tok)).drop("text")


def p5_found(spark, d):
    a = found_in_documents(spark.read.parquet(f"{d}/documents.parquet")).select(F.lit("document").alias("record"), "doc_id", F.lit(-1).alias("token_i"))
    b = found_in_tokens(spark.read.parquet(f"{d}/idx_doc_token_info_recs.parquet")).select(F.lit("token").alias("record"), "doc_id", "token_i")
    return a.union(b)


SQL: dict = {}
QUERIES = {
    "p5_skeletons": p5_skeletons,
    "p5_groups": lambda spark, d: look_alike_groups(spark.read.parquet(f"{d}/idx_doc_token_info_recs.parquet").select("text").union(spark.read.parquet(f"{d}/documents.parquet").select("text"))),
    "p5_found": p5_found,
}

"""Personal data with source offsets, also behind disguises.

Base detectors run on the source text. A second pass runs the same detectors on a normalised
text: transducers fold homoglyphs and width variants, drop invisible characters, turn spelled
digits (English, German, French, Spanish) into digits and ``[at]``, ``(dot)``, `` at x dot y`` into
``@`` and ``.``. The normalised text carries, for each character, the range of source code points it
came from, so every hit maps back to an exact source span. Only texts in which some transducer
fires are normalised; the others cannot change.

Numbers that a base pattern swallows with their neighbours, and so drops, are recovered from the run's parts.

Spans are (kind, start, end) in code points, end exclusive. A normalised hit is added unless a base
span already covers it; base spans are never removed. All matching is linear in the text: e-mail is
anchored at ``@``, digit runs are possessive.

One text is one row and is processed as a whole, without shuffles. Null and empty texts give no
spans; repeated rows are answered each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.columns import batch, carried, mapped, unpacked
from tickloom.llm.text import buffers, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
IP_HINT = re.compile(r"[0-9]\.[0-9]")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while m and start > done and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            yield "email", start, m.end()
            done = at = m.end()
        else:
            at += 1


def detect(text: str, missed: list | None = None) -> list[tuple[str, int, int]]:
    """Base spans, by kind and start; ``missed`` takes the matches that failed their check."""
    out = list(emails(text))
    if IP_HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
            elif missed is not None and len(digits) >= 13:
                missed.append(("card", m))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 9 <= n <= 15:
                out.append(("phone", m.start(), m.end()))
            elif missed is not None and n > 15:
                missed.append(("phone", m))
    return out


GROUP = re.compile(r"[0-9]+")


def recovered(missed: list) -> Iterator[tuple[str, int, int]]:
    """Numbers inside a run that failed its check because they stand next to others: the digit groups after a plus that
    make a phone, and consecutive groups of 13 to 19 digits that pass as a card. Cards of the usual shapes (one group,
    4-4-4-4, 4-6-5) come first; of the other sequences those that hold or lie in a found card are left out."""
    for kind, m in missed:
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
        if kind == "phone":
            digits, end = 0, None
            for s, e in groups:
                digits += e - s
                if digits > 15:
                    break
                end = e if digits >= 9 else None
            if end:
                yield "phone", m.start(), end
            continue
        usual, others = [], []
        for i, j in _cards([m.string[s:e] for s, e in groups]):
            size = tuple(e - s for s, e in groups[i:j])
            (usual if j - i == 1 or size in ((4, 4, 4, 4), (4, 6, 5)) else others).append((i, j))
        # both lists ascend by start, for each start the longest comes first
        taken, end = [], 0
        for i, j in usual:
            if i >= end:
                taken.append((i, j))
                end = j
        starts, stops = [i for i, _ in taken], [j for _, j in taken]
        reach = 0
        for i, j in others:
            k = bisect.bisect_left(starts, i)
            holds = k < len(starts) and stops[k] <= j
            inside = j <= reach or k < len(starts) and starts[k] == i and j <= stops[k] or k > 0 and j <= stops[k - 1]
            if not holds and not inside:
                taken.append((i, j))
                reach = j
        for i, j in taken:
            yield "card", groups[i][0], groups[j - 1][1]


def _cards(groups: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive groups with 13 to 19 digits that pass the Luhn check, from prefix sums of both parities."""
    at = [0]
    for g in groups:
        at.append(at[-1] + len(g))
    sums = ([0], [0])
    for k, c in enumerate("".join(groups)):
        n = int(c)
        sums[k % 2].append(sums[k % 2][-1] + n)
        sums[1 - k % 2].append(sums[1 - k % 2][-1] + (2 * n - 9 if n > 4 else 2 * n))
    for i in range(len(groups)):
        last = bisect.bisect_right(at, at[i] + 19) - 1
        for j in range(last, i, -1):
            if at[j] - at[i] < 13:
                break
            plain = sums[(at[j] - 1) % 2]  # the last digit counts once
            if (plain[at[j]] - plain[at[i]]) % 10 == 0:
                yield i, j


# Characters that look like ASCII ones, invisible characters, digit words.
GLYPHS = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅαοερνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․。｡·＠﹫",
                  "aeopcyxijsdhlABEKMHOPCTYXIJSaoepvikABEZHIKMNOPTYX------....@@"))
INVISIBLE = "​‌‍⁠﻿­᠎‎‏"
SPACES = "     　"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


WORD_SET = frozenset(DIGIT_WORDS)


def _glyph_table() -> dict[int, str]:
    out = {ord(k): v for k, v in GLYPHS.items()}
    out.update({0xFF01 + i: chr(0x21 + i) for i in range(94)})  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out.update({zero + i: str(i) for i in range(10)})
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):  # mathematical letters
        for i in range(26):
            out[first + i], out[first + 26 + i] = chr(65 + i), chr(97 + i)
    out.update({0x2080 + i: str(i) for i in range(10)})
    out.update({0x2460 + i: str(i + 1) for i in range(9)})
    out.update({ord(c): " " for c in SPACES})
    out.update({ord(c): "" for c in INVISIBLE})
    return out


TABLE = _glyph_table()
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLE)) + "]")
ENTITY = re.compile(r"&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);|%40", re.I)
_one = "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True))
_unit = rf"(?:(?:{_one})(?![^\W_])|[0-9](?=[ ,-]))"
#: A run of at least two digits of which the first is a word; the run may go on with plain digits.
SPELLED = re.compile(rf"(?<![^\W_])(?:{_one})(?:[ ,]{{1,2}}|-)(?:{_unit}(?:[ ,]{{1,2}}|-))*(?:(?:{_one})|[0-9]+)(?![^\W_])|"
                     rf"(?<![^\W_])(?:{_one})(?=(?: dot | point | punkt | punto ))|(?<= dot )(?:{_one})(?![^\W_])", re.I)
DIGIT = re.compile(rf"{_one}|[0-9]", re.I)
PLUS = re.compile(r"(?<![^\W_])plus (?=[0-9(])", re.I)
AT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba|ät)\s{0,3}[\])}>]\s{0,3})"
DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3})"
BRACKETED = re.compile(rf"(?P<at>{AT})|(?P<dot>{DOT})", re.I)
#: Bare words count as signs only in a whole address: local at host dot suffix.
_dot = r"(?: (?:dot|punkt|point|punto|\.) |\.)"
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}(?: (?:dot|punkt|punto) [A-Za-z0-9_%+-]{1,64}){0,3}"
                  rf"(?P<at> (?:at|arroba|@) |@)(?P<host>[A-Za-z0-9-]{{1,63}}(?:{_dot}(?!(?:dot|punkt|point|punto|at)(?![A-Za-z0-9]))[A-Za-z0-9-]{{1,63}}){{0,4}}"
                  rf"{_dot}(?!(?:dot|punkt|point|punto|at)(?![A-Za-z]))[A-Za-z]{{2,24}})(?![A-Za-z0-9-])", re.I)
BARE_SIGN = re.compile(r" (?:(?P<at>at|arroba|@)|dot|punkt|point|punto|\.) ", re.I)
IP_DOTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?: (?:dot|punkt|point|punto) [0-9]{1,3}){3}(?![0-9])", re.I)
#: Letters for digits inside a long, mostly numeric run.
MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9](?:[ .()-]{0,2}[0-9OoIl]){8,18}(?![A-Za-z0-9])")
LETTER_DIGIT = re.compile(r"[OoIl]")
DOT_WORDS = ("dot", "punkt", "point", "punto")
IN_BRACKETS = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|ät|dot|punkt|point|punto|\.)\s{0,3}[\])}>]", re.I)
LETTERS_IN_DIGITS = re.compile(r"[0-9][ .()-]{0,2}[OoIl]")


class Mapped:
    """A text under rewriting with the source range of every character (or the identity, kept implicit)."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply ascending, disjoint replacements; each new character covers the replaced range."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            if lo < hi:
                starts += [self.starts[lo]] * len(new)
                ends += [self.ends[hi - 1]] * len(new)
            at = hi
        self.text = "".join([*text, self.text[at:]])
        self.starts = starts + self.starts[at:]
        self.ends = ends + self.ends[at:]


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    """One edit per digit of a run; the separators go with the digit before them."""
    marks = [(d.start() + m.start(), d.end() + m.start(), DIGIT_WORDS.get(d[0].lower(), d[0])) for d in DIGIT.finditer(m[0])]
    return [(lo, marks[i + 1][0] if i + 1 < len(marks) else hi, new) for i, (lo, hi, new) in enumerate(marks)]


TOKEN = re.compile(r"[^\W_]+")


def _spelled(low: str) -> bool:
    """Whether a digit word stands before another one or a number (a quick test before the patterns)."""
    tokens = TOKEN.findall(low)
    if WORD_SET.isdisjoint(tokens):
        return False
    return any(a in WORD_SET and (b in WORD_SET or b[0] in "0123456789") for a, b in zip(tokens, tokens[1:]))


def fires(text: str) -> bool:
    """Whether some transducer may change the text; without it none does."""
    low = text.lower()
    if not text.isascii():
        if any(ord(c) in TABLE for c in set(text)):
            return True
        low = low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")  # letters the patterns take for i and s
    return (
        " @ " in text or " . " in text or any(w in low for w in DOT_WORDS) or any(c in text for c in "[({<") and IN_BRACKETS.search(text) is not None
        or ("&" in text or "%40" in text) and ENTITY.search(text) is not None
        or "plu" in low and PLUS.search(text) is not None or _spelled(low) or LETTERS_IN_DIGITS.search(text) is not None)


def normalise(text: str) -> Mapped | None:
    """The normalised text with its offsets; None where no transducer fires."""
    if not fires(text):
        return None
    m = Mapped(text)
    m.rewrite([(x.start(), x.end(), TABLE[ord(x[0])]) for x in ODD.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), "@" if re.search("64|40|commat", x[0], re.I) else ".") for x in ENTITY.finditer(m.text)])
    m.rewrite([e for x in SPELLED.finditer(m.text) for e in _digits(x)])
    m.rewrite([(x.start(), x.end(), "+") for x in PLUS.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), "@" if x["at"] else ".") for x in BRACKETED.finditer(m.text)])
    m.rewrite([(s.start() + x.start(), s.end() + x.start(), "@" if s["at"] else ".")
               for x in BARE.finditer(m.text) if x["at"] == " @ " or BARE_SIGN.search(x["host"])  # "look at host.com" is no address
               for s in BARE_SIGN.finditer(x[0])])
    m.rewrite([(s.start() + x.start(), s.end() + x.start(), ".") for x in IP_DOTS.finditer(m.text) for s in BARE_SIGN.finditer(x[0])])
    m.rewrite([(s.start() + x.start(), s.end() + x.start(), "0" if s[0] in "Oo" else "1")
               for x in MIXED.finditer(m.text) for s in LETTER_DIGIT.finditer(x[0])])
    return m


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that only the normalised text or a run's parts show; both by kind, start, end."""
    if not text:
        return [], []
    missed: list = []
    base = detect(text, missed)
    known = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    added = set(recovered(missed))
    m = normalise(text)
    if m is not None and m.text != text:
        missed = []
        for kind, s, e in [*detect(m.text, missed), *recovered(missed)]:
            lo, hi = m.starts[s], m.ends[e - 1]
            i = bisect.bisect_right(known[kind], (lo, 1 << 60)) - 1
            if i < 0 or known[kind][i][1] < hi:
                added.add((kind, lo, hi))
    return base, sorted(added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("spans", SPANS), ("redacted", pa.string())])


FOUND_DDL = "doc_id long, spans array<struct<kind:string,start:int,end:int,disguised:boolean>>, redacted string"


def _found(b: pa.RecordBatch):
    for lo, hi in slices(buffers(b.column(1))[1]):
        part = b.slice(lo, hi - lo)
        spans, texts = [], []
        for t in part.column(1).to_pylist():
            base, added = find_spans(t)
            both = [(*s, False) for s in base] + [(*s, True) for s in added]
            spans.append([dict(zip(("kind", "start", "end", "disguised"), s)) for s in both])
            texts.append(redact(t, base + added))
        yield batch(FOUND, doc_id=part.column(0), spans=spans, redacted=texts)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, disguised), redacted (the text with spans masked)."""
    return mapped(docs, lambda: _found, FOUND_DDL, id_col, text_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their spans masked in the text."""
    return unpacked(carried(docs, lambda: _found, FOUND_DDL, id_col, text_col), docs, **{text_col: "redacted"})


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the joined spans of ``find``'s result."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("n_disguised", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for i, ss in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base = [(s["kind"], s["start"], s["end"]) for s in ss if not s["disguised"]]
                rows.append({"doc_id": i, **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS},
                             "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                             "spans": joined([(s["kind"], s["start"], s["end"]) for s in ss]), "n_disguised": len(ss) - len(base)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.select("doc_id", "spans").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")

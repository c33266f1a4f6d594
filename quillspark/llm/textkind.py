"""Per-document text statistics as an associative summary, and the kind of text they show.

A text is summarised line by line. A summary of a chunk holds counters of its complete lines and, as boundary state,
the unfinished line at either end, of which a bounded part is kept as text and the rest as counters; two neighbouring
summaries merge exactly whatever the place of the cut.
"""

from __future__ import annotations

import re

# The commonest function words of the six languages of the corpus.
COMMON_WORDS = frozenset(
    (
        "the a an of and to in is was were be been for on at by with from that this which it as or not but are has have had we you they"
        " der die das den dem des ein eine einen einem und oder ist sind wurde nicht von zu mit für auf im in am bis nach noch weil wenn nur ob"
        " le la les un une des du de et ou est sont été pas pour par avec dans sur au aux que qui ne se si avant après car mais"
        " el los las una unos y o es son ha han no por para con en del al que se si antes porque todavía pero"
        " il lo gli i uno e è sono non per con nel nella del della dei delle che si se prima perché ma alla"
        " os as um uma e ou são foi não por para com no na do da dos das que se antes porque mas ainda ao"
    ).split()
)
BULLET = re.compile(r"\s*(?:[-*•–·▪◦+]{1,2}|\[[ xX]?\]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
CELLS = re.compile(r"\t| {2,}| \.{3,} |[|;]")
MOJIBAKE = re.compile("Ã(?=.)|â(?=€)|Â(?=[^A-Za-z\n])|�")  # told by a character and the next, so that counts add up over cuts
EDGES = "()[]\"«»„“”'’.,;:!?"
VOWELS = "aeiouyáéíóúàèäöü"
SYMBOLS = "{}<>^~\\=*&%§"
ABBREVIATIONS = ("No. ", "no. ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "tel. ", "ext. ", ".... ")

COUNTERS = (
    "words", "word_chars", "marks", "chars", "lines", "common", "plain", "vowels", "symbols", "mojibake", "ends", "commas",
    "list_lines", "list_words", "table_lines", "table_words", "ended_lines", "menu",
)
FIELDS = len(COUNTERS)


def block_counts(block: str, out: list[int]) -> None:
    """Add the counters of a block of complete lines to out."""
    tokens = block.split()
    n = len(tokens)
    out[3] += len(block) + 1
    if not n:
        return
    out[0] += n
    out[1] += sum(map(len, tokens))
    out[2] += block.count(".") + block.count("!") + block.count("?")
    low = block.lower()
    out[5] += sum(map(COMMON_WORDS.__contains__, low.split()))
    out[6] += sum(1 for t in tokens if t.isalpha() or t.strip(EDGES).replace("-", "").replace("'", "").isalpha())
    out[7] += sum(map(low.count, VOWELS))
    out[8] += sum(map(block.count, SYMBOLS))
    if "Ã" in block or "Â" in block or "â€" in block or "�" in block:
        out[9] += len(MOJIBAKE.findall(block))
    for line in block.split("\n"):
        line = line.strip()
        if line:
            ends = line.count(". ") + line.count("? ") + line.count("! ")
            commas = line.count(",") + line.count(";") if "," in line or ";" in line else 0
            line_counts(out, line, line.count(" ") + 1, len(line), ends, sum(map(line.count, ABBREVIATIONS)) if ends else 0, commas, line.count(" > "), None, None)


def line_counts(out: list[int], line: str, blanks: int, length: int, ends: int, abbreviations: int, commas: int, arrows: int, cells: bool | None, words: int | None) -> None:
    """Add the counters of one line that is not blank. line: its text, or the two ends of it where it is long."""
    if not line:
        return
    out[4] += 1
    ended = line[-1] in ".!?"
    out[16] += ended
    bullet = BULLET.match(line)
    if ends:
        ends -= abbreviations + (1 if bullet and ". " in line[: bullet.end()] else 0)
    ends = max(0, ends) + (ended and not line.endswith(" ...."))
    out[10] += ends
    out[11] += commas
    if arrows >= 2:
        out[17] += blanks
    if ends:
        return
    if bullet:
        out[12] += 1
        out[13] += blanks
    elif cells or cells is None and CELLS.search(line):
        out[14] += 1
        out[15] += len(line.split()) if words is None else words
    elif blanks <= 8 and length < 60:
        out[12] += 1
        out[13] += blanks


FEATURES = ("words", "word_chars", "marks", "chars", "common", "plain", "vowels", "symbols", "mojibake", "commas", "spaces", "ends", "abbreviations", "arrows", "cells")
COUNTER_OF = {"words": 0, "word_chars": 1, "marks": 2, "common": 5, "plain": 6, "vowels": 7, "symbols": 8, "mojibake": 9}
KEEP = 512  # characters kept as text at either end of an unfinished line
WORD_KEEP = 32  # and at either end of a long word in it
LONG_WORD = re.compile(r"\S{80,}")
LONG_GAP = re.compile(r"[^\S\n]{12,}")


def features(text: str) -> list[int]:
    """What adds up over the parts of one line; the last of FEATURES only says whether there is one."""
    tokens, low = text.split(), text.lower()
    return [
        len(tokens),
        sum(map(len, tokens)),
        text.count(".") + text.count("!") + text.count("?"),
        len(text),
        sum(map(COMMON_WORDS.__contains__, low.split())),
        sum(1 for t in tokens if t.isalpha() or t.strip(EDGES).replace("-", "").replace("'", "").isalpha()),
        sum(map(low.count, VOWELS)),
        sum(map(text.count, SYMBOLS)),
        len(MOJIBAKE.findall(text)),
        text.count(",") + text.count(";"),
        text.count(" "),
        text.count(". ") + text.count("? ") + text.count("! "),
        sum(map(text.count, ABBREVIATIONS)),
        text.count(" > "),
        1 if CELLS.search(text) else 0,
    ]


def short_word(m: re.Match) -> str:
    """A long word without its inner part, which leaves a mark of the same kind: plain letters or not."""
    w = m.group()
    inner = w[WORD_KEEP:-WORD_KEEP]
    if not inner.strip("."):
        mark = "..."
    else:
        core = inner.strip(EDGES).replace("-", "").replace("'", "")
        mark = ("(" if inner[0] in EDGES else "") + ("" if not inner.strip(EDGES) else "a" if core.isalpha() or not core else "0") + ("(" if inner[-1] in EDGES else "")
    return w[:WORD_KEEP] + mark + w[-WORD_KEEP:]


def cut_after(text: str, at: int, end: int) -> int:
    """The first place from at on where a word begins after one blank; no pattern of a line reaches over it."""
    fallback = 0
    for p in range(max(2, at), end):
        if text[p - 1].isspace() and not text[p].isspace():
            if not text[p - 2].isspace() and text[p] not in ">.":
                return p
            fallback = fallback or p
    return fallback


class Piece:
    """A part of a line: bounded text, counters of what was taken out of it, and blanks taken out at its ends."""

    __slots__ = ("text", "out", "left", "right")

    def __init__(self, text: str, out: list[int] | None = None, left: tuple[int, int] = (0, 0), right: tuple[int, int] = (0, 0)):
        self.text, self.out, self.left, self.right = text, out or [0] * len(FEATURES), left, right

    def drop(self, new: str) -> None:
        """Go on with a shorter text that has the same ends; what it lacks is counted."""
        before, after = features(self.text), features(new)
        self.out = [o + b - a for o, a, b in zip(self.out, after, before)]
        self.text = new

    def gap(self, blanks: str) -> tuple[str, tuple[int, int]]:
        """A run of blanks at an end, cut to eight characters, and (characters, spaces) of what goes."""
        if len(blanks) <= 12:
            return blanks, (0, 0)
        return blanks[:4] + blanks[-4:], (len(blanks) - 8, blanks[4:-4].count(" "))

    def shrink(self) -> Piece:
        if len(self.text) <= 4 * KEEP:
            return self
        core = self.text.strip()
        if not core:
            kept, gone = self.gap(self.text)
            self.text, self.left = kept, (self.left[0] + self.right[0] + gone[0], self.left[1] + self.right[1] + gone[1])
            self.right = (0, 0)
            return self
        at = self.text.index(core[0])
        lead, trail = self.text[:at], self.text[at + len(core) :]
        lead, gone = self.gap(lead)
        self.left = (self.left[0] + gone[0], self.left[1] + gone[1])
        trail, gone = self.gap(trail)
        self.right = (self.right[0] + gone[0], self.right[1] + gone[1])
        self.text = lead + core + trail
        inner = LONG_GAP.sub(lambda m: m.group()[:4] + m.group()[-4:], LONG_WORD.sub(short_word, core))
        if len(inner) < len(core):
            self.drop(lead + inner + trail)
        if len(self.text) > 4 * KEEP:
            p = cut_after(self.text, KEEP, len(self.text) - KEEP)
            q = cut_after(self.text, len(self.text) - KEEP, len(self.text))
            if 0 < p < q:
                self.drop(self.text[:p] + self.text[q:])
        return self

    def join(self, other: Piece) -> Piece:
        out = [a + b for a, b in zip(self.out, other.out)]
        left, right = self.left, other.right
        gone = (self.right[0] + other.left[0], self.right[1] + other.left[1])
        if not self.text.strip():  # blanks so far: still at the left end
            left, gone = (left[0] + gone[0], left[1] + gone[1]), (0, 0)
        elif not other.text.strip():
            right, gone = (right[0] + gone[0], right[1] + gone[1]), (0, 0)
        if gone[0]:
            out[3] += gone[0]
            out[10] += gone[1]
            out[14] += 1
        return Piece(self.text + other.text, out, left, right).shrink()

    def count(self, out: list[int]) -> None:
        """Add the counters of the line, now complete."""
        if not any(self.out):
            block_counts(self.text, out)
            out[3] += self.left[0] + self.right[0]
            return
        f = [a + b for a, b in zip(features(self.text), self.out)]
        for name, i in COUNTER_OF.items():
            out[i] += f[FEATURES.index(name)]
        out[3] += f[3] + self.left[0] + self.right[0] + 1
        line = self.text.strip()
        blank, own = features(self.text), features(line)
        g = dict(zip(FEATURES, (x - b + o for x, b, o in zip(f, blank, own))))
        line_counts(out, line, g["spaces"] + 1, g["chars"], g["ends"], g["abbreviations"], g["commas"], g["arrows"], g["cells"] > 0, g["words"])


class Summary:
    """Counters of complete lines with the unfinished first and last line of a chunk as boundary state."""

    __slots__ = ("head", "tail", "counts")

    def __init__(self, head: Piece, tail: Piece | None, counts: list[int]):
        self.head, self.tail, self.counts = head, tail, counts  # tail is None while no line break was seen

    @classmethod
    def of(cls, chunk: str) -> Summary:
        first, sep, rest = chunk.partition("\n")
        counts = [0] * FIELDS
        if not sep:
            return cls(Piece(first).shrink(), None, counts)
        middle, sep, last = rest.rpartition("\n")
        if sep:
            block_counts(middle, counts)
        return cls(Piece(first).shrink(), Piece(last).shrink(), counts)

    def merge(self, other: Summary) -> Summary:
        counts = [a + b for a, b in zip(self.counts, other.counts)]
        if self.tail is None:
            return Summary(self.head.join(other.head), other.tail, counts)
        line = self.tail.join(other.head)
        if other.tail is None:
            return Summary(self.head, line, counts)
        line.count(counts)
        return Summary(self.head, other.tail, counts)

    def state(self) -> tuple:
        """The summary as plain values of bounded size."""
        head, tail = ((p.text, p.out, p.left, p.right) if p is not None else None for p in (self.head, self.tail))
        return head, tail, self.counts

    @classmethod
    def from_state(cls, state: tuple) -> Summary:
        head, tail, counts = state
        return cls(Piece(*head), Piece(*tail) if tail is not None else None, counts)

    def close(self) -> list[int]:
        counts = list(self.counts)
        self.head.count(counts)
        if self.tail is not None:
            self.tail.count(counts)
        counts[3] -= 1  # the last line has no line break
        return counts


def whole(text: str) -> list[int]:
    """The counters of a whole text."""
    counts = [0] * FIELDS
    block_counts(text, counts)
    counts[3] -= 1
    return counts


def readability(c: list[int]) -> float | None:
    """clamp(100 - 1.5 words/marks - 5 mean word length, 0, 100); 0 without marks, None without words."""
    words, marks = c[0], c[2]
    if not words:
        return None
    if not marks:
        return 0.0
    return min(100.0, max(0.0, 100 - 1.5 * words / marks - 5 * c[1] / words))


def kind(c: list[int]) -> str:
    """'prose', 'list', 'table' or 'junk' from the counters of a whole text; '' for a text without words."""
    words = c[0]
    if not words:
        return ""
    plain, common, ends = c[6] / words, c[5] / words, c[10] / words
    if c[9] * 12 > c[1] or c[17] * 2 > words or c[8] * 12 > c[1]:
        return "junk"
    if plain > 0.5 and c[7] * 8 < c[1]:
        return "junk"
    if ends >= 0.008 and common > 0.04 and plain > 0.5 and c[13] * 10 < words * 9 and c[15] * 2 < words:
        return "prose"
    if c[15] * 2 > words and (c[14] >= 2 or c[4] == 1 and c[11] < 3) and c[14] * 2 > c[4]:
        return "table"
    if plain < 0.3:
        return "junk"
    if c[13] * 2 > words and c[12] > 1 or c[11] * 9 > words:
        return "list"
    return "junk"


def is_prose(text: str) -> bool:
    return kind(whole(text)) == "prose"

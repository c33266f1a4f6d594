"""Problem 3: noise in text from scanned pages.

Method: the body lines of a scan are joined to a stream and decoded by the cheapest path through a lattice of word
hypotheses - a word as read, with misrecognised characters, split, merged with its neighbour, or joined over a line end
with or without a hyphen of its own - under the word frequencies of the whole corpus. Only stretches with a word that the
corpus hardly knows have more than one path, so only they are searched. Paragraph boundaries of the repaired text are
chosen by dynamic programming.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise

# What a scanner reads for what was printed.
CONFUSIONS = {
    "c": "e", "f": "t", "1": "i l", "@": "a", "0": "o", "5": "s", "ii": "u", "rn": "m", "li": "h", "m": "in rn", "9": "g",
    "6": "b é", "vv": "w", "h": "li", "ﬁ": "fi", "ﬂ": "fl", "d": "cl", "cl": "d", "8": "b", "|": "l i", "$": "s",
}
# Kinds of paper named in running headers, and page words of the six languages.
PAPERS = "proposal form report memo survey handbook statement minutes receipt notice invoice policy letter contract".split()
PAGE_WORDS = "page seite página pagina pag pg blatt"
NUMBER = r"(?:[\dilIoO|]{1,3}|[ivxlIVXL]{1,8})"
PAGE = re.compile(rf"(?i)^[\W_]*(?:(?:{'|'.join(PAGE_WORDS.split())})\W{{0,3}}\s*{NUMBER}|{NUMBER})(?:\s*(?:/|of|von|de|di|sur)\s*{NUMBER})?[\W_]*$")
HEADER = re.compile(rf"^(?:{NUMBER}\s{{2,}})?(?P<org>\S+(?: \S+){{0,4}}) (?P<dash>\S) (?P<paper>\S{{3,11}})(?:\s{{2,}}{NUMBER})?$")
TIGHT_HEADER = re.compile(rf"^(?:{NUMBER}\s{{2,}})?(?P<org>\S+(?: \S+){{0,4}}?)(?P<dash>.?[—–].?)(?P<paper>\S{{3,11}})(?:\s{{2,}}{NUMBER})?$")
FILE_HEADER = re.compile(rf"^(?:{NUMBER}\s{{2,}})?[A-Z~|]\S+ (?P<file>\S{{4}}) \S.{{2,24}}?(?:\s{{2,}}{NUMBER}|\s/\s{NUMBER})$")
BREAK = re.compile(r"[^\W\d_][-­¬]$")
BROKEN = re.compile(r"\S*[-­¬]\n\S*")
EDGE = ".,;:!?()[]{}\"'«»„“”‘’…–—"
DIGIT = re.compile(r"[0-9]")
SURE = re.compile(r"^(?=.*[^\W\d_].*[^\W\d_])[^\W_]*[@01569|][^\W_]*$|^[^\W\d_]+[@][^\W\d_]*$")
ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|er|e|re|a|o|x|h|b)?$|^[a-z]{1,4}\d+$|^\d+[a-z]$")

TOP_WORDS = 300_000  # bound of the word frequencies sent to the workers; rarer words are looked up by a join
MIN_COUNT = 2
MAX_WORD = 64  # a longer run of characters is no word of any of the languages
LINE_WIDTH = 110  # of a printed page; nine in ten body lines of a scan are no wider
MEMO = 300_000  # bound of the remembered decisions of a worker
CONFUSION_COST = 2.5
NAME_COST = 0.7
UNKNOWN_COST = 4.0
SPLIT_COST = 5.0
MERGE_COST = 7.0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of every word of all distinct texts, pre-aggregated in the tasks; words cut by a line end are left out.

    Deliveries and copies of a text count once, so that a misread word does not become common by being copied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                if "\n" in t:
                    t = BROKEN.sub(" ", t)
                count.update([w.strip(EDGE) for w in t.lower().split()])
            if len(count) > 1_000_000:
                yield from emit(count)
                count.clear()
        yield from emit(count)

    def emit(count: Counter) -> Iterator[pa.RecordBatch]:
        words = [w for w in count if w and not DIGIT.search(w) and len(w) <= MAX_WORD]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([count[w] for w in words], pa.int64())], ["word", "n"])

    return texts.select("text").filter("text is not null").distinct().mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def readings(word: str, most: int = 2) -> dict[str, int]:
    """What a word may have been in print, with the number of misread characters (1 to most)."""
    out: dict[str, int] = {}
    front = {(word, 0)}
    for k in range(1, most + 1):
        after = set()
        for w, start in front:
            for i in range(start, len(w)):
                for seen in (w[i : i + 1], w[i : i + 2]):
                    for printed in CONFUSIONS.get(seen, "").split():
                        made = w[:i] + printed + w[i + len(seen) :]
                        if made not in out and made != word:
                            out[made] = k
                        after.add((made, i + len(printed)))
        front = after
    return out


class Recorder(dict):
    """Word frequencies that note which words were asked for in vain."""

    missed: set[str]

    def get(self, word, default=None):
        if word not in self:
            return default
        return self[word]

    def __contains__(self, word):
        found = super().__contains__(word)
        if not found and 0 < len(word) <= MAX_WORD:
            self.missed.add(word)
        return found


class Lexicon:
    """Costs of words under the corpus frequencies.

    cut: there are more words of MIN_COUNT than counts has. rare: what the join found on words outside counts, for a text.
    """

    def __init__(self, counts: dict[str, int], total: int, cut: bool = False, rare: dict[str, int] | None = None):
        self.counts, self.log_total, self.cut, self.rare = counts, math.log(max(2, total)), cut, rare
        self.memo: dict[tuple[str, bool], tuple[float, tuple[str, list[str]] | None]] = {}
        self.read: dict[tuple[str, bool], tuple[float, str] | None] = {}

    def recorder(self) -> Lexicon:
        """The same frequencies, with note of the words that are missing."""
        other = Lexicon(Recorder(self.counts), 2)
        other.log_total, other.counts.missed = self.log_total, set()
        return other

    def widened(self, rare: dict[str, int]) -> Lexicon:
        """With the rarer words of a text; those seen only once decide between open forms and nothing else."""
        more = {w: n for w, n in rare.items() if n >= MIN_COUNT}
        other = Lexicon(ChainMap(more, self.counts) if more else self.counts, 2, False, rare)
        other.log_total = self.log_total
        return other

    def decide(self, fixed: str, forms: list[str]) -> str:
        """The most frequent of the open forms, the first guess where none was ever seen."""
        return max(forms, key=lambda w: (self.rare.get(w, 0), w == fixed)) if forms and self.rare else fixed

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return self.log_total - math.log(n) if n else self.log_total + UNKNOWN_COST

    def best_reading(self, word: str, capital: bool = False) -> tuple[float, str] | None:
        """The cheapest known printed form of a word, if it is not the word as read."""
        key = (word, bool(capital))
        if key in self.read:
            return self.read[key]
        if len(self.read) >= MEMO:
            self.read.clear()
        best = None
        for made, k in readings(word).items():
            if len(made) > 1 and made in self.counts:
                c = self.cost(made) + k * (CONFUSION_COST + NAME_COST * capital)
                if best is None or (c, made) < best:
                    best = (c, made)
        self.read[key] = best
        return best


def plausible(paper: str) -> bool:
    """Whether a word is a kind of paper but for at most two misread characters."""
    low = paper.lower()
    return any(len(p) == len(low) and sum(a != b for a, b in zip(p, low)) <= (1 if len(p) < 6 else 2) for p in PAPERS)


def is_header(line: str) -> bool:
    m = FILE_HEADER.match(line)
    if m and sum(a != b for a, b in zip("file", m["file"])) <= 1:
        return True
    m = HEADER.match(line)
    if not m or not plausible(m["paper"]):
        m = TIGHT_HEADER.match(line)
    if not m or not plausible(m["paper"]) or len(m["dash"]) == 1 and m["dash"] not in "—–-~|ilc1.":
        return False
    words = m["org"].split()
    return all(any(c.isalpha() for c in w) for w in words) and sum(w[0].isupper() or w[0] in "~|ilc1." for w in words) == len(words)


class Scan:
    """The lines of a text with their part in the layout; body lines in order."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        bare = [x.strip() for x in self.lines]
        n = len(bare)
        furniture = [bool(x) and is_header(x) for x in bare]
        for i, x in enumerate(bare):
            if x and len(x) < 24 and not furniture[i] and PAGE.match(x):
                worded = x[:1].isalpha() and len(x) > 2 or x[:1] in "-[–—(" or "/" in x
                edge = i == 0 or i == n - 1 or not bare[i - 1] or not bare[i + 1] or is_header(bare[i - 1]) or is_header(bare[i + 1])
                alone = x.isalnum() or i > 0 and BREAK.search(bare[i - 1]) or "\f" in self.lines[i] or i + 1 < n and "\f" in self.lines[i + 1] or self.lines[i].startswith("   ")
                furniture[i] = bool(worded or edge or alone)
        self.furniture = [i for i in range(n) if furniture[i]]
        self.body = [i for i in range(n) if bare[i] and not furniture[i]]
        self.bare = bare
        long = [len(bare[i]) for i in self.body]
        runs = sum(1 for a, b in zip(self.body, self.body[1:]) if b == a + 1 and len(bare[a]) >= 25)
        self.wrapped = len(self.body) >= 3 and sum(x > LINE_WIDTH for x in long) * 10 <= len(long) and runs >= 2
        self.breaks = [(a, b) for a, b in zip(self.body, self.body[1:]) if BREAK.search(bare[a]) and bare[b][:1].isalnum()]
        self.scanned = self.wrapped and bool(self.furniture or self.breaks)


def maybe_scanned(text: str) -> bool:
    return text.count("\n") >= 3


def halves(scan: Scan, a: int, b: int) -> tuple[str, str, str]:
    """(left half, mark, right half) of the word broken between two body lines, lower case."""
    left, right = scan.bare[a].split()[-1], scan.bare[b].split()[0]
    return left[:-1].lower().lstrip(EDGE), left[-1], right.lower().rstrip(EDGE)


def joined_word(left: str, mark: str, right: str, lex: Lexicon) -> tuple[str, list[str]]:
    """The whole word, and the forms between which only rarer words can decide."""
    plain, own = left + right, f"{left}-{right}"
    forms = [plain] if mark != "-" else [plain, own]
    known = [(lex.cost(w), w) for w in forms if w in lex.counts]
    read = [(c, w) for w in forms if (r := lex.best_reading(w)) for c, w in [r]]
    best = min(known + [(c, w) for c, w in read], default=None)
    if best is not None:
        return best[1], []
    return plain, forms


def misread(token: str, lex: Lexicon) -> tuple[str, list[str]] | None:
    """(word meant, forms still to be looked up) if a token is taken for misread, else None."""
    return single(token, lex)[1]


def single(token: str, lex: Lexicon) -> tuple[float, tuple[str, list[str]] | None]:
    """(cost, misread(token)) of the cheaper of a token as read and as misread; what is no word costs nothing as read."""
    key = (token.lower().strip(EDGE), token[:1].isupper() and not token.isupper())
    if key not in lex.memo:
        if len(lex.memo) >= MEMO:
            lex.memo.clear()
        lex.memo[key] = single_word(*key, lex)
    return lex.memo[key]


def single_word(word: str, capital: bool, lex: Lexicon) -> tuple[float, tuple[str, list[str]] | None]:
    """single() of a bare word in lower case; a known word is misread only if a reading is common enough against it."""
    plain = (lex.cost(word) if word.isalpha() else 0.0), None
    if len(word) < 2 or len(word) > MAX_WORD or "/" in word or ORDINAL.match(word) or sum(c.isdigit() for c in word) > 3:
        return plain
    if "@" in word and ("." in word.partition("@")[2] or word[0] == "@" and not lex.counts.get("a" + word[1:])):
        return plain
    sure = SURE.match(word) is not None
    if not sure and DIGIT.search(word):
        return plain
    if not any(seen in word for seen in CONFUSIONS):
        return plain
    best = lex.best_reading(word, capital)
    here = lex.cost(word) if not sure else lex.log_total + UNKNOWN_COST + 6
    if best is not None and best[0] < here:
        return best[0], (best[1], [])
    if sure and len(word) >= 5 and sum(c.isalpha() for c in word) >= 4 and sum(not c.isalpha() for c in word) == 1:
        forms = [w for w, k in readings(word, 1).items() if w.isalpha()]
        if forms:
            return here, (forms[0], forms)
    return (here if sure else plain[0]), None


def split_or_merged(tokens: list[str], lex: Lexicon) -> list[str]:
    """The words of a line on the cheapest path."""
    return [w for edge in cheapest(tokens, [False] * len(tokens), lex) for w in edge.words]


class Edge(NamedTuple):
    """A word hypothesis over tokens first to last - 1: the printed words, and (word meant, open forms) of the misread ones."""

    first: int
    last: int
    words: list[str]
    misread: list[tuple[str, list[str]]]
    hyphen: bool = False


def alone(i: int, token: str, lex: Lexicon) -> tuple[float, Edge]:
    cost, found = single(token, lex)
    return cost, Edge(i, i + 1, [dress(token, lex.decide(*found)) if found else token], [found] if found else [])


def known_as(word: str, capital: bool, lex: Lexicon) -> tuple[float, str] | None:
    """(cost, word meant) of a word as read or as misread, if the corpus has it."""
    options = [(lex.cost(word), word)] if word in lex.counts else []
    best = lex.best_reading(word, capital)
    return min(options + ([best] if best else []), default=None)


def cheapest(tokens: list[str], cut: list[bool], lex: Lexicon) -> list[Edge]:
    """The cheapest path over a stream of tokens: each as read, misread, split in two, merged with the next, and each of
    these also with misread characters. cut: the token is broken off at a line end and goes on in the next; such words are
    joined, with or without a hyphen of their own.
    """
    n = len(tokens)
    plain = [t.lower().strip(EDGE) for t in tokens]
    odd = [not c and (p.isalpha() or SURE.match(p) is not None) and p not in lex.counts for p, c in zip(plain, cut)]
    tail = [i > 0 and cut[i - 1] for i in range(n)]
    best: list[tuple[float, Edge | None]] = [(0.0, None)] + [(math.inf, None)] * n

    def relax(cost: float, edge: Edge) -> None:
        if best[edge.first][0] + cost < best[edge.last][0]:
            best[edge.last] = (best[edge.first][0] + cost, edge)

    for i in range(n):
        if best[i][0] == math.inf:
            continue
        if cut[i] and i + 1 < n:
            relax(*joined(i, tokens, cut, lex))
            continue
        relax(*alone(i, tokens[i], lex))
        p, capital = plain[i], tokens[i][:1].isupper() and not tokens[i].isupper()
        if odd[i] and len(p) <= MAX_WORD:
            at = tokens[i].lower().find(p)
            for k in range(2, len(p) - 1):
                a, b = (known_as(p[:k], capital, lex), known_as(p[k:], False, lex)) if p[:k] in lex.counts or p[k:] in lex.counts else (None, None)
                if a and b:
                    halves = [(tokens[i][: at + k], p[:k], a[1]), (tokens[i][at + k :], p[k:], b[1])]
                    relax(a[0] + b[0] + SPLIT_COST, Edge(i, i + 1, [t if w == m else dress(t, m) for t, w, m in halves], [(m, []) for _, w, m in halves if w != m]))
        if i + 1 < n and not cut[i + 1] and (odd[i] or odd[i + 1]) and tokens[i][-1:].isalnum() and tokens[i + 1][:1].isalnum():
            q = plain[i + 1]
            if all(odd[j] or plain[j].isalpha() for j in (i, i + 1)) and (found := known_as(p + q, capital, lex)):
                whole = tokens[i] + tokens[i + 1]
                relax(found[0] + MERGE_COST, Edge(i, i + 2, [whole if found[1] == p + q else dress(whole, found[1])], [] if found[1] == p + q else [(found[1], [])]))
    out, j = [], n
    while j:
        edge = best[j][1]
        out.append(edge)
        j = edge.first
    return out[::-1]


def joined(i: int, tokens: list[str], cut: list[bool], lex: Lexicon) -> tuple[float, Edge]:
    """The edge of a word broken at one or more line ends."""
    j = i + 1
    while cut[j] and j + 1 < len(tokens):
        j += 1
    head = "".join(t[:-1] for t in tokens[i:j])
    found = joined_word(head.lower().lstrip(EDGE), tokens[j - 1][-1], tokens[j].lower().rstrip(EDGE), lex) if j == i + 1 else joined_word(head.lower().lstrip(EDGE), "", tokens[j].lower().rstrip(EDGE), lex)
    return 0.0, Edge(i, j + 1, [dress(head + tokens[j], lex.decide(*found))], [found], True)


class Decoded:
    """A text with the cheapest path over its de-lined body, from which faults and the repaired text are read."""

    def __init__(self, text: str, lex: Lexicon):
        self.text, self.scan = text, Scan(text)
        self.tokens, self.line, self.edges = [], [], []
        if not self.scan.wrapped:
            return
        cut_lines = {a for a, _ in self.scan.breaks}
        cut = []
        for i in self.scan.body:
            words = self.scan.bare[i].split()
            self.tokens += words
            self.line += [i] * len(words)
            cut += [False] * (len(words) - 1) + [i in cut_lines]
        self.edges = cheapest(self.tokens, cut, lex) if self.scan.scanned else [alone(k, t, lex)[1] for k, t in enumerate(self.tokens)]

    def faults(self) -> list[tuple[int, str, str, list[str]]]:
        out = [(i + 1, "furniture", "", []) for i in self.scan.furniture] if self.scan.scanned else []
        for e in self.edges:
            read = "".join(self.tokens[e.first : e.last])
            if e.hyphen:
                parts = self.tokens[e.first : e.last]
                if all(t.strip(EDGE + "-­¬") for t in parts) and sum(c.isdigit() for c in read) <= 2 and "/" not in read:
                    out += [(self.line[k] + 1, "hyphen", *e.misread[0]) for k in range(e.first, e.last - 1)]
            elif self.scan.scanned or DIGIT.search(read) or "@" in read:
                out += [(self.line[e.first] + 1, "misread", *m) for m in e.misread]
        return out


def faults(text: str, lex: Lexicon) -> list[tuple[int, str, str, list[str]]]:
    """(line_no, kind, fixed, forms still to be looked up) of every fault of a scanned text."""
    return Decoded(text, lex).faults()


def paragraph_breaks(lines: list[str], gaps: list[bool], pages: list[bool]) -> list[bool]:
    """Whether a paragraph ends after each body line, by dynamic programming over breaks and joins.

    gaps: a blank line follows; pages: page furniture follows. A break is cheap at a blank line after an ended sentence and
    dear inside a sentence; a paragraph of one short line costs extra.
    """
    n = len(lines)
    if not n:
        return []
    ended = [x.rstrip()[-1:] in ".!?:" for x in lines]
    width = max(map(len, lines))
    cost_break, cost_join = [], []
    for i in range(n):
        starts = i + 1 < n and lines[i + 1][:1].islower()
        cost_break.append((0 if ended[i] else 6) + (4 if pages[i] else 0 if gaps[i] else 5) + (6 if starts else 0))
        cost_join.append((5 if gaps[i] and not pages[i] else 2 if gaps[i] else 0) + (1 if ended[i] and len(lines[i]) < 0.6 * width else 0))
    best = [(0.0, -1)] * (n + 1)  # best[j]: cost and start of the last paragraph where the first j lines end with one
    longer = (math.inf, -1)  # the same for a paragraph of two lines or more that is still open
    for j in range(1, n + 1):
        if j > 1:
            step = cost_join[j - 2]
            longer = min((best[j - 2][0] + step, 2 - j), (longer[0] + step, longer[1]))  # of equals the shorter paragraph
        single = best[j - 1][0] + (2.0 if len(lines[j - 1]) < 0.4 * width else 0.0)
        cost, start = (single, j - 1) if single <= longer[0] else (longer[0], -longer[1])
        best[j] = (cost + (cost_break[j - 1] if j < n else 0), start)
    ends, j = [False] * n, n
    while j:
        ends[j - 1] = True
        j = best[j][1]
    return ends


def repair(text: str, lex: Lexicon) -> str:
    """Continuous paragraphs of a scanned text; a text that is no scan comes back unchanged."""
    return repaired(Decoded(text, lex))


def repaired(d: Decoded) -> str:
    scan = d.scan
    if not scan.scanned:
        return d.text
    words: dict[int, list[str]] = {i: [] for i in scan.body}
    for e in d.edges:
        words[d.line[e.first]] += e.words
    lines, gaps, pages, furniture = [], [], [], set(scan.furniture)
    for k, i in enumerate(scan.body):
        follow = scan.body[k + 1] if k + 1 < len(scan.body) else len(scan.lines)
        between = range(i + 1, follow)
        lines.append(" ".join(words[i]))
        gaps.append(any(not scan.bare[x] for x in between))
        pages.append(any(x in furniture for x in between))
    keep = [x for x in range(len(lines)) if lines[x]]
    lines, gaps, pages = [lines[x] for x in keep], [gaps[x] for x in keep], [pages[x] for x in keep]
    out, part = [], []
    for line, end in zip(lines, paragraph_breaks(lines, gaps, pages)):
        part.append(line)
        if end:
            out.append(" ".join(part))
            part = []
    return "\n\n".join(out)


def dress(token: str, word: str) -> str:
    """A repaired word with the outer marks and the letter case of what was read."""
    core = token.strip(EDGE + "-­¬")
    at = token.find(core) if core else 0
    made = word.upper() if core.isupper() and len(core) > 1 else word.capitalize() if core[:1].isupper() else word
    return token[:at] + made + token[at + len(core) :]


def shared_lexicon(texts: DataFrame) -> tuple[DataFrame, Lexicon]:
    """(table of all words, the TOP_WORDS most frequent of at least MIN_COUNT)."""
    table = materialise(word_counts(texts), "words")
    total = table.agg(F.sum("n")).collect()[0][0] or 1
    top = table.filter(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").limit(TOP_WORDS).toPandas()
    return table, Lexicon(dict(zip(top.word, top.n.tolist())), int(total), len(top) >= TOP_WORDS)


def wanted(text: str, forms: list[list[str]], lex: Lexicon, recorder: Lexicon | None) -> list[str]:
    """The words whose frequency a text needs besides the shared ones: open forms, and every word missed where there are more."""
    words = {w for f in forms for w in f}
    if recorder is not None:
        recorder.counts.missed.clear()
        recorder.memo.clear()
        recorder.read.clear()
        Decoded(text, recorder)
        words |= recorder.counts.missed
    return sorted(words)


def decoded(texts: DataFrame, make: Callable[[str, Lexicon, Decoded | None], list[tuple]], columns: str) -> DataFrame:
    """(file_id, columns) of make(text, lexicon, decoded) for every text; null texts give one row of nulls.

    Texts for which the shared frequencies are enough are done at once. The others wait, their missing words are joined
    with the table of all words, and they are done with what was found; only they are shuffled.
    """
    table, lexicon = shared_lexicon(texts)
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("file_id", pa.int64()), *((c.split()[0], {"bigint": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in columns.split(", "))])
    waiting = pa.schema([*schema, ("text", pa.string()), ("wanted", pa.list_(pa.string()))])

    def batch(rows: list[tuple], names: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(names)], schema=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        recorder = lex.recorder() if lex.cut else None
        none = (None,) * (len(schema) - 1)
        for b in batches:
            rows = []
            for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()):
                if t is None:
                    rows.append((i, *none, None, None))
                    continue
                d = Decoded(t, lex) if maybe_scanned(t) else None
                words = wanted(t, [m[1] for e in d.edges for m in e.misread], lex, recorder) if d else []
                rows += [(i, *none, t, words)] if words else [(i, *r, None, None) for r in make(t, lex, d)]
            yield batch(rows, waiting)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, found in zip(*[b.column(c).to_pylist() for c in ("file_id", "text", "found")]):
                lex = shared.value.widened({x["word"]: x["n"] for x in found or []})
                rows += [(i, *r) for r in make(t, lex, Decoded(t, lex))]
            yield batch(rows, schema)

    names = f"file_id bigint, {columns}"
    first = materialise(texts.select("file_id", "text").mapInArrow(run, f"{names}, text string, wanted array<string>"), "decoded")
    late = first.filter("text is not null").select("file_id", "text", "wanted", F.sha2("text", 256).alias("text_key"))
    found = late.select("text_key", F.explode("wanted").alias("word")).distinct().join(table, "word").groupBy("text_key").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    second = late.select("file_id", "text", "text_key").join(found, "text_key", "left").select("file_id", "text", "found").mapInArrow(again, names)
    return first.filter("text is null").drop("text", "wanted").unionByName(second)


def scan_faults(texts: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, fixed) of every fault in texts that went through a scanner.

    texts: (file_id, text); further columns are ignored. Scans are told by their layout: lines of bounded width with page
    furniture or words broken at line ends. Null and empty texts give no row, repeated rows count once, empty tables give
    an empty result. Words outside the shared frequencies are decided by a join with the table of all words.
    """

    def make(text: str, lex: Lexicon, d: Decoded | None) -> list[tuple]:
        return [f[:2] + (lex.decide(f[2], f[3]),) for f in d.faults()] if d else []

    source = texts.filter("file_id is not null and text is not null")
    return decoded(source, make, "line_no bigint, kind string, fixed string").distinct()


def repaired_texts(texts: DataFrame) -> DataFrame:
    """(file_id, repaired): each text that is a scan as continuous paragraphs; other texts unchanged. One row an input row."""

    def make(text: str, lex: Lexicon, d: Decoded | None) -> list[tuple]:
        return [(repaired(d) if d else text,)]

    return decoded(texts, make, "repaired string")

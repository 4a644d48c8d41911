"""Personal data in plain and in disguised form, with spans in the original text.

Plain finds come from four patterns on the text as it is.  A chain of transducers then rewrites the text and
remembers for every character which source characters it stands for:

1. invisible characters are dropped, look-alike letters, digits and signs become their ASCII forms;
2. ``(at)``, ``[dot]`` and the like, and ``name at host dot tld`` in words, become ``@`` and ``.``;
3. runs of spelled digits (with ``plus``, ``dot``, ``double``, ``triple``) become digits.

The same patterns run on each rewritten text, and what they find is mapped back to source characters.
Plain finds stay as they are.  A disguised find is added unless its span is equal to or inside that of a plain find
or of an earlier disguised one; so a whole identifier is listed beside a shorter plain match in it.

Spans are in code points, end exclusive.  Defined results: null is the empty text and has no finds;
repeated rows are treated alike; columns other than id and text are not read; an empty table gives an
empty result.  All patterns take time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handing_back, text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that isn't followed by three more groups fails at each of its digits, so only its first is tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LUHN = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(LUHN[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@label(.label)+, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            yield "email", start, done
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def plain(text: str) -> list[Span]:
    """The finds of the four patterns, by kind as listed, then start."""
    found = list(emails(text))
    if any(map(text.__contains__, "0123456789")):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


class Tape:
    """A rewritten text; character i stands for source characters begin[i] to end[i] - 1."""

    def __init__(self, text: str, begin: list[int] | range, end: list[int] | range):
        self.text, self.begin, self.end = text, begin, end

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewritten(self, parts: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, new) of the text replaced; every new character stands for the whole part."""
        text, begin, end, at = [], [], [], 0
        for start, stop, new in [*parts, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start])
            begin += self.begin[at:start]
            end += self.end[at:start]
            if new:
                text.append(new)
                begin += [self.begin[start]] * len(new)
                end += [self.end[stop - 1]] * len(new)
            at = stop
        return Tape("".join(text), begin, end)

    def source(self, span: Span) -> Span:
        kind, start, end = span
        return kind, self.begin[start], self.end[end - 1]


def _range(first: int, count: int, ascii_first: str) -> dict[str, str]:
    return {chr(first + i): chr(ord(ascii_first) + i) for i in range(count)}


#: Characters that pass for ASCII ones.
LOOKALIKES = (
    _range(0xFF10, 10, "0") | _range(0xFF21, 26, "A") | _range(0xFF41, 26, "a")  # full width
    | _range(0x0660, 10, "0") | _range(0x06F0, 10, "0") | _range(0x0966, 10, "0")  # Arabic-Indic, Devanagari digits
    | {chr(0x1D400 + 52 * s + i): chr((65 if i < 26 else 71) + i) for s in range(13) for i in range(52)}  # mathematical letters
    | {chr(0x1D7CE + i): chr(48 + i % 10) for i in range(50)}  # mathematical digits
    | dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXYIJS", strict=True))  # Cyrillic
    | dict(zip("οανιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaviptukABEZHIKMNOPTYX", strict=True))  # Greek
    | dict.fromkeys("＠﹫", "@") | dict.fromkeys("．。․﹒", ".") | dict.fromkeys("＋﹢", "+") | dict.fromkeys("－﹣‐‑‒–—−", "-") | {"（": "(", "）": ")", "＿": "_"}
)
#: Characters without a width, and blanks that pass for a space.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"
BLANKS = dict.fromkeys("\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
MAP = LOOKALIKES | BLANKS
ODD = re.compile(f"[{re.escape(''.join(MAP))}{INVISIBLE}]")
ODD_LATIN = [c for c in (*MAP, *INVISIBLE) if c < "\u0100"]


def is_odd(text: str) -> bool:
    """Whether unmask would change the text."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ODD.search(text) is not None
    return any(map(text.__contains__, ODD_LATIN))


def unmask(tape: Tape) -> Tape:
    """Look-alikes to ASCII, invisible characters away."""
    return tape.rewritten([(m.start(), m.end(), MAP.get(m[0], "")) for m in ODD.finditer(tape.text)])


_AT = r"[ \t]?[\[({<][ \t]?(?:at|@)[ \t]?[\])}>][ \t]?"
_DOT = r"[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?"
BRACKET = re.compile(r"[\[({<][ \t]?(?:[aA][tT]|@|[dD][oO][tT]|\.)[ \t]?[\])}>]")
BRACKETED = re.compile(f"(?P<at>{_AT})|(?P<dot>{_DOT})", re.IGNORECASE)
#: Last labels that make "name at host dot tld" an address without further signs: any two letters or one of these.
TOP_LEVEL = re.compile("com|net|org|edu|gov|mil|int|info|biz|app|dev|name|online|site|xyz|shop|store|tech|cloud|blog|email|agency|academy|digital|global|group|health|museum|network|news|software|solutions|studio|support|systems|website|[a-z]{2}", re.IGNORECASE)
AT = re.compile(r"(?<![ \t])[ \t]++at[ \t]++|@", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:[ \t]++dot[ \t]++|\.)[A-Za-z0-9-]++)*+", re.IGNORECASE)
#: The part before the at, read from its end.
LOCAL_BACK = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:[ \t]++tod[ \t]++|\.)[A-Za-z0-9_%+-]++)*+", re.IGNORECASE)
#: Words that announce an address, as parts of a word, and words that may stand between.
CUES, BETWEEN = ("mail", "address", "contact", "reach"), frozenset("is to me us him her them".split())
WORDED = re.compile(r"(?<![ \t])[ \t]++(dot|at)[ \t]++", re.IGNORECASE)
DOTTED = re.compile(r"[ \t]dot[ \t]", re.IGNORECASE)
BARE = re.compile(r"[ \t]at[ \t]++[A-Za-z0-9-]++\.[A-Za-z]", re.IGNORECASE)
SIGNED = re.compile(r"[0-9._%+-]|[ \t]dot[ \t]", re.IGNORECASE)


LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def back_over(text: str, stop: int, start: int, signs: frozenset[str] | str) -> int:
    """Where the run of signs that ends at ``stop`` begins, not before ``start``."""
    while stop > start and text[stop - 1] in signs:
        stop -= 1
    return stop


def announced(text: str, stop: int, start: int) -> bool:
    """Whether the words before ``stop`` (from ``start`` on) end with one of CUES, words of BETWEEN and blanks passed over."""
    while True:
        end = back_over(text, stop, start, " \t:")
        stop = back_over(text, end, start, LETTERS)
        word = text[stop:end].lower()
        if end == stop or word not in BETWEEN:
            return any(cue in word for cue in CUES)


def is_address(text: str, start: int, m: re.Match, stop: int, done: int) -> bool:
    """Whether what lies before and behind an at (the match), from start to stop, makes an address; what comes before ``done`` is not looked at.

    The last label is of two letters or more.  An @ or a dot in words speaks for an address under a label of TOP_LEVEL.  Otherwise (any
    label, or plain dots after a bare "at") something else must: a sign or digit in the local part, or a word like mail before it.
    """
    label = text[back_over(text, stop, m.end(), LETTERS) : stop]
    before = text[stop - len(label) - 1]
    if len(label) < 2 or len(label) >= stop - m.end() or before not in ". \t" or m.start() - start + stop - m.end() < 4:
        return False
    if (m[0] == "@" or DOTTED.search(text, m.end(), stop)) and TOP_LEVEL.fullmatch(label):
        return True
    return bool(SIGNED.search(text, start, m.start())) or (start > done and text[start - 1] in " \t:" and announced(text, start, done))


def spoken(text: str) -> list[tuple[int, int]]:
    """Spans of addresses with an "at" or a dot in words: from each at, its neighbours to both sides.  Takes time linear in the text."""
    found, done, host_end, seen, last = [], 0, 0, 0, 0
    for m in AT.finditer(text):
        if m.start() < done:
            continue
        seen, last = last, m.end()  # a cue lies behind the at before
        host = HOST.match(text, m.end()) if m.end() >= host_end else None
        stop = host.end() if host else host_end if m.end() < host_end else m.end()
        host_end = max(host_end, stop)
        back = LOCAL_BACK.match(text[done : m.start()][::-1])
        if back and stop > m.end():
            start = m.start() - back.end()
            if is_address(text, start, m, stop, seen):
                found.append((start, stop))
                done = stop
                continue
        done = max(done, m.start())
    return found


def unspoken(tape: Tape) -> Tape:
    """(at) and [dot], then name at host dot tld."""
    if BRACKET.search(tape.text):
        tape = tape.rewritten([(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETED.finditer(tape.text)])
    if DOTTED.search(tape.text) or BARE.search(tape.text):
        parts = []
        for start, stop in spoken(tape.text):
            parts += [(w.start(), w.end(), "@" if w[1].lower() == "at" else ".") for w in WORDED.finditer(tape.text, start, stop)]
        tape = tape.rewritten(parts)
    return tape


#: Spelled digits and the signs between them.
DIGIT = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "nought": "0"}
SIGN = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}
TIMES = {"double": 2, "triple": 3}
_WORD = "|".join([*DIGIT, *SIGN, *TIMES])
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:\+[ ]?)?(?:{_WORD}|[0-9]+)(?:(?:[ ,.-]|, )(?:{_WORD}|[0-9]+))+(?![A-Za-z0-9])", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
WRITTEN = (*DIGIT, *SIGN)


def may_be_spelled(text: str) -> bool:
    return any(map(text.lower().__contains__, WRITTEN))


def unspelled(tape: Tape) -> Tape:
    """Runs with a digit and a spelled digit or sign become digits without the blanks between them; signs stay.

    With fewer than three spelled digits, groups of plain digits keep what is between them.
    """
    if not may_be_spelled(tape.text):
        return tape
    parts = []
    for m in SPELLED.finditer(tape.text):
        tokens = [(t.start(), t.end(), t[0].lower()) for t in TOKEN.finditer(m[0])]
        spelled = sum(t in DIGIT for _, _, t in tokens)
        if not (spelled or any(t in SIGN and t.isalpha() for _, _, t in tokens) and any(t.isdigit() for _, _, t in tokens)):
            continue
        times, held = 1, None
        for k, (a, b, t) in enumerate(tokens):
            a, b = a + m.start(), b + m.start()
            if t in TIMES:
                times, held = TIMES[t], a if held is None else held
            elif t in DIGIT:
                parts.append((a if held is None else held, b, DIGIT[t] * times))
                times, held = 1, None
            elif t in SIGN:
                parts.append((a, b, SIGN[t]))
                times, held = 1, None
            elif t.isdigit():
                if held is not None:
                    parts.append((held, b, t[0] * times + t[1:]))
                times, held = 1, None
            elif t == "+ ":
                parts.append((a, b, "+"))
            elif held is None and not t.strip(" ,") and (spelled >= 3 or not (tokens[k - 1][2].isdigit() and tokens[k + 1][2].isdigit())):
                parts.append((a, b, ""))
    return tape.rewritten(parts)


class Cover:
    """Spans none of which lies in another, by start and so by end too; a lookup takes logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.begin, self.end = [], []
        for span in sorted(spans, key=lambda s: (s[1], -s[2])):
            self.add(span)

    def add(self, span: Span) -> bool:
        """Whether the span is equal to or inside none of these, which it then joins in place of those inside it."""
        _, a, b = span
        i = bisect_right(self.begin, a)
        if i and self.end[i - 1] >= b:
            return False
        first, last = bisect_left(self.begin, a), bisect_right(self.end, b)
        self.begin[first:last], self.end[first:last] = [a], [b]
        return True


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Finds in the rewritten texts that lie in no plain find and no earlier one, in source positions."""
    tape, taken, added = Tape.of(text), Cover(base), []
    for step in (unmask, unspoken, unspelled) if is_odd(text) else (unspoken, unspelled):
        after = step(tape)
        if after.text == tape.text:
            continue
        tape = after
        for span in map(tape.source, plain(tape.text)):
            if taken.add(span):
                added.append(span)
    return added


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain finds and all finds, each by kind as listed, then start."""
    base = plain(text or "")
    added = disguised(text, base) if text else []
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digests(docs: DataFrame, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, counts of plain finds by kind, digest of the plain spans, all spans, and how many are disguised ones."""

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
    @handing_back
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in text_slices(batch):
                for base, every in map(find, texts):
                    kinds = [k for k, _, _ in base]
                    rows.append((*map(kinds.count, KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])

    found = docs.select(F.struct(*keep).alias("kept"), scan(F.col(text).cast("string")).alias("found"))
    return found.select("kept.*", "found.*")


def redacted(text: str | None) -> str | None:
    """The text with every find, plain or disguised, replaced by its kind in angle brackets; overlapping finds become one."""
    if not text:
        return text
    _, spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; a null text stays null."""

    @F.arrow_udf("string")
    @handing_back
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([redacted(t) for t in texts], pa.string()) for texts in text_slices(batch)]
            yield pc.if_else(batch.is_valid(), pa.concat_arrays(parts), None) if parts else pa.array([], pa.string())

    return docs.withColumn(text, clean(F.col(text)))

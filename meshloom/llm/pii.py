"""Operator 4 - personal data with offset-preserving deobfuscation.

Detectors for e-mail addresses, IPv4 addresses, payment cards and phone numbers
run over the text as it is; these are the base spans. Then three transducers
rewrite it, each carrying for every character of its output the source
characters that it stands for:

1. homoglyphs: look-alike letters and full-width forms become ASCII, in tokens
   that are ASCII otherwise;
2. spelled digits: a run of four or more digit words (or digits and digit words)
   becomes digits, a leading "plus" a "+";
3. at and dot disguises: "(at)", "[dot]" and the like, and "name at host dot tld",
   become "@" and ".". "name at mail.example.org", its dots written out, is left alone:
   prose names hosts like that.

The detectors run again over the result, and every span found is mapped back to
the source characters it covers. Spans that overlap no base span are added; base
spans always stay. Texts in which no transducer's own pattern is found skip that part.

Detectors are linear in the text: a candidate is a maximal run, found once, so a
very long run of digits or letters costs no more than other text, and texts are read
whole. Everything happens within a row; nothing is shuffled. Null and empty texts have no
spans; a null id is kept, repeated rows are answered each, spans of one start are in the
order of kind and end. An empty table gives no rows. Other columns are unused, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(t: str) -> Iterator[Span]:
    at, floor = t.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        floor = m.end() if m else at + 1
        at = t.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _ips(t: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(t):
        parts = m[0].split(".")
        at = m.start()
        while len(parts) >= 4:
            four, parts = parts[:4], parts[4:]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(t: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def _phones(t: str) -> Iterator[Span]:
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def detect(t: str) -> list[Span]:
    """Base spans, by kind as in KINDS, then by start."""
    return [*_emails(t), *_ips(t), *_cards(t), *_phones(t)]


# Look-alikes of ASCII letters and signs, source then target.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝкмтвАВЕКМНОРСТУХІЈЅαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。‑–—＠",
                       "aeopcyxijsdhqwkmtbABEKMHOPCTYXIJSaovptuikABEZHIKMNOPTYX..---@"))
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_OF = {w: str(d) for d, w in enumerate(DIGIT_WORDS)} | {"oh": "0"}
_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "！-～]")
_ONE = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9]+)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ \-]+)?{_ONE}(?:[ \-.,]{{1,2}}{_ONE}){{3,}}(?![A-Za-z0-9])", re.IGNORECASE)
_PIECE = re.compile(r"[A-Za-z]+|[0-9]")
_BRACKET = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(at|@|dot|punkt|punto|point|\.)\s*[\])}>]\s*", re.IGNORECASE)
_PLAIN = re.compile(r"[A-Za-z0-9._%+-]( at )[A-Za-z0-9-]+((?: dot [A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.IGNORECASE)


class Tape:
    """A text and, for every character, the source range it stands for."""

    def __init__(self, text: str, lo: list[int] | None = None, hi: list[int] | None = None):
        self.text = text
        self.lo = list(range(len(text))) if lo is None else lo
        self.hi = list(range(1, len(text) + 1)) if hi is None else hi

    def rewrite(self, edits: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> Tape:
        """Replace [a, b) by text; each new character stands for the whole range,
        or for its own range where ranges are given."""
        out, lo, hi, at = [], [], [], 0
        for a, b, new, ranges in edits:
            out.append(self.text[at:a])
            lo += self.lo[at:a]
            hi += self.hi[at:a]
            out.append(new)
            for k in range(len(new)):
                x, y = ranges[k] if ranges else (a, b)
                lo.append(self.lo[x])
                hi.append(self.hi[y - 1])
            at = b
        out.append(self.text[at:])
        return Tape("".join(out), lo + self.lo[at:], hi + self.hi[at:])


def _plain_char(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return c


def _homoglyphs(tape: Tape) -> Tape:
    edits = []
    for m in re.finditer(r"\S+", tape.text):
        new = "".join(map(_plain_char, m[0]))
        if new != m[0] and new.isascii() and any(c.isascii() and c.isalnum() or unicodedata.category(c) == "Nd"
                                                 or "！" <= c <= "～" for c in m[0]):
            edits += [(m.start() + i, m.start() + i + 1, n, None) for i, (c, n) in enumerate(zip(m[0], new)) if c != n]
    return tape.rewrite(edits) if edits else tape


def _spelled(tape: Tape) -> Tape:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        new, ranges, words = "", [], 0
        for p in _PIECE.finditer(m[0]):
            w = p[0].lower()
            words += w.isalpha() and w != "plus"
            new += "+" if w == "plus" else _DIGIT_OF.get(w, w)
            ranges.append((m.start() + p.start(), m.start() + p.end()))
        if words >= 4:
            edits.append((m.start(), m.end(), new, ranges))
    return tape.rewrite(edits) if edits else tape


def _at_dot(tape: Tape) -> Tape:
    edits = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".", None)
             for m in _BRACKET.finditer(tape.text)]
    tape = tape.rewrite(edits) if edits else tape
    edits = []
    for m in _PLAIN.finditer(tape.text):
        edits.append((m.start(1), m.end(1), "@", None))
        edits += [(m.start(2) + d.start(), m.start(2) + d.end(), ".", None)
                  for d in re.finditer(r" dot ", m[2], re.IGNORECASE)]
    return tape.rewrite(edits) if edits else tape


def _triggers(t: str) -> bool:
    """True if any transducer would change the text; by their own patterns, as a
    narrower test would lose spans."""
    return bool(not t.isascii() and _ODD.search(t) or _BRACKET.search(t) or _PLAIN.search(t) or _SPELLED.search(t))


def find(t: str) -> tuple[list[Span], list[Span]]:
    """Base spans and spans added by deobfuscation, both in source offsets."""
    base = detect(t)
    if not _triggers(t):
        return base, []
    tape = _at_dot(_spelled(_homoglyphs(Tape(t))))
    if tape.text == t:
        return base, []
    taken = [(s, e) for _, s, e in base]
    added = []
    for kind, s, e in detect(tape.text):
        a, b = tape.lo[s], tape.hi[e - 1]
        if all(b <= x or a >= y for x, y in taken):
            added.append((kind, a, b))
            taken.append((a, b))
    return base, added


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column(1).to_pylist():
            base, added = find(t or "")
            rows.append([{"kind": k, "start": s, "end": e, "added": False} for k, s, e in base]
                        + [{"kind": k, "start": s, "end": e, "added": True} for k, s, e in added])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], names=["id", "found"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and found: array of (kind, start, end, added), code points, end exclusive."""
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
            .mapInArrow(_scan, "id long, found array<struct<kind:string,start:long,end:long,added:boolean>>")
            .withColumnRenamed("id", id_col))


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    base, added = find(text)
    out, at = [], 0
    for k, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join(out) + text[at:]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))

    def digest(keep) -> Column:
        ordered = F.array_sort(F.transform(keep, lambda x: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"),
            x["end"].alias("e"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
            ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: ~x["added"])
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"))

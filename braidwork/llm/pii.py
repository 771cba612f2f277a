"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Edge cases: a null text counts as empty and has no spans; repeated rows are scanned separately; other columns are
neither read nor changed; an empty table gives an empty result. Whole texts are scanned, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The patterns, in the order in which kinds are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Tighter forms, sought again within matches that a check has refused.
CARD_AGAIN = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
PHONE_AGAIN = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Scores before the context is read, and words that raise or lower them when they stand within REACH characters before a span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
RAISE = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto")}
LOWER = ("version", "order", "invoice", "isbn", "serial", "example", "test")
STEP, REACH, KEEP = 0.15, 40, 0.5


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _card(match: str) -> bool:
    return 16 <= len(d := _digits(match)) <= 19 and luhn(d)


def _phone(match: str) -> bool:
    return 8 <= len(_digits(match)) <= 15


def _ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, found from each @ backwards so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _score(kind: str, text: str, start: int) -> float:
    near = set(re.findall("[a-z]+", text[max(0, start - REACH) : start].lower()))
    return PRIOR[kind] + STEP * (any(w in near for w in RAISE[kind]) - any(w in near for w in LOWER))


def find(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as in KINDS, then start; positions in code points, ends exclusive.

    Base spans pass their kind's check and stay whatever their score. The others come from a second look into refused
    card and phone matches and from IBANs; they need their checksum or length, and a score of KEEP or more.
    """
    if not text:
        return []
    found = [("email", s, e, True) for s, e in _emails(text)]
    more = []
    for kind, pattern, valid, again in (("ip", IP, _ip, None), ("card", CARD, _card, CARD_AGAIN), ("phone", PHONE, _phone, PHONE_AGAIN)):
        for m in pattern.finditer(text):
            if valid(m.group()):
                found.append((kind, *m.span(), True))
            elif again and m.end() - m.start() > 8:
                more += [(kind, *x.span(), False) for x in again.finditer(text, *m.span()) if valid(x.group())]
    more += [("iban", *m.span(), False) for m in IBAN.finditer(text) if mod97(m.group().replace(" ", ""))]
    scored = [(k, s, e, _score(k, text, s), base) for k, s, e, base in found + more]
    return sorted((x for x in scored if x[4] or x[3] >= KEEP), key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then longest, counts."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, *_ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and its spans, an array of (kind, start, end, score, base)."""

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int, score double, base boolean>>")


def report(docs: DataFrame) -> DataFrame:
    """Per document the counts of base spans, a digest of them, and all spans as kind:start:end, comma-joined."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                spans = find(t.as_py())
                base = [x for x in spans if x[4]]
                text = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in xs)
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS[:4]), hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with `text` redacted and, where there is an `n_chars`, that of the new text."""
    text = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            new = [redact(t.as_py()) for t in b.column(text)]
            cols[text] = pa.array(new, pa.string())
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(b.schema, cols, strict=True)]))

    return docs.mapInArrow(run, docs.schema)

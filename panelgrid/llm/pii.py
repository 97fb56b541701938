"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans. Spans of the four base formats are always
redacted; the other proposals are scored by boosted trees on features of their format and of the
text around them, and those above their kind's calibrated threshold are taken in the order of their
scores, as far as they overlap nothing taken before. The trees are trained on spans drawn from a
seeded generator of formats and look-alikes, and thresholds calibrated on a second draw.

Null counts as empty text, which has no spans. Offsets are code points, ends exclusive. Rows are
kept one by one, whatever their ids, and other columns may have any names; an empty table gives no rows. Of proposals
with equal scores the one found first is taken. Every search passes a text once, and overlaps are looked up in sorted
intervals, so texts of any length and with any number of spans are read whole.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

#: Base kinds and their formats.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: All of a run of numbers with dots between: matches of IP are its numbers in fours, as each takes its digits whole.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"\bat\b", re.IGNORECASE)

#: Kinds beyond the base, with their generators. Spelled addresses are found around an "at", by _spelled.
GENERATORS = {
    "email_spelled": None,
    "phone_local": re.compile(r"\(?\b[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}\b"),
    "secret": re.compile(r"[A-Za-z0-9_+/-]{16,}+={0,2}"),
    "ssn": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
}
#: What _spelled finds.
SPELLED = r"[A-Za-z0-9._%+-]{2,} ?[\[(]? ?\bat\b ?[\])]? ?[A-Za-z0-9-]{2,} ?[\[(]? ?(?:\bdot\b|\.) ?[\])]? ?[A-Za-z]{2,10}\b"
_HOST = re.compile(r"[A-Za-z0-9-]*+")
_AFTER_AT = re.compile(r" ?[\])]? ?")
_TOP = re.compile(r" ?[\[(]? ?(?:\bdot\b|\.) ?[\])]? ?[A-Za-z]{2,10}\b", re.IGNORECASE)
CONTEXT_CHARS = 24
#: Of what a threshold selects in the calibration draw, this share is right.
PRECISION = 0.98
SEED = 20240607


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap others of their kind, in order."""
    out = []
    # the leftmost match of EMAIL around an @: back over the local part, not beyond the match before
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    out += _addresses(text)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _addresses(text: str) -> list[tuple[str, int, int]]:
    """Matches of IP whose parts are 255 at most."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in four)):
                out.append(("ip", start, end))
            start = end + 1
    return out


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Matches of SPELLED, leftmost and with the longest names, in linear time: from each "at" back over the name and on over the
    host. Runs of characters of names and of hosts that were walked over once are remembered, so those with many an "at" in them
    are walked once."""
    run_start, run_end, host_start, host_end = 0, -1, 0, -1

    def name(at: int, done: int) -> tuple[int, int]:
        nonlocal run_start, run_end
        i = at
        for between in (" ", "[(", " "):
            if i > done and text[i - 1] in between:
                i -= 1
        start = i
        while start > 0 and text[start - 1] in _LOCAL:
            if run_start < start <= run_end:
                start = run_start
                break
            start -= 1
        if i > start:
            run_start, run_end = start, i
        return max(start, done), i

    done, pending = 0, None
    for at in _AT.finditer(text):
        start, end = name(at.start(), done)
        if pending and start != pending[0]:
            if at.start() < pending[1]:
                continue
            yield pending
            done, pending = pending[1], None
            start, end = name(at.start(), done)
        if end - start < 2:
            continue
        host = _AFTER_AT.match(text, at.end()).end()
        if not host_start <= host <= host_end:
            host_start, host_end = host, _HOST.match(text, host).end()
        m = _TOP.match(text, host_end) if host_end - host >= 2 else None
        if not m and host_end - host >= 5 and text[host_end - 4 : host_end].lower() == "-dot":
            m = _TOP.match(text, host_end - 3)
        if m:
            pending = start, m.end()
    if pending:
        yield pending


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposals beyond the base; they may overlap each other and the base."""
    out = []
    out += [("email_spelled", *span) for span in _spelled(text)]
    if _DIGIT.search(text):
        for kind in ("phone_local", "secret", "ssn", "iban"):
            out += [(kind, *m.span()) for m in GENERATORS[kind].finditer(text) if kind != "secret" or _DIGIT.search(m.group())]
    return out


_CUES = (("key", "token", "secret", "passw", "pwd", "auth", "akia", "api"), ("phone", "tel", "call", "fax", "mobile", "cell"), ("mail", "contact", "write"), ("ssn", "social"), ("iban", "account", "bank"))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT_CHARS) : start].lower(), text[end : end + CONTEXT_CHARS]
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    digits, upper, lower = (sum(map(t, s)) for t in (lambda c: "0" <= c <= "9", str.isupper, str.islower))
    changes = sum((a.isdigit() != b.isdigit()) for a, b in zip(s, s[1:]))
    return [
        *(float(kind == k) for k in GENERATORS),
        n, digits, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, changes, changes / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()), len(counts) / n,
        float(s.startswith("AKIA")), float("(" in s or "[" in s), s.count(" "), s.count("-"),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()), float(bool(before) and before[-1] in ":=\"'"),
        *(float(any(c in before for c in cues)) for cues in _CUES),
    ]


def _drawn(seed: int, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """n spans of each kind and label: (kinds, features, labels)."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=2, b=9: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    alnum = lambda k, chars=letters + letters.upper() + "0123456789": "".join(r.choice(chars) for _ in range(k))
    hexa = lambda k: alnum(k, "0123456789abcdef")
    upper = lambda k: alnum(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    at, dot = lambda: r.choice((" at ", " (at) ", "[at]", "(at)", " [at] ")), lambda: r.choice((" dot ", "(dot)", "[dot]", " [dot] ", "."))
    sep = lambda: r.choice(" .-")
    quote = lambda s: r.choice((f"{s}", f'"{s}"', f"'{s}'"))
    right = {
        "email_spelled": lambda: f"{r.choice(('mail', 'contact', word()))} {word()}{r.choice(('', '.', '_'))}{word()}{r.choice((' (at) ', '[at]', ' [at] ', '(at)'))}{word()}{dot()}{r.choice(('com', 'org', 'net', 'de', 'io'))}",
        "phone_local": lambda: f"{r.choice(('phone', 'tel', 'call', 'fax:', 'mobile'))} ({digits(3)}){r.choice((' ', ''))}{digits(3)}{sep()}{digits(4)}",
        "secret": lambda: r.choice((lambda: f"{word()} AKIA{upper(16)}", lambda: f"{r.choice(('api_key', 'token', 'secret', 'password', 'auth', 'key'))}{r.choice(('=', ': ', ' = ', ':'))}{quote(r.choice((hexa, alnum))(r.randint(20, 48)))}"))(),
        "ssn": lambda: f"{r.choice(('ssn', 'social security', 'SSN:'))} {digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: f"{r.choice(('iban', 'account', 'bank'))} {upper(2).translate(str.maketrans('0123456789', 'ABCDEFGHIJ'))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
    }
    wrong = {
        "email_spelled": lambda: f"{word()} {word()}{at() if r.random() < 0.1 else ' at '}{word()} {word()} {word()}. {word().title()}",
        "phone_local": lambda: f"{word()} {r.choice((f'{digits(4)}-{digits(4)}', f'{digits(3)} {digits(3)} {digits(3)}', f'{digits(4)}.{digits(3)}.{digits(4)}', f'{digits(3)}{digits(4)} {digits(3)}'))}",
        "secret": lambda: r.choice((lambda: f"{word()} {word(16, 40)}{r.choice('0123456789')}", lambda: f"{word()} {word(5, 9)}-{word(5, 9)}-{word(5, 9)}-{digits(2)}", lambda: f"{word()} {digits(r.randint(16, 40))}", lambda: f"/{word()}/{word()}/{word()}/{digits(4)}/{word()}", lambda: f"{word()} {word(16, 30)}_{digits(1)}", lambda: f"{word()} sha {hexa(r.choice((32, 40, 64)))}"))(),
        "ssn": lambda: f"{word()} {digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: f"{word()} {upper(4)} {upper(4)} {upper(4)} {upper(4)}",
    }
    kinds, x, y = [], [], []
    for label, made in ((1, right), (0, wrong)):
        for kind, f in made.items():
            found = 0
            for _ in range(20 * n):
                text = f"{word()} {word()} {f()} {word()}{r.choice(('.', ' ', ','))}"
                for k, s, e in candidates(text):
                    if k == kind and found < n:
                        kinds.append(k)
                        x.append(features(text, k, s, e))
                        y.append(label)
                        found += 1
                if found >= n:
                    break
    return kinds, np.array(x), np.array(y, float)


@functools.lru_cache(maxsize=1)
def trained(seed: int = SEED, n: int = 200) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and for each kind the least score at which PRECISION holds in a second draw (at least 0.5)."""
    _, x, y = _drawn(seed, n)
    model = BoostedTrees().fit(x, y)
    kinds, x, y = _drawn(seed + 1, n)
    p, least = model.probability(x), {}
    for kind in GENERATORS:
        own = np.flatnonzero(np.array(kinds) == kind)
        order = own[np.argsort(-p[own], kind="stable")]
        good = np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= PRECISION
        least[kind] = max(0.5, float(p[order[np.flatnonzero(good)[-1]]])) if good.any() else math.inf
    return model, least


class _Intervals:
    """Stretches of a text in order, none of which overlap."""

    def __init__(self, spans: list[tuple[str, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda v: v[1]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that meets none of the others."""
        k = bisect.bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def _chosen(texts: list[str], model: BoostedTrees, least: dict[str, float]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: those of the base, and what the model adds."""
    spans, of, x = [base_spans(t) for t in texts], [], []
    for i, t in enumerate(texts):
        taken = _Intervals(spans[i])
        for kind, s, e in candidates(t):
            if not taken.meets(s, e):
                of.append((i, kind, s, e))
                x.append(features(t, kind, s, e))
    if of:
        p = model.probability(np.array(x))
        added: dict[int, _Intervals] = {}
        for j in np.argsort(-p, kind="stable"):
            i, kind, s, e = of[j]
            if p[j] >= least[kind] and not (own := added.setdefault(i, _Intervals())).meets(s, e):
                own.add(s, e)
                spans[i].append((kind, s, e))
    order = {k: n for n, k in enumerate((*BASE_KINDS, *sorted(GENERATORS)))}
    return [sorted(x, key=lambda v: (order[v[0]], v[1])) for x in spans]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch that spans cover becomes [KIND] of its first span."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda v: (v[1], -v[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row id_col, spans array<struct<kind, start, end>>: by kind, base kinds first, then by start."""
    model, least = trained()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = _chosen(b.column("text").to_pylist(), model, least)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], pa.list_(span))], names=["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind string, start bigint, end bigint>>").withColumnRenamed("id", id_col)


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with the spans of text_col replaced; null stays null, the other columns stay as they are."""
    model, least = trained()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = _chosen([t or "" for t in texts], model, least)
            new = pa.array([t if t is None else redacted(t, x) for t, x in zip(texts, found, strict=True)], pa.string())
            yield b.set_column(b.schema.get_field_index(text_col), text_col, new)

    return df.mapInArrow(run, df.schema)

"""Secret scans: fixed patterns, and formats learnt as probabilistic automata from labelled credentials.

Every run of credential characters of MIN_RUN or more is scored by each format's automaton, as a whole
and from each place where the beginning stands that all of the format's examples share (every
character, if they share none: then between characters other than letters and digits only). What an
automaton accepts at no more bits a character than that format's own examples need (with a margin), and
at GAIN bits less than the background needs (each credential character as likely as the others), is
reported. So a credential counts wherever it stands in a run: behind "=", in a URL, before a full stop. Automata are bounded by their examples and travel with the task.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import os
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .grammar import Automaton, infer

MIN_RUN = 16
MARGIN, GAIN = 1.0, 16.0
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
BACKGROUND = math.log2(len(_ALNUM + "+/_.=-"))
# Public credential formats, each as runs of (literal) or (alphabet, length).
FORMATS = {
    "aws_access_key": ["AKIA", (_UPPER + _DIGIT, 16)],
    "aws_session_key": ["ASIA", (_UPPER + _DIGIT, 16)],
    "github_token": ["ghp_", (_ALNUM, 36)],
    "gitlab_token": ["glpat-", (_ALNUM, 20)],
    "google_api_key": ["AIza", (_ALNUM + "_-", 35)],
    "npm_token": ["npm_", (_ALNUM, 36)],
    "sendgrid_key": ["SG.", (_ALNUM, 22), ".", (_ALNUM, 43)],
    "slack_bot_token": ["xoxb-", (_DIGIT, 12), "-", (_DIGIT, 12), "-", (_ALNUM, 24)],
    "stripe_key": ["sk_live_", (_ALNUM, 24)],
    "hex_key": [("0123456789abcdef", 40)],
}


def labelled_credentials(each: int = 250, seed: int = 11) -> list[tuple[str, str]]:
    """(format, credential) examples drawn by rule from FORMATS, always the same."""
    rng = random.Random(seed)
    make = lambda parts: "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=p[1])) for p in parts)
    return [(name, make(parts)) for name, parts in FORMATS.items() for _ in range(each)]


def learn(examples: list[tuple[str, str]], alpha: float = 0.05) -> dict[str, tuple[Automaton, float, int, int, str]]:
    """For each format its automaton, the most bits a character, the shortest and longest length that count, and the examples' common beginning."""
    out = {}
    for name in sorted({n for n, _ in examples}):
        own = [x for n, x in examples if n == name and x]
        if not own:
            continue
        auto = infer(own, alpha)
        costs = sorted(auto.bits(x) / len(x) for x in own)
        out[name] = (auto, costs[-1] + MARGIN, min(map(len, own)), max(map(len, own)), os.path.commonprefix(own))
    return out


def scan(text: str | None, models: dict) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then by the order of KINDS."""
    t = text or ""
    found = []
    low = t.lower() if t.isascii() else t.translate(_FOLD)
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(t)]
    if models and (long := [w for w in t.split() if len(w) >= MIN_RUN]) and any(map(_RUN.search, long)):
        taken = {(a, b) for a, _, b in found}
        whole = sorted((a, b) for a, k, b in found if k)
        for m in _RUN.finditer(t):
            for a, b in formats_in(m[0], models):
                a, b = a + m.start(), b + m.start()
                at = bisect.bisect_right(whole, (a, math.inf)) - 1
                if (a, b) not in taken and not (at >= 0 and whole[at][1] >= b):
                    found.append((a, 3, b))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


_FOLD = {ord(c): c.lower() for c in _UPPER}


def formats_in(run: str, models: dict) -> list[tuple[int, int]]:
    """(start, end) of what the automata accept of the run, by start.

    From one start the end with the fewest bits a character counts, the longer of equals. A format goes
    on behind what it accepted; a span within another is left out.
    """
    if best_format(run, models):
        return [(0, len(run))]
    out = set()
    for auto, most, low, high, lead in models.values():
        a = run.find(lead)
        while 0 <= a <= len(run) - low:
            b = 0 if not lead and a and run[a - 1].isalnum() else _best_end(run, a, auto, most, low, high, not lead)
            if b:
                out.add((a, b))
            a = run.find(lead, b or a + 1)
    kept, done = [], 0
    for a, b in sorted(out, key=lambda x: (x[0], -x[1])):
        if b > done:
            kept.append((a, b))
            done = b
    return kept


def _best_end(run: str, start: int, auto: Automaton, most: float, low: int, high: int, border: bool) -> int:
    """Where the likeliest accepted text from start ends (border: not before a letter or digit); 0 where none is accepted."""
    state, total, best, cost = 0, 0.0, 0, math.inf
    arcs, ends, limit = auto.arcs, auto.ends, most * high
    for i in range(start, min(len(run), start + high)):
        arc = arcs[state].get(run[i])
        if arc is None or total > limit:
            break
        state = arc[0]
        total += arc[1]
        n = i + 1 - start
        if n >= low and (each := (total + ends[state]) / n) <= min(most, BACKGROUND - GAIN / n) and each <= cost and not (border and run[i + 1 : i + 2].isalnum()):
            best, cost = i + 1, each
    return best


def best_format(run: str, models: dict) -> str | None:
    """The format whose automaton accepts the run within its limit, at the fewest bits; None without one."""
    best, cost = None, math.inf
    for name, (auto, most, low, high, _) in models.items():
        if low <= len(run) <= high:
            limit = min(most * len(run), BACKGROUND * len(run) - GAIN)
            bits = auto.bits(run, limit)
            if bits <= limit and bits < cost:
                best, cost = name, bits
    return best


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"


def secret_spans(docs: DataFrame, models: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with counts, the digest of the base spans, and all spans.

    A null text counts as empty (no spans), a null id stays null, repeated rows stay repeated, other
    columns are left out, an empty table gives no rows. Offsets are code points, ends exclusive.
    """
    models = learn(labelled_credentials()) if models is None else models

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in SPANS.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                rows = []
                for key, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    spans = scan(text, models)
                    n = [sum(k == x for _, k, _ in spans) for x in KINDS]
                    base = _join([x for x in spans if x[1] != "format"])
                    rows.append((key, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), _join(spans), n[3]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).mapInArrow(work, SPANS)


def redact(docs: DataFrame, models: dict | None = None, mark: str = "[SECRET]", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with every secret in the text column replaced by mark; overlapping spans become one mark.

    Rows, order of columns and all other columns stay; a null text stays null; the length column, if
    there is one of that name, follows the new text.
    """
    models = learn(labelled_credentials()) if models is None else models
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(text: str | None) -> str | None:
        spans = scan(text, models)
        if not spans:
            return text
        out, done = [], 0
        for a, _, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                new = pa.array([clean(t) for t in s.column(at).to_pylist()], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else s.column(i) for i in range(s.num_columns)], schema=b.schema)

    out = docs.mapInArrow(work, schema)
    if n_chars_col in docs.columns:
        length = F.length(f"`{text_col}`").cast(schema[n_chars_col].dataType)
        out = out.select(*[length.alias(c) if c == n_chars_col else F.col(f"`{c}`") for c in docs.columns])
    return out

"""Secret scans: fixed shapes, and guess cost of values that stand in a credential context.

Base spans are those of three patterns. The method adds spans of kind `guess`: in a wider credential context (more key
words, key boundaries by a change of case too, a line break before the sign; values of any visible characters, in quotes up to the same quote, else up to white space)
the value is cut into words, dates, repeats, sequences, keyboard walks and
brute-force spans so that the number of guesses is least; a value that takes at least 10**MIN_LOG10 guesses is a secret. Words are
guessed by their rank in a list: frequent password parts, then the words of a tokenizer's rank file in its order, if its path is given.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, sorted by start, then by
kind in the order assign, access, hex, guess; a base span is never dropped; an empty table gives an empty table; only
the named columns are read (redact keeps all others as they are); ids are read as long, a null id is passed through; repeated rows give rows of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.bpe import read_ranks
from annalist.llm.common import mapped, session_defaults

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
#: Base key words; a text without any has no assign span and needs no search for one.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Each alternative of CONTEXT has one of these.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
CONTEXT = re.compile(
    r"""(?:(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))(?:pwd|pass|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|private|access|signing|encryption|secret|client)[\x20_-]?(?:key|secret))|password|passwd|passphrase|passcode)(?:[_-]?(?:value|text|string))?[0-9]{0,4}(?:\\?["'])?[\x20\t]*(?:\r?\n[\x20\t]*)?(?:=>|:=|[:=])[\x20\t]*(?:bearer\x20|basic\x20)?""",
    re.I | re.A,
)
#: What follows a context: a value in three quotes, in escaped ones, in quotes up to the same quote in its line, or visible characters (the group UNQUOTED).
VALUE = re.compile(r"""(?:"{3}((?:[^"\\]|\\.|"(?!""))*)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*)'{3}|\\"([^"\\\r\n]*)\\"|\\'([^'\\\r\n]*)\\'|"((?:[^"\\\r\n]|\\.)*)"|'((?:[^'\\\r\n]|\\.)*)'|`((?:[^`\\\r\n]|\\.)*)`)|["'`]?(\S+)""")
UNQUOTED = VALUE.groups
#: Guesses (power of ten) from which a value counts as a secret.
MIN_LOG10 = 9.0

# Common parts of passwords by falling frequency, and keyboard rows.
COMMON = (
    "password qwerty admin welcome login dragon master monkey letmein football baseball shadow sunshine princess iloveyou hello "
    "charlie michael secret superman batman trustno starwars freedom whatever ninja access flower default changeme example test "
    "guest root user pass temp demo sample none null true false required optional string value token key your my the and for with "
    "from this that not love summer winter spring autumn monday friday sunday january march april june july august october "
    "company office server system backup public private internet database oracle mysql windows linux google apple orange banana "
    "cookie pepper ginger tiger lion eagle falcon hunter ranger soccer hockey golf killer jordan thomas robert daniel andrew "
    "jessica ashley nicole amanda maggie buster lucky happy smile magic money power star moon sun sky fire water earth blue red "
    "green black white silver golden angel devil king queen prince knight hammer pokemon matrix phoenix mustang ferrari porsche"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "7894561230")

_RANK = {w: k + 1 for k, w in enumerate(COMMON)}
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
#: Letters of a listed word.
MIN_WORD, MAX_WORD = 3, 24
_NEAR: dict[str, set[str]] = {}
for _a, _b in [p for row in ROWS for p in zip(row, row[1:])] + [
    # A key touches two of the row above it; the digits' row begins one key further left.
    (low, high) for k in (1, 2, 3) for at, low in enumerate(ROWS[k]) for high in ROWS[k - 1][at + (k == 1) : at + (k == 1) + 2]
]:
    _NEAR.setdefault(_a, set()).add(_b)
    _NEAR.setdefault(_b, set()).add(_a)
_KEY = {c: (k, at + (k == 0 and -1)) for k, row in reversed(list(enumerate(ROWS[:4]))) for at, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
#: Power of ten of: starting one more segment, a date, a year, a brute-force character.
_SEGMENT, _FULL_DATE, _YEAR, _BRUTE = 0.3, math.log10(365 * 120), math.log10(120), 1.0


def _word_cost(word: str, low: str, plain: str, ranks: dict[str, int]) -> float | None:
    """Cost of a listed word, more for capitals and for marks in place of letters."""
    rank, extra = ranks.get(low), 0.0
    if rank is None:
        rank, extra = ranks.get(plain), 0.6
    if rank is None:
        return None
    upper = sum(map(str.isupper, word))
    return math.log10(rank + 1) + extra + (0.0 if not upper else 0.3 if upper in (1, len(word)) else 0.3 * upper)


@lru_cache(2)
def word_ranks(ranks_path: str | None = None) -> dict[str, int]:
    """Guess rank of each listed word: COMMON first, then the words of a rank file in its order."""
    out = dict(_RANK)
    if ranks_path:
        with open(ranks_path, "rb") as f:
            for raw, _ in sorted(read_ranks(f.read()).items(), key=lambda x: x[1]):
                word = raw.strip().lower()
                if MIN_WORD <= len(word) <= MAX_WORD and word.isalpha():
                    out.setdefault(word.decode("ascii"), len(out) + 1)
    return out


def _way(a: str, b: str) -> tuple[int, int]:
    """Where a step between two keys goes: up or down, else left or right along the row."""
    (row, at), (to, there) = _KEY.get(a, (0, 0)), _KEY.get(b, (0, 0))
    return (to > row) - (to < row), 0 if to != row else (there > at) - (there < at)


def _runs(value: str) -> list[tuple[int, int, float]]:
    """Maximal spans of one repeated unit of 1 to 4 characters, of code-point sequences and of keyboard walks, with costs."""
    found, n = [], len(value)
    low = value.lower()
    for unit in range(1, 5):
        start = 0
        for k in range(unit, n + 1):
            if k == n or value[k] != value[k - unit]:
                if k - start >= max(3, 2 * unit):
                    found.append((start, k, unit * _BRUTE + math.log10((k - start) / unit + 1)))
                start = k - unit + 1
    start, step = 0, 0
    for k in range(1, n + 1):
        now = ord(low[k]) - ord(low[k - 1]) if k < n else 99
        if now != step or abs(now) != 1:
            if abs(step) == 1 and k - start >= 3:
                found.append((start, k, 1.4 + math.log10(k - start)))
            start, step = k - 1, now
    start, turns, before = 0, 0, (0, 0)
    for k in range(1, n + 1):
        near = k < n and (low[k] == low[k - 1] or low[k] in _NEAR.get(low[k - 1], ()))
        if not near:
            if k - start >= 4:
                found.append((start, k, 1.7 + math.log10(k - start) + 0.5 * turns))
            start, turns, before = k, 0, (0, 0)
        else:
            way = _way(low[k - 1], low[k])
            turns += bool(k - 1 > start and way != before)
            before = way
    return found


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the least number of guesses over all segmentations. Linear in the value's length."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET)
    ending: dict[int, list[tuple[int, float]]] = {}
    for s, e, cost in _runs(value):
        ending.setdefault(e, []).append((s, cost))
    for s in range(n):
        m = _DATE.match(value, s)
        if m:
            ending.setdefault(m.end(), []).append((s, _YEAR if m.end() - s == 4 else _FULL_DATE))
        for e in range(s + MIN_WORD, min(n, s + MAX_WORD) + 1):
            cost = _word_cost(value[s:e], low[s:e], plain[s:e], ranks)
            if cost is not None:
                ending.setdefault(e, []).append((s, cost))
    # least[k]: cost of the first k characters; brute[k]: the same with a brute-force span at the end.
    least, brute = [0.0] * (n + 1), [math.inf] * (n + 1)
    for k in range(1, n + 1):
        brute[k] = min(brute[k - 1], least[k - 1] + _SEGMENT) + _BRUTE
        best = brute[k]
        for s, cost in ending.get(k, ()):
            best = min(best, least[s] + _SEGMENT + cost)
        least[k] = best
    return least[n]


Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[Span, tuple[int, int]]]:
    """(kind, start, end) of the base patterns, with the range of the value that a redaction hides."""
    found: list[tuple[Span, tuple[int, int]]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(("assign", m.start(), m.end()), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(("access", *m.span()), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(("hex", *m.span()), m.span()) for m in HEX.finditer(text)]
    return found


def guess_spans(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[Span, tuple[int, int]]]:
    """Values in a credential context that are costly to guess."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        value = VALUE.match(text, m.end())
        if not value:
            continue
        s, e = value.span(value.lastindex)
        if value.lastindex == UNQUOTED:
            e = s + len(value[UNQUOTED].rstrip(".:!?)]},;\"'`>"))
        if e - s >= MIN_VALUE and guess_cost(text[s:e], ranks) >= MIN_LOG10:
            found.append((("guess", s, e), (s, e)))
    return found


def scan_text(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[Span, tuple[int, int]]]:
    return sorted(base_spans(text) + guess_spans(text, ranks), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))


def redact_text(text: str, mark: str = "[SECRET]", ranks: dict[str, int] = _RANK) -> str:
    """Each value that a span covers becomes the mark; overlapping ranges are one."""
    out, at = [], 0
    for s, e in sorted(v for _, v in scan_text(text, ranks)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Columns id, spans array<struct<kind, start, end>>, n_assign, n_access, n_hex, n_guess, base_sha256."""
    session_defaults(documents.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make(batch: pa.RecordBatch):
        ranks = word_ranks(ranks_path)
        every = [[x for x, _ in scan_text(t or "", ranks)] for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(x[0] == k for x in spans) for spans in every], pa.int64()) for k in KINDS]
        digest = [hashlib.sha256(joined([x for x in spans if x[0] != "guess"]).encode()).hexdigest() for spans in every]
        found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in every], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), found, *counts, pa.array(digest, pa.string())], ["id", "spans", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256"])

    schema = "id long, spans array<struct<kind: string, start: long, end: long>>, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string"
    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, schema)


def redact(documents: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """The same rows and columns; found values are replaced in the text column, null stays null."""
    session_defaults(documents.sparkSession)
    at = documents.columns.index(text_col)

    def make(batch: pa.RecordBatch):
        texts = pa.array([None if t is None else redact_text(t, ranks=word_ranks(ranks_path)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    return mapped(documents, make, documents.schema)

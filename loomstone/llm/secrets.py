"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

A candidate is a run of letters, digits and + / _ - of some length, parted at = from the name it is given to. A run that mixes + / with _ -
fits no alphabet; its parts at either pair of characters are candidates. Its encoding is inferred as the smallest alphabet of a secret
that holds it: hex, base32, base64. Under the hypothesis that the characters were drawn evenly and independently from that
alphabet, four tests are made: chi-squared of the alphabet's classes of characters, chi-squared of the single characters, the
runs test (changes of class), and serial correlation of neighbours. Bonferroni joins them to one p-value per candidate.
The hypothesis is the finding here, so the error to hold down is clearing a real secret: Benjamini-Hochberg over a document's
candidates, weighted by the square root of their lengths with mean 1, clears those that are not random at level CLEAR_FDR. A candidate that is not
cleared becomes a finding only if its length gives the battery the power to clear written text: the bits it holds must reach MIN_BITS.
Decisions need only their own document, so they are alike at every size of the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release, slices

#: The base patterns; spans of group 0, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"
CLEAR_FDR = 0.05
MIN_BITS = 96.0
#: Base-64 runs that can hold MIN_BITS; a digit among the letters is asked for, as every encoding of a secret has them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The values in a run, the characters that no alphabet has together, and the parts of a value at either pair of them.
VALUE = re.compile(r"[^=]+")
MIXED = re.compile(r"[+/]"), re.compile(r"[_-]")
SIDES = re.compile(r"[^_-]+"), re.compile(r"[^+/]+")
_CLASS = [-1] * 128
for _i, _s in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_-")):
    for _c in _s:
        _CLASS[ord(_c)] = _i
#: name -> (letters, sizes of the classes upper, lower, digit, other)
ENCODINGS = {
    "hex": ("0123456789abcdef", (0, 6, 10, 0)),
    "HEX": ("0123456789ABCDEF", (6, 0, 10, 0)),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (26, 0, 6, 0)),
    "base36": ("abcdefghijklmnopqrstuvwxyz0123456789", (0, 26, 10, 0)),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26, 10, 0)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26, 10, 2)),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26, 26, 10, 2)),
}
_SETS = {k: frozenset(v[0]) for k, v in ENCODINGS.items()}


def infer_encoding(s: str) -> str | None:
    """The smallest alphabet that holds all characters; none for strings without both letters and digits."""
    chars = set(s)
    if not any(c.isdigit() for c in chars) or not any(c.isalpha() for c in chars):
        return None
    return next((k for k in ENCODINGS if chars <= _SETS[k]), None)


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) by the Wilson-Hilferty approximation."""
    if df <= 0 or x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str, encoding: str) -> float:
    """The joint p-value of the tests that s is random in its encoding."""
    letters, sizes = ENCODINGS[encoding]
    n, k = len(s), len(letters)
    place = {c: i for i, c in enumerate(letters)}
    x = [place[c] for c in s]
    cls = [_CLASS[ord(c)] for c in s]
    seen = [0] * 4
    for c in cls:
        seen[c] += 1
    used = [i for i in range(4) if sizes[i]]
    by_class = sum((seen[i] - n * sizes[i] / k) ** 2 / (n * sizes[i] / k) for i in used)
    counts = [0] * k
    for i in x:
        counts[i] += 1
    # The single characters: the statistic's mean and variance for few draws from many cells.
    even = sum(c * c for c in counts) * k / n - n
    var = 2 * (k - 1) * (n - 1) / n
    p = [chi2_tail(by_class, len(used) - 1), 0.5 * math.erfc((even - (k - 1)) / math.sqrt(2 * var)) if var else 1.0]
    # Counted pairs of equal characters are few and skewed; a Poisson tail holds for them.
    pairs, rate = sum(c * (c - 1) // 2 for c in counts), n * (n - 1) / 2 / k
    p[1] = max(p[1], poisson_tail(pairs, rate))
    stay = sum((sizes[i] / k) ** 2 for i in used)
    changes = sum(a != b for a, b in zip(cls, cls[1:], strict=False))
    mean = (n - 1) * (1 - stay)
    cube = sum((sizes[i] / k) ** 3 for i in used)
    spread = (n - 1) * stay * (1 - stay) + 2 * (n - 2) * (cube - stay * stay)
    p.append(normal_two_sided((changes - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    m = sum(x) / n
    total = sum((a - m) ** 2 for a in x)
    if total:
        r = sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / total
        p.append(normal_two_sided((r + 1 / n) * math.sqrt(n)))
    else:
        p.append(0.0)
    return min(1.0, len(p) * min(p))


def poisson_tail(k: int, rate: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if rate > 50:
        return 0.5 * math.erfc((k - 0.5 - rate) / math.sqrt(2 * rate))
    term = total = math.exp(-rate)
    for i in range(1, k):
        term *= rate / i
        total += term
    return max(0.0, 1 - total)


def cleared(p_values: list[float], lengths: list[int], level: float = CLEAR_FDR) -> list[bool]:
    """Weighted Benjamini-Hochberg: which candidates are declared not random."""
    n = len(p_values)
    roots = [math.sqrt(x) for x in lengths]
    mean = sum(roots) / n
    q = [p * mean / w for p, w in zip(p_values, roots, strict=True)]
    limit = -1.0
    for rank, value in enumerate(sorted(q), 1):
        if value <= level * rank / n:
            limit = value
    return [x <= limit for x in q]


def judged(s: str) -> tuple[float, float]:
    """As _judged; short candidates are kept."""
    return _judged(s) if len(s) <= 256 else _judged.__wrapped__(s)


@functools.lru_cache(maxsize=4096)
def _judged(s: str) -> tuple[float, float]:
    """p-value and bits of a candidate; -1 bits where no encoding fits."""
    encoding = infer_encoding(s)
    if encoding is None:
        return 0.0, -1.0
    return battery(s, encoding), len(s) * math.log2(len(ENCODINGS[encoding][0]))


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The stretches of a run that are tested: what = parts, and of those no alphabet holds, the parts at - _ and the parts at + /."""
    found = []
    for m in VALUE.finditer(text, a, b):
        whole = m.span()
        mixed = MIXED[0].search(text, *whole) and MIXED[1].search(text, *whole)
        found += [x.span() for side in SIDES for x in side.finditer(text, *whole)] if mixed else [whole]
    return sorted({(x, y) for x, y in found if y - x >= 16})


def find_random(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Findings of the battery outside the base spans."""
    tried = []
    for m in CANDIDATE.finditer(text):
        for a, b in parts(text, *m.span()):
            if not any(x < b and a < y for _, x, y in base):
                p, bits = judged(text[a:b])
                if bits >= 0:
                    tried.append((p, b - a, bits, a, b))
    if not tried:
        return []
    clear = cleared([t[0] for t in tried], [t[1] for t in tried])
    found: list[tuple[int, int, int]] = []
    for (_, _, bits, a, b), c in zip(tried, clear, strict=True):
        if c or bits < MIN_BITS:
            continue
        if found and a < found[-1][2]:  # parts of one run that overlap are one finding
            found[-1] = 3, found[-1][1], max(b, found[-1][2])
        else:
            found.append((3, a, b))
    return found


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text, in code points."""
    if not text:
        return [], []
    base = find_base(text)
    return base, sorted(base + find_random(text, base), key=lambda f: (f[1], f[0]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping findings replaced by MASK."""
    spans = find_secrets(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, n_random, base_spans and spans (kind:start:end, code points, end
    exclusive, by start and then kind), base_sha256. Null and empty texts have no findings; repeated rows come back as often; columns besides the two are not read."""
    long = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([docs.schema[id_col], *long, T.StructField("base_spans", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for part in slices(batches, 1):
            rows = []
            for t in part.column(1).to_pylist():
                base, every = find_secrets(t)
                n = [0] * len(KINDS)
                for k, _, _ in every:
                    n[k] += 1
                rows.append((*n, w := written(base), hashlib.sha256(w.encode()).hexdigest(), written(every)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64() if i < len(KINDS) else pa.string()) for i, c in enumerate(zip(*rows, strict=True)))], names=schema.names)
        _judged.cache_clear()
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of docs with the findings in the text masked; length_col, where named, follows the new text."""
    names = docs.columns

    def run(batches):
        for part in slices(batches, text_col):
            texts = [masked(t) for t in part.column(text_col).to_pylist()]
            new = {text_col: pa.array(texts, part.schema.field(text_col).type)}
            if length_col:
                new[length_col] = pa.array([None if t is None else len(t) for t in texts]).cast(part.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names=names)
        _judged.cache_clear()
        release()

    return docs.mapInArrow(run, docs.schema)

"""URL filter: a bit-parallel wildcard automaton.

All patterns lie side by side in one row of bits, cut into 64-bit words. For each byte of a canonical URL one shift, two masks and
the loops of the wildcards move all patterns at once (Shift-And); a batch of URLs moves together. A canonical URL is the host, a
byte that UTF-8 never has, and the path. A pattern is host/path: * in the host stays within the host, * in the path is any text, ? is any one byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

CUT, PAD = 0xFF, 0xFE
#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Globs of hosts or paths that are blocked where no rule fits.
GLOBS = ("*casino*/*", "*cheap-pills*/*", "*free-bets*/*", "*ads-track*/*", "*adserver*/*", "*doubleclick*/*", "*porn*/*", "*/*viagra*", "*/*.exe", "*/*.apk")


class ShiftAnd:
    """patterns: pairs of host and path globs; host None stands for any host."""

    def __init__(self, patterns: list[tuple[str, str]]):
        moves: list[tuple[object, object]] = []  # of each bit: the bytes that enter it, the bytes that stay in it
        every = np.ones(256, dtype=bool)
        every[[CUT, PAD]] = False
        self.first, self.last = [], []
        for host, path in patterns:
            self.first.append(len(moves))
            moves.append([np.zeros(256, bool), np.zeros(256, bool)])
            for part in (host.encode(), None, path.encode()):
                if part is None:
                    moves.append([np.arange(256) == CUT, np.zeros(256, bool)])
                    continue
                for b in part:
                    if b == ord("*"):
                        moves[-1][1] = moves[-1][1] | every
                    else:
                        moves.append([every if b == ord("?") else np.arange(256) == b, np.zeros(256, bool)])
            self.last.append(len(moves) - 1)
        self.words = -(-len(moves) // 64)
        self.enter, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for i, (enter, stay) in enumerate(moves):
            bit = np.uint64(1) << np.uint64(i % 64)
            self.enter[enter, i // 64] |= bit
            self.stay[stay, i // 64] |= bit
        self.stay[PAD] = ~np.uint64(0)
        self.begin = np.zeros(self.words, np.uint64)
        for i in self.first:
            self.begin[i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def match(self, texts: list[bytes], block: int = 4096) -> np.ndarray:
        """A row for each text and a column for each pattern."""
        out = np.zeros((len(texts), len(self.last)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in range(0, len(order), block):
            rows = order[at : at + block]
            # The longest text of a block sets its width: texts are ordered, and a block of long ones is cut further.
            while len(rows) > 1 and len(rows) * len(texts[rows[-1]]) > 1 << 24:
                half = len(rows) // 2
                out[rows[half:]] = self._run([texts[i] for i in rows[half:]]) if len(rows[half:]) * len(texts[rows[-1]]) <= 1 << 24 else self.match([texts[i] for i in rows[half:]], half)
                rows = rows[:half]
            out[rows] = self._run([texts[i] for i in rows])
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        width = max(map(len, texts))
        codes = np.full((len(texts), width), PAD, dtype=np.uint8)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = np.frombuffer(t, np.uint8)
        state = np.tile(self.begin, (len(texts), 1))
        one, high = np.uint64(1), np.uint64(63)
        for k in range(width):
            shifted = state << one
            shifted[:, 1:] |= state[:, :-1] >> high
            c = codes[:, k]
            state = (shifted & self.enter[c]) | (state & self.stay[c])
        bits = np.array(self.last)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & one != 0


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    return (rest, "") if cut < 0 else (rest[:cut], rest[cut:]) if cut else ("", rest)


def canonical(url: str | None) -> tuple[str, str]:
    host, path = split_url(url)
    return host.translate(_LOWER), path


class UrlFilter:
    """Rules fit a host and its subdomains if the path starts with theirs; the longest wins. Else any glob that matches blocks; an URL without a host is blocked."""

    def __init__(self, rules=RULES, globs=GLOBS):
        self.rules = sorted(rules, key=lambda r: -len(r[0] + r[1]))
        escape = lambda s: s  # rules hold no wildcards
        patterns = [p for h, path, _ in self.rules for p in ((escape(h), path + "*"), ("*." + escape(h), path + "*"))]
        self.globs = list(globs)
        self.automaton = ShiftAnd(patterns + [tuple(g.split("/", 1)) for g in self.globs])

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str, str | None]]:
        """host, path, rule, verdict, glob"""
        parts = [canonical(u) for u in urls]
        hit = self.automaton.match([h.encode("utf-8", "surrogatepass") + bytes([CUT]) + p.encode("utf-8", "surrogatepass") for h, p in parts])
        n = len(self.rules)
        ruled = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
        out = []
        for i, (host, path) in enumerate(parts):
            rule = next((r for r, ok in zip(self.rules, ruled[i], strict=True) if ok), None)
            glob = next((g for g, ok in zip(self.globs, hit[i, 2 * n :], strict=True) if ok), None)
            verdict = rule[2] if rule else "block" if glob or not host else "allow"
            out.append((host, path, rule[0] + rule[1] if rule else None, verdict, glob))
        return out


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """One row per page: id, host, path, rule (as host and path; null if none fits), verdict, glob (the first that matches). Null urls have empty parts; repeated rows come back as often; other columns are not read."""
    schema = T.StructType([pages.schema[id_col], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "glob"))])

    def run(batches):
        judge = UrlFilter(rules, globs).judge
        for part in slices(batches, 1):
            cols = zip(*judge(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    return pages.select(id_col, url_col).mapInArrow(run, schema)

"""Secret scan: keyword automaton, anchored expressions at its hits, embedded checksums (operator 3).

An Aho-Corasick automaton finds the keywords of every kind in one pass; an expression is
tried only at a hit, from its start. Long hexadecimal runs have no keyword: they are found
by looking at every 16th character, of which any run of 32 holds two, and only there is the
run measured. Kinds with an embedded checksum count only if it is right.

Base kinds: assign, access, hex. Kinds the method adds: github and npm tokens (CRC-32 in
base 62), xprv keys (base58 with a double SHA-256), age and nsec keys (bech32).

Nulls count as empty texts; empty texts have no span; texts of any length are read whole;
where spans start at one place they are ordered by kind; repeated rows and ids give one row
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded, mapped, texts

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
HEX = frozenset("0123456789abcdef")
HEX_RUN, HEX_STEP = 32, 16
LOWER = {c: c + 32 for c in range(65, 91)}


def crc_base62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before."""
    body, check = m.group(1)[:30], m.group(1)[30:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def base58_check(m: re.Match) -> bool:
    """78 bytes and the first four of their double SHA-256."""
    value = 0
    for c in m.group(0):
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def bech32_check(m: re.Match) -> bool:
    """The polynomial checksum over prefix and data is one."""
    prefix, _, data = m.group(0).lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


#: kind: keywords in lower case, expression from the keyword on, test of a match
KINDS: dict[str, tuple[tuple[str, ...], str, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 8,
    ),
    "access": (("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 16),
    "hex": ((), r"[0-9a-f]+", lambda m: len(m.group(0)) >= HEX_RUN),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])", crc_base62),
    "npm": (("npm_",), r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])", crc_base62),
    "xprv": (("xprv",), rf"xprv[{BASE58}]{{107}}(?![0-9A-Za-z])", base58_check),
    "age": (("age-secret-key-1",), rf"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![0-9A-Za-z])", bech32_check),
    "nsec": (("nsec1",), rf"nsec1[{BECH32}]{{58}}(?![0-9A-Za-z])", bech32_check),
}
NAMES = list(KINDS)
BASE = ("assign", "access", "hex")
_PATTERNS = [re.compile(p) for _, p, _ in KINDS.values()]
_TESTS = [t for _, _, t in KINDS.values()]


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (words, _, _) in enumerate(KINDS.values()):
        for w in words:
            a.add_word(w, (k, len(w)))
    a.make_automaton()
    return a


def _hex_starts(text: str) -> Iterator[int]:
    """Starts of the runs that two neighbours among every 16th character point to."""
    end = 0
    for m in re.finditer(r"[0-9a-f]{2,}", text[HEX_STEP - 1 :: HEX_STEP]):
        for k in range(m.start(), m.end()):
            at = HEX_STEP - 1 + HEX_STEP * k
            if at < end:
                continue
            start = at
            while start > end and text[start - 1] in HEX:
                start -= 1
            end = _PATTERNS[2].match(text, start).end()
            if end - start >= HEX_RUN:
                yield start


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans by start, then kind; leftmost and apart within a kind."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(LOWER)
    hits = [(end + 1 - n, k) for end, (k, n) in _automaton().iter(lower)]
    hits += [(s, 2) for s in _hex_starts(text)]
    hits.sort()
    free, out = [0] * len(NAMES), []
    for start, k in hits:
        if start >= free[k] and (m := _PATTERNS[k].match(text, start)):
            free[k] = m.end()
            if _TESTS[k](m):
                out.append((start, k, m.end()))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked for every row of docs."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_checked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_secrets(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(len(BASE))]
            digests = pa.array([hashlib.sha256(_named([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found], pa.string())
            checked = pa.array([sum(k >= len(BASE) for _, k, _ in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, pa.array(map(_named, found), pa.string()), checked], names=names)

    return mapped(texts(docs, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def redacted_text(text: str, mark: str = "[SECRET]") -> str:
    """text with every span, or run of overlapping spans, replaced by mark."""
    out, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced; all rows and columns stay, null texts too."""
    bounded(docs.sparkSession)
    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(redacted_text, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))

"""Secret scans: keyword prefilter, anchored patterns near hits, checksums.

One Aho-Corasick automaton finds all keywords in a single pass over the bytes of
a text; a pattern is tried only at the place of a hit, anchored there. Runs of
hex digits have no keyword: any run of ``n`` covers a multiple of ``n``, so only
every n-th byte is looked at and runs are grown from those that are hex digits.
Access tokens whose last six characters are a base-62 CRC-32 of the others are
reported only when that checksum holds.
"""

import re
import zlib
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowloom.llm.text import LOWER_BYTES

BASE = ("assign", "access", "hex")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
# Keywords, token prefixes and patterns.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
TOKEN = re.compile(rb"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
HEX_RUN = re.compile(rb"[0-9a-f]+")
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
IS_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def automaton():
    """Keywords in lower case, each with the kind of pattern to try at a hit."""
    found = ahocorasick.Automaton()
    for kind, keywords in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("token", TOKEN_PREFIXES)):
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body):
    """Six base-62 digits of the CRC-32 of ``body``."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit : digit + 1] + out
    return out


def hex_runs(data):
    """(start, end) of maximal lower-case hex runs of at least ``HEX_MIN`` bytes."""
    marks = np.frombuffer(data, np.uint8)[HEX_MIN - 1 :: HEX_MIN]
    done = 0
    for i in np.flatnonzero(IS_HEX[marks]):
        at = int(i) * HEX_MIN + HEX_MIN - 1
        if at < done:
            continue
        start = at
        while start > done and IS_HEX[data[start - 1]]:
            start -= 1
        done = HEX_RUN.match(data, start).end()
        if done - start >= HEX_MIN:
            yield start, done


def byte_spans(data, keywords):
    """(start, end, kind) in bytes of every secret in UTF-8 ``data``."""
    hits = [(end + 1 - size, kind) for end, (kind, size) in keywords.iter(data.translate(LOWER_BYTES).decode("latin-1"))]
    hits.sort()
    spans, done = [], dict.fromkeys(("assign", "access", "token"), 0)
    for start, kind in hits:
        if start < done[kind]:
            continue
        match = {"assign": ASSIGN, "access": ACCESS, "token": TOKEN}[kind].match(data, start)
        if not match:
            continue
        done[kind] = match.end()
        if kind == "assign" and len(match[2]) >= ASSIGN_MIN or kind == "access" and len(match[0]) >= ACCESS_MIN:
            spans.append((start, match.end(), kind))
        elif kind == "token" and checksum(match[1]) == match[2]:
            spans.append((start, match.end(), kind))
    spans.extend((start, end, "hex") for start, end in hex_runs(data))
    return spans


def spans_of(data, keywords):
    """``byte_spans`` in code points, by start and then kind."""
    spans = byte_spans(data, keywords)
    if spans and not data.isascii():
        heads = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
        spans = [(int(heads[a]), int(heads[b]), kind) for a, b, kind in spans]
    rank = {kind: i for i, kind in enumerate((*BASE, "token"))}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]]))


def _joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _rows(batches):
    keywords = automaton()
    for batch in batches:
        columns = [[] for _ in range(5)]
        for data in batch.column(1).to_pylist():
            spans = spans_of(data or b"", keywords)
            base = [s for s in spans if s[2] in BASE]
            for column, kind in zip(columns, BASE):
                column.append(sum(s[2] == kind for s in base))
            columns[3].append(sha256(_joined(base).encode()).hexdigest())
            columns[4].append(_joined(spans))
        yield pa.record_batch(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs):
    """Secrets of every row of ``docs``.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans
    (kind:start:end in code points, end exclusive, by start and then kind).
    A span is the whole match. Kind ``token`` is added to the base kinds where the
    checksum holds. Null and empty texts have no spans; repeated rows are scanned
    alike; other columns are ignored.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return ready.mapInArrow(_rows, SCHEMA)


def redact(docs, mark="[secret]"):
    """``docs`` with every secret in ``text`` replaced by ``mark``; null text stays null."""
    names = docs.columns

    def run(batches):
        keywords = automaton()
        for batch in batches:
            at = names.index("text")
            out = []
            for text in batch.column(at).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                data, done, parts = text.encode(), 0, []
                for start, end, _ in sorted(byte_spans(data, keywords)):
                    if start >= done:
                        parts += [data[done:start], mark.encode()]
                    done = max(done, end)
                out.append(b"".join([*parts, data[done:]]).decode())
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, docs.schema)

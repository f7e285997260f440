"""Secrets in texts: plain patterns, and encoded keys confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import text_of

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Kinds in their order among spans that start at one place; the first three are the plain ones.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{9,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
FRAMED = re.compile(r"[A-Za-z0-9+/=\s:,.-]*+")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]++")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9A-Fa-f]{64,})(?![0-9A-Za-z])")

#: How base64 of a sequence, of a public key's first field and of a private key file begins.
BEGINNINGS = ("M", "AAAA", "b3BlbnNzaC1rZXktdjEA")

SSH_MARK = b"openssh-key-v1\0"
#: Public keys by name, with the number of fields that follow it. Fixed values.
SSH_FIELDS = {
    b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2,
}

DEPTH = 8


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the element at ``at``, if its length is well-formed and fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def nested(data: bytes, start: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill the stretch exactly, with those of constructed ones checked in turn."""
    tags, at = [], start
    while at < end:
        found = element(data, at, end)
        if found is None or found[0] & 0x1F == 0x1F:
            return None
        tag, a, b = found
        if tag & 0x20 and (depth >= DEPTH or nested(data, a, b, depth + 1) is None):
            return None
        if tag == 2 and (a == b or (b - a > 1 and data[a] == 0 and data[a + 1] < 0x80)):
            return None
        tags.append(tag)
        at = b
    return tags


def is_der_key(data: bytes) -> bool:
    """Private keys: a sequence that begins with a small version and holds integers, an algorithm or octets; encrypted
    ones: an algorithm identifier and octets; public keys: an algorithm identifier and a bit string. Lengths must nest
    exactly."""
    found = element(data, 0, len(data))
    if found is None or found[0] != 0x30 or found[2] != len(data):
        return False
    tags = nested(data, found[1], found[2])
    if not tags:
        return False
    version = tags[0] == 2 and data[found[1] + 1] == 1 and data[found[1] + 2] <= 3
    private = version and (tags[:9] == [2] * 9 or tags[:6] == [2] * 6 or tags[1:3] == [0x30, 4] or tags[1:2] == [4])
    if tags == [0x30, 4]:
        inner = element(data, found[1], found[2])
        return inner is not None and inner[1] < inner[2] and data[inner[1]] == 6
    return private or (tags == [0x30, 3] and data[found[1]] == 0x30)


def ssh_size(read: Callable[[int, int], bytes]) -> int | None:
    """Bytes that the OpenSSH private key file or public key at the start of what ``read(at, n)`` reads says it has, by its
    length fields. A private key file holds one key, as all that are written do."""
    at = 0

    def fields(n: int) -> bool:
        nonlocal at
        for _ in range(n):
            size = read(at, 4)
            if len(size) < 4:
                return False
            at += 4 + int.from_bytes(size, "big")
        return True

    if read(0, len(SSH_MARK)) == SSH_MARK:
        at = len(SSH_MARK)
        if not fields(3) or read(at, 4) != b"\0\0\0\1":
            return None
        at += 4
        return at if fields(2) else None
    name = read(4, min(int.from_bytes(read(0, 4), "big"), 32))
    return at if name in SSH_FIELDS and fields(1 + SSH_FIELDS[name]) else None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file, or a public key: fields each behind its length, filling the bytes exactly."""
    return ssh_size(lambda at, n: data[at : at + n]) == len(data)


def der_size(read: Callable[[int, int], bytes]) -> int | None:
    """Bytes that the sequence at the start says it has, if at most twelve well-formed elements fill it and the first is
    a version or an algorithm: all that the elements' heads tell of a key."""
    def head(at: int) -> tuple[int, int] | None:
        got = read(at, 6)
        n = got[1] & 0x7F if len(got) > 1 and got[1] & 0x80 else 0
        if len(got) < 2 + n or n > 4 or (got[1] == 0x80):
            return None
        return got[0], 2 + n + (int.from_bytes(got[2 : 2 + n], "big") if n else got[1])

    whole = head(0)
    if whole is None or whole[0] != 0x30:
        return None
    first = read(1, 1)[0]
    at, seen = 2 + (first & 0x7F if first & 0x80 else 0), 0
    while at < whole[1]:
        found = head(at)
        if found is None or seen == 12 or (seen == 0 and found[0] not in (2, 0x30)):
            return None
        at, seen = at + found[1], seen + 1
    return whole[1] if at == whole[1] and seen > 1 else None


def wrapped_spans(text: str) -> list[tuple[int, int, int]]:
    """Keys whose base64 goes on over several lines, whatever lines stand before and after. The first bytes of a key say
    where it ends, and single bytes of base64 are read where they stand, so a line that only looks like a beginning
    costs a few reads and not the lines behind it."""
    spans = []
    for m in WRAPPED.finditer(text):
        lines = list(LINE.finditer(text, m.start(), m.end()))
        body = "".join(x[0] for x in lines)
        starts, total = [], 0
        for x in lines:
            starts.append(total)
            total += x.end() - x.start()
        stops = starts[1:] + [total]
        k = 0
        while k < len(lines):
            at, k = starts[k], k + 1
            if not body.startswith(BEGINNINGS, at):
                continue

            def read(p: int, n: int, at: int = at) -> bytes:
                lo = at + p // 3 * 4
                return (decoded(body[lo : lo + (p % 3 + n + 2) // 3 * 4]) or b"")[p % 3 : p % 3 + n]

            for kind, size in ((5, der_size(read)), (6, ssh_size(read))):
                stop = at + -(-size * 4 // 3) if size else 0
                j = bisect.bisect_left(stops, stop)
                if not size or j < k or j == len(stops) or stops[j] != stop:
                    continue
                data = decoded(body[at:stop])
                if data is not None and (is_der_key if kind == 5 else is_ssh_key)(data):
                    end = lines[j].end()
                    end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("=")) if j == len(lines) - 1 else 0
                    spans.append((lines[k - 1].start(), kind, end))
                    k = j + 1
                    break
    return spans


def framed_spans(text: str) -> list[tuple[int, int, int]]:
    """PEM blocks, each from the last head before a foot of its name, whose contents parse or say that they are encrypted."""
    spans, opened = [], None
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            opened = m
            continue
        if opened is not None and opened[2] == m[2] and FRAMED.fullmatch(text, opened.end(), m.start()):
            inner = text[opened.end() : m.start()]
            body = decoded("".join("".join(line.split()) for line in inner.split("\n") if ":" not in line))
            if body and (is_der_key(body) or is_ssh_key(body) or "Proc-Type" in inner):
                spans.append((opened.start(), 4, m.end()))
        opened = None
    return spans


def is_signed_token(text: str) -> bool:
    """A header that decodes to a JSON object naming its algorithm, and a payload that decodes."""
    head, payload, _ = text.split(".", 2)
    data = decoded(head)
    if data is None or not data.lstrip().startswith(b"{") or decoded(payload) is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the plain kinds."""
    spans = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of encoded keys and tokens whose structure holds."""
    spans = []
    if "." in text and ("ey" in text or "ew" in text):
        spans += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    framed = framed_spans(text) if "-----BEGIN " in text else []
    spans += framed

    def free(at: int) -> bool:
        k = bisect.bisect_right(framed, at, key=lambda span: span[0])
        return k == 0 or framed[k - 1][2] <= at

    for m in RUN.finditer(text):
        data = decoded(m[0])
        if data and free(m.start()):
            kind = 5 if is_der_key(data) else 6 if is_ssh_key(data) else None
            if kind:
                spans.append((m.start(), kind, m.end()))
    spans += [s for s in wrapped_spans(text) if free(s[0])]
    for m in HEX_RUN.finditer(text):
        if len(m[1]) % 2 == 0:
            data = bytes.fromhex(m[1])
            kind = 5 if is_der_key(data) else 6 if is_ssh_key(data) else None
            if kind:
                spans.append((m.start(1), kind, m.end()))
    return spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans)))


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each document: counts of the plain kinds and of the confirmed ones, a digest of the plain spans, and all spans.

    Plain kinds are patterns alone. Encoded candidates, base64 or hex, are decoded and reported only if they parse: DER
    keys by nested lengths, OpenSSH keys and public keys by their length fields, signed tokens by a JSON header that
    names an algorithm, PEM blocks by what they enclose. Texts are scanned whole, each by itself, without a shuffle.

    Null texts are empty and have no spans. A match of two kinds is two spans; one kind never overlaps itself. Repeated
    rows are each scanned. Columns but ``doc_id`` and ``text`` are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), digest, _joined(base + more)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(scan, SCHEMA)

"""Secret scan with structural confirmation.

Base findings come from three patterns. Besides, base64 and hex candidates are decoded and reported only if their bytes
have the structure of a key: DER with lengths that nest exactly (PKCS#1, PKCS#8 with the inner key of its algorithm, SEC1),
the length-prefixed fields of an SSH key, or the decoded JSON header and claims of a signed token. A key may go over lines
(indented, quoted or escaped), in either base64 alphabet or in hex; its own lengths tell where it ends, so no more lines are
read than it announces. Python inside tasks: decoding needs loops over bytes that SQL lacks.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in order; the first three are base kinds.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "der", "ssh", "jwt"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What joins two lines of one key: a line end with quotes, a sign of joined strings or a mark of quoted text, or an escaped one.
JOINT = r"""(?:(?:\\r\\n|\\n)?["']?[ \t]*+[+,\\]?[ \t]*+\r?\n[ \t>|#*]*+["']?|(?:\\r\\n|\\n)[ \t]*+)"""


def _encoding(alphabet: str, begins: str, behind: str) -> tuple[re.Pattern, re.Pattern]:
    """Where a key may begin, and one more line of it."""
    return re.compile(rf"(?:(?<![{behind}])|(?<=\\n))(?={begins})[{alphabet}]{{16,}}+"), re.compile(rf"{JOINT}([{alphabet}]++)")


#: DER sequences begin with M in base64, openssh-key-v1 with b.
ENCODINGS = {
    "base64": _encoding("A-Za-z0-9+/", "M|b3BlbnNzaC1rZXktdjEA", "A-Za-z0-9+/"),
    "url": _encoding("A-Za-z0-9_-", "M|b3BlbnNzaC1rZXktdjEA", "A-Za-z0-9_-"),
    "hex": _encoding("0-9A-Fa-f", "30|6[Ff]70656[Ee]737368", "0-9A-Fa-f"),
}
PADDING = re.compile(r"={0,2}")
#: Three parts, the first the base64 of a brace or of a blank before it.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]++)")
# Object identifiers in DER of private-key algorithms (RSA, RSA-PSS, DSA, EC, X25519, X448, Ed25519, Ed448),
# and of password-based encryption (PBES2), which a sealed private key names.
ALGORITHMS = {
    "06092a864886f70d010101": "rsa",
    "06092a864886f70d01010a": "rsa",
    "06072a8648ce380401": "dsa",
    "06072a8648ce3d0201": "ec",
    "06032b656e": 32,
    "06032b656f": 56,
    "06032b6570": 32,
    "06032b6571": 57,
}
SEALED = bytes.fromhex("06092a864886f70d01050d")
#: Bytes that the modulus or prime of a key has at least.
LEAST_MODULUS = 32
SSH = b"openssh-key-v1\x00"


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None if lengths do not fit."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def _fields(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the values of the one sequence that data is; empty if it is none."""
    top = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    items = der_items(data, top[0][1], top[0][2]) if top and len(top) == 1 else None
    return [(tag, data[a:b]) for tag, a, b in items or []]


def _positive(field: tuple[int, bytes]) -> bool:
    return field[0] == 0x02 and len(field[1]) > 0 and field[1][0] < 0x80 and any(field[1])


def _is_rsa(fields: list[tuple[int, bytes]]) -> bool:
    """Version, eight positive integers (modulus first), and perhaps further primes."""
    return len(fields) in (9, 10) and fields[0][0] == 0x02 and len(fields[0][1]) == 1 and all(map(_positive, fields[1:9])) and len(fields[1][1]) >= LEAST_MODULUS and all(t == 0x30 for t, _ in fields[9:])


def _is_sec1(fields: list[tuple[int, bytes]]) -> bool:
    """Version 1, octets of a curve's size that are not all zero, and perhaps the curve and the public point."""
    return len(fields) >= 2 and fields[0] == (0x02, b"\x01") and fields[1][0] == 0x04 and len(fields[1][1]) in (20, 24, 28, 32, 48, 66) and any(fields[1][1]) and all(t in (0xA0, 0xA1) for t, _ in fields[2:])


def _is_inner(algorithm: str | int, octets: bytes) -> bool:
    """Whether the octets of PKCS#8 are a key of the algorithm."""
    if algorithm == "rsa":
        return _is_rsa(_fields(octets))
    if algorithm == "ec":
        return _is_sec1(_fields(octets))
    only = der_items(octets, 0, len(octets))
    if not only or len(only) != 1:
        return False
    value = (only[0][0], octets[only[0][1] :])
    return _positive(value) if algorithm == "dsa" else value[0] == 0x04 and len(value[1]) == algorithm


def is_private_der(data: bytes) -> bool:
    """PKCS#1, DSA (version, five positive integers), PKCS#8 (version, algorithm, octets that hold a key of the algorithm),
    sealed PKCS#8 (encryption, at least 16 octets) or SEC1."""
    fields = _fields(data)
    tags = [t for t, _ in fields]
    if tags == [0x30, 0x04]:
        inner = fields[0][1]
        return inner.startswith(SEALED) and der_items(inner, 0, len(inner)) is not None and len(fields[1][1]) >= 16
    if tags[:1] != [0x02] or len(fields[0][1]) != 1:
        return False
    if tags[1:3] == [0x30, 0x04]:
        inner = fields[1][1]
        named = der_items(inner, 0, len(inner))
        return bool(named) and _is_inner(ALGORITHMS.get(inner[: named[0][2]].hex(), -1), fields[2][1])
    if len(fields) == 6:
        return all(map(_positive, fields[1:])) and len(fields[1][1]) >= LEAST_MODULUS
    return _is_rsa(fields) or _is_sec1(fields)


def _ssh_size(data: bytes) -> tuple[int, bool]:
    """(bytes of the openssh-key-v1 structure that begins here, as far as its lengths are known; whether that is all): magic,
    three length-prefixed names, a key count, length-prefixed public and private parts."""
    at = len(SSH)
    for n in range(5):
        at += 4 * (n == 3)
        if at + 4 > len(data):
            return at + 4, False
        at += 4 + struct.unpack_from(">I", data, at)[0]
    return at, True


def is_ssh_private(data: bytes) -> bool:
    size, whole = _ssh_size(data)
    return data.startswith(SSH) and whole and size <= len(data)


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def is_signed(header: str, claims: str, signature: str) -> bool:
    """A header that names an algorithm, claims that are an object, and a signature of whole bytes."""
    head = _json(header)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and isinstance(_json(claims), dict) and len(signature) % 4 != 1


def _kind_of(data: bytes) -> str | None:
    return "der" if is_private_der(data) else "ssh" if is_ssh_private(data) else None


def _decoded(body: str, encoding: str) -> bytes:
    if encoding == "hex":
        return bytes.fromhex(body[: len(body) // 2 * 2])
    body = body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4)
    return base64.b64decode(body, b"-_" if encoding == "url" else None)


def _letters(size: int, encoding: str) -> int:
    return 2 * size if encoding == "hex" else size // 3 * 4 + (0, 2, 3)[size % 3]


def _der_size(data: bytes) -> int | None:
    """Bytes of the DER value that begins here, by its own length."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    k = data[1] & 0x7F
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 else None


def _key(text: str, m: re.Match, encoding: str) -> tuple[int, str] | None:
    """(end, kind) of the key that begins with the line m and ends with it or one of the lines after it."""
    line = ENCODINGS[encoding][1]
    first = _decoded(m[0][:12], encoding)
    size, whole = (_der_size(first), True) if first[0] == 0x30 else (len(SSH), False)
    if size is None:
        return None
    lines, end, length = [m[0]], m.end(), len(m[0])
    while True:
        # Only as many lines as the lengths read so far announce, and none if the text is too short for that.
        if _letters(size, encoding) > len(text) - m.start():
            return None
        while length < _letters(size, encoding) and (more := line.match(text, end)):
            lines.append(more[1])
            end, length = more.end(), length + len(more[1])
        if length < _letters(size, encoding):
            return None
        if whole:
            break
        size, whole = _ssh_size(_decoded("".join(lines), encoding))
    body = "".join(lines)
    # The key fills its last line.
    if length != _letters(size, encoding) or encoding == "url" and not ("-" in body or "_" in body):
        return None
    kind = _kind_of(_decoded(body, encoding))
    return (end if encoding == "hex" else PADDING.match(text, end).end(), kind) if kind else None


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text, by start, then in the order of KINDS."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for encoding, (begin, _) in ENCODINGS.items():
        done = 0
        for m in begin.finditer(text):
            if m.start() >= done and (key := _key(text, m, encoding)):
                done = key[0]
                out.append((m.start(), *key))
    out += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed(*m.groups())]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with `out`: array<struct<kind,start,end>> of every whole text, code points, end exclusive, by start then kind.

    Null and empty texts give an empty array. Rows are independent: nothing is shuffled, repeated rows give equal results,
    and an empty table gives an empty one. A column already named `out` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != out.lower()]
    df = df.select(*kept)
    schema = f"{df._jdf.schema().toDDL()}{',' if kept else ''} `{out}` array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] if t else [] for t in (x.as_py() for x in batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


"""Secret scan: three pattern kinds, and structural confirmation of encoded candidates.

Runs of base64 or hex characters are decoded and only reported if the bytes parse as something
secret: a DER private key whose nested lengths add up, an OpenSSH key container whose parts do, an
armoured key under headers that name its cipher, or a signed token whose header is a JSON object
with an algorithm. Spans are in code points, end exclusive. Every step is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so the shortest length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_-]{40,}={0,2}")
#: Both alphabets in one run; it is parted by BASE64 only if the whole is no key.
MIXED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Runs over line ends, also escaped ones.
LINE_END = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
WRAPPED = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
ANY_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
#: A token begins after a character that no token has, so that every run is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
#: Armour, with the headers of encrypted keys.
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[ \t]*(?:\r?\n|\\r\\n|\\n)[A-Za-z][A-Za-z0-9-]{0,40}:[^\r\n\\]{0,200})*+)((?:[A-Za-z0-9+/=\s]|\\[rn])++)-----END \1-----")
CIPHER = re.compile(r"DEK-Info: *[A-Z0-9-]+, *([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "armoured_key", "der_key", "openssh_key")
MIN_VALUE, MIN_ACCESS = 6, 20
#: Bytes that no single key exceeds (an RSA key of 16,384 bits has 9.3 KB).
MOST_KEY = 1 << 16
#: How the object identifiers of password-based encryption begin (PKCS 5 and 12).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def der_tree(data: bytes, depth: int = 0) -> list | None:
    """The elements of data if their DER lengths fill it exactly, constructed ones parsed in turn; else None."""
    at, found = 0, []
    while at < len(data):
        tag = data[at]
        if at + 2 > len(data):
            return None
        length, head = data[at + 1], 2
        if length & 0x80:
            more = length & 0x7F
            if not 1 <= more <= 4 or at + 2 + more > len(data):
                return None
            length, head = int.from_bytes(data[at + 2 : at + 2 + more], "big"), 2 + more
        if at + head + length > len(data):
            return None
        body = data[at + head : at + head + length]
        if tag & 0x20:
            body = der_tree(body, depth + 1) if depth < 8 else None
            if body is None:
                return None
        found.append((tag, body))
        at += head + length
    return found


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key container that data begins with: magic, cipher, key derivation, its options, number of
    keys, that many public keys, the private part, each with its length before it. None if it is not whole."""

    def after(at: int) -> int | None:
        if at is None or at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else None

    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at = after(after(after(15)))
    if at is None or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        at = after(at)
    return at


def key_kind(data: bytes) -> str | None:
    """What decoded bytes hold: der_key, openssh_key or None."""
    if len(data) > MOST_KEY:
        return None
    if openssh_size(data):
        return "openssh_key"
    if len(data) < 24 or data[0] != 0x30:
        return None
    tree = der_tree(data)
    if not tree or len(tree) != 1 or tree[0][0] != 0x30:
        return None
    parts = tree[0][1]
    # Private keys begin with a version number; then come numbers, an octet string or an algorithm with an octet string.
    if len(parts) >= 2 and parts[0][0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 3:
        tags = [t for t, _ in parts[1:]]
        if 0x04 in tags[:2] or (len(tags) >= 4 and set(tags[:4]) == {0x02}):
            return "der_key"
    # Encrypted ones are an encryption algorithm and an octet string.
    if [t for t, _ in parts] == [0x30, 0x04] and parts[0][1] and parts[0][1][0][0] == 0x06 and parts[0][1][0][1].startswith(ENCRYPTION):
        return "der_key"
    return None


def from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> bool:
    """A token's header decodes to a JSON object that names its algorithm, and its claims to an object."""
    parts = text.split(".")
    for part, name in zip(parts, ("alg", None), strict=False):
        data = from_base64(part)
        try:
            value = json.loads(data) if data else None
        except ValueError:
            return False
        if not isinstance(value, dict) or (name and not isinstance(value.get(name), str)):
            return False
    return True


def wrapped_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys whose base64 goes over several lines. A key begins with a line, and its DER length says at which line's end it ends."""
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for e in LINE_END.finditer(text, m.start(), m.end()):
            lines.append((at, e.start()))
            at = e.end()
        lines.append((at, m.end()))
        joined = "".join(text[a:b] for a, b in lines).rstrip("=")
        ends, n = {}, 0
        for k, (a, b) in enumerate(lines):
            n += len(text[a:b].rstrip("="))
            ends[n] = k
        n, done = 0, -1
        for k, (a, b) in enumerate(lines):
            size = None
            if k > done and text.startswith("b3BlbnNzaC1rZXktdjE", a):
                piece = joined[n : n + MOST_KEY // 3 * 4]
                head = from_base64(piece[: len(piece) - (len(piece) % 4 == 1)])
                size = -(-4 * whole // 3) if head and (whole := openssh_size(head)) else None
            elif k > done and text.startswith("M", a) and (head := from_base64(joined[n : n + 8])) and len(head) == 6:
                more = head[1] & 0x7F if head[1] & 0x80 else 0
                if more <= 4:
                    size = -(-4 * (2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])) // 3)
            last = ends.get(n + size, -1) if size and size <= MOST_KEY * 4 // 3 else -1
            if last > k and (data := from_base64(joined[n : n + size])) and (kind := key_kind(data)):
                yield a, lines[last][1], kind
                done = last
            n += len(text[a:b].rstrip("="))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that decode to a key or a signed token."""
    found = []
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if signed_token(m[0])]
    if "PRIVATE KEY-----" in text:
        for m in ARMOUR.finditer(text):
            data = from_base64("".join(re.sub(r"\\[rn]", "", m[3]).split()))
            cipher = CIPHER.search(m[2])
            if data and ((len(data) % (len(cipher[1]) // 2) == 0 if cipher else key_kind(data))):
                found.append((m.start(), m.end(), "armoured_key"))
    armoured = [(s, e) for s, e, k in found if k == "armoured_key"]
    starts = [s for s, _ in armoured]
    found += [x for x in wrapped_keys(text) if not (i := bisect_right(starts, x[0])) or armoured[i - 1][1] < x[1]]
    for run in MIXED.finditer(text):
        for m in (run, *BASE64.finditer(text, run.start(), run.end())):
            if (data := from_base64(m[0])) and (kind := key_kind(data)):
                found.append((m.start(), m.end(), kind))
                if m is run:
                    break
    for m in ANY_HEX.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), kind))
    return found


def _listed(spans: list[tuple[int, int, str]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], rank[x[2]], x[1])))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end of the patterns and of the confirmed structures. Null text counts as
    empty, and has no spans (an empty string, and its digest). Repeated rows are scanned each, a null id stays null; an empty
    table gives an empty result; other columns are not read. A row needs memory for its own text only.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                listed = _listed(base)
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed.encode()).hexdigest(), _listed(base + confirmed_spans(text))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

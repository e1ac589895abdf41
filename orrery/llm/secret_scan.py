r"""Secret scans with structural confirmation.

Three plain patterns give the base findings (``assign``, ``access``, ``hex``).
Further candidates, runs of base64 or hex and dotted tokens, are decoded and
reported only if what they decode to is built like a secret: a signed token
whose header is JSON naming its algorithm, or a private key whose encoding
parses with every nested length consistent to the last byte, an encrypted one
included. Lines are joined over real and escaped breaks (``\n`` of JSON and the
like) before they are decoded; a key of many lines without armour ends where its
own lengths say.

Spans are code points, the end exclusive. A text is scanned whole and alone, in
one pass of an Arrow UDF, so there is no shuffle and any lost task just reruns.

Defined results: a null or empty text has no findings; repeated rows and null
ids are scanned like any other row; an empty table gives an empty table; every
input column is kept, and one named like the output column is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.llm import shared

#: In the order in which findings of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "key", "hexkey")

ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same matches as HEX of that length
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
HEADER = re.compile(r"^[\x20\t]*[A-Za-z][A-Za-z0-9-]*:.*$", re.MULTILINE)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
DEK = re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED\s+DEK-Info:\s*([A-Za-z0-9-]+)\s*,\s*([0-9A-Fa-f]{16,})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
ESCAPED = re.compile(r"\\+[nrt/]")
#: How a key, the text of one, or a token starts in either encoding; NUL stands for backslashes, see ``unescaped``.
START = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:(?P<hex>30[0-9a-fA-F]{14}|6f70656e7373682d6b65792d763100|2d2d2d2d2d424547494e20|65794a[0-9a-f]{10})"
    r"|(?:M[A-P][A-Za-z0-9+/_\0-]{14}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi|ZXlK[A-Za-z0-9+/_\0-]{12}))"
)
LINES = {False: re.compile(r"[A-Za-z0-9+/_\0-]+"), True: re.compile(r"[0-9a-fA-F\0]+")}
BREAK = re.compile(r"[\x20\t\0]*[\r\n][\x20\t\r\n\0]*")
#: Password-based encryption of PKCS#5 and PKCS#12, as algorithms.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


#: Characters of a joined key's first line that are looked at before the lines that follow.
HEAD = 512


def unescaped(text: str) -> str:
    """``text`` with escaped breaks and slashes as such, as long as before: NUL stands for their backslashes."""
    if "\\" not in text:
        return text
    real = {"n": "\n", "r": "\r", "t": "\t", "/": "/"}
    return ESCAPED.sub(lambda m: "\0" * (len(m[0]) - 1) + real[m[0][-1]], text)


def unbase64(run: str) -> bytes | None:
    """The bytes of a run in either alphabet, padded or not; None if it can't be base64."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]`` exactly; None if their lengths don't."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        start = at + size
    return found


def is_rsa(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Whether these nine integers or more can be an RSA key: version, modulus, exponents, primes and the rest, of sizes that fit."""
    version, modulus, public, private, p, q, dp, dq, inverse = (int.from_bytes(data[b:e], "big") for _, b, e in parts[:9])
    if any(b == e or data[b] >= 0x80 for _, b, e in parts) or version > 1 or (version == 0) != (len(parts) == 9):
        return False
    if modulus.bit_length() < 512 or public < 3 or not private or min(dp, dq, inverse) < 1:
        return False
    if version:  # of several primes, which follow
        return p.bit_length() + q.bit_length() < modulus.bit_length()
    return abs(p.bit_length() + q.bit_length() - modulus.bit_length()) <= 1 and dp < p and dq < q and inverse < p


def is_der_key(data: bytes) -> bool:
    """Whether these bytes are one SEQUENCE laid out as a PKCS#8, encrypted PKCS#8, PKCS#1 or SEC1 private key."""
    top = der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der(data, *top[0][1:])
    if not parts:
        return False
    tags = [x[0] for x in parts]
    if tags == [0x30, 0x04]:  # the algorithm, what it encrypted; a digest is built alike
        algorithm = der(data, *parts[0][1:])
        if not algorithm or algorithm[0][0] != 0x06 or parts[1][1] == parts[1][2]:
            return False
        return data[algorithm[0][1] : algorithm[0][2]].startswith(PBE)
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, the key in an octet string
        algorithm = der(data, *parts[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and bool(der(data, *parts[2][1:]))
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and set(tags[9:]) <= {0x30}:
        return is_rsa(data, parts)
    return tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1} and parts[1][2] - parts[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """Whether the length-prefixed fields after the magic string fill these bytes."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at < len(data):
        if fields == 3:  # the number of keys stands bare
            at += 4
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return at == len(data) and fields >= 5


def is_token(text: str) -> bool:
    """Whether this is a signed token: header and payload are JSON objects, the header names ``alg``, and a signature decodes."""
    parts = text.split(".")
    if len(parts) != 3 or not unbase64(parts[2]):
        return False
    try:
        header, payload = (json.loads(unbase64(x) or b"") for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """The spans of signed tokens. Each part of a dotted run is looked at a bounded number of times."""
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split("."), run.start(), 0
        while k + 2 < len(parts):
            start, size = parts[k].find("eyJ"), len(parts[k])
            if start >= 0 and is_token(".".join((parts[k][start:], *parts[k + 1 : k + 3]))):
                end = at + size + len(parts[k + 1]) + len(parts[k + 2]) + 2
                yield at + start, end
                at, k = end + 1, k + 3
            else:
                at, k = at + size + 1, k + 1


def is_secret(data: bytes | None) -> bool:
    """Whether decoded bytes are a key, or the text of a key or of a signed token."""
    if not data:
        return False
    if data[0] == 0x30:
        return is_der_key(data)
    if data.startswith(b"openssh-key-v1\x00"):
        return is_ssh_key(data)
    if data.startswith((b"-----BEGIN ", b"eyJ")) and data.isascii():
        text = data.decode("ascii")
        return is_token(text.strip()) or any(True for _ in pem_keys(text))
    return False


def is_pem_body(body: str) -> bool:
    """Whether what stands between the lines of armour is a key, encrypted or not, under headers or not."""
    body = body.replace("\0", "")
    dek, rest = DEK.search(body), body
    if dek and "\n" not in body.strip():
        rest = body[dek.end() :]
    elif headers := list(HEADER.finditer(body)):
        rest = body[headers[-1].end() :]
        if m := BLANK.search(rest):
            rest = rest[m.end() :]
    data = unbase64("".join(rest.split()))
    if not data:
        return False
    if dek:  # nothing shows in the encrypted bytes but whole blocks
        block = len(dek[2]) // 2
        return not dek[1].upper().endswith("-CBC") or len(data) % block == 0
    return is_der_key(data) or is_ssh_key(data)


def pem_keys(text: str) -> Iterator[tuple[int, int]]:
    for m in PEM.finditer(unescaped(text)):
        if is_pem_body(m[2]):
            yield m.span()


def der_size(head: bytes) -> int | None:
    """The bytes of the whole key that starts so; None if no key does."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    first = head[2 + n : 5 + n]
    if first[:1] != b"\x30" and not (first[:2] == b"\x02\x01" and first[2:] <= b"\x03"):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def may_be_key(head: bytes, size: int) -> bool:
    """Whether a key of this size can start so, as far as these first bytes of it tell: what ``is_der_key`` asks for, in order."""

    def value(at: int) -> tuple[int, int, int] | None:
        """(tag, start, end) of what is at ``at``; None if its length is not in the head."""
        n = head[at + 1] & 0x7F if len(head) > at + 1 and head[at + 1] >= 0x80 else 0
        if len(head) < at + 2 + n:
            return None
        start = at + 2 + n
        return head[at], start, start + (int.from_bytes(head[at + 2 : start], "big") if n else head[at + 1])

    if not (top := value(0)) or not (first := value(top[1])):
        return True
    if first[2] > size:
        return False
    if first[0] == 0x30:  # the algorithm, then an octet string to the end
        if first[1] < len(head) and (first[1] == first[2] or head[first[1]] != 0x06):
            return False
        second = value(first[2])
        return not second or second[0] == 0x04 and second[2] == size
    if not (second := value(first[2])):
        return True
    if second[2] > size or second[0] not in (0x30, 0x02, 0x04):
        return False
    if second[0] == 0x30:
        return second[1] >= len(head) or second[1] < second[2] and head[second[1]] == 0x06
    return second[0] == 0x02 or second[2] - second[1] >= 16


def secret_size(data: bytes) -> int | None:
    """How many of these bytes are the secret that starts them; None if none does."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left = 15, 3
        while left:
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
        while left and at < len(data):
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        return at if not left and is_ssh_key(data[:at]) else None
    if data.startswith(b"-----BEGIN "):
        m = PEM.match(unescaped(data.decode("latin-1")))
        return m.end() if m and is_pem_body(m[2]) else None
    if data.startswith(b"eyJ"):
        m = TOKEN.match(data.decode("latin-1"))
        return m.end() if m and is_token(m[0]) else None
    size = der_size(data[:12])
    return size if size and size <= len(data) and is_der_key(data[:size]) else None


def joined_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets whose encoding starts a run and may go on over the lines that follow, up to where it says it ends."""
    text, done = unescaped(text), 0
    for m in START.finditer(text):
        if m.start() < done:
            continue
        hexed = m["hex"] is not None
        bits, line = 4 if hexed else 6, LINES[hexed]
        need = len(text)
        if m[0].startswith("30" if hexed else "M"):
            head = m[0].replace("\0", "")
            size = der_size(bytes.fromhex(head) if hexed else unbase64(head) or b"")
            if not size or (need := -(-size * 8 // bits)) < 40 or need > len(text) - m.start():
                continue  # no key, or one that ends behind the text
            own = line.match(text, m.start())[0].replace("\0", "")
            own = own[: min(need, len(own), HEAD) // 8 * 8]
            if not may_be_key((bytes.fromhex(own) if hexed else unbase64(own)) or b"", size):
                continue  # refused by its own line, so that those that follow are not read for it
        run, at, pieces, have = None, m.start(), [], 0
        while have < need and (run := line.match(text, at)):
            pieces.append(run.span())
            have += len(run[0]) - run[0].count("\0")
            gap = BREAK.match(text, run.end())
            if not gap:
                break
            at = gap.end()
        whole = "".join(text[a:b] for a, b in pieces).replace("\0", "")
        whole = whole[: min(need, len(whole))]
        whole = whole[: len(whole) - 1] if len(whole) % 2 and hexed or len(whole) % 4 == 1 and not hexed else whole
        data = bytes.fromhex(whole) if hexed else unbase64(whole)
        if not data or not (size := secret_size(data)):
            continue
        left = -(-size * 8 // bits)
        for a, b in pieces:
            for k in range(a, b):
                left -= text[k] != "\0"
                if not left:
                    break
            if not left:
                done = k + 1
                break
        if not hexed:
            done += len(re.match("={0,2}", text[done : done + 2])[0])
        yield "hexkey" if hexed else "key", m.start(), done


class Covered:
    """Spans, asked whether one of them holds another."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.begins = [b for b, _ in sorted(spans)]
        self.ends = list(accumulate((e for _, e in sorted(spans)), max))

    def holds(self, begin: int, end: int) -> bool:
        k = bisect_right(self.begins, begin)
        return bool(k) and end <= self.ends[k - 1]


def findings(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in ``text``, by start, then kind in the order of KINDS, then end."""
    if not text:
        return []
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *span) for span in tokens(text)]
    if "-----BEGIN " in text:
        out += [("pem", *span) for span in pem_keys(text)]
    armoured = Covered([x[1:] for x in out if x[0] == "pem"])
    for m in BASE64.finditer(text):
        if armoured.holds(*m.span()):
            continue
        if is_secret(unbase64(m[0])):
            out.append(("key", *m.span()))
        else:
            for h in HEX_ANY.finditer(m[0]):
                if is_secret(bytes.fromhex(h[0])):
                    out.append(("hexkey", m.start() + h.start(), m.start() + h.end()))
    known = Covered([x[1:] for x in out if x[0] in KINDS[len(BASE_KINDS) :]])
    out += [x for x in joined_keys(text) if not known.holds(*x[1:])]
    if len(out) > 1:
        out.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each stretch covered by findings replaced by ``[<kind>]`` of the first of them."""
    if not text or not spans:
        return text
    out, at, kind, begin, end = [], 0, *spans[0]
    for k, b, e in [*spans[1:], ("", len(text) + 1, 0)]:
        if b < end:
            end = max(end, e)
        else:
            out += [text[at:begin], f"[{kind}]"]
            at, kind, begin, end = end, k, b, e
    return "".join([*out, text[at:]])


@F.arrow_udf(SPANS)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": b, "end": e} for k, b, e in findings(t.as_py())] for t in texts], type=_ARROW
    )


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array((redacted(x, findings(x)) for x in (t.as_py() for t in texts)), type=pa.string())


def scan(docs: DataFrame, text_col: str = "text", to: str = "findings") -> DataFrame:
    """``docs`` with an array of (kind, start, end) in ``to``."""
    return docs.withColumn(to, _find(shared.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the findings in their texts replaced by their kinds."""
    return docs.withColumn(text_col, _redact(shared.col(text_col)))


def listed(spans: str | Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    each = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, each), ",")

"""Secret scans with structural confirmation.

Patterns for assignments, access keys and long hex find the base spans. Beyond them, heads of keys in base64 and hex, armoured
key blocks and dotted tokens are candidates only: each is decoded and its structure parsed, and a span is reported
when a key encoding, its nested lengths or a signed token's header hold together. A head may stand anywhere in a run, and
a key may go on over line ends, plain or escaped; its own lengths say where it stops.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.common import as_text, pick

#: The order of kinds: the three base kinds, then those of the method.
KINDS = ("assign", "access", "hex", "armour", "der", "openssh", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----).){16,}?)-----END \1-----", re.S)
#: RFC 1421 headers of an encrypted key: the cipher's name and its start value.
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-Fa-f]+)\s+")
_HEADERS = re.compile(r"\A\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t][^\n]*\n)*)+")
_ESCAPED = re.compile(r"(?<!\\)\\+(?:u([0-9a-fA-F]{4})|([rnt/]))")
_LINE_MARKS = re.compile(r"""["'][ \t]*(?:[+.,;][ \t]*)?$|^[ \t>#*|]*["']?|\\$""", re.M)
#: The first character of what may be a DER SEQUENCE, with what has to follow it on its line.
_BASE64_HEAD = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{14})")
_HEX_HEAD = re.compile(r"3(?=0(?:[0-7][0-9a-fA-F]|8[1-4])[0-9a-fA-F]{28})")
_OPENSSH_HEADS = re.compile(r"b3BlbnNzaC1rZXktdjEA|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100")
_BASE64_RUN, _HEX_RUN = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9a-fA-F]+")
#: From one line of a wrapped run to the next: line ends, plain or escaped, with the quotes and margins around them.
_BREAK = re.compile(r"""(?:["'][ \t]*(?:[+.,][ \t]*)?|[ \t]*)(?:\\+[rn]|\\?[\r\n])(?:\\+[rn]|\\?[\r\n]|["'][ \t]*[+.](?=\s)|[ \t"'>#*|])*""")
#: Three dotted runs, from the start of a run only; others may begin inside the second and third.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{11,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,}))")
_OPENSSH = b"openssh-key-v1\0"
_JSON, _FIRST_KEY = json.JSONDecoder(), re.compile(r'\{"[^"\\]*"\s*:')


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, with or without padding; None if it is neither."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list | None:
    """The (tag, value) items of a DER byte string whose lengths add up exactly, else None; constructed
    items have a list as value."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length == 0x80:
            return None
        if length > 0x80:
            n = length & 0x7F
            if n > 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        value = data[at : at + length]
        at += length
        if tag & 0x20:
            value = der_items(value, depth + 1)
            if value is None:
                return None
        out.append((tag, value))
    return out


def _is_encrypted_key(inside: list) -> bool:
    """EncryptedPrivateKeyInfo: a SEQUENCE of an algorithm's OBJECT IDENTIFIER and parameters, and an OCTET STRING."""
    if [tag for tag, _ in inside] != [0x30, 0x04] or len(inside[1][1]) < 16:
        return False
    algorithm = inside[0][1]
    return [tag for tag, _ in algorithm] == [0x06, 0x30] and bool(algorithm[1][1])


def is_der_key(data: bytes | None) -> bool:
    """A private key: one SEQUENCE that starts with a small version INTEGER and holds key material, or an encrypted one."""
    if not data or len(data) < 32 or data[0] != 0x30:
        return False
    items = der_items(data)
    if not items or len(items) != 1 or not isinstance(items[0][1], list):
        return False
    inside = items[0][1]
    if _is_encrypted_key(inside):
        return True
    if len(inside) < 2 or inside[0][0] != 0x02 or inside[0][1] not in (b"\0", b"\1"):
        return False
    numbers = sum(tag == 0x02 and len(value) >= 16 for tag, value in inside)
    octets = any(tag == 0x04 and len(value) >= 16 for tag, value in inside)
    return numbers >= 4 or octets


def openssh_end(data: bytes | None) -> int | None:
    """The length of the openssh-key-v1 container that data starts with: strings with four-byte lengths; None without one. Minus the
    bytes it takes to know more, if data ends too early."""
    if not data or not data.startswith(_OPENSSH):
        return None
    at, strings, keys = len(_OPENSSH), 3, None
    while True:
        if at + 4 > len(data):
            return -(at + 4)
        length = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if strings:
            at, strings = at + length, strings - 1
            if strings == 0 and keys is not None:
                return at if at <= len(data) else -at
        elif 0 < length < 100:
            keys = length
            strings = keys + 1
        else:
            return None


def is_openssh_key(data: bytes | None) -> bool:
    """The openssh-key-v1 container, which fills data exactly."""
    return bool(data) and openssh_end(data) == len(data)


def is_armoured_key(body: str) -> bool:
    """What stands between the lines of an armour: a key's encoding, after headers if there are any, or, after those of
    an encrypted key, whole blocks of its cipher. Line ends may be escaped, lines may be quoted."""
    body = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "/" if m[2] == "/" else "\n", body)
    body = _LINE_MARKS.sub("", body)
    m = _ENCRYPTED.search(body)
    if m:
        data = decode_base64(body[m.end() :])
        return bool(data) and len(m[1]) in (16, 32) and len(data) >= 32 and len(data) % (len(m[1]) // 2) == 0
    data = decode_base64(_HEADERS.sub("", body))
    return is_der_key(data) or is_openssh_key(data)


class Runs:
    """The runs of base64 or hex characters of a text, a run that goes on over line ends being one chain, with bytes to be decoded anywhere in it.

    A character's coordinate is its place less the gaps before it in its chain, so that any number of characters further on is found by
    bisection, however many lines lie between."""

    def __init__(self, text: str, of_hex: bool):
        self.text, self.of_hex = text, of_hex
        runs = [m.span() for m in (_HEX_RUN if of_hex else _BASE64_RUN).finditer(text)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]
        self.heads: dict[int, tuple[int, int, int] | None] = {}
        self.moved, self.first, self.last = [0] * len(runs), list(self.starts), list(range(len(runs)))
        for j in range(1, len(runs)):
            gap = _BREAK.match(text, self.ends[j - 1]) if runs[j][0] - runs[j - 1][1] < 1000 else None
            if gap and self.starts[j] <= gap.end() < self.ends[j]:
                self.first[j] = self.ends[j - 1] + self.moved[j - 1]
                self.moved[j] = self.first[j] - gap.end()
        for j in range(len(runs) - 2, -1, -1):
            if self.first[j + 1] == self.ends[j] + self.moved[j] and self.starts[j + 1] != self.first[j + 1]:
                self.last[j] = self.last[j + 1]

    def _run(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def left(self, at: int) -> int:
        """How many characters of the chain there are from a place on."""
        j = self._run(at)
        k = self.last[j]
        return self.ends[k] + self.moved[k] - at - self.moved[j]

    def place(self, at: int, count: int) -> int:
        """Where the text stands after so many characters from a place on."""
        j = self._run(at)
        c = at + self.moved[j] + count
        k = j if c <= self.ends[j] + self.moved[j] else bisect.bisect_left(self.first, c, j + 1, self.last[j] + 1) - 1
        return c - self.moved[k]

    def chars(self, at: int, skip: int, count: int) -> str:
        j = self._run(at)
        c, out = at + self.moved[j] + skip, []
        if c >= self.ends[j] + self.moved[j]:
            j = bisect.bisect_right(self.first, c, j + 1, self.last[j] + 1) - 1
        while count > 0:
            piece = self.text[c - self.moved[j] : min(self.ends[j], c - self.moved[j] + count)]
            out.append(piece)
            c, count = c + len(piece), count - len(piece)
            if j == self.last[j]:
                break
            j += 1
        return "".join(out)

    def bytes(self, at: int, skip: int, count: int) -> bytes:
        """`count` bytes, `skip` bytes into what begins at a place; fewer at the chain's end."""
        if self.of_hex:
            some = self.chars(at, 2 * skip, 2 * count)
            return bytes.fromhex(some[: len(some) // 2 * 2])
        first = skip // 3
        some = self.chars(at, 4 * first, 4 * (-(-(skip + count) // 3) - first))
        return (decode_base64(some[: len(some) - (len(some) % 4 == 1)]) or b"")[skip - 3 * first :][:count]

    def head(self, at: int, skip: int) -> tuple[int, int, int] | None:
        """(tag, bytes of the head, length) of the DER part `skip` bytes into what begins at a place; None if it has none. Candidates that overlap
        share what was read, by the bit it begins at."""
        key = 6 * (at + self.moved[self._run(at)]) + 8 * skip if not self.of_hex else 4 * (at + self.moved[self._run(at)]) + 8 * skip
        if key in self.heads:
            return self.heads[key]
        head, found = self.bytes(at, skip, 6), None
        if len(head) >= 2 and head[1] != 0x80:
            n = head[1] & 0x7F if head[1] > 0x80 else 0
            length = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
            if not n or (n <= 4 and len(head) >= 2 + n and head[2] != 0 and length >= 0x80):
                found = (head[0], 2 + n, length)
        if len(self.heads) > 200_000:  # a bound of memory
            self.heads.clear()
        self.heads[key] = found
        return found

    def size(self, length: int) -> int:
        """Characters of so many bytes."""
        return 2 * length if self.of_hex else -(-length * 4 // 3)


#: A private key has no more parts than this, those within parts included: version, algorithm, numbers, attributes.
MOST_PARTS = 32


def _parts(runs: Runs, at: int, begin: int, end: int, depth: int, left: list[int]) -> list | None:
    """(tag, begin, length, parts inside or None) of the DER parts that fill bytes begin to end of what begins at a place; None if they don't, nest too
    deeply or are too many. Only tags and lengths are decoded, from the front inward, so a candidate costs no more than MOST_PARTS steps."""
    out = []
    while begin < end:
        left[0] -= 1
        head = runs.head(at, begin) if left[0] >= 0 and depth <= 12 else None
        if head is None:
            return None
        tag, n, length = head
        first = begin + n
        if first + length > end:
            return None
        inside = _parts(runs, at, first, first + length, depth + 1, left) if tag & 0x20 else None
        if tag & 0x20 and inside is None:
            return None
        out.append((tag, first, length, inside))
        begin = first + length
    return out


def der_end(runs: Runs, at: int) -> int | None:
    """Where the private key that begins at a place ends, None without one: is_der_key by tags and lengths alone."""
    head = runs.head(at, 0)
    if head is None or head[0] != 0x30:
        return None
    length = head[1] + head[2]
    if length < 32 or runs.size(length) > runs.left(at):
        return None
    whole = _parts(runs, at, 0, length, 0, [MOST_PARTS])
    if not whole or len(whole) != 1 or whole[0][3] is None:
        return None
    inside = whole[0][3]
    tags = [part[0] for part in inside]
    if tags == [0x30, 0x04] and inside[1][2] >= 16:
        algorithm = inside[0][3]
        encrypted = [part[0] for part in algorithm] == [0x06, 0x30] and bool(algorithm[1][3])
        return runs.place(at, runs.size(length)) if encrypted else None
    if len(inside) < 2 or tags[0] != 0x02 or inside[0][2] != 1 or runs.bytes(at, inside[0][1], 1) not in (b"\0", b"\1"):
        return None
    long = [tag for tag, _, size, _ in inside if size >= 16]
    return runs.place(at, runs.size(length)) if long.count(0x02) >= 4 or 0x04 in long else None


def _openssh_length(runs: Runs, at: int) -> int | None:
    """The length of the openssh-key-v1 container that begins at a place; only the strings' lengths are decoded, a hundred or so at most."""
    end, strings, keys = len(_OPENSSH), 3, None
    most = runs.left(at) // 2 if runs.of_hex else runs.left(at) * 3 // 4
    while end + 4 <= most:
        length = int.from_bytes(runs.bytes(at, end, 4), "big")
        end += 4
        if strings:
            end, strings = end + length, strings - 1
            if strings == 0 and keys is not None:
                return end if end <= most else None
        elif 0 < length < 100:
            keys = length
            strings = keys + 1
        else:
            return None
    return None


def key_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 or hex, found by their heads and read inward by their lengths. A key's inner parts, which may look like keys, are not reported."""
    found, made = [], {}

    def runs_of(of_hex: bool) -> Runs:
        if of_hex not in made:
            made[of_hex] = Runs(text, of_hex)
        return made[of_hex]

    for head, of_hex in ((_BASE64_HEAD, False), (_HEX_HEAD, True)):
        last = 0
        for m in head.finditer(text):
            end = der_end(runs_of(of_hex), m.start()) if m.start() >= last else None
            if end is not None:
                found.append((m.start(), end, "der", of_hex))
                last = end
    for m in _OPENSSH_HEADS.finditer(text):
        of_hex = m[0][0] == "6"
        length = _openssh_length(runs_of(of_hex), m.start())
        if length is not None:
            found.append((m.start(), runs_of(of_hex).place(m.start(), runs_of(of_hex).size(length)), "openssh", of_hex))
    padded = lambda end: end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
    return [(at, end if of_hex else padded(end), kind) for at, end, kind, of_hex in found]


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A header that is a JSON object naming its algorithm, a JSON payload and a decodable signature."""
    try:
        first, second = json.loads(decode_base64(header) or b""), json.loads(decode_base64(payload) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict) and decode_base64(signature) is not None


def token_start(run: str) -> int | None:
    """Where in a run the header of a signed token begins, which goes on to the run's end. Heads at one alignment are decoded once."""
    heads: dict[int, int] = {}
    best = None
    for m in re.finditer("eyJ", run):
        heads.setdefault(m.start() % 4, m.start())
    for first in heads.values():
        data = (decode_base64(run[first:]) or b"").decode("latin-1")
        at = first
        while at >= 0 and (best is None or at < best):
            end = None
            if _FIRST_KEY.match(data, (at - first) // 4 * 3):
                try:
                    header, end = _JSON.raw_decode(data, (at - first) // 4 * 3)
                except (ValueError, RecursionError):
                    pass
            if end == len(data) and isinstance(header, dict) and isinstance(header.get("alg"), str):
                best = at
                break
            at = run.find("eyJ", at + 1)
            while at >= 0 and at % 4 != first % 4:
                at = run.find("eyJ", at + 1)
    return best


def token_spans(text: str) -> list[tuple[int, int, str]]:
    out, last = [], 0
    for m in _TOKEN.finditer(text):
        at = token_start(m[1]) if m.start() >= last else None
        if at is not None and is_signed_token(m[1][at:], m[2], m[3]):
            last = m.end(3)
            out.append((m.start() + at, last, "token"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """The method's own spans: candidates whose decoded structure parses."""
    out = []
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            if is_armoured_key(m[2]):
                out.append((m.start(), m.end(), "armour"))
    if "eyJ" in text:
        out += token_spans(text)
    return out + key_spans(text)


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty: no spans, an empty string, the
    digest of an empty string. Each whole text is scanned in its own row's task, without a shuffle; repeated
    rows are scanned each. Spans are code points, the end exclusive. No rows give no rows.
    """

    def run(batches):
        for batch in batches:
            texts = as_text(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [s[2] for s in base]
                rows.append(
                    (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more))
                )
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)

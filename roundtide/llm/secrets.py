"""Secret scan with a worklist of decoded layers.

The text is the first layer. Each layer is scanned for secrets and for what is encoded: URL escapes and
Unicode escapes, which are decoded in place in the whole layer (what is no character stays as it is),
and base64, also over line ends and after a path or name, whose bytes may be text or hold zlib or gzip
streams. What decodes to text becomes a new layer with a map from its characters to the text's characters, and is scanned
in turn, until no new layer appears. An escape of an escape (%252541) is decoded to its end in one step, so nests
of one kind cost one layer; nests that alternate between the two kinds cost a layer for each change. A stretch of the text that gives the same layer again (a cycle)
is not followed twice. Findings in layers are reported where their encoded form stands in the text.

Spans are ``kind:start:end`` in code points, end exclusive; a finding in a layer has the decoders in
its kind, ``assign@url>base64``. Base findings are those of the text itself and always stay. A stream
that inflates beyond ``max_layer_bytes`` is searched in pieces of that size, each of which begins with the last
quarter of the one before, so what is longer than that may be found in part only; its place is reported as
``oversize`` besides.

Edge cases: null or empty text has no spans; ids may be null or repeat, each row is scanned by
itself; very long texts take time in proportion to their length; other columns are ignored.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections import deque

from pyspark.sql import DataFrame

from roundtide.llm.common import map_columns, texts

# The base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

#: Hexadecimal runs are searched as at least 24 characters from a run's start, which is the same set.
HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORD_PARTS = ("passw", "secret", "token", "apikey", "api_key")
#: Escapes, also of the mark that begins an escape, however often.
URL_ESCAPE = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
URL_ESCAPES = re.compile(rf"(?:{URL_ESCAPE.pattern})+")
UNICODE_ESCAPE = re.compile(r"\\(?:u005[Cc]|x5[Cc])*(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
UNICODE_CODE = re.compile(r"(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})\Z")
UNICODE_ESCAPES = re.compile(rf"(?:{UNICODE_ESCAPE.pattern})+")
BASE64_STRETCH = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line end inside base64, also one that is escaped as in JSON.
BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
WRAPPED_STRETCH = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)+={{0,2}}")
#: No pattern, and no encoded form of one, is met by less text than this.
READABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{12}")
STREAM = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][^\x20-\x3f\x60-\x7f\xa0-\xbf\xe0-\xff]", re.DOTALL)
MAX_LAYER_BYTES = 16 << 20


class Layer:
    """A text, how it was decoded, and for each character its start and end in the document."""

    __slots__ = ("text", "path", "starts", "ends", "large")

    def __init__(self, text: str, path: tuple[str, ...] = (), starts=None, ends=None):
        self.text, self.path, self.starts, self.ends = text, path, starts, ends
        self.large = False  # a piece of a stream that is not held whole

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, Spot):
            return self.starts.at, self.ends.at
        return min(self.starts[start:end]), max(self.ends[start:end])


class Spot:
    """The same place for every character of a layer."""

    __slots__ = ("at", "size")

    def __init__(self, at: int, size: int):
        self.at, self.size = at, size

    def __getitem__(self, part: slice) -> list[int]:
        return [self.at] * len(range(*part.indices(self.size)))


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORD_PARTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    return found


def _unescape(run: str, name: str):
    """(length in the run, text or None where it stays as it is) of a run of escapes, in order."""
    if name == "url":
        escapes, at = URL_ESCAPE.findall(run), 0
        for c in bytes.fromhex("".join(e[-2:] for e in escapes)).decode("utf-8", "surrogateescape"):
            bad = "\udc80" <= c <= "\udcff"  # a byte that is not UTF-8
            n = 1 if bad else len(c.encode("utf-8"))
            yield sum(map(len, escapes[at : at + n])), None if bad else c
            at += n
        return
    codes = [(len(e), int(UNICODE_CODE.search(e, max(0, len(e) - 5)).group()[1:], 16)) for e in UNICODE_ESCAPE.findall(run)]
    at = 0
    while at < len(codes):
        n, code = codes[at]
        at += 1
        if 0xD800 <= code < 0xDC00 and at < len(codes) and 0xDC00 <= codes[at][1] < 0xE000:
            n, code = n + codes[at][0], 0x10000 + (code - 0xD800) * 0x400 + codes[at][1] - 0xDC00
            at += 1
        yield n, None if 0xD800 <= code < 0xE000 else chr(code)


def unwrap_escapes(layer: Layer, escapes: re.Pattern, name: str) -> Layer | None:
    """The whole layer with its escapes decoded in place; what is no character stays as it is."""
    text, size = layer.text, len(layer.text)
    from_ = layer.starts if layer.starts is not None else range(size)
    to = layer.ends if layer.ends is not None else range(1, size + 1)
    parts, starts, ends, at, changed = [], [], [], 0, False
    for m in escapes.finditer(text):
        i = m.start()
        for n, c in _unescape(m.group(), name):
            if c is not None:
                parts += (text[at:i], c)
                starts += from_[at:i]
                ends += to[at:i]
                starts.append(min(from_[i : i + n]))
                ends.append(max(to[i : i + n]))
                at, changed = i + n, True
            i += n
    if not changed:
        return None
    parts.append(text[at:])
    starts += from_[at:]
    ends += to[at:]
    return Layer("".join(parts), (*layer.path, name), starts, ends)


def inflate(raw: bytes | memoryview, limit: int) -> tuple[bytes, int] | None:
    """The content of a zlib stream or of all members of a gzip one, and its length in ``raw``; None if it is
    none; OverflowError beyond the limit."""
    out, at = b"", 0
    while at == 0 or raw[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(47)
        try:
            part = stream.decompress(raw[at:], limit + 1 - len(out))
        except zlib.error:
            break
        out += part
        if len(out) > limit:
            raise OverflowError
        if not stream.eof:
            break
        at = len(raw) - len(stream.unused_data)
        if raw[0] != 0x1F:
            break
    return (out, at) if at else None


def pieces(raw: bytes | memoryview, limit: int):
    """(content, length of the stream so far) of a large stream, a piece at a time; the last one is what is left."""
    out, at, read = b"", 0, 0
    while at == 0 or raw[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(47)
        rest = raw[at:]
        try:
            while not stream.eof:
                part = stream.decompress(rest, limit - len(out))
                rest = stream.unconsumed_tail
                out += part
                read = len(raw) - len(rest) - len(stream.unused_data)
                if len(out) >= limit:
                    yield out, read
                    out = out[-(limit // 4) :]
                elif not part and not rest:
                    break
        except zlib.error:
            break
        if not stream.eof or raw[0] != 0x1F:
            break
        at = read
    yield out, max(read, 1)


def streams(raw: bytes, limit: int):
    """(start, end, content) of the zlib and gzip streams in the bytes; beyond the limit the content is an
    iterator of its pieces."""
    at, view = 0, memoryview(raw)
    while m := STREAM.search(raw, at):
        at = m.start()
        try:
            got = inflate(view[at:], limit) if raw[at] == 0x1F or (raw[at] << 8 | raw[at + 1]) % 31 == 0 else None
        except OverflowError:
            for _, size in pieces(view[at:], limit):
                pass
            yield at, at + size, (text for text, _ in pieces(view[at:], limit))
            at += size
            continue
        if got:
            yield at, at + got[1], got[0]
        at += got[1] if got else 1


def unwrap_base64(layer: Layer, m: re.Match, limit: int):
    """Layers of a run of base64, read from each of four characters, as a prefix may belong to the run.

    Bytes that are not UTF-8 stay in the layer as surrogates, which no pattern takes.
    """
    body, spots = m.group(), None
    if not body.isalnum():
        spots = [m.start() + i for i in _joined(body)]
        body = BREAK.sub("", body)
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    place = (lambda a, b: (m.start() + a, m.start() + b)) if spots is None else (lambda a, b: (spots[a], spots[b - 1] + 1))
    for phase in range(4):
        size = len(body) - phase
        if size % 4 == 1:
            size -= 1
        raw = binascii.a2b_base64(body[phase : phase + size] + "=" * (-size % 4))
        for a, b, packed in streams(raw, limit):
            spot = layer.place(*place(phase + a // 3 * 4 + a % 3, min(size, -(-b * 4 // 3)) + phase))
            if a == 0 and phase == 0 and b == len(raw):
                spot = layer.place(m.start(), m.end())
            if not isinstance(packed, bytes):
                yield spot
            for part in [packed] if isinstance(packed, bytes) else packed:
                text = part.decode("utf-8", "surrogateescape")
                below = Layer(text, (*layer.path, "base64", "inflate"), Spot(spot[0], len(text)), Spot(spot[1], len(text)))
                below.large = part is not packed
                yield below
        text = raw.decode("utf-8", "surrogateescape")
        if not READABLE.search(text):
            continue
        starts, ends, at = [], [], 0
        for c in text:
            n = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
            first, last = phase + at // 3 * 4 + at % 3, phase + (at + n - 1) // 3 * 4 + (at + n - 1) % 3
            start, end = layer.place(*place(first, last + 2))
            starts.append(start)
            ends.append(end)
            at += n
        yield Layer(text, (*layer.path, "base64"), starts, ends)


def _joined(body: str):
    """Positions of the characters that are left without line ends."""
    at = 0
    for m in BREAK.finditer(body):
        yield from range(at, m.start())
        at = m.end()
    yield from range(at, len(body))


def unwrapped(layer: Layer, limit: int):
    """Layers one step below, and (start, end) places of streams too large to hold."""
    text = layer.text
    for escapes, name in ((URL_ESCAPES, "url"), (UNICODE_ESCAPES, "unicode")):
        if escapes.search(text):
            yield unwrap_escapes(layer, escapes, name)
    for stretch in (BASE64_STRETCH, WRAPPED_STRETCH):
        for m in stretch.finditer(text):
            if m.end() - m.start() >= 16:
                yield from unwrap_base64(layer, m, limit)


def scan(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each sorted by start, then kind as listed."""
    base = findings(text)
    added: set[tuple[str, int, int]] = set()
    known = set(base)
    seen: set[tuple[int, int, bytes]] = set()

    def follow(first: Layer) -> None:
        work = deque([first])
        while work:
            layer = work.popleft()
            if layer.path:
                for kind, a, b in findings(layer.text):
                    a, b = layer.place(a, b)
                    if (kind, a, b) not in known:  # what the text itself shows is no news
                        known.add((kind, a, b))
                        added.add((f"{kind}@{'>'.join(layer.path)}", a, b))
            for below in unwrapped(layer, max_layer_bytes):
                if isinstance(below, tuple):
                    added.add(("oversize", *below))
                elif below is not None and READABLE.search(below.text):
                    a, b = below.place(0, len(below.text))
                    mark = (a, b, hashlib.blake2b(below.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    if mark in seen:
                        continue
                    seen.add(mark)
                    if below.large:
                        follow(below)  # at once, so that one piece of it is held at a time
                    else:
                        work.append(below)

    follow(Layer(text))

    def order(span):
        kind = span[0].partition("@")[0]
        return span[1], KINDS.index(kind) if kind in KINDS else len(KINDS), span[0], span[2]

    return sorted(base, key=order), sorted([*base, *added], key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind in the text itself, base_sha256, spans."""

    def make():
        def step(ids, text):
            out = [[] for _ in range(6)]
            for i, t in zip(ids, text):
                base, spans = scan(t)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                row = (i, *(sum(s[0] == k for s in base) for k in KINDS), digest, joined(spans))
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return step

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_columns(texts(docs), make, schema)

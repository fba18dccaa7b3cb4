"""Operator 1: secrets in texts, also below nested URL, Unicode, base64 and compressed layers.

Every text is a worklist of layers.  A layer is scanned, then unwrapped in every way that changes it; each new
layer keeps, per character, the span of the original text it came from, so finds are reported there.  A layer
already seen is not entered again, so the list ends at a fixpoint.  URL and Unicode escapes are unwrapped one level at a
time, each level scanned, up to ``LEVELS`` of them in a row; what is left is then decoded to its end in one pass, so
that text which holds an escape of an escape of an escape costs its length, not the square of it.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run is what leftmost matching of one or more finds
NAMES = ("passw", "secret", "token", "api")

#: Bytes that the distinct compressed layers of one text may unwrap to at once, together; beyond it a layer is read as a
#: stream, in overlapping windows, and counts in ``n_refused``.
LAYER_BYTES = 32 << 20
WINDOW, OVERLAP = 4 << 20, 64 << 10
#: Compressed bytes fed, and unwrapped ones taken, at a time.
FEED, STEP = 1 << 10, 1 << 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Levels of escapes that are scanned one by one.
LEVELS = 3
#: An escape that ends where it is matched, by its last character: hexadecimal digit, bracket or semicolon.
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
TAIL = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
LONGEST = 10
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
SEPARATOR = re.compile(r"[_/-]")
#: Any secret, wrapped or not, holds so many plain characters in a row; bytes without them need no look.
PLAIN = re.compile(rb"[\x20-\x7e]{12}")


class _Everywhere:
    """One place for every character of a layer."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, i):
        return [self.place] * (i.stop - i.start) if isinstance(i, slice) else self.place


Layer = tuple[str, "list[int] | _Everywhere | None", "list[int] | _Everywhere | None"]


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets of one layer: leftmost non-overlapping matches per kind, failing matches dropped."""
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _bytes_to_layer(raw: bytes, starts: list[int], ends: list[int]) -> Layer:
    """Text of decoded bytes, with the source span of each character's bytes; a byte that is not UTF-8 becomes U+FFFD."""
    text = raw.decode(errors="replace")
    if len(text) == len(raw):
        return text, starts, ends
    text = raw.decode(errors="surrogateescape")  # one character per bad byte, so that places stay
    first, last, at = array("q"), array("q"), 0
    for c in text:
        size = 1 if 0xDC80 <= ord(c) < 0xDD00 else len(c.encode())
        first.append(starts[at])
        last.append(ends[at + size - 1])
        at += size
    return "".join("\ufffd" if 0xDC80 <= ord(c) < 0xDD00 else c for c in text), first, last


def _spliced(layer: Layer, pattern: re.Pattern[str], unwrap) -> Layer | None:
    """The layer with every match that ``unwrap`` can read replaced; None if none was."""
    text, starts, ends = layer
    out, first, last, done = [], array("q"), array("q"), 0

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        first.extend(range(a, b) if starts is None else starts[a:b])
        last.extend(range(a + 1, b + 1) if ends is None else ends[a:b])

    for m in pattern.finditer(text):
        inner = unwrap(m[0], m.start())
        if inner is None:
            continue
        copy(done, m.start())
        done = m.end()
        out.append(inner[0])
        first.extend(inner[1] if starts is None else [starts[i] for i in inner[1]])
        last.extend(inner[2] if ends is None else [ends[i - 1] for i in inner[2]])
    if not done:
        return None
    copy(done, len(text))
    return "".join(out), first, last


def _percent(token: str, at: int) -> Layer | None:
    raw = unquote_to_bytes(token)
    return _bytes_to_layer(raw, [at + 3 * i for i in range(len(raw))], [at + 3 * i + 3 for i in range(len(raw))])


def _escape(token: str, at: int) -> Layer | None:
    if token.startswith("\\x"):
        raw = bytes.fromhex(token.replace("\\x", ""))
        return _bytes_to_layer(raw, [at + 4 * i for i in range(len(raw))], [at + 4 * i + 4 for i in range(len(raw))])
    if token.startswith("\\u") and token[2] != "{":
        units = [int(u, 16) for u in token.split("\\u")[1:]]
        out, first, last, i = [], [], [], 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
            out.append("\ufffd" if 0xD800 <= code < 0xE000 else chr(code))
            first.append(at + 6 * i)
            i += 1 + pair
            last.append(at + 6 * i)
        return "".join(out), first, last
    digits = token.strip("\\uU{}&#;")
    code = int(digits[1:], 16) if digits[0] in "xX" else int(digits, 10 if token[0] == "&" else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [at], [at + len(token)]


def _settled(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded until none is left; None if it has none.

    Decoded characters go onto a stack, whose end may be an escape again: each character is put and taken once.
    """
    text, starts, ends = layer
    if not (PERCENT.search(text) or ESCAPE.search(text)):
        return None
    codes: list[str] = []  # a byte from 80 on stands as a lone surrogate until all are known
    first, last = array("q"), array("q")
    for i, c in enumerate(text):
        codes.append(c)
        first.append(i if starts is None else starts[i])
        last.append(i + 1 if ends is None else ends[i])
        while (c := codes[-1]) in HEX_DIGITS or c in "};":
            m = TAIL.search("".join(codes[-LONGEST:]))
            if m is None:
                break
            token = m[0]
            code = int(token[2:-1], 10) if token[:2] == "&#" and token[2] not in "xX" else int(token.strip("%\\xXuU{}&#;"), 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                break
            begin = first[-len(token)]
            end = last[-1]
            del codes[-len(token) :], first[-len(token) :], last[-len(token) :]
            as_byte = token[0] == "%" or token[:2] == "\\x"
            codes.append(chr(0xDC00 + code) if as_byte and code >= 0x80 else chr(code))
            first.append(begin)
            last.append(end)
    raw = [c.encode("utf-8", "surrogateescape") for c in codes]
    if len(raw) == len(text):
        return None
    sizes = [len(b) for b in raw]
    wide = lambda places: array("q", itertools.chain.from_iterable(map(itertools.repeat, places, sizes)))
    return _bytes_to_layer(b"".join(raw), wide(first), wide(last))


def _decoder(head: bytes):
    """A decompressor for bytes that begin so, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor(max_window_size=128 << 20).decompressobj()
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    return None


def _inflated(chunks: Iterator[bytes], read: list[int]) -> Iterator[bytes]:
    """What is below one compression, in small pieces, up to its end or the first damage; ``read`` gets the bytes it took."""
    pieces = (c[i : i + FEED] for c in chunks for i in range(0, len(c), FEED))
    fed, rest, decoder = 0, b"", None
    try:
        while True:
            if decoder is None or not rest:
                while len(rest) < 6 and (more := next(pieces, b"")):
                    rest += more
                    fed += len(more)
                if not rest:
                    return
            if decoder is None and (decoder := _decoder(rest)) is None:
                read[:] = [fed - len(rest)]
                return
            if isinstance(decoder, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                yield decoder.decompress(rest, STEP)
                while not decoder.needs_input and not decoder.eof:
                    yield decoder.decompress(b"", STEP)
            else:
                yield decoder.decompress(rest)
            rest = b""
            if decoder.eof:
                rest, decoder = decoder.unused_data, None
                read[:] = [fed - len(rest)]
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        return


class _Budget:
    """Bytes that one text may still unwrap to at once, compressed tokens already charged, and tokens read as a stream."""

    def __init__(self, left: int) -> None:
        self.left, self.charged, self.refused = left, {}, 0


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Overlapping windows of a stream."""
    held = b""
    for c in itertools.chain(chunks, (b"",)):
        held += c
        while len(held) >= 2 * WINDOW:
            yield held[: 2 * WINDOW]
            # The next window begins at a break, so that only a run longer than a window is ever split.
            at = held.rfind(b"\n", WINDOW // 2, 2 * WINDOW - OVERLAP)
            at = at if at >= 0 else held.rfind(b" ", WINDOW // 2, 2 * WINDOW - OVERLAP)
            held = held[at if at >= 0 else 2 * WINDOW - OVERLAP :]
    if held:
        yield held


def _unpacked(raw: bytes, budget: _Budget) -> Iterator[tuple[str, int | None]]:
    """Texts of every layer below a compressed token, with the bytes it took if known: one a layer, or windows if it is
    too large for the budget.

    A layer may only look compressed, or hold text beside what is compressed in it, so each is read as text too.  The list
    ends at what no decompressor reads, or at a whole layer that the token held before: one that holds itself.  What was
    charged for a layer is given back when the next one below it is read from it.
    """
    key, seen, read = xxhash.xxh3_128_digest(raw), {xxhash.xxh3_128_digest(raw)}, []
    source, took = (lambda: iter((raw,))), None
    for level in itertools.count():
        most = max(budget.left, budget.charged.get((key, level), 0))
        chunks = (c for c in _inflated(source(), read if not level else []) if c)
        kept, size, mark = [], 0, xxhash.xxh3_128()
        for c in chunks:
            kept.append(c)
            size += len(c)
            mark.update(c)
            if size > most:
                break
        if not size:
            return
        if size <= most:
            if mark.digest() in seen:
                return
            took = read[0] if read else None
            spent = (key, level) not in budget.charged
            if spent:
                budget.charged[key, level] = size
                budget.left -= size
            whole = b"".join(kept)
            if PLAIN.search(whole):
                yield whole.decode(errors="replace"), took
            if spent and _decoder(whole[:6]) is not None:
                budget.left += size
            source = lambda whole=whole: iter((whole,))
        else:
            if (key, level) not in budget.charged:
                budget.charged[key, level] = 0
                budget.refused += 1

            def marked(chunks=chunks, mark=mark):
                for c in chunks:
                    mark.update(c)
                    yield c

            for window in _windows(itertools.chain(kept, marked())):
                if PLAIN.search(window):
                    yield window.decode(errors="replace"), took
            if mark.digest() in seen:
                return
            took = read[0] if read else None
            source = lambda source=source: _inflated(source(), [])
        seen.add(mark.digest())


def _tokens(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    """Layers below base64 tokens: text directly, or text below any number of compressions.

    A token may be glued to what stands around it by "_", "-" or "/", so one may start behind, and end before, each of
    these in a run.  Starts that are a multiple of four apart read the same bytes, so a run is decoded once for each of
    four alignments.  A separator in front of a start decodes to "?", ">", "~" or no plain character at all, and likewise
    one behind an end; no pattern crosses these, so the finds are those of every start with every end.
    """
    text, starts, ends = layer
    for m in BASE64.finditer(text):
        token = m[0].rstrip("=")
        begins = [0, *(g.end() for g in SEPARATOR.finditer(token) if len(token) - g.end() >= 12)]
        plain = token.replace("-", "+").replace("_", "/")
        decoded: dict[int, tuple[int, bytes]] = {}
        for b in begins:
            if b % 4 not in decoded:
                part = plain[b:-1] if (len(plain) - b) % 4 == 1 else plain[b:]
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                decoded[b % 4] = b, raw
                if PLAIN.search(raw):
                    at = m.start() + b
                    src = [at + i * 4 // 3 for i in range(len(raw))]
                    stop = [min(at + len(part), at + (i * 8 + 7) // 6 + 1) for i in range(len(raw))]
                    if starts is not None:
                        src, stop = [starts[i] for i in src], [ends[i - 1] for i in stop]
                    yield _bytes_to_layer(raw, src, stop)
            base, raw = decoded[b % 4]
            at = (b - base) // 4 * 3
            if _decoder(raw[at : at + 6]) is None:
                continue
            for below, took in _unpacked(raw[at:], budget):
                first = m.start() + b
                end = min(m.start() + len(token), first + -(-(len(raw) - at if took is None else took) * 4 // 3))
                yield below, _Everywhere(first if starts is None else starts[first]), _Everywhere(end if ends is None else ends[end - 1])


def _below(layer: Layer, budget: _Budget, level: int = 0) -> Iterator[tuple[Layer, int]]:
    """Layers below this one, each with the number of escapes that were unwrapped in a row above it."""
    for made in _tokens(layer, budget):
        yield made, 0
    if level >= LEVELS:
        if made := _settled(layer):
            yield made, level
        return
    if "%" in layer[0] and (made := _spliced(layer, PERCENT, _percent)):
        yield made, level + 1
    if ("\\" in layer[0] or "&#" in layer[0]) and (made := _spliced(layer, ESCAPE, _escape)):
        yield made, level + 1


def secrets(text: str, layer_bytes: int = LAYER_BYTES) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int, int]:
    """Base secrets, all secrets with those of unwrapped layers, the number of layers, and of those read as a stream."""
    base = list(scan(text))
    budget = _Budget(layer_bytes)
    found, seen, work = set(base), set(), [_below((text, None, None), budget)]
    while work:
        found_below = next(work[-1], None)
        if found_below is None:
            work.pop()
            continue
        made, level = found_below
        key = xxhash.xxh3_128_digest(made[0].encode(errors="surrogatepass")), made[1][0], made[2][-1]
        if key in seen:
            continue
        seen.add(key)
        work.append(_below(made, budget, level))
        found |= {(kind, made[1][a], made[2][b - 1]) for kind, a, b in scan(made[0])}
    return base, found, len(seen), budget.refused


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _row(text: str) -> tuple:
    base, found, layers, refused = secrets(text)
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return *n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), layers, refused


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base secrets by kind, their digest, and all spans, those of layers included.

    Spans are kind:start:end in code points of the original text, end exclusive; a find in a layer spans the source
    of its characters (below compression, the whole token).  Null text is empty text: no counts, the digest of the
    empty string, an empty list.  Repeated rows get equal results; no rows give no rows.  ``n_layers`` counts
    unwrapped layers that have plain characters enough for a secret, bytes that are not UTF-8 replaced; ``n_refused``
    compressed ones that exceed ``LAYER_BYTES`` and were read as a stream.
    """
    return map_rows(texts(docs), _row, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

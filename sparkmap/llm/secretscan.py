"""Secrets in whole texts, also inside nested encodings: a worklist of decoded layers.

The text itself is the first layer.  Each layer is scanned for three kinds,
`assign` (a named value), `access` (an access key) and `hex` (a long lower-case
hex number), and its encoded parts are unwrapped into new layers:

escapes     a line with URL escapes (%41), Unicode escapes (\\u0041, \\x41, &#65;,
            &quot;), full-width forms or invisible characters, all of them replaced
base64      a run of 16 or more of its characters, plain or URL-safe, from each of the
            four places where its groups of four may begin; lines of 60 and more that
            follow one another make one run
compressed  bytes that open as gzip, zlib, bz2, xz or zstandard (from base64, or from a
            run of byte escapes), up to where they break off; UTF-16 text as well

New layers go through the same until none is left.  A layer with the same text for
the same part of the original as one seen before is not worked off again, so
compressed data that unpacks to itself ends, and layers reached in two orders
count once.

Every layer maps its places back to the original text: an escape to its own
characters, a base64 byte to the characters that carry it, unpacked data to the
whole packed part.  A match in a layer counts if it takes in a decoded
character; its span in the original is given in code points, end exclusive.

Data unpacked from a layer are taken in pieces of about a megabyte that end at a
line end, so a small text that unpacks to gigabytes of lines needs little memory; a
line is never cut.

Defined cases: null and empty texts have no secrets; repeated rows are scanned
each for itself; an empty table gives no rows; `find` keeps all columns and
refuses a name that clashes with its new one.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import free_name

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

LEAST_ENCODED = 16
ESCAPE = re.compile(
    r"%u[0-9A-Fa-f]{4}|(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&(?:quot|amp|apos|lt|gt);|[\xad​-‍⁠﻿！-～]"
)
NAMED = {"&quot;": '"', "&amp;": "&", "&apos;": "'", "&lt;": "<", "&gt;": ">"}
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{16,}")
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8}")
URL_SAFE = str.maketrans("-_", "+/")
PIECE = 1 << 20

# which bytes may stand in a hex number (1), in base64 (1)
_HEX_BYTE = bytes(int(chr(i) in "0123456789abcdef") for i in range(256))
_B64_BYTE = bytes(int(chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-")) for i in range(256))
_RUN = b"\x01" * LEAST_ENCODED
_MARKS = (b"%", b"\\", b"&", b"\xc2\xad", b"\xe2\x80", b"\xe2\x81", b"\xef\xbb", b"\xef\xbc", b"\xef\xbd")

Span = tuple[int, int, bool]  # start, end, whether it takes in a decoded character


class Layer(NamedTuple):
    text: str
    to_source: Callable[[int, int], Span]
    steps: tuple[str, ...]


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    steps: str
    value: str


def matches(text: str, raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of all secrets in a text; `raw` is the text in UTF-8."""
    low = raw.lower()  # of A-Z only, so places stay
    if any(word in low for word in (b"passw", b"secret", b"token", b"api")):
        for m in ASSIGN.finditer(low.decode("utf-8", "surrogatepass")):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if b"AKIA" in raw:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    if _RUN[:LEAST_HEX] in raw.translate(_HEX_BYTE):
        for m in HEX.finditer(text):
            if m.end() - m.start() >= LEAST_HEX:
                yield "hex", m.start(), m.end()


def _packing(head: bytes) -> str | None:
    """How bytes that open like this are packed."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    starts = {b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
    return next((name for mark, name in starts.items() if head.startswith(mark)), None)


class _Chunks:
    """Chunks as something to read from."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, size: int = -1) -> bytes:
        if not self.held:
            self.held = next(self.chunks, b"")
        size = len(self.held) if size < 0 else size
        out, self.held = self.held[:size], self.held[size:]
        return out


def _opened(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What packed bytes hold, up to where they break off, in chunks of at most a megabyte; nothing if they are not packed."""
    first = next(chunks, b"")
    kind = _packing(first)
    chunks = chain([first], chunks)
    try:
        if kind in ("gzip", "zlib"):
            bits = 31 if kind == "gzip" else 15
            opener = zlib.decompressobj(bits)
            for data in chunks:
                while data:
                    if part := opener.decompress(data, PIECE):
                        yield part
                    data = opener.unconsumed_tail
                    if opener.eof:
                        data = opener.unused_data
                        if _packing(data) != kind:
                            return
                        opener = zlib.decompressobj(bits)
            if part := opener.flush():
                yield part
        elif kind in ("bz2", "xz"):
            opener = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()
            for data in chunks:
                if part := opener.decompress(data, PIECE):
                    yield part
                while not (opener.eof or opener.needs_input):
                    yield opener.decompress(b"", PIECE)
                if opener.eof:
                    return
        elif kind == "zstd":
            reader = zstandard.ZstdDecompressor().stream_reader(_Chunks(chunks))
            while part := reader.read(PIECE):
                yield part
    except (zlib.error, OSError, lzma.LZMAError, EOFError, zstandard.ZstdError):
        return  # broken off: what came before counts


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of about a megabyte that end at a line end."""
    held: list[bytes] = []
    size = 0
    for part in chunks:
        held.append(part)
        size += len(part)
        cut = part.rfind(b"\n") + 1 if size >= PIECE else 0
        if cut:
            held[-1] = part[:cut]
            yield b"".join(held)
            held, size = [part[cut:]], len(part) - cut
    if size:
        yield b"".join(held)


def _decoded(escape: str) -> tuple[str, list[int], bytes | None]:
    """The characters an escape stands for, where each one's part of it begins (and the end), and its bytes."""
    if escape[0] == "%" and escape[1] != "u" or escape[:2] == "\\x":
        width = 3 if escape[0] == "%" else 4
        raw = bytes.fromhex(escape.replace("%", "").replace("\\x", ""))
        chars = raw.decode("utf-8", "surrogateescape")
        edges, at = [0], 0
        for c in chars:
            at += len(c.encode("utf-8", "surrogateescape"))
            edges.append(at * width)
        return chars, edges, raw
    if escape in NAMED:
        c = NAMED[escape]
    elif escape[0] == "&":
        digits = escape[2:].rstrip(";")
        c = _char(int(digits[1:], 16) if digits[0] in "xX" else int(digits))
    elif len(escape) == 1:
        c = chr(ord(escape) - 0xFEE0) if 0xFF01 <= ord(escape) <= 0xFF5E else ""
    else:
        c = _char(int(escape[2:].strip("{}"), 16))
    return c, [0, len(escape)] if c else [0], None


def _char(point: int) -> str:
    return chr(point) if point <= 0x10FFFF else "�"


def _unescaped(layer: Layer) -> Iterator[Layer]:
    """Each line that holds escapes, with all of them replaced; packed bytes in a run of escapes, opened."""
    text, at = layer.text, 0
    while m := ESCAPE.search(text, at):
        begin = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        parts: list[str] = []
        here: list[int] = []  # where a segment begins in the line
        there: list[tuple[int, int, bool]] = []  # its part of this layer, and whether it is an escape
        escapes: list[int] = []  # where they begin in this layer; invisible characters leave no segment
        size, done = 0, begin
        for e in ESCAPE.finditer(text, begin, end):
            if e.start() > done:
                parts.append(text[done : e.start()])
                here.append(size)
                there.append((done, e.start(), False))
                size += e.start() - done
            escapes.append(e.start())
            chars, edges, raw = _decoded(e.group())
            for i, c in enumerate(chars):
                parts.append(c)
                here.append(size)
                there.append((e.start() + edges[i], e.start() + edges[i + 1], True))
                size += 1
            done = e.end()
            if raw and len(raw) >= 8:
                yield from _blobs(raw, layer, e.start(), e.end(), "escapes")
        if done < end:
            parts.append(text[done:end])
            here.append(size)
            there.append((done, end, False))
        yield Layer("".join(parts), _through(layer, here, there, escapes), (*layer.steps, "escapes"))
        at = end
        if at >= len(text):
            return


def _through(layer: Layer, here: list[int], there: list[tuple[int, int, bool]], escapes: list[int]) -> Callable[[int, int], Span]:
    def to_source(start: int, end: int) -> Span:
        a, b = bisect_right(here, start) - 1, bisect_right(here, end - 1) - 1
        first, _, escaped = there[a]
        first += 0 if escaped else start - here[a]
        begin, last, escaped = there[b]
        last = last if escaped else begin + end - here[b]
        s, e, inside = layer.to_source(first, last)
        # an escape of several characters begins before a match of its last ones
        return s, e, inside or there[a][2] or bisect_left(escapes, first) < bisect_left(escapes, last)

    return to_source


def _blobs(raw: bytes, layer: Layer, start: int, end: int, step: str) -> Iterator[Layer]:
    """Layers of unpacked bytes, also of packed bytes straight inside them; all stand for one part of `layer`."""
    first, last, _ = layer.to_source(start, end)
    steps = (*layer.steps, step)
    seen: set[bytes] = set()
    times = 1
    while True:
        mark, some = blake2b(digest_size=16), False
        for piece in _pieces(_nested(raw, times)):
            some = True
            mark.update(piece)
            yield Layer(_as_text(piece), lambda s, e: (first, last, True), (*steps, *["compressed"] * times))
        if not some or mark.digest() in seen:
            return
        seen.add(mark.digest())
        times += 1


def _nested(raw: bytes, times: int) -> Iterator[bytes]:
    """`raw`, opened so many times over."""
    chunks = iter([raw])
    for _ in range(times):
        chunks = _opened(chunks)
    return chunks


def _as_text(raw: bytes) -> str:
    if WIDE.search(raw):
        return raw.decode("utf-16-le", "replace")
    return raw.decode("utf-8", "surrogateescape")


def _from_base64(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        run = m.group().translate(URL_SAFE)
        places = None  # where a character of the run stands, if lines are joined
        if "\n" in run:
            places = [i for i, c in enumerate(run) if c not in "\r\n"]
            run = run.replace("\r", "").replace("\n", "")
        for skip in range(4):
            chars = run[skip:]
            chars = chars[: len(chars) - (len(chars) % 4 == 1)]
            raw = base64.b64decode(chars + "=" * (-len(chars) % 4))
            if _packing(raw):
                yield from _blobs(raw, layer, m.start(), m.end(), "base64")
            wide = WIDE.search(raw)
            if wide:
                begin = wide.start()
                text = raw[begin:].decode("utf-16-le", "replace")
                edges = None if text.isascii() else [begin + 2 * i for i in range(len(text) + 1)]
                yield Layer(text, _by_bytes(layer, m.start() + (0 if places else skip), places, skip, edges, 2, begin), (*layer.steps, "base64"))
            elif READABLE.search(raw):
                text = raw.decode("utf-8", "surrogateescape")
                edges = None
                if not text.isascii():
                    edges = [0]
                    for c in text:
                        edges.append(edges[-1] + len(c.encode("utf-8", "surrogateescape")))
                yield Layer(text, _by_bytes(layer, m.start() + (0 if places else skip), places, skip, edges, 1, 0), (*layer.steps, "base64"))


def _by_bytes(layer: Layer, base: int, places: list[int] | None, skip: int, edges: list[int] | None, width: int, begin: int) -> Callable[[int, int], Span]:
    """Places of decoded text as places of the base64 characters that carry its bytes."""

    def to_source(start: int, end: int) -> Span:
        a, b = (edges[start], edges[end]) if edges else (begin + start * width, begin + end * width)
        first, last = a * 8 // 6, -(-b * 8 // 6)
        if places:
            first, last = places[skip + first], places[skip + last - 1] + 1
        s, e, _ = layer.to_source(base + first, base + last)
        return s, e, True

    return to_source


def _unwrapped(layer: Layer, raw: bytes) -> Iterator[Layer]:
    if any(mark in raw for mark in _MARKS):
        yield from _unescaped(layer)
    if _RUN in raw.translate(_B64_BYTE):
        yield from _from_base64(layer)


def scan(text: str | None) -> list[Found]:
    """All secrets of a text by start, kind and end; those in the text itself have no steps."""
    if not text:
        return []
    found: dict[tuple[str, int, int], Found] = {}
    seen: set[tuple[int, int, bytes]] = set()
    todo: list[Iterator[Layer]] = [iter([Layer(text, lambda s, e: (s, e, False), ())])]
    while todo:  # layers are made one at a time, so only those above the present one are held
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if not layer.text:
            continue
        raw = layer.text.encode("utf-8", "surrogatepass")
        if layer.steps:
            start, end, _ = layer.to_source(0, len(layer.text))
            mark = (start, end, blake2b(raw, digest_size=16).digest())
            if mark in seen:
                continue
            seen.add(mark)
        for kind, s, e in matches(layer.text, raw):
            start, end, decoded = layer.to_source(s, e)
            if decoded or not layer.steps:
                found.setdefault((kind, start, end), Found(kind, start, end, "/".join(layer.steps), layer.text[s:e]))
        todo.append(_unwrapped(layer, raw))
    return sorted(found.values(), key=lambda f: (f.start, KINDS.index(f.kind), f.end))


_SECRETS = "kind array<string>, start array<bigint>, end array<bigint>, steps array<string>, value array<string>"


def _scanned(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        found = scan(t.decode("utf-8", "replace") if t else None)
        rows.append([[f[i] for f in found] for i in range(5)])
    return pd.DataFrame(rows, columns=Found._fields)


def find(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """`docs` with its secrets, array<struct<kind, start, end, steps, value>>, by start, kind and end."""
    if secrets.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column already there: {secrets}; name another")
    s = free_name(docs, "found__")
    found = docs.withColumn(s, F.pandas_udf(_scanned, _SECRETS)(F.col(text).cast("binary")))
    return found.select(*docs.columns, F.arrays_zip(*[F.col(s)[c].alias(c) for c in Found._fields]).alias(secrets))


def spans(secrets: Column, base: bool = False) -> Column:
    """kind:start:end of the secrets, joined by commas; with `base` only of those in the text itself."""
    chosen = F.filter(secrets, lambda x: x["steps"] == "") if base else secrets
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

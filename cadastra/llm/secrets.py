"""Secret scan with a recursive decoding worklist.

The text is scanned, then every part of it that looks encoded (URL escapes, Unicode
escapes, base64, compressed data inside base64) becomes a layer of its own on a worklist.
Each layer is scanned and searched for further encodings, until no layer is left; a layer
that has been seen at the same place is not taken again, so cycles end. A layer knows for
each of its characters which stretch of the original text it came from, and its findings
are given as spans of the original text.

Base kinds, in the plain text: ``assign`` (a value of 6 or more characters given to a
secret's name), ``access`` (an access key id), ``hex`` (24 or more hexadecimal digits).
Findings in a layer carry its path, such as ``base64/url>assign``.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPANS, count_kind, free_name, map_batches, span_array, struct_text, texts

BASE = ["assign", "access", "hex"]
_ORDER = {k: i for i, k in enumerate(BASE)}
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}")
#: Runs shorter than this hold no finding: 12 bytes are too few for a name, a sign and 6 characters.
SHORTEST = 16
#: A run goes on over a line break, with what may stand around one in wrapped, indented or quoted text.
_BREAK = r"[\x20\t]*+\\?\r?\n[\x20\t>#*]*+"
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)*+")
_BREAKS = re.compile(r"[^A-Za-z0-9+/_-]+")
_OPEN = re.compile(r"[A-Za-z0-9+/_-]*+(?:[\x20\t>#*]*+\n\r?\\?[\x20\t]*+[A-Za-z0-9+/_-]++)*+")
_STANDARD = str.maketrans("-_", "+/")
#: A finding, or what encodes one, is a stretch of at least 12 such bytes.
_READABLE = re.compile(rb"[\t\n\r -~]{12}")
_STREAMED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|PK\x03\x04")
#: Compressed data is unpacked and scanned in parts of this many bytes, each with at least the last characters of the one before.
PART, OVERLAP = 4 << 20, 1 << 16


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one text, leftmost and non-overlapping within a kind."""
    spans = []
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    for start, end in long_words(text, 24):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text, start, end)]
    return spans


def long_words(text: str, length: int) -> list[tuple[int, int]]:
    """Stretches without white space of at least some length; what is searched for inside holds none."""
    out, at = [], 0
    for word in text.split():
        if len(word) >= length:
            at = text.index(word, at)
            out.append((at, at + len(word)))
            at += len(word)
    return out


class Layer:
    """Decoded text; ``starts`` and ``ends`` give each character's stretch of the original (None: the original itself).

    In a layer with ``whole`` every character stands for that one stretch.
    """

    def __init__(self, text: str, path: str = "", starts: list[int] | None = None, ends: list[int] | None = None, whole: tuple[int, int] | None = None):
        self.text, self.path, self.starts, self.ends, self.whole = text, path, starts, ends, whole

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        return (start, end) if self.starts is None else (min(self.starts[start:end]), max(self.ends[start:end]))

    def child(self, kind: str, text: str, starts: list[int], ends: list[int]) -> Layer:
        path = f"{self.path}/{kind}" if self.path else kind
        if self.whole is not None:
            return Layer(text, path, whole=self.whole)
        if self.starts is not None:
            spans = [self.origin(a, b) for a, b in zip(starts, ends, strict=True)]
            starts, ends = [a for a, _ in spans], [b for _, b in spans]
        return Layer(text, path, starts, ends)


def _escaped(layer: Layer, kind: str, pattern: re.Pattern, decode) -> list[Layer]:
    """One layer per line with escapes: the line with its escapes undone, so that names and values stay together."""
    out, text, done = [], layer.text, 0
    for hit in pattern.finditer(text):
        if hit.start() < done:
            continue
        start, done = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.start())
        done = len(text) if done < 0 else done
        parts, starts, ends, at = [], [], [], start
        for m in pattern.finditer(text, start, done):
            parts.append(text[at:m.start()])
            starts += range(at, m.start())
            ends += range(at + 1, m.start() + 1)
            for char, a, b in decode(m[0]):
                parts.append(char)
                starts.append(m.start() + a)
                ends.append(m.start() + b)
            at = m.end()
        parts.append(text[at:done])
        starts += range(at, done)
        ends += range(at + 1, done + 1)
        out.append(layer.child(kind, "".join(parts), starts, ends))
    return out


def _percent(run: str) -> list[tuple[str, int, int]]:
    raw, out, at = bytes.fromhex(run.replace("%", "")), [], 0
    try:
        chars = raw.decode()
    except UnicodeDecodeError:
        chars = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(chars)]
    for c in chars:
        n = len(c.encode())
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _unicode(run: str) -> list[tuple[str, int, int]]:
    if run[1] in "xU" or run[2] == "{":  # one character
        code = int(run[2:].strip("{}"), 16)
        return [(chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd", 0, len(run))]
    out, at = [], 0
    for c in bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace"):
        n = 12 if ord(c) > 0xFFFF else 6
        out.append((c, at, min(at + n, len(run))))
        at = min(at + n, len(run) - 6)
    return out


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 runs, which may be wrapped, and of compressed data in them.

    A run may hold other characters before the encoded part (a path, a prefix, the end of the
    line before), so each of the four alignments is decoded, whole; bytes that are no UTF-8
    stay in the layer as characters of their own.
    """
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < SHORTEST:
            continue
        run = _BREAKS.sub("", m[0])
        if len(run) < SHORTEST:
            continue
        plain, places = run.translate(_STANDARD), None
        for k in range(4):
            part = plain[k:len(plain) - ((len(plain) - k) % 4 == 1)]
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            path, origin = f"{layer.path}/base64" if layer.path else "base64", layer.origin(m.start(), m.end())
            yield from _unpacked(raw, path, origin)
            if (stream := deflated(raw)) is not None:
                for text in parts(stream):
                    yield Layer(text, f"{path}/zip", whole=origin)
            if 3 * raw.count(0) > len(raw):
                for code in ("utf-16-le", "utf-16-be"):
                    wide = raw[:len(raw) & -2].decode(code, "replace")
                    if _READABLE.search(wide.encode("ascii", "ignore")):
                        yield Layer(wide, f"{path}/utf16", whole=origin)
            if not _READABLE.search(raw):
                continue
            if places is None:
                places = [i for x in re.finditer(r"[A-Za-z0-9+/_-]+", m[0]) for i in range(m.start() + x.start(), m.start() + x.end())]
            found = raw.decode("utf-8", "surrogateescape")
            if layer.whole is not None:
                yield layer.child("base64", found, [], [])
                continue
            starts, ends, at = [], [], 0
            for c in found:
                n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                starts.append(places[k + at * 4 // 3])
                ends.append(places[min(k - (-(at + n) * 4 // 3), len(places)) - 1] + 1)
                at += n
            yield layer.child("base64", found, starts, ends)


def _unpacked(raw: bytes, path: str, origin: tuple[int, int]) -> Iterator[Layer]:
    """Layers of all compressed data in some bytes, and of what is compressed again inside, to any depth."""
    done = 0
    for hit in _PACKED.finditer(raw):
        if hit.start() < done:
            continue
        depth, some = 0, True
        while some:  # each depth is unpacked from the start again, so that memory stays bounded
            some, outer, stream = False, unpack(raw, hit.start()), None
            stream = outer
            for _ in range(depth):
                stream = inflated(stream)
            depth += 1
            for text in parts(stream):
                some = True
                yield Layer(text, path + "/zip" * depth, whole=origin)
            done = max(done, outer.end)


def _compressed(layer: Layer) -> Iterator[Layer]:
    """Layers of compressed data in a decoded layer: bytes that escapes gave, or a zip archive that was inside another file."""
    if layer.path.rsplit("/", 1)[-1] in ("url", "unicode"):
        raw, last = layer.text.encode("latin-1", "replace"), len(layer.text)
        if (hit := _PACKED.search(raw)) is not None:
            if layer.whole is None:  # up to the last character that was escaped
                last = max((i + 1 for i, (a, b) in enumerate(zip(layer.starts, layer.ends, strict=True)) if b - a > 1), default=last)
            if hit.start() < last:
                yield from _unpacked(raw[hit.start():last], layer.path, layer.origin(hit.start(), last))
    elif "PK\3\4" in layer.text and layer.path.endswith("zip"):
        raw = layer.text.encode("utf-8", "surrogateescape")
        yield from _unpacked(raw[raw.index(b"PK\3\4"):], layer.path, layer.origin(0, len(layer.text)))


def deflated(raw: bytes) -> Iterator[bytes] | None:
    """Parts of bytes that are one raw deflate stream of text as a whole; None for other bytes."""
    def run() -> Iterator[bytes]:
        stream, data = zlib.decompressobj(-15), raw
        while not stream.eof:
            out = stream.decompress(data, PART)
            data = stream.unconsumed_tail
            if not out and not data:
                return
            yield out

    try:
        first = zlib.decompressobj(-15).decompress(raw, 1 << 12)
        if not _READABLE.search(first) or sum(map(len, run())) < len(first):
            return None
    except zlib.error:
        return None
    return run()


def inflated(stream) -> Iterator[bytes]:
    """Unpacked bytes of all gzip, zlib, bzip2 and xz data in a stream of bytes, in parts; nothing if there is none."""
    waiting, current = b"", None
    for part in stream:
        waiting += part
        while waiting:
            if current is None:
                hit = _STREAMED.search(waiting)
                if hit is None:
                    waiting = waiting[-5:]
                    break
                waiting = waiting[hit.start():]
                current = _opened(waiting)
                begun = False
            try:
                out = current.decompress(waiting, PART)
                if hasattr(current, "unconsumed_tail"):
                    rest, more = current.unconsumed_tail, bool(current.unconsumed_tail)
                else:
                    rest, more = b"", not current.needs_input and not current.eof
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                current, waiting = None, waiting if begun else waiting[1:]
                continue
            begun = True
            if out:
                yield out
            while more and not hasattr(current, "unconsumed_tail"):
                yield current.decompress(b"", PART)
                more = not current.needs_input and not current.eof
            waiting = rest
            if current.eof:
                waiting, current = current.unused_data, None
                yield b"\n"


def _opened(raw: bytes):
    return bz2.BZ2Decompressor() if raw.startswith(b"BZh") else lzma.LZMADecompressor() if raw.startswith(b"\xfd7z") else zlib.decompressobj(47)


class unpack:
    """Iterates over the unpacked bytes, in parts, of the compressed data at a place: all members, up to the first error.

    ``end`` is then where whole members end (0: there is none). gzip, zlib, bzip2, xz and zip archives are read.
    """

    def __init__(self, raw: bytes, start: int):
        self.raw, self.start, self.end = raw, start, 0

    def __iter__(self) -> Iterator[bytes]:
        at = self.start
        try:
            if self.raw.startswith(b"PK", at):
                yield from self._archive(at)
                return
            while True:
                if self.raw.startswith(b"BZh", at):
                    stream = bz2.BZ2Decompressor()
                elif self.raw.startswith(b"\xfd7z", at):
                    stream = lzma.LZMADecompressor()
                elif _PACKED.match(self.raw, at):
                    stream = zlib.decompressobj(47)
                else:
                    return
                data = self.raw[at:]
                while not stream.eof:
                    out = stream.decompress(data, PART)
                    data = stream.unconsumed_tail if hasattr(stream, "unconsumed_tail") else b""
                    if out:
                        yield out
                    elif not data or stream.eof:
                        break
                if not stream.eof:
                    return
                self.end = at = len(self.raw) - len(stream.unused_data)
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            return

    def _archive(self, at: int) -> Iterator[bytes]:
        try:
            with zipfile.ZipFile(io.BytesIO(self.raw[at:])) as archive:
                for name in archive.infolist():
                    try:
                        with archive.open(name) as member:
                            while out := member.read(PART):
                                yield out
                            yield b"\n"
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                        continue
                self.end = len(self.raw)
        except zipfile.BadZipFile:
            return


def parts(stream: unpack) -> Iterator[str]:
    """The texts of a stream in parts; each starts with the end of the one before, at least with its open encoded run.

    Memory is bounded by a part and the longest run of encoding characters. Parts double
    while a run stays open, so that it is not read over and over.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    kept, new, size, least = "", [], 0, 0
    for raw in stream:
        new.append(decoder.decode(raw))
        size += len(new[-1])
        if size < max(least, PART // 2):
            continue
        text = kept + "".join(new)
        yield text
        kept = text[max(0, min(len(text.rstrip(" ")) - OVERLAP, len(text) - _OPEN.match(text[::-1]).end())):]
        new, size, least = [], 0, len(kept)
    new.append(decoder.decode(b"", True))
    if size or new[-1]:
        yield kept + "".join(new)


def _following(layer: Layer) -> Iterator[Layer]:
    yield from _base64(layer)
    if layer.path:
        yield from _compressed(layer)
    if "%" in layer.text:
        yield from _escaped(layer, "url", _URL, _percent)
    if "\\" in layer.text:
        yield from _escaped(layer, "unicode", _UNICODE, _unicode)


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text and its layers, by start, then base kinds as listed before others, then kind and end."""
    found = set(scan(text))
    work, seen = [_following(Layer(text))], set()  # a layer is made when it is taken, so that parts of compressed data come one by one
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        if not new.text or (key := (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass")).digest(), *new.origin(0, len(new.text)))) in seen:
            continue
        seen.add(key)
        work.append(_following(new))
        for kind, start, end in scan(new.text):
            a, b = new.origin(start, end)
            if text[a:b] != new.text[start:end]:  # else it stands like this in the text
                found.add((f"{new.path}>{kind}", a, b))
    return sorted(found, key=lambda s: (s[1], _ORDER.get(s[0], len(BASE)), s[0], s[2]))


def annotate(docs: DataFrame, text_column: str = "text", spans_column: str = "spans") -> DataFrame:
    """Adds the spans (code points, end exclusive) of each whole text; null and empty texts have none.

    All columns pass through, repeated rows too; if ``spans_column`` is taken, a free name is used.
    """
    name = free_name(docs, spans_column)
    place = docs.columns.index(text_column)

    def make():
        def step(batch):
            return pa.RecordBatch.from_arrays([*batch.columns, span_array([find(t) for t in texts(batch, place)])], names=[*batch.schema.names, name])
        return step

    return map_batches(docs, make, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` {SPANS}"]))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, one row per document."""
    rows = annotate(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    return rows.select("doc_id", *(count_kind("spans", k).alias(f"n_{k}") for k in BASE),
                       F.sha2(struct_text("spans", BASE), 256).alias("base_sha256"), struct_text("spans").alias("spans"))

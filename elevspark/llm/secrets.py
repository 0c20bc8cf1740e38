"""Operator 8: secret scans with a recursive decoding worklist.

A document's text is the first layer. Every layer is scanned for the kinds below and searched for
encoded parts: URL escapes, Unicode and character-reference escapes (decoded in place), base64 runs
(each decoded into a layer of its own, directly or after gzip, zlib or bzip2). A decoded layer goes
onto the worklist unless its text was seen at the same place, so cycles end and the work stops at a
fixpoint; equal parts at other places are layers of their own.
Each layer knows, for each of its characters, the span of the original text that made it; what is
found in a layer is reported at that span.

Base spans are those of the first layer; they are always reported. Spans are in code points, end
exclusive. Null texts count as empty and have no spans; repeated rows each give a row; other columns
are ignored. Of a compressed stream that unfolds to more than ``UNFOLDED`` bytes the first so many are read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, sliced, table

#: The kinds in order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: A run that can hold the shortest secret is at least so long; bytes that are read of an unfolded stream; layers of compression.
MIN_BASE64, UNFOLDED, NESTED = 22, 32 << 20, 64

_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: Runs over several lines; none begins inside a run.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+" % MIN_BASE64)
#: Where compressed bytes may begin.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68]", re.DOTALL)
_PACKED_URL = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])|BZh[1-9])(?:%[0-9A-Fa-f]{2}|[^%\s&\"'<>])*")
_HEX_RUN = b"x" * MIN_HEX
_BASE64_RUN = b"x" * MIN_BASE64
_HEX_TABLE = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_BASE64_TABLE = bytes(120 if re.match(r"[A-Za-z0-9+/_-]", chr(i), re.ASCII) and i < 128 else 32 for i in range(256))


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in ``text``. ``raw``: its UTF-8 form, if known."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if _HEX_RUN in (raw if raw is not None else text.encode("utf-8", "surrogatepass")).translate(_HEX_TABLE):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and, for each character, where it starts and ends in the original (None: the original)."""

    __slots__ = ("ends", "starts", "text", "via")

    def __init__(self, text: str, starts=None, ends=None, via: str = ""):
        self.text, self.starts, self.ends, self.via = text, starts, ends, via

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def inner(self, text: str, first: np.ndarray, after: np.ndarray, via: str) -> Layer:
        """A layer whose character i comes from this layer's characters first[i]..after[i]."""
        if self.starts is not None:
            first, after = self.starts[first], self.ends[after - 1]
        return Layer(text, first, after, f"{self.via}>{via}" if self.via else via)


def _in_place(layer: Layer, pattern: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with each match of ``pattern`` replaced by decode(match): [(character, first, after)], or None to leave it."""
    parts, first, after, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        parts.append(layer.text[at : m.start()])
        first.append(np.arange(at, m.start()))
        after.append(np.arange(at, m.start()) + 1)
        parts.append("".join(c for c, _, _ in got))
        first.append(np.array([a for _, a, _ in got], int))
        after.append(np.array([b for _, _, b in got], int))
        at = m.end()
    if not at:
        return None
    parts.append(layer.text[at:])
    first.append(np.arange(at, len(layer.text)))
    after.append(np.arange(at, len(layer.text)) + 1)
    return layer.inner("".join(parts), np.concatenate(first), np.concatenate(after), via)


def _decode_url(m: re.Match) -> list[tuple[str, int, int]]:
    data, at = bytes.fromhex(m[0].replace("%", "")), m.start()
    try:
        text, widths = (t := data.decode("utf-8")), [len(c.encode("utf-8")) for c in t]
    except UnicodeDecodeError:
        text, widths = data.decode("latin-1"), [1] * len(data)
    out = []
    for c, n in zip(text, widths, strict=True):
        out.append((c, at, at + 3 * n))
        at += 3 * n
    return out


def _decode_escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    return [(chr(code), m.start(), m.end())] if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def _member(data: bytes) -> tuple[bytes, bytes] | None:
    """What the gzip, zlib or bzip2 stream at the head of ``data`` holds, as far as it goes, and what follows it."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0):
        d = zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        d = bz2.BZ2Decompressor()
    else:
        return None
    try:
        out = d.decompress(data, UNFOLDED)
    except (zlib.error, OSError, EOFError, ValueError):
        return None
    return (out, d.unused_data if d.eof else b"") if out else None


def _unfolded(data: bytes) -> bytes | None:
    """What ``data`` holds under all its layers of compression, every member of a stream; None if it is none."""
    found = None
    for _ in range(NESTED):
        parts, size = [], 0
        while size < UNFOLDED and (got := _member(data)):
            parts.append(got[0])
            size, data = size + len(got[0]), got[1]
        if not parts:
            break
        found = data = b"".join(parts)
    return found


def _readable(data: bytes) -> str:
    """The text; where it is no UTF-8, a character for each byte (all kinds are ASCII)."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _packed_url_layers(layer: Layer) -> Iterator[Layer]:
    for m in _PACKED_URL.finditer(layer.text):
        packed = _unfolded(urllib.parse.unquote_to_bytes(m[0]))
        if packed is not None:
            text = _readable(packed)
            yield layer.inner(text, np.full(len(text), m.start()), np.full(len(text), m.end()), "url>inflate")


def _decoded_layers(layer: Layer, run: str, at: np.ndarray) -> Iterator[Layer]:
    """Layers of a base64 run whose characters lie at ``at``; at all four alignments unless the first one is plain text."""
    for k in range(4):
        part, where = run[k:], at[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            data = base64.b64decode(part.replace("-", "+").replace("_", "/") + "=" * (-len(part) % 4))
        except (binascii.Error, ValueError):
            continue
        if not data:
            continue
        for m in _MAGIC.finditer(data):
            if (packed := _unfolded(data[m.start() :])) is not None:
                text = _readable(packed)
                yield layer.inner(text, np.full(len(text), where[m.start() * 8 // 6]), np.full(len(text), at[-1] + 1), "base64>inflate")
                if m.start() == 0:
                    return
        try:
            text, plain = data.decode("utf-8"), True
        except UnicodeDecodeError:
            text, plain = data.decode("latin-1"), False
        # byte j comes from the base64 characters that hold bits 8j to 8j + 7
        ends = np.cumsum([len(c.encode("utf-8")) for c in text]) if plain and not text.isascii() else np.arange(1, len(text) + 1)
        begin = np.concatenate([[0], ends[:-1]])
        yield layer.inner(text, where[begin * 8 // 6], where[(ends * 8 + 5) // 6 - 1] + 1, "base64")
        if plain and k == 0:
            return


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        yield from _decoded_layers(layer, run, np.arange(m.start(), m.start() + len(run)))
    for m in _WRAPPED.finditer(layer.text):
        at = np.array([i for i, c in enumerate(m[0], m.start()) if not c.isspace()])
        yield from _decoded_layers(layer, "".join(m[0].split()), at)


def layers_in(layer: Layer, raw: bytes | None = None) -> Iterator[Layer]:
    """The layers one decoding away."""
    if "%" in layer.text and (got := _in_place(layer, _URL, _decode_url, "url")):
        yield got
    if "%" in layer.text:
        yield from _packed_url_layers(layer)
    if ("\\" in layer.text or "&#" in layer.text) and (got := _in_place(layer, _ESCAPE, _decode_escape, "escape")):
        yield got
    if _BASE64_RUN in (raw if raw is not None else layer.text.encode("utf-8", "surrogatepass")).translate(_BASE64_TABLE):
        yield from _base64_layers(layer)


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], str]]:
    """(base spans, {every span: the decodings that lead to it}); spans are (start, kind, end)."""
    raw = text.encode("utf-8", "surrogatepass")
    base = sorted(scan(text, raw))
    found = dict.fromkeys(base, "")
    scans: dict[str, list[tuple[int, int, int]]] = {}
    seen = set()
    work = list(layers_in(Layer(text), raw))
    while work:
        layer = work.pop()
        place = (layer.text, hashlib.blake2b(layer.starts.tobytes() + layer.ends.tobytes()).digest())
        if place in seen:
            continue
        seen.add(place)
        if layer.text not in scans:
            scans[layer.text] = scan(layer.text)
        for start, kind, end in scans[layer.text]:
            a, b = layer.span(start, end)
            found.setdefault((a, kind, b), layer.via)
        work += layers_in(layer)
    return base, found


def _told(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,via:string>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("via", pa.string())]))
    for batch in sliced(batches):
        counts, shas, told, found = ([], [], []), [], [], []
        for text in batch.column("text").to_pylist():
            base, every = find_secrets(text or "")
            for k in range(3):
                counts[k].append(sum(b[1] == k for b in base))
            shas.append(hashlib.sha256(_told(base).encode()).hexdigest())
            ordered = sorted(every.items())
            told.append(_told(s for s, _ in ordered))
            found.append([{"kind": KINDS[k], "start": a, "end": b, "via": via} for (a, k, b), via in ordered])
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(told, pa.string()), pa.array(found, span)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and digest of the base spans, all spans as text and as ``found`` with their decodings."""
    return docs.select("doc_id", "text").mapInArrow(lean(_run), f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op8_scan_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")

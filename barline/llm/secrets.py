"""Secret scan with a recursive decoding worklist.

Three patterns are looked for in every text. Then the text is decoded into layers: the whole text with its
URL escapes or its Unicode escapes replaced in place (those that give no character stay), and what its base64
runs hold, also over line ends, at any offset, and as gzip or zlib data. Each layer is scanned and unwrapped
in turn, until none yields a new one. A layer seen before within the document is not entered again, so cycles
end. What is found in a layer is reported with the span of the original text it was decoded from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import query, table

KINDS = ("assign", "access", "hex")
#: Fixed patterns; matches below the given length (of group 2 for assignments) are dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: An escape whose own first character is escaped, however often, is read to its end at once.
URL_ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_SLASH = r"\\(?:u005[cC]|x5[cC])*"
UNICODE_ESCAPE = re.compile(
    rf"(?:{_SLASH}|%(?:25)*)u([0-9A-Fa-f]{{4}})|{_SLASH}x([0-9A-Fa-f]{{2}})|{_SLASH}u\{{([0-9A-Fa-f]{{1,6}})\}}"
)
#: Base64 of at least 16 characters in its first line, and its further lines.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Every secret, and every code of one, has so many printable ASCII characters in a row.
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
#: The same in UTF-16.
WIDE = {"utf-16-le": re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){16}"), "utf-16-be": re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){16}")}
BZIP2 = re.compile(rb"BZh[1-9]1AY&SY")
PACKED = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)", re.S)
#: Compressed data is unpacked in pieces of so many bytes; each begins with the end of the one before. It
#: bounds a worker's memory.
MAX_UNPACKED, OVERLAP, STEP = 64 << 20, 1 << 20, 256


class Layer(NamedTuple):
    text: str
    #: Original spans of the layer's characters: ascending (position in the layer, start, end); the
    #: characters up to the next entry count on one by one if ``step`` is 1, else share the span.
    at: list[int]
    spans: list[tuple[int, int, int]]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that gave characters start..end of the layer."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        s, _, step = self.spans[first]
        begin = s + (start - self.at[first]) * step
        s, e, step = self.spans[last]
        return begin, s + (end - self.at[last]) if step else e


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a number, end) of the secrets written in the text itself."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class _Bzip2:
    """A bzip2 stream with the interface of a zlib one."""

    def __init__(self):
        self.z, self.unconsumed_tail = bz2.BZ2Decompressor(), b""

    eof = property(lambda self: self.z.eof)
    unused_data = property(lambda self: self.z.unused_data)

    def decompress(self, data, most: int) -> bytes:
        try:
            # What it has not read it keeps, so the next step brings it nothing new.
            out = self.z.decompress(bytes(data) if self.z.needs_input else b"", most)
            rest = b"" if self.z.needs_input or self.z.eof else b"\0"
        except (OSError, EOFError) as damage:
            raise zlib.error(str(damage)) from damage
        self.unconsumed_tail = rest
        return out


def _unpacked(data: bytes | memoryview, make=lambda: zlib.decompressobj(47)) -> Iterator[bytes]:
    """Pieces of what the gzip (all members), zlib or other compressed data at the start of ``data`` holds, as
    far as it goes."""
    kept = bytearray()
    while data:
        z, at = make(), 0
        try:
            # In small steps, so that what lies before damage is not lost.
            while not z.eof and (z.unconsumed_tail or at < len(data)):
                more = z.unconsumed_tail
                if not more:
                    more, at = data[at : at + STEP], at + STEP
                kept += z.decompress(more, MAX_UNPACKED - len(kept))
                if len(kept) == MAX_UNPACKED:
                    yield bytes(kept)
                    del kept[:-OVERLAP]
        except zlib.error:
            break
        data = z.unused_data + data[at:] if z.eof else b""
        if data[:2] != b"\x1f\x8b":
            break
    if kept:
        yield bytes(kept)


def _escaped(layer: Layer, escape: re.Pattern, url: bool) -> Layer | None:
    """The layer with its escapes decoded, every character mapped to where it came from; escapes that
    give no character stay. None if all stay."""
    text, pieces, at, spans, n, pos, changed = layer.text, [], [], [], 0, 0, False

    def keep(start: int, end: int) -> None:
        nonlocal n
        if end > start:
            for offset, entry in _own(layer, start, end):
                at.append(n + offset)
                spans.append(entry)
            pieces.append(text[start:end])
            n += end - start

    m = escape.search(text)
    while m:
        keep(pos, m.start())
        end, group = m.end(), [m]
        while (more := escape.match(text, end)) is not None:
            group.append(more)
            end = more.end()
        chars: list[tuple[str, int]] = []  # (character or nothing, how many escapes)
        if url:
            raw = bytes(int(x[1], 16) for x in group)
            chars = [("", 1) if "\udc80" <= c <= "\udcff" else (c, len(c.encode())) for c in raw.decode("utf-8", "surrogateescape")]
        else:
            raw16 = [int(x[1] or x[2] or x[3], 16) for x in group]
            k = 0
            while k < len(raw16):
                pair = raw16[k : k + 2]
                if len(pair) == 2 and 0xD800 <= pair[0] < 0xDC00 <= pair[1] < 0xE000:
                    chars.append((chr(0x10000 + (pair[0] - 0xD800) * 1024 + pair[1] - 0xDC00), 2))
                else:
                    chars.append(("" if 0xD800 <= pair[0] < 0xE000 or pair[0] > 0x10FFFF else chr(pair[0]), 1))
                k += chars[-1][1]
        k = 0
        for c, w in chars:
            start, stop = group[k].start(), group[k + w - 1].end()
            k += w
            if not c:
                keep(start, stop)
                continue
            s, e = layer.origin(start, stop)
            at.append(n)
            spans.append((s, e, 0))
            pieces.append(c)
            n += 1
            changed = True
        pos = end
        m = escape.search(text, pos)
    if not changed:
        return None
    keep(pos, len(text))
    return Layer("".join(pieces), at, spans)


def _own(layer: Layer, start: int, end: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """(offset, span entry) of characters taken over from the layer unchanged."""
    i = bisect_right(layer.at, start) - 1
    while i < len(layer.at) and layer.at[i] < end:
        s, e, step = layer.spans[i]
        begin = max(start, layer.at[i])
        stop = min(end, layer.at[i + 1]) if i + 1 < len(layer.at) else end
        if step:
            yield begin - start, (s + begin - layer.at[i], s + stop - layer.at[i], 1)
        else:
            yield begin - start, (s, e, 0)
        i += 1


def _base64(layer: Layer, run: re.Match) -> Iterator[Layer]:
    """What a run holds, read from each of its first four characters on."""
    lines = [(m.start() + run.start(), m[0].rstrip("=")) for m in BASE64_LINE.finditer(run[0])]
    token = "".join(t for _, t in lines)
    # Words are not base64: it mixes cases or has digits.
    if token.isalpha() and token[1:].islower():
        return
    token = token.replace("-", "+").replace("_", "/")
    edges = [0]
    for _, t in lines:
        edges.append(edges[-1] + len(t))
    origins = [layer.origin(p, p + len(t)) for p, t in lines]
    origins[-1] = (origins[-1][0], layer.origin(run.end() - 1, run.end())[1])
    whole = (origins[0][0], origins[-1][1], 0)
    for offset in range(4):
        part = token[offset:]
        part = part[:-1] if len(part) % 4 == 1 else part
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        if PRINTABLE.search(data):
            at, n, last = [], 0, 0
            for edge in edges[:-1]:
                byte = max(0, edge - offset) * 3 // 4
                n, last = n + len(data[last:byte].decode("utf-8", "replace")), byte
                at.append(n)
            yield Layer(data.decode("utf-8", "replace"), at, [(*o, 0) for o in origins])
        for name, wide in WIDE.items():
            if (m := wide.search(data)) is not None:
                yield Layer(data[m.start() % 2 :].decode(name, "replace"), [0], [whole])
        packed = [(m.start(), _Bzip2) for m in BZIP2.finditer(data)]
        if offset == 0:
            packed.append((0, lambda: zlib.decompressobj(-15)))
        for start, make in packed:
            for piece in _unpacked(memoryview(data)[start:], make):
                if PRINTABLE.search(piece):
                    yield Layer(piece.decode("utf-8", "replace"), [0], [whole])
        for m in PACKED.finditer(data):
            head = data[m.start() : m.start() + 2]
            if head == b"\x1f\x8b" or head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
                for piece in _unpacked(memoryview(data)[m.start() :]):
                    if PRINTABLE.search(piece):
                        yield Layer(piece.decode("utf-8", "replace"), [0], [whole])


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers one decoding below."""
    text = layer.text
    for run in BASE64_RUN.finditer(text):
        yield from _base64(layer, run)
    last = [_escaped(layer, UNICODE_ESCAPE, False) if "\\" in text or "%" in text else None, _escaped(layer, URL_ESCAPE, True) if "%" in text else None]
    # A long chain of layers is not held in memory.
    del layer, text
    run = None
    while last:
        if (inner := last.pop()) is not None:
            yield inner


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans as (start, kind, end), each sorted."""
    text = text or ""
    base = sorted(find(text))
    found = set(base)
    if len(text) >= 3:
        # Depth first: a layer and its pieces are dropped once they are read.
        seen, todo = {_name(text)}, [unwrap(Layer(text, [0], [(0, len(text), 1)]))]
        while todo:
            inner = next(todo[-1], None)
            if inner is None:
                todo.pop()
                continue
            # The same layer from another place is another finding, but is entered only once there.
            name = _name(inner.text) + b"%d:%d" % (inner.spans[0][0], inner.spans[-1][1])
            if name in seen:
                continue
            seen.add(name)
            for start, kind, end in find(inner.text):
                s, e = inner.origin(start, end)
                found.add((s, kind, e))
            todo.append(unwrap(inner))
    return base, sorted(found)


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind, start, end; code points,
    end exclusive, by start and kind). ``spans`` has the base ones and those found in decoded layers.

    Null and empty texts have none; repeated rows give repeated results; an empty table gives an empty
    result; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType
    span = "array<struct<kind:string,start:int,end:int>>"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "base": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base] for base, _ in rows],
                "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in both] for _, both in rows],
            })

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = own.mapInPandas(look, f"doc_id string, base {span}, spans {span}")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def digest_columns(found: DataFrame) -> DataFrame:
    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(k: str):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    return digest_columns(secret_spans(table(spark, sf_dir, "documents")))

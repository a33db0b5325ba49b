"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secret. Then nested URL, Unicode, base64 and
compressed layers are unwrapped one by one until no new layer appears, each layer is
scanned too, and its finds are mapped back to spans of the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import small_batches, table

# The kinds in the order in which ties are listed, their patterns, and
# the least length of what counts (of group 2 for assign, of the match for the rest).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
#: A run of 32 hex digits or more is a maximal run, as the matches of [0-9a-f]+ are.
HEX = re.compile(r"[0-9a-f]{32,}")
#: Likewise AKIA and the capitals and digits after it, 16 characters at least.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: No match of ASSIGN lacks all of these; finding them is much cheaper than the pattern.
ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|[Uu]\+([0-9A-Fa-f]{4,6})")
#: The shortest secret has 14 characters, hence 19 in base64; compressed, a run of equal
#: characters takes 7, so shorter runs count that have a character on which zlib data
#: (whose first byte is 8 to 120, ending in 8), gzip data or a last block of deflate data in
#: fixed codes (the short kind) can begin.
LEAST, LEAST_PACKED = 19, 7
_HEADS = "[CGKOSWae][A-P]|H4|[ACEGIKMOQSUWYacegikmoqsuwy02468+-][w-z0-9+/_-]"
HEAD = re.compile(_HEADS)
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{19,}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{0,3}(?:" + _HEADS + r")[A-Za-z0-9+/_-]{5})[A-Za-z0-9+/_-]{7,18})={0,2}")
#: Text in two bytes a character, either order: an ASCII character beside a zero.
UTF16 = re.compile("(?:[\\t\\n\\r\\x20-\\x7e]\\x00){12,}|(?:\\x00[\\t\\n\\r\\x20-\\x7e]){12,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Where compressed data can start among other bytes, or other characters.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
PACKED_TEXT = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
#: Bytes that a secret, an escape or a run of base64 lines can hold. Unpacked data is
#: scanned in windows that end after any other byte, so nothing is cut in two.
JOINED = ALPHABET.encode() + b".=\"' :%\\&#;{}\t\r\n"
#: Bytes unpacked at once, bytes given to it at once, unpacked bytes that are looked at as
#: a whole, and bytes by which the beginning of compressed data is told from chance.
WINDOW, PIECE, WHOLE, PROBE = 1 << 20, 1 << 16, 8 << 20, 1 << 12
#: Compressed layers in one another, if no other bound is given. Other layers are shorter
#: than what they come from, so they end; these can go on for ever. What is below is named
#: as a span UNREAD.
MAX_CHAIN = 16
UNREAD = len(KINDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the finds in one layer; leftmost, non-overlapping per kind."""
    out = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _packed(raw: bytes) -> bool:
    """Whether raw starts as gzip or zlib data does."""
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 1 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _begins(raw: bytes, at: int) -> bool:
    """Whether compressed data begins there, as far as its next bytes tell."""
    piece = raw[at : at + PROBE]
    if not _packed(piece):
        return False
    d = zlib.decompressobj(47)
    try:
        return bool(d.decompress(piece, 1)) or d.eof or len(piece) == PROBE
    except zlib.error:
        return False


def _pieces(raw: bytes, at: int = 0) -> Iterator[bytes]:
    return (raw[i : i + PIECE] for i in range(at, len(raw), PIECE))


def _inflated(parts: Iterator[bytes], end: list[int] | None = None, form: int = 47) -> Iterator[bytes]:
    """The unpacked bytes of the gzip or zlib data (or of the given form) that `parts`
    start with, member by member, up to its end or first fault. `end` gets the number of
    bytes that it takes, if it has an end."""
    d, data, taken, whole = zlib.decompressobj(form), b"", 0, 0

    def close() -> None:
        if end is not None and whole:
            end.append(whole)

    for part in parts:
        data += part
        while data:
            if d.eof:
                if data[:2] != b"\x1f\x8b"[: len(data)] or form != 47:
                    return close()
                if len(data) == 1:
                    break
                d = zlib.decompressobj(47)
            try:
                out = d.decompress(data, WINDOW)
            except zlib.error:
                return close()
            if out:
                yield out
            rest = d.unused_data if d.eof else d.unconsumed_tail
            taken += len(data) - len(rest)
            whole = taken if d.eof else whole
            data = rest
    while not d.eof:
        try:
            out = d.decompress(b"", WINDOW)
        except zlib.error:
            return close()
        if not out:
            return close()
        yield out
    whole = taken
    close()


def _from(blocks: Iterator[bytes], at: int) -> Iterator[bytes]:
    """The bytes from number `at` on."""
    for b in blocks:
        if at < len(b):
            yield b[at:] if at else b
        at = max(0, at - len(b))


def _kinds(blocks: Callable[[], Iterator[bytes]], chain: int, most: int) -> set[int] | None:
    """Kinds found in the unpacked bytes that blocks() gives and in all layers below;
    null if there are none."""
    held, size = [], 0
    for b in blocks():
        held.append(b)
        size += len(b)
        if size > WHOLE:
            return _kinds_in_windows(blocks, chain, most)
    if not size:
        return None
    return {k for _, k, _ in _layers(b"".join(held).decode("latin-1"), chain, most)[1]}


def _kinds_in_windows(blocks: Callable[[], Iterator[bytes]], chain: int, most: int) -> set[int]:
    """The same of more bytes than are held at once: in windows that end where nothing
    that is looked for is cut, but compressed data, which is followed beyond them."""
    found: set[int] = set()
    held: list[bytes] = []
    start = 0  # number of the first byte held

    def look(window: bytes, last: bool) -> None:
        found.update(k for _, k, _ in _layers(window.decode("latin-1"), chain, most)[1])
        at = 0
        for m in PACKED.finditer(window):
            i = m.start()
            if i < at or not _begins(window, i):
                continue
            end: list[int] = []
            for _ in _inflated(_pieces(window, i), end):
                pass
            if end:
                at = i + end[0]
            elif not last and chain < most:
                found.update(_kinds(lambda i=start + i: _inflated(_from(blocks(), i)), chain + 1, most) or ())

    for block in blocks():
        cut = len(block.rstrip(JOINED))
        # The next window begins with the last bytes of this one, in which compressed data
        # may begin that these do not tell from chance.
        if cut > PROBE:
            window = b"".join([*held, block[:cut]])
            look(window, False)
            keep = len(window) - PROBE
            keep = len(window[:keep].rstrip(JOINED)) or keep
            start += keep
            held = [window[keep:], block[cut:]]
        else:
            held.append(block)
    look(b"".join(held), True)
    return found


#: Of a layer's characters s to e (exclusive) the span that they came from.
Span = Callable[[int, int], tuple[int, int]]


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, Span] | None:
    """text with the matches decoded, and where its parts came from: runs that were kept
    are one entry each, whatever their length, and so are decoded characters."""
    parts, at, done = [], 0, 0
    new, old, end = array("q"), array("q"), array("q")  # end: -1 for a kept run

    def add(piece: str, a: int, b: int) -> None:
        nonlocal done
        if piece:
            parts.append(piece)
            new.append(done)
            old.append(a)
            end.append(b)
            done += len(piece)

    for m in pattern.finditer(text):
        got = decode(m)
        if got is None:
            continue
        add(text[at : m.start()], at, -1)
        for piece, a, b in got:
            add(piece, m.start() + a, m.start() + b)
        at = m.end()
    if not at:
        return None
    add(text[at:], at, -1)

    def span(s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(new, s) - 1, bisect_right(new, e - 1) - 1
        return old[i] + (s - new[i] if end[i] < 0 else 0), old[j] + e - new[j] if end[j] < 0 else end[j]

    return "".join(parts), span


def _url(m: re.Match) -> list[tuple[str, int, int]]:
    """Bytes, each as the character of its number, as they may be compressed."""
    return [(chr(x), 3 * i, 3 * i + 3) for i, x in enumerate(bytes.fromhex(m[0].replace("%", "")))]


def _utf16(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, 2 * i, 2 * i + 2) for i, c in enumerate(m[0].replace("\0", ""))]


def _unicode(m: re.Match) -> list[tuple[str, int, int]] | None:
    hexed = next((g for i, g in enumerate(m.groups()) if g and i != 5), None)
    code = int(m[6]) if hexed is None else int(hexed, 16)
    return [(chr(code), 0, len(m[0]))] if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def _chains(text: str) -> list[list[tuple[int, int]]]:
    """Places of base64 characters that go on over line breaks: from the end of a line
    over whole lines to the start of one."""
    out, chain, at = [], [], 0
    for line in text.split("\n"):
        body = line.rstrip(" \t\r")
        inner = body.lstrip(" \t")
        left = at + len(body) - len(inner)
        at += len(line) + 1
        head = len(inner) - len(inner.lstrip(ALPHABET))
        if chain and head:
            chain.append((left, left + head))
            if head == len(inner):
                continue
        out.append(chain)
        tail = len(inner) - len(inner.rstrip(ALPHABET))
        chain = [(left + len(inner) - tail, left + len(inner))] if tail else []
    out.append(chain)
    return [c for c in out if len(c) > 1 and sum(b - a for a, b in c) >= LEAST]


def _base64(text: str) -> Iterator[tuple[bytes, Span, set[int]]]:
    """(decoded bytes, where they came from, bytes that begin a line) of base64 runs,
    decoded from each of the first four characters on: whatever foreign characters a run
    begins with, one of these is in step with what follows."""
    chains = _chains(text) if "\n" in text else []
    taken = {a for c in chains for a, _ in c}
    runs = chains + [[(m.start(), m.start() + len(m[0].rstrip("=")))] for m in BASE64.finditer(text) if m.start() not in taken]
    for pieces in runs:
        run = "".join(text[a:b] for a, b in pieces)
        if len(run) >= LEAST and run.isalpha() and (run.islower() or run[1:].islower()):
            continue  # a word; no base64 of text stays in lower case for 19 letters
        plain = run.replace("-", "+").replace("_", "/")
        before = [0, *accumulate(b - a for a, b in pieces)]
        last = pieces[-1][1]
        last += len(text[last : last + 2]) - len(text[last : last + 2].lstrip("="))
        for skip in range(4):
            body = plain[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < LEAST and (len(body) < LEAST_PACKED or not HEAD.match(run, skip)):
                continue
            raw = base64.b64decode(body + "=" * (-len(body) % 4))

            def place(k: int, pieces=pieces, before=before) -> int:
                i = bisect_right(before, k) - 1
                return pieces[i][0] + k - before[i]

            def span(s: int, e: int, skip=skip, place=place, n=before[-1], size=len(raw), whole=skip + len(body) >= before[-1], last=last) -> tuple[int, int]:
                return place(skip + s * 4 // 3), last if e == size and whole else place(min(skip - (-e * 4 // 3), n) - 1) + 1

            yield raw, span, {0} | {max(0, x - skip) * 3 // 4 for x in before[:-1]}


def _unpacked(raw: bytes, lines: set[int], chain: int, most: int, fills: bool = False) -> Iterator[tuple[int, int, int]]:
    """(first byte, kind, byte after the last) for the kinds in compressed data in raw:
    gzip and zlib data wherever it stands and, if it may, deflate data that fills raw."""
    at, found = 0, False
    for i in sorted({m.start() for m in PACKED.finditer(raw)} | {i for i in lines if _packed(raw[i : i + 2])}):
        if i < at or not _begins(raw, i):
            continue
        found, end = True, []
        if chain < most:
            kinds = _kinds(lambda i=i, end=end: _inflated(_pieces(raw, i), end), chain + 1, most) or ()
        else:
            kinds = (UNREAD,)
            for _ in _inflated(_pieces(raw, i), end):
                pass
        at = i + end[0] if end else at
        yield from ((i, k, i + end[0] if end else len(raw)) for k in kinds)
    if fills and not found and _deflated(raw):
        kinds = _kinds(lambda: _inflated(_pieces(raw), None, -15), chain + 1, most) or () if chain < most else (UNREAD,)
        yield from ((0, k, len(raw)) for k in kinds)


def _deflated(raw: bytes) -> bool:
    """Whether raw is deflate data from end to end: few other bytes are."""
    d = zlib.decompressobj(-15)
    try:
        data = raw
        while data and not d.eof:
            d.decompress(data, WINDOW)
            data = d.unconsumed_tail
    except zlib.error:
        return False
    return d.eof and len(d.unused_data) < 3  # base64 of other steps adds a byte or two


def _layers(text: str, chain: int, most: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """scan() of a text in `chain` compressed layers.

    The worklist holds layers still to unwrap. A layer is a string with the way from its
    characters back to the span of the text that they stand for; one whose string and
    span were met before is left out. Decoded bytes are read as Latin-1: all that is
    looked for is ASCII, which is the same in it and in UTF-8, whatever stands around it.
    Compressed data is looked for in every layer. If layers that are equal put one find's
    end at several places, as with and without padding, the last one counts.
    """
    base = base_spans(text)
    finds: dict[tuple, int] = {}
    work: list[tuple[str, Span]] = [(text, lambda s, e: (s, e))]
    seen = {(text, 0, len(text))}

    def add(key, kind: int, a: int, b: int) -> None:
        finds[key, kind, a] = max(b, finds.get((key, kind, a), 0))

    while work:
        layer, back = work.pop()
        fresh: list[tuple[str, Span]] = []
        if "%" in layer and (got := _replaced(layer, URL_ESCAPES, _url)):
            fresh.append(got)
        if ("\\" in layer or "&#" in layer or "+" in layer) and (got := _replaced(layer, UNICODE_ESCAPES, _unicode)):
            fresh.append(got)
        if "\0" in layer and (got := _replaced(layer, UTF16, _utf16)):
            fresh.append(got)
        if PACKED_TEXT.search(layer):  # one byte a character; others are no compressed data
            raw = layer.encode("latin-1", "replace")
            for i, kind, j in _unpacked(raw, set(), chain, most):
                add(raw[i:j], kind, *back(i, j))
        for raw, span, lines in _base64(layer):
            if len(raw) >= 14:
                fresh.append((raw.decode("latin-1"), span))
            # What stands behind other bytes is looked for once more in the fresh layer.
            for i, kind, j in _unpacked(raw, lines, chain, most, True):
                add(raw[i:j], kind, *back(*span(i, j)))
        for string, span in fresh:
            if not string:
                continue
            to = lambda s, e, span=span, back=back: back(*span(s, e))
            key = string, to(0, 1)[0], to(len(string) - 1, len(string))[1]
            if key in seen:
                continue
            seen.add(key)
            for s, kind, e in base_spans(string):
                add((string, s), kind, *to(s, e))
            work.append((string, to))
    return base, sorted({*base, *((a, kind, b) for (_, kind, a), b in finds.items())})


def scan(text: str | None, most: int = MAX_CHAIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(finds in the text itself, finds in any layer), each (start, kind, end) in order.
    A span of kind UNREAD holds more than `most` compressed layers in one another."""
    return _layers(text or "", 0, most)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'unread')[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"


def _scan_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = scan(text.as_py(), most)
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), sum(k != UNREAD for _, k, _ in every) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_CHAIN) -> DataFrame:
    """One row per row of `docs`: id, finds per kind in the text itself, the digest of
    those, and all spans with those of decoded layers, as kind:start:end in code
    points, end exclusive, by start, then kind. A span of kind unread, not counted, is
    one that holds more than `most` compressed layers in one another.

    Cases: null and empty texts have no finds (the digest is that of the empty
    string); repeated rows give repeated rows; no rows, no result; other columns are
    ignored. Texts are scanned whole, each by one task, without a shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(_scan_batches(most), SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def base_of_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_secret_scan finds in the texts themselves, which SQL can state."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN_SQL = f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = ((0, "assign", _ASSIGN_SQL), (1, "access", "AKIA[A-Z0-9]{12,}"), (2, "hex", "[0-9a-f]{32,}"))
#: Matches are marked by two control characters, and places counted from what stands before.
_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS kind, '{name}' AS name, string_split(regexp_replace(t, '{p}', chr(1) || '{chr(92)}0' || chr(2), 'g'), chr(1)) AS p FROM t" for k, name, p in _PATTERNS)}),
each AS (SELECT doc_id, kind, name, unnest(list_transform(range(2, len(p) + 1), lambda j: struct_pack(s := list_sum(list_transform(p[1:j - 1], lambda x: length(replace(x, chr(2), '')))), m := split_part(p[j], chr(2), 1)))) AS x FROM parts),
found AS (SELECT doc_id, kind, name, CAST(x.s AS BIGINT) AS s, CAST(x.s AS BIGINT) + length(x.m) AS e FROM each WHERE kind > 0 OR length(regexp_extract(x.m, '{_ASSIGN_SQL}', 2)) >= 8),
told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM found GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN told ON t.doc_id = told.doc_id
"""

QUERIES = {"op2_secret_scan": op2_secret_scan, "base_of_op2": base_of_op2}
ORACLE_SQL = {"base_of_op2": _SQL}

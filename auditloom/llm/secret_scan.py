"""Secret scans by a recursive decoding worklist.

A text is the first layer. Every layer is scanned by the rules, then unwrapped: percent escapes, Unicode and HTML
number escapes are replaced all over the layer, and each run of base64 that decodes to text (UTF-8 or UTF-16), to bytes in which a rule could match,
or to a gzip, zlib, bzip2, xz or zstandard stream gives a layer of its own. New layers join the worklist until none is new; a layer seen
before is not taken again, so cycles end. Each layer carries a map to the characters of the text it came from, so a finding has a
span in the original.

Whole batches are first looked through in numpy: every rule and every decoder needs a run of 16 base64 characters, a line of 40 with another below it or
one of a few byte strings, and rows that have none of them cannot match, so they are left out exactly. Rows are independent: the scan is a narrow map.

Defined results: a null or empty text has no findings and is kept as it is by ``redact``. Repeated rows repeat their findings. An empty table
gives none. Of a compressed stream that is cut short, or unfolds to more than ``STREAM_BYTES``, what can be read is scanned, and its run of base64 is a finding of the rule ``unscanned``; a
broken stream gives no layer. Overlapping findings in one layer count as the longest, then the first rule. Every secret of a layer is a finding of its own, also where several have one span of the
original, as in one run of base64; a secret that is still there when the escapes around it are replaced is reported once, from the shallower layer. A private key is its BEGIN line with what can be
a key's body after it, up to the END line if there is one: a mention of a BEGIN line in prose is none. ``scan`` reads doc_id and
text only, and a doc_id that is no whole number counts as null; ``redact`` keeps all columns whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import frugal

#: Bytes to which one compressed stream is unfolded; what is beyond is reported as unscanned (a guard against decompression bombs).
STREAM_BYTES = 64 << 20
UNSCANNED = "unscanned"

_KEY = r"(?:api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token|access[_-]?token|token|secret|password|passwd|pwd)"
RULES: list[tuple[str, re.Pattern]] = [
    ("private_key", re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s|\\+[nr])*[A-Za-z][A-Za-z-]{2,30}: [^\r\n\\]{0,200}(?:[\r\n]|\\+[nr])+)*"  # headers of an encrypted key
        r"(?:(?:[A-Za-z0-9+/=\s]|\\+[nr])*-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\+[nr])*[A-Za-z0-9+/]{16,}={0,2})+)"
    )),
    ("aws_access_key", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Z0-9])")),
    ("github_token", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{40,255})")),
    ("gitlab_token", re.compile(r"(?<![A-Za-z0-9_])glpat-[A-Za-z0-9_-]{20,}")),
    ("slack_token", re.compile(r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google_key", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    ("stripe_key", re.compile(r"(?<![A-Za-z0-9])[rsp]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("sk_key", re.compile(r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url_password", re.compile(r"(?<![A-Za-z])[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"']{1,100}:[^\s:/@\"']{3,200}@[^\s/\"']+")),
    ("assigned_quoted", re.compile(rf"(?i)(?<![A-Za-z0-9]){_KEY}[\"']?\s*(?:[:=]|=>)\s*([\"'])[^\"'\s]{{8,}}\1")),
    ("assigned", re.compile(rf"(?i)(?<![A-Za-z0-9]){_KEY}\s*[:=]\s*(?=[A-Za-z_./+-]*[0-9])[A-Za-z0-9_./+=-]{{12,}}")),
]
#: Found inside a run of 16 base64 characters of either alphabet by every rule that needs neither a sign nor one of _DENSE.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|AIza|[rsp]k_(?:live|test)_|sk-|eyJ")
#: In bytes that are no text, only what is unlikely by chance is looked for.
_BINARY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}|github_pat_[A-Za-z0-9_]{40}|glpat-[A-Za-z0-9_-]{20}|xox[abeoprs]-[A-Za-z0-9-]{10}|AIza[A-Za-z0-9_-]{35}|[rsp]k_(?:live|test)_[A-Za-z0-9]{16}|sk-[A-Za-z0-9_-]{20}|eyJ[A-Za-z0-9_-]{8,}\.eyJ|-----BEGIN [A-Z ]*PRIVATE KEY|(?i:" + _KEY + r")[\"']?\s*(?:[:=]|=>)\s*[\"']?[^\"'\s]{8}")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+\r?\n)+[A-Za-z0-9+/]+={0,2}")
_PRINT = re.compile(r"[^\x20-\x7e\t\r\n\x85\xa0-\u024f\u0370-\u1fff\u2010-\u2060\u20a0-\u20bf\u3000-\ud7ff]")

_B64 = np.zeros(256, bool)
_B64[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ":=%\\"]] = True
#: The last two are of rules that match shorter runs: a Slack token has 15 characters at least, a part of a JWT 11.
_DENSE = [b"&#", b"-----BEGIN", b"xox", b"eyJ"]


def _escape(m: re.Match) -> str:
    s = m.group()
    try:
        if s[0] == "%":
            return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")
        if s[0] == "&":
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))
        if s[1] == "u" and s[2] != "{":
            return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")
        return chr(int(s[3:-1] if s[2] == "{" else s[2:], 16))
    except (ValueError, OverflowError):
        return s


def _unescape(text: str) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """The text with all escapes replaced, and (start, end, old start, old end) of the pieces it is made of."""
    out, spans, at, size = [], [], 0, 0
    for m in _ESCAPES.finditer(text):
        new = _escape(m)
        if new == m.group():
            continue
        if m.start() > at:
            out.append(text[at : m.start()])
            spans.append((size, size + m.start() - at, at, m.start()))
            size += m.start() - at
        out.append(new)
        spans.append((size, size + len(new), m.start(), m.end()))
        size, at = size + len(new), m.end()
    if not spans:
        return None
    if at < len(text):
        out.append(text[at:])
        spans.append((size, size + len(text) - at, at, len(text)))
    return "".join(out), spans


def _stream(make, data: bytes) -> tuple[bytes, bool] | None:
    """What a compressed stream unfolds to, and whether that is all of it; None if it is none or broken."""
    out, left = b"", data
    try:
        while left:
            d = make()
            if isinstance(d, zstandard.ZstdDecompressor):
                with d.stream_reader(left, read_across_frames=True) as r:
                    out = r.read(STREAM_BYTES + 1)
                told = zstandard.get_frame_parameters(left).content_size
                return out[:STREAM_BYTES], len(out) <= STREAM_BYTES and (told >= 1 << 63 or told <= len(out))
            out += d.decompress(left, STREAM_BYTES - len(out) + 1)
            if len(out) > STREAM_BYTES or not d.eof:
                return out[:STREAM_BYTES], False
            left = d.unused_data
            if not left.startswith(data[:3]):  # members can follow each other
                break
        return out, True
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        return (out, False) if out else None


_MAGIC = [(b"\x1f\x8b\x08", "gzip", lambda: zlib.decompressobj(31)), (b"BZh", "bzip2", bz2.BZ2Decompressor), (b"\xfd7zXZ", "xz", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", "zstd", zstandard.ZstdDecompressor)]
_ZLIB = {b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"}


def _unpack(data: bytes) -> tuple[bytes, list[str], bool]:
    """Compressed layers off until there are none (a stream that repeats itself ends it), their names, and whether all was read."""
    names: list[str] = []
    seen = {hashlib.sha256(data).digest()}
    whole = True
    while True:
        found = next(((n, m) for magic, n, m in _MAGIC if data.startswith(magic)), None) or (("zlib", zlib.decompressobj) if data[:2] in _ZLIB else None)
        got = _stream(found[1], data) if found else None
        if got is None or (h := hashlib.sha256(got[0]).digest()) in seen or (found[0] == "zlib" and not got[1]):  # two bytes are too few to tell a zlib stream that is cut short
            return data, names, whole
        seen.add(h)
        data, names, whole = got[0], [*names, found[0]], whole and got[1]


def _plain(data: bytes) -> str | None:
    """Bytes as text: UTF-8, UTF-16, or a character for each byte where a rule could match; None if there is no text in them."""
    try:
        text = data.decode("utf-8")
        if text and "\0" not in text and len(_PRINT.findall(text)) * 20 <= len(text):
            return text
    except UnicodeDecodeError:
        pass
    for start, code in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ((b"", "utf-16-le"), (b"", "utf-16-be")):
        side = data[1::2] if code == "utf-16-le" else data[::2]
        if len(data) >= 8 and len(data) % 2 == 0 and (start or side.count(0) * 2 > len(side)):
            try:
                text = data.decode(code)
            except UnicodeDecodeError:
                continue
            if len(_PRINT.findall(text)) * 20 <= len(text):
                return text
    text = data.decode("latin-1")
    return text if _BINARY.search(text) else None


def _base64(run: str) -> tuple[str, list[str], bool] | None:
    """The text under a run of base64, the names of what was unwrapped, and whether all could be read; None if it holds no text."""
    body = re.sub(r"\s", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    data, names, whole = _unpack(data)
    text = _plain(data)
    if text is None and whole:
        return None
    return text or "", ["base64", *names], whole


def _marked(text: str) -> list[tuple[int, int, str]]:
    """Spans of the rules in one layer, the longest of those that overlap."""
    found = [(m.start(), m.end(), name) for name, rule in RULES for m in rule.finditer(text)]
    found.sort(key=lambda x: (x[0] - x[1], x[0]))
    kept: list[tuple[int, int, str]] = []
    for s, e, name in found:
        k = bisect_left(kept, (s, e, name))  # those kept are apart, so only the neighbours can overlap
        if (k == 0 or kept[k - 1][1] <= s) and (k == len(kept) or e <= kept[k][0]):
            kept.insert(k, (s, e, name))
    return kept


def _through(spans, start: int, end: int) -> tuple[int, int]:
    """A span of a layer in the text above it; a span that touches a replaced piece takes all of it."""
    if len(spans) == 1 and spans[0][0] == -1:
        return spans[0][2], spans[0][3]
    first, last = spans[bisect_right(spans, start, key=lambda x: x[1])], spans[bisect_left(spans, end, key=lambda x: x[0]) - 1]
    lo = first[2] + (max(0, start - first[0]) if first[1] - first[0] == first[3] - first[2] else 0)
    hi = last[3] - (max(0, last[1] - end) if last[1] - last[0] == last[3] - last[2] else 0)
    return lo, hi


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def findings(text: str | None) -> list[tuple[int, int, str, str, int, str]]:
    """(start, end, rule, layers, depth, SHA-256 of the secret) in a text: characters of the text, layers as 'url>base64>gzip'."""
    if not text:
        return []
    out: dict[tuple, tuple] = {}
    seen = {(_digest(text), 0, len(text))}
    work: list[tuple[str, list[str], list, set]] = [(text, [], [], set())]  # with what the layer above has found
    for layer, names, maps, above in work:

        def origin(start: int, end: int) -> tuple[int, int]:
            for spans in reversed(maps):
                start, end = _through(spans, start, end)
            return start, end

        mine = set()
        for s, e, rule in _marked(layer):
            at, secret = origin(s, e), _digest(layer[s:e])
            mine.add((*at, rule))
            if not (names and names[-1] == "escape" and (*at, rule) in above):
                out.setdefault((*at, secret), (*at, rule, ">".join(names), len(names), secret))
        nexts = []
        if flat := _unescape(layer):
            nexts.append((flat[0], ["escape"], flat[1], (0, len(text))))
        for pattern in (_LINES, _RUN):
            for m in pattern.finditer(layer):
                if got := _base64(m.group()):
                    at = origin(m.start(), m.end())
                    if not got[2]:
                        out.setdefault((*at, UNSCANNED), (*at, UNSCANNED, ">".join(names + got[1]), len(names + got[1]), _digest(m.group())))
                    if got[0]:
                        nexts.append((got[0], got[1], [(-1, -1, m.start(), m.end())], at))
        for new, added, spans, at in nexts:
            key = (_digest(new), *at)
            if key not in seen:  # the same text from the same place is a cycle, or a layer that two ways lead to
                seen.add(key)
                work.append((new, names + added, [*maps, spans], mine))
    return sorted(out.values())


def suspects(data: np.ndarray, starts: np.ndarray, texts: list[str | None]) -> list[int]:
    """Rows that a rule or a decoder could match. data: the batch's bytes; starts: where each row begins, and the end."""
    n = len(starts) - 1
    if not len(data):
        return []
    hit = np.zeros(n, bool)
    row_of = lambda at: np.searchsorted(starts, at, "right") - 1
    hit[row_of(np.flatnonzero(_SIGN[data]))] = True
    raw = data.tobytes()
    for sign in _DENSE:
        at = 0
        while (at := raw.find(sign, at)) >= 0:
            hit[row_of(at)] = True
            at += 1
    inside = _B64[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.unique(np.concatenate([[0], edge, starts, [len(data)]]))
    size = np.diff(edge)
    long = np.flatnonzero((size >= 16) & inside[np.minimum(edge[:-1], len(data) - 1)])
    lines = edge[long[size[long] >= 40] + 1]  # where long runs end: _LINES joins those that a line break follows
    lines = lines[lines < len(data)]
    hit[row_of(lines[(data[lines] == 10) | (data[lines] == 13)])] = True
    for k, r in zip(long.tolist(), row_of(edge[long]).tolist()):
        if hit[r]:
            continue
        run = raw[edge[k] : edge[k + 1]].decode("latin-1")
        if _PREFIX.search(run) or _base64(run):
            hit[r] = True
    return [i for i in np.flatnonzero(hit).tolist() if texts[i]]


def _of_batch(column: pa.Array) -> list[tuple[int, list]]:
    """(row, findings) of the rows of a batch that have any."""
    texts = column.to_pylist()
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = ((i, findings(texts[i])) for i in suspects(data, starts, texts))
    return [(i, f) for i, f in got if f]


_FOUND = "doc_id bigint, start int, end int, rule string, layers string, depth int, secret_sha256 string"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each secret: doc_id, its span in characters, the rule, the layers it was under, how many, and its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                rows = [(ids[i], *f) for i, found in _of_batch(part.column(1)) for f in found]
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.selectExpr("try_cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(frugal(run), _FOUND)


def _blank(text: str, found: list) -> str:
    """The text with every span replaced by its rule's name; spans that overlap are replaced as one."""
    out, at = [], 0
    for start, end, rule, *_ in found:
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[{rule.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced by ``[RULE]`` in text, and n_chars, where there is such a column, brought up to date in those rows."""
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = _of_batch(part.column(where))
                cols = list(part.columns)
                if found:
                    texts = cols[where].to_pylist()
                    sizes = cols[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                    for i, f in found:
                        texts[i] = _blank(texts[i], f)
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                    cols[where] = pa.array(texts, cols[where].type)
                    if sizes is not None:
                        k = names.index("n_chars")
                        cols[k] = pa.array(sizes, cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(frugal(run), schema)

"""Secrets in texts: fixed patterns, and strings in a sensitive context that a primed compressor cannot shorten."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Container, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.llm.common import slices

#: The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "novel"]
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: What makes the following AHEAD code points sensitive, and what can be a secret there.
CONTEXT = re.compile(r"password|passwd|passphrase|\bpwd\b|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|authorization|bearer", re.I | re.A)
HINT = r"(?i)passw|passphrase|pwd|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|authorization|bearer"
LEAST_NOVEL = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST_NOVEL},}}")
AHEAD, AROUND = 48, 512
#: Share of a candidate's bytes by its own order-0 entropy that must stay after compression.
NOVELTY = 0.75
#: What may stand between a reported secret and the next line that belongs to it.
ADJOINING = re.compile(r"[\x20\t\"'+,\\]*(?:\r?\n[\x20\t\"'+]*){1,2}")
#: The short last line of such a secret: padded, or before the closing line of a key.
TAIL = re.compile(rf"[A-Za-z0-9+/]{{1,{LEAST_NOVEL - 1}}}(?:={{1,2}}(?![A-Za-z0-9+/=])|(?=\r?\n-----END))")
#: Identifiers and phrases of code that are no secrets; every candidate's dictionary begins with them.
IDENTIFIERS = b" ".join(
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 9876543210 0000000000000000 1111111111111111 "
    b"configuration environment authentication authorization application development production localhost example.com "
    b"getElementById addEventListener undefined function constructor prototype initialize parameters arguments response "
    b"request exception interface implements transaction connection credentials certificate permission username password "
    b"access_token refresh_token client_id client_secret api_key private_key public_key session_id user_id created_at "
    b"updated_at description placeholder your_api_key_here your_secret_here changeme XXXXXXXXXXXXXXXX xxxxxxxxxxxxxxxx "
    b"ssh-rsa BEGIN PRIVATE KEY END PUBLIC CERTIFICATE sha256 sha512 base64 utf-8 application/json text/html version "
    b"import export default return include namespace template static public private protected package module require".split()
)


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Bytes that ``candidate`` adds to a zstandard frame primed with the identifiers and what stands around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(press.compress(candidate)) - len(press.compress(b""))


def entropy_bytes(candidate: bytes) -> float:
    """Bytes of ``candidate`` if each of its characters is written by its own frequency in it."""
    times = np.unique(np.frombuffer(candidate, np.uint8), return_counts=True)[1]
    return float((times * np.log2(len(candidate) / times)).sum() / 8)


def is_novel(text: str, start: int, end: int) -> bool:
    """Has a letter and a digit and stays long although text around it is known.

    Below 64 bytes zstandard writes characters as they are, so the bound is the length; from there on it writes them by
    frequency, and no string can stay longer than its own entropy.
    """
    piece = text[start:end]
    if not (re.search("[0-9]", piece) and re.search("[A-Za-z]", piece)):
        return False
    around = text[max(0, start - AROUND):start] + " " + text[end:end + AROUND]
    left = marginal_bytes(piece.encode(), around.encode("utf-8", "surrogatepass"))
    return left >= NOVELTY * min(len(piece), entropy_bytes(piece.encode()) if len(piece) >= 64 else len(piece))


def novel(text: str, covered: Sequence[Sequence[int]] = (), names: Container[int] = ()) -> list[tuple[int, int]]:
    """Candidates that start within AHEAD of a sensitive word and are novel, and those on lines that adjoin such a one.

    ``covered`` spans (ascending, disjoint) are known already: what they leave of a candidate is judged piece by piece; a
    piece that ends at one of ``names`` is the name of an assignment.
    """
    found, done = [], 0
    for word in CONTEXT.finditer(text):
        at, last = max(word.end(), done), word.end() + AHEAD
        while m := CANDIDATE.search(text, at, min(len(text), last + LEAST_NOVEL)):
            start = m.start()
            at = done = CANDIDATE.match(text, start).end()  # the window may cut it
            while True:
                whole, pieces = is_novel(text, start, done), _beside(start, done, covered)
                if pieces != [(start, done)]:
                    pieces = [(a, b) for a, b in pieces if b not in names and is_novel(text, a, b)]
                elif not whole:
                    break
                found += pieces
                if not (whole or pieces):
                    break
                gap = ADJOINING.match(text, done)
                more = gap and CANDIDATE.match(text, gap.end())
                if not more:
                    if tail := gap and TAIL.match(text, gap.end()):
                        found += _beside(*tail.span(), covered)
                        done = tail.end()
                    break
                start, done = more.span()
            at = done
    return found


def _beside(start: int, end: int, covered: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """What the ascending, disjoint ``covered`` spans leave of start..end."""
    pieces, at = [], bisect.bisect_left(covered, start, key=lambda c: c[1])
    while at < len(covered) and covered[at][0] < end:
        if covered[at][0] > start:
            pieces.append((start, covered[at][0]))
        start = max(start, covered[at][1])
        at += 1
    return [*pieces, (start, end)] if start < end else pieces


def find_secrets(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) by start, then kind; code points, end exclusive.

    Base spans are leftmost and non-overlapping per kind. Of a novel span that touches base spans, the pieces beside them
    that are novel themselves remain, however short, but not the name before an assignment.
    """
    base = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    base += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    base += [(m.start(), m.end(), "hex", m.start()) for m in LONG_HEX.finditer(text)]
    covered: list[list[int]] = []
    for start, end in sorted(s[:2] for s in base):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    names = {s[0] for s in base if s[2] == "assign"}
    more = [(a, b, "novel", a) for a, b in novel(text, covered, names)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def _suspects(text: pa.Array) -> np.ndarray:
    """Rows in which any pattern can match; the others have no spans."""
    hit = pc.or_(pc.match_substring_regex(text, HINT), pc.match_substring_regex(text, "AKIA[A-Z0-9]|[0-9a-f]{24}"))
    return np.flatnonzero(pc.fill_null(hit, False).to_numpy(zero_copy_only=False))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    base_sha256 is that of the base spans written kind:start:end and joined by commas, spans has all of them so.
    A null text is empty; rows without spans have zeros, the hash of the empty string and an empty text. Repeated rows
    are answered each; an empty table stays empty.
    """
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches):
        for b in slices(batches):
            text = b.column("text")
            counts, sha, spans = np.zeros((4, len(text)), np.int64), [none] * len(text), [""] * len(text)
            for i in _suspects(text):
                found = find_secrets(text[int(i)].as_py())
                for k, kind in enumerate(KINDS):
                    counts[k, i] = sum(s[2] == kind for s in found)
                sha[i] = hashlib.sha256(joined([s for s in found if s[2] != "novel"]).encode()).hexdigest()
                spans[i] = joined(found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(sha), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")


MARK = "[secret]"


def redact(text: str) -> str:
    """``text`` with each secret replaced by a mark; overlapping ones share a mark."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, end, _, value in find_secrets(text)):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns; secrets in ``text`` are replaced by a mark, all else stays. Null stays null."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text")) if rest else docs.select(F.lit(0).alias("row"), F.col(text).alias("text"))

    def clean(batches):
        for b in slices(batches):
            column = b.column("text")
            changed = {int(i): redact(column[int(i)].as_py()) for i in _suspects(column)}
            if changed:
                values = column.to_pylist()
                for i, new in changed.items():
                    values[i] = new
                column = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), column], ["row", "text"])

    out = rows.mapInArrow(clean, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

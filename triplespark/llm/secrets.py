"""Secret scan by token efficiency.

A vocabulary learnt on ordinary text spends many tokens on a random string. Among the long runs of letters and digits
of a text, those that are neither known digests nor identifiers and have few characters to a token are reported.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .scratch import Scratch
from .tables import integer_id, small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that the byte-level vocabularies of this family are used with.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAST, RATIO = 16, 2.5
#: Characters to a token of a word, in any language; random letters have 1.66 on average.
WORD = 2.1

_ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|AIza|glpat-)"
_CREDENTIAL = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)s?$"
_GAP = " \t\n\r\f\v\u00a0\"'=:>"
_NAME = r"^[A-Za-z][A-Za-z_-]*[0-9]{0,4}$"
_PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"
_NUMBER = r"^[0-9TZ+_-]+$"
_UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_HEX = r"^[0-9a-fA-F]+$"
_DIGESTS = (32, 40, 56, 64, 96, 128)


def is_name(run: str, enc: tiktoken.Encoding, ratio: float) -> bool:
    """Whether a run is letters with up to 4 digits at the end, and its camelCase or snake parts are words: tokenised
    alone or after a space, those of 3 letters or more have ``ratio`` characters to a token each, and at most half of
    the parts are shorter."""
    if not re.search(_NAME, run):
        return False
    parts = [p.lower() for p in re.findall(_PART, run)]
    long = [p for p in parts if len(p) > 2]
    if 2 * len(long) < len(parts):
        return False
    return all(len(p) >= ratio * min(len(enc.encode_ordinary(p)), len(enc.encode_ordinary(" " + p))) for p in long)


def lead_in(raw: np.ndarray, start: int, at: int, least: int = 16) -> str:
    """What stands before byte ``at`` of a document that begins at ``start``: all white space, quotes and signs of
    assignment, however many, and at least so many bytes before them, where the document has them."""
    step = 4 * least
    while True:
        lo = max(start, at - step)
        text = raw[lo:at].tobytes().decode(errors="replace")
        if lo == start or len(text.rstrip(_GAP)) >= 2 * least:
            return text
        step *= 4


def assigns(before: str) -> bool:
    """Whether a text ends in the name of a credential and white space or one sign of assignment, quoted or not."""
    name = before.rstrip(_GAP)
    gap = re.sub(r"^[\"']|[\"']$", "", before[len(name) :])
    return bool(gap) and gap.strip() in ("", "=", ":", ":=", "=>") and bool(re.search(_CREDENTIAL, name[-16:]))


def is_excluded(run: str, before: Callable[[], str], enc: tiktoken.Encoding) -> bool:
    """Whether a run is a name, a number, a UUID or, unless what stands ``before`` it assigns it to a credential, a
    digest by form."""
    if re.search(_ISSUED, run):
        return False
    if re.search(_NUMBER, run) or re.search(_UUID, run) or is_name(run, enc, WORD):
        return True
    return len(run) in _DIGESTS and bool(re.search(_HEX, run)) and not assigns(before())


def candidates(run: str, enc: tiktoken.Encoding, least: int) -> list[tuple[int, str]]:
    """(offset, string) of what may be a secret in a run. A slash belongs to base64, so a run with slashes is one
    string without the path around it, which is short lower-case pieces, names and numbers at either end; but an
    issued key stands by itself, and so do the pieces of a run in which each long one is a digest or a UUID."""
    if "/" not in run:
        return [(0, run)]
    pieces, at = [], 0
    for p in run.split("/"):
        pieces.append((at, p))
        at += len(p) + 1
    bare = lambda p: p.rstrip("=")
    digest = lambda p: bool(re.search(_UUID, p)) or len(p) in _DIGESTS and bool(re.search(_HEX, p))
    long = [p for _, p in pieces if len(p) >= least]
    if any(re.search(_ISSUED, p) for p in long) or long and all(digest(p) for p in long):
        return [(i, p) for i, p in pieces if len(p) >= least]
    path = lambda p: bool(re.search(r"^(?:[a-z]{0,4}|v[0-9]{1,2})$", bare(p)) or re.search(_NUMBER, p)) or is_name(bare(p), enc, WORD)
    while pieces and path(pieces[0][1]):
        del pieces[0]
    while pieces and path(pieces[-1][1]):
        del pieces[-1]
    if not pieces:
        return []
    value = run[pieces[0][0] : pieces[-1][0] + len(pieces[-1][1])]
    return [(pieces[0][0], value)] if len(value) >= least else []


def runs(raw: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of the runs of at least so many ASCII letters, digits, _, +, - and /, with up to
    two = that end a run."""
    allowed = np.zeros(256, bool)
    allowed[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+-/"]] = True
    ok = np.zeros(len(raw) + 2, bool)
    ok[1:-1] = allowed[raw]
    edge = np.flatnonzero(ok[1:] != ok[:-1])
    starts, ends = edge[::2], edge[1::2]
    cut = np.searchsorted(offs, starts, "right") - 1
    over = np.flatnonzero(ends > offs[cut + 1])
    if len(over):  # a run over the end of a document is one run of each
        pieces = [(s, e) for k in over.tolist() for s, e in _split(int(starts[k]), int(ends[k]), offs)]
        keep = np.ones(len(starts), bool)
        keep[over] = False
        both = np.concatenate([np.stack([starts[keep], ends[keep]], 1), np.array(pieces, np.int64).reshape(-1, 2)])
        starts, ends = both[np.argsort(both[:, 0], kind="stable")].T
        cut = np.searchsorted(offs, starts, "right") - 1
    stop, sign = offs[cut + 1], np.concatenate([raw, np.zeros(3, raw.dtype)])
    pad = np.zeros(len(ends), np.int64)
    for k in range(2):
        pad += (pad == k) & (ends + k < stop) & (sign[ends + k] == ord("="))
    after = ends + pad
    ends = np.where((after < stop) & (allowed[sign[after]] | (sign[after] == ord("="))), ends, after)
    long = ends - starts >= least
    return cut[long], starts[long], ends[long]


def _split(start: int, end: int, offs: np.ndarray) -> list[tuple[int, int]]:
    inner = np.unique(offs[(offs > start) & (offs < end)]).tolist()
    return list(zip([start, *inner], [*inner, end], strict=True))


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoding of a vocabulary file's bytes; a worker process keeps it for its later tasks."""
    kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
    key = (len(vocabulary), hash(vocabulary))
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        kept[key] = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _scanner(sent, least: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            rows, starts, sizes, tokens, values = [], [], [], [], []
            for lo, _, raw, offs in textvec.chunks(batch["text"]):
                lead = None
                found = ((doc, a + i, value) for doc, a, b in zip(*(x.tolist() for x in runs(raw, offs, least)), strict=True) for i, value in candidates(raw[a:b].tobytes().decode(), enc, least))
                for doc, a, value in found:
                    if is_excluded(value, lambda doc=doc, a=a: lead_in(raw, int(offs[doc]), a), enc):
                        continue
                    n = len(enc.encode_ordinary(value))
                    if len(value) >= ratio * n:
                        continue
                    if lead is None:
                        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    rows.append(lo + doc)
                    starts.append(int(lead[a] - lead[offs[doc]]))
                    sizes.append(len(value))
                    tokens.append(n)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.int32()), pa.array(values, pa.string())], ["doc_id", "start", "length", "tokens", "value"])

    return run


def secret_scan(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, known: DataFrame | None = None, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """(doc_id, start, length, tokens, chars_per_token, fingerprint) of each string that looks random.

    ``start`` counts characters from 0; ``fingerprint`` is the SHA-256 of the string, which itself stays out of the
    report. ``known`` is a table with a column ``digest`` of strings that are no secrets, in either case of letters;
    null ones are skipped. Null and empty texts have no strings, an empty table gives an empty result; a string counts
    at each place and in each row it occurs in; doc_id must be a whole number of up to 64 bits, a null one is reported
    as null. A string whose ratio equals ``ratio`` isn't reported. Only runs of at least ``least`` characters are
    tokenised, each whole, as texts are. Other columns, whatever their names, don't count. A string of the form of a
    digest is a secret if a credential's name is all that stands before it, with any amount of white space between.
    """
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    texts = docs.where("text is not null").select(integer_id(docs).alias("doc_id"), "text")
    found = texts.mapInArrow(_scanner(sent, least, ratio), "doc_id long, start int, length int, tokens int, value string")
    if known is not None:
        ours = small(Scratch(spark, "secrets").table(known.select(F.lower("digest").alias("d")).where("d is not null").distinct(), "known"))
        found = found.join(ours, F.lower("value") == F.col("d"), "left_anti")
    return found.select("doc_id", "start", "length", "tokens", (F.col("length") / F.col("tokens")).alias("chars_per_token"), F.sha2("value", 256).alias("fingerprint"))

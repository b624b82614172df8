"""Secret scans by token efficiency.

Patterns find assignments, access keys and runs of hexadecimal digits. Beside them, any run of ``LEAST`` key
characters or more is looked at: words take few tokens of a byte-level vocabulary for their characters, random strings
take many, so a string with few characters for each token is a secret, unless it has the form of a known
digest or identifier (a UUID, a checksum, a number, a date). Runs are cut where parts of them are words or numbers (paths, names with
underscores), so that a key in a path is judged by itself; what base spans cover is cut out of a run, and the rest is judged. Strings of letters only count if they mix the cases, or, of capitals only,
below a ratio of their own; lower-case letters alone are not told from prose.

Defined results: a null text is empty; an empty text gives no spans; positions are code points, ends
excluded; each input row gives one row, repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.arrow import id_type, keyed_text, map_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")

# The patterns of the base spans. Runs are taken whole, so a lower bound on their length
# changes no match.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Characters of the shortest string that is judged.
LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Parts of a run that are words or numbers.
PART = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Z]?[a-z]{3,}[0-9]{0,2}|[A-Z]{3,}[0-9]{0,2}|(?:[A-Z]?[a-z]{2,}){2,}|[0-9]{1,8}")
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"  # digests
    r"|[0-9_/=+-]+)"  # dates, numbers and rules
)
#: Characters for each token below which a string counts as random, with digits and of letters only; and the least entropy of its characters in bits.
RATIO = 2.2
LETTERS = 1.9
#: The same for capitals only: at most one in fifty strings of glued words lies below, and nine in ten random ones.
CAPITALS = 1.8
ENTROPY = 2.8


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("keys", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def entropy(x: str) -> float:
    return -sum(k / len(x) * math.log2(k / len(x)) for k in map(x.count, set(x)))


def is_random(x: str, vocabulary: str, ratio: float = RATIO) -> bool:
    if len(x) < LEAST or KNOWN.fullmatch(x) or entropy(x) < ENTROPY:
        return False
    if x.isalpha() and x.isupper():
        if sum(ord(b) - ord(a) == 1 for a, b in zip(x, x[1:], strict=False)) > len(x) // 3:  # the alphabet
            return False
        ratio = ratio * CAPITALS / RATIO
    elif not any("0" <= c <= "9" for c in x):
        if sum(a.islower() and b.isupper() for a, b in zip(x, x[1:], strict=False)) < 2:
            return False
        ratio = ratio * LETTERS / RATIO
    elif not any(c.isalpha() for c in x):
        return False
    return len(x) < ratio * len(encoder(vocabulary).encode_ordinary(x))


def apart(run: str) -> list[tuple[int, int]]:
    """The stretches of a run between parts that are words or numbers, separators at their ends left out."""
    out: list[list[int]] = []
    open_ = False
    for m in PART.finditer(run):
        if WORD.fullmatch(m[0]) and not (len(m[0]) >= LEAST and m[0].isalpha() and m[0].isupper()):
            open_ = False
        elif open_:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
            open_ = True
    return [(a, b) for a, b in out]


def random_spans(run: str, vocabulary: str, ratio: float) -> list[tuple[int, int]]:
    """The random strings of a run of key characters; the whole run, with the signs that fill it up, if nothing else is in it."""
    if KNOWN.fullmatch(run):
        return []
    found = [(a, b) for a, b in apart(run) if is_random(run[a:b], vocabulary, ratio)]
    if len(found) == 1 and not run[: found[0][0]].strip("+/=_-") and not run[found[0][1] :].strip("+/=_-"):
        return [(0, len(run))]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; a match that fails its length is dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, vocabulary: str, ratio: float = RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with the random strings that no base span covers."""
    base = base_spans(text)
    covered = merged([(a, b) for a, _, b in base])
    starts = [a for a, _ in covered]
    more = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        before = max(bisect_left(starts, at + 1) - 1, 0)
        if KNOWN.fullmatch(m[0]):
            continue
        for a, b in [*covered[before : bisect_left(starts, m.end())], (m.end(), m.end())]:
            if b > at:
                more += [(at + x, 3, at + y) for x, y in random_spans(text[at:a], vocabulary, ratio)] if a - at >= LEAST else []
                at = b
        # nothing is left behind a span that ends the run or goes on beyond it
    return base, sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(vocabulary: str, ratio: float, batch: pa.RecordBatch) -> pa.RecordBatch:
    base, every = [], []
    for text in batch.column("text").to_pylist():
        b, e = all_spans(text, vocabulary, ratio)
        base.append(b)
        every.append(e)
    counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)]
    return pa.record_batch(
        [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base]), pa.array([listed(e) for e in every], pa.string())],
        names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """Secrets of each row's whole text; ``vocabulary`` is a tiktoken file that every executor can open."""
    schema = f"doc_id {id_type(docs, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_slices(keyed_text(docs, id_col, text_col), partial(scanned, vocabulary, ratio), schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO, mark: str = "<SECRET>") -> DataFrame:
    """doc_id and the text with every span, overlapping ones as one, replaced by ``mark``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            parts, at = [], 0
            for a, _, b in all_spans(text, vocabulary, ratio)[1]:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_slices(keyed_text(docs, id_col, text_col), one, f"doc_id {id_type(docs, id_col)}, text string")

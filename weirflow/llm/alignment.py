"""Alignment of two tokenizers' tokens by a sweep over the places where tokens end.

A is a byte-level BPE vocabulary, which encodes a space and the text; B a SentencePiece model, which adds the space itself. Both sides' tokens cover the
same bytes. The end of a token is an event; the events of a document's two sides are united, dealt out by document, sorted by offset within each
partition and read once: a machine holds what either side has beyond the last offset at which both end, closes a group wherever they meet, and links
every A and B token that overlap. Events travel in blocks of up to ``TOKENS`` tokens of one side, which begin at their own offset, so whatever a document's length, the machine holds
two blocks and one open group.

An id pair's count is the number of documents that hold it linked. Counts are an aggregation of all documents' pairs, made smaller in each task first. The ``HEAD`` most frequent pairs at most, and each A id's
highest count (a row for each id of the vocabulary), go to the tasks; other pairs are joined.

Long texts are encoded in parts that end between a character that is no space and a space, which no token of either side crosses.

Defined results: a null or empty text, and one whose tokens' bytes on either side differ from the space and the text (U+2581, which B takes for a space), have no tokens: zeros and an empty digest. Every
input row gives one row and counts as one document, repeated rows too; equal rows of a partition are encoded once, so that a row that a third of the table repeats is no hot document. Null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, shared_dir, slices

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this family cuts a text before it merges (a fixed value, as published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of an event block, and characters of a text that are encoded at once.
TOKENS = 1 << 16
PART = 1 << 18
#: Tokens of closed groups that are worked on together, and pairs whose documents are counted together.
CLOSED = 1 << 18
PAIRS = 1 << 21
#: Pairs whose counts are sent to every task, at most.
HEAD = 1 << 17
A, B = 0, 1


@lru_cache(maxsize=2)
def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Side:
    """A vocabulary: the bytes of each id, and texts to ids."""

    tokens: list[bytes]
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def sides(a_file: str, b_file: str) -> tuple[Side, Side, object, object]:
    """Both vocabularies and their encoders."""
    import sentencepiece
    import tiktoken

    with open(a_file, encoding="utf-8") as f:
        made = json.load(f)
    own = byte_level()
    ranks = {bytes(own[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if all(c in own for c in piece)}
    for t in made["added_tokens"]:
        ranks.pop(t["content"].encode(), None)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    encoder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=b_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(tokens), Side(pieces), encoder, model


def parts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Places at which a text can be cut for both sides; each part but the first begins with a space and goes on behind it."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and not (text[end] == " " and end + 1 < len(text) and not text[end - 1].isspace()):
            end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
        yield start, end
        start = end


class Encoder:
    """Texts to ids of both sides, or None where their bytes are not those of the text."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b, self.encoder, self.model = sides(a_file, b_file)

    def part(self, text: str, first: bool) -> tuple[list[int], list[int]] | None:
        spaced = " " + text if first else text
        raw = spaced.encode()
        ids = self.encoder.encode_ordinary(spaced), self.model.encode(spaced[1:])
        return ids if self.a.joined(ids[0]) == raw == self.b.joined(ids[1]) else None

    def whole(self, text: str, size: int) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of each part of a text; nothing if any part has none."""
        cuts = list(parts(text, size))
        if len(cuts) == 1:
            made = self.part(text, True)
            if made:
                yield made
        elif all(self.part(text[a:b], a == 0) for a, b in cuts):  # twice, so that only a part is held
            for a, b in cuts:
                yield self.part(text[a:b], a == 0)


def planes(x: np.ndarray, width: int) -> bytes:
    """Whole numbers with their first bytes together, then their second ones, ..., which compresses better."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T).tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width)
    return np.ascontiguousarray(x.T).view(f"<u{width}").ravel()


EVENTS = "key binary, doc_id {}, copies long, at long, side int, ids binary"


def events(docs: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str, tokens: int = TOKENS, part: int = PART) -> DataFrame:
    """Blocks of tokens of either side with the offset at which they begin; a document without tokens has one empty block.

    ``key`` is a digest of the row and of the partition it stands in, so that a task that runs again makes the same.
    """
    rows = keyed_text(docs, id_col, text_col)
    names = ["key", "doc_id", "copies", "at", "side", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(a_file, b_file)
        press = zstandard.ZstdCompressor(level=1)
        place = TaskContext.get().partitionId().to_bytes(8, "little")
        lengths = encoder.a.lengths, encoder.b.lengths

        def packed(held: list, kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [pa.binary(), kind, pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for piece in slices(batch, "text"):
                same: dict[tuple, int] = {}
                for row in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    same[row] = same.get(row, 0) + 1
                held, size = [], 0
                for (i, text), copies in same.items():
                    key = hashlib.blake2b(place + repr(i).encode() + b"\0" + text.encode(), digest_size=16).digest()
                    at, some = [0, 0], False
                    for ids in encoder.whole(text, part):
                        some = True
                        for side in (A, B):
                            x = np.array(ids[side], np.uint32)
                            for k in range(0, len(x), tokens):
                                block = x[k : k + tokens]
                                held.append((key, i, copies, at[side], side, press.compress(planes(block, 4))))
                                at[side] += int(lengths[side][block].sum())
                                size += len(block)
                        if size > 4 * CLOSED:
                            yield packed(held, kind)
                            held, size = [], 0
                    if not some:
                        held.append((key, i, copies, 0, A, b""))
                if held:
                    yield packed(held, kind)

    return rows.mapInArrow(run, EVENTS.format(id_type(docs, id_col)))


class Machine:
    """Reads a document's blocks in the order of their offsets and hands on closed ranges: the tokens of both sides up to an offset at which both end."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.start = 0

    def block(self, side: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        if not len(self.ids[A]) or not len(self.ids[B]):
            return None
        a, b = (np.cumsum(n[x]) for n, x in zip(self.lengths, self.ids, strict=True))
        if a[-1] == b[-1]:
            na, nb = len(a), len(b)
        else:
            both = np.intersect1d(a, b, assume_unique=True)
            if not len(both):
                return None
            na, nb = (int(np.searchsorted(x, both[-1])) + 1 for x in (a, b))
        done = self.ids[A][:na], self.ids[B][:nb]
        self.ids = [self.ids[A][na:], self.ids[B][nb:]]
        return done


@dataclass
class Closed:
    """What is known of a closed range: numbers of tokens, groups and links, the ids in order and the linked pairs with their numbers of times."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray
    times: np.ndarray


@lru_cache(maxsize=2)
def written(n: int) -> list[bytes]:
    """Each id with what can stand behind it: a comma, the bar between the sides, the end of a group."""
    return [b"%d%s" % (i, end) for i in range(n) for end in (b",", b"|", b";")]


def sweep(ranges: list[tuple[np.ndarray, np.ndarray]], lengths: tuple[np.ndarray, np.ndarray]) -> list[Closed]:
    """Groups and links of many closed ranges at once: as both sides of each have as many bytes, ranges in a row are one long range."""
    a, b = (np.concatenate([r[s] for r in ranges]).astype(np.int64) for s in (A, B))
    ends_a, ends_b = np.cumsum(lengths[A][a]), np.cumsum(lengths[B][b])
    over = np.searchsorted(ends_b, ends_a)  # the B token that holds the last byte of each A token
    last_a = ends_b[over] == ends_a
    last_b = np.zeros(len(b), bool)
    last_b[over[last_a]] = True
    from_b = np.r_[0, (over + last_a)[:-1]]
    width = over - from_b + 1
    first = np.cumsum(width) - width
    links_a = np.repeat(np.arange(len(a)), width)
    links_b = np.arange(len(links_a)) - np.repeat(first - from_b, width)
    code = a[links_a] * len(lengths[B]) + b[links_b]
    group_ends_a, group_ends_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    spelt = np.empty(len(a) + len(b), np.int64)
    spelt[np.arange(len(a)) + np.r_[0, group_ends_b[:-1] + 1][np.cumsum(last_a) - last_a]] = a * 3 + last_a
    spelt[np.arange(len(b)) + (group_ends_a + 1)[np.cumsum(last_b) - last_b]] = b * 3 + 2 * last_b
    table = written(max(map(len, lengths)))
    na, nb = (np.array([len(r[s]) for r in ranges]) for s in (A, B))
    to_a, to_b = np.cumsum(na), np.cumsum(nb)
    to_links = (first + width)[to_a - 1]
    to_groups = np.cumsum(last_a)[to_a - 1]
    whose = np.repeat(np.arange(len(ranges)), np.diff(np.r_[0, to_links]))
    order = np.lexsort((code, whose)) if len(lengths[A]) * len(lengths[B]) * len(ranges) >= 1 << 63 else np.argsort(whose * (len(lengths[A]) * len(lengths[B])) + code, kind="stable")
    code, whose = code[order], whose[order]
    fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])])
    times = np.diff(np.r_[fresh, len(code)])
    pairs, to_pairs = code[fresh], np.searchsorted(whose[fresh], np.arange(len(ranges)), "right")
    out, t0, l0, g0, p0 = [], 0, 0, 0, 0
    spelt = spelt.tolist()
    for k in range(len(ranges)):
        t1, l1, g1, p1 = int(to_a[k] + to_b[k]), int(to_links[k]), int(to_groups[k]), int(to_pairs[k])
        out.append(Closed(int(na[k]), int(nb[k]), g1 - g0, l1 - l0, b"".join(map(table.__getitem__, spelt[t0:t1])), pairs[p0:p1], times[p0:p1]))
        t0, l0, g0, p0 = t1, l1, g1, p1
    return out


def pack(press: zstandard.ZstdCompressor, pairs: np.ndarray, times: np.ndarray) -> bytes:
    return press.compress(planes(np.diff(pairs, prepend=0), 8) + planes(times, 4))


def unpack(open_: zstandard.ZstdDecompressor, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = open_.decompress(raw)
    n = len(raw) // 12
    return np.cumsum(unplaned(raw[: 8 * n], 8).astype(np.int64)), unplaned(raw[8 * n :], 4).astype(np.int64)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
#: ``part`` counts a document's ranges; the row of its figures has none. ``whole``: it had one range, whose pairs stand with the figures.
SWEPT = "key binary, doc_id {}, copies long, part int, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary{}"


def swept(blocks: DataFrame, a_file: str, b_file: str, spell: bool = False) -> DataFrame:
    """Reads events that are sorted by document and offset. A row for each document, and for each closed range of a document that has several; ``spell`` adds the ranges' ids as text in ``groups``."""
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side, _, _ = sides(a_file, b_file)
        lengths = a_side.lengths, b_side.lengths
        press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        todo: list[tuple] = []  # closed ranges that wait: (document, its number there, tokens)
        size = 0
        kinds = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows = []
            made = iter(sweep([t[2] for t in todo if t[2]], lengths)) if any(t[2] for t in todo) else iter(())
            for doc, part, tokens in todo:
                r = next(made) if tokens else None
                if r:
                    doc["hash"].update((b";" if part else b"") + r.groups[:-1])
                    for f in FIGURES:
                        doc[f] += getattr(r, f)
                    if doc["ended"] and doc["parts"] == 1:
                        doc["pairs"], doc["spelt"] = pack(press, r.pairs, r.times), r.groups[:-1].decode()
                    else:
                        rows.append((doc["key"], doc["id"], doc["copies"], part, False, None, None, None, None, None, pack(press, r.pairs, r.times), r.groups[:-1].decode()))
                if doc["ended"] and part == doc["parts"] - 1:
                    n = doc["n_a"]
                    rows.append((doc["key"], doc["id"], doc["copies"], None, doc["parts"] == 1, *(doc[f] for f in FIGURES), doc["hash"].hexdigest() if n else "", doc["pairs"], doc["spelt"]))
            todo.clear()
            size = 0
            if rows:
                columns = list(zip(*rows, strict=True))[: 12 if spell else 11]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], [f"c{i}" for i in range(len(columns))])

        doc = machine = None
        seen: set[tuple] = set()

        def end() -> None:
            """A document's blocks are through; its last range, or an empty one, closes its row."""
            if doc:
                doc["ended"] = True
                if not doc["parts"]:
                    doc["parts"] = 1
                    todo.append((doc, 0, None))

        for batch in batches:
            if kinds is None:
                kinds = [pa.binary(), batch.column("doc_id").type, pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.string()]
            for key, i, copies, at, side, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is None or key != doc["key"]:
                    end()
                    if size > CLOSED:
                        yield from flush()
                    doc = {"key": key, "id": i, "copies": 0, "parts": 0, "ended": False, "hash": hashlib.sha256(), "pairs": None, "spelt": None, **dict.fromkeys(FIGURES, 0)}
                    machine = Machine(lengths)
                    seen = set()
                if at == 0 and side == A:
                    doc["copies"] += copies
                if (at, side) in seen:  # the same row again, from another slice of its partition
                    continue
                seen = {s for s in seen if s[0] == at} | {(at, side)}
                if not raw:
                    continue
                ids = unplaned(open_.decompress(raw), 4)
                done = machine.block(side, ids)
                if done:
                    if doc["parts"] and todo and size > CLOSED:
                        yield from flush()
                    todo.append((doc, doc["parts"], done))
                    doc["parts"] += 1
                    size += len(done[0]) + len(done[1])
        end()
        if todo:
            yield from flush()

    return blocks.mapInArrow(run, SWEPT.format(kind, ", groups string" if spell else ""))


def dealt(blocks: DataFrame) -> DataFrame:
    """Events by document, in the order of their offsets."""
    return blocks.repartition("key").sortWithinPartitions("key", "at", "side")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, tokens: int = TOKENS, part: int = PART, spell: bool = False) -> DataFrame:
    """Documents' figures, digests and packed pairs, as ``SWEPT`` says."""
    return swept(dealt(events(docs, id_col, text_col, a_file, b_file, tokens, part)), a_file, b_file, spell)


def groups(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id``, ``part`` and ``groups``: the ids of each group as `a1,a2|b1;a3|b2,b3`, the groups of a long document in several parts; repeated rows give their groups as often."""
    out = aligned(docs, spell=True, **options).where("groups is not null")
    return out.select("doc_id", F.coalesce("part", F.lit(0)).alias("part"), "groups", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each packed pair: ``columns``, ``code`` and ``times``."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, raw in enumerate(batch.column("pairs").to_pylist()):
                code, times = unpack(open_, raw)
                own = [pa.array(batch.column(c).slice(k, 1)).take(pa.array(np.zeros(len(code), np.int64))) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(code), pa.array(times)], [*columns, "code", "times"])

    return rows.select(*columns, "pairs").mapInArrow(run, f"{schema}, code long, times long")


def links(swept_rows: DataFrame, b_file: str = B_FILE, a_file: str = A_FILE) -> DataFrame:
    """``doc_id``, ``a``, ``b`` and how many ``times`` a document links them."""
    n = len(sides(a_file, b_file)[1].tokens)
    rows = unpacked(swept_rows.where("pairs is not null"), ["key", "doc_id", "copies"]).groupBy("key", "doc_id", "copies", "code").agg(F.sum("times").alias("times"))
    return rows.select("doc_id", F.expr(f"code div {n}").alias("a"), F.expr(f"code % {n}").alias("b"), "times", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def documents_of_pairs(rows: DataFrame) -> DataFrame:
    """``code`` and ``n``, partly added up: the documents, ``copies`` a row, that hold each packed pair. Each row's pairs are different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        held, weights, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            code, back = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(back, np.concatenate(weights)).astype(np.int64)
            held.clear()
            weights.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in batches:
            for raw, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                code, _ = unpack(open_, raw)
                held.append(code)
                weights.append(np.full(len(code), copies, np.float64))
                size += len(code)
                if size > PAIRS:
                    yield flush()
        if size:
            yield flush()

    return rows.select("pairs", "copies").mapInArrow(run, "code long, n long")


def level(n: Column) -> Column:
    """A count's rank among few: equal counts are on one level, greater ones not below."""
    return F.floor(F.log2(n) * 8).cast("int")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, tokens: int = TOKENS, part: int = PART, head: int = HEAD) -> DataFrame:
    """A row for each document: tokens of either side, groups, links, links whose count is their A id's highest, the sum of links' counts, and the digest of the groups."""
    spark = docs.sparkSession
    shared_dir(spark)
    n_b = len(sides(a_file, b_file)[1].tokens)
    rows = aligned(docs, id_col, text_col, a_file, b_file, tokens, part).checkpoint()
    # documents of several ranges: their pairs are added up first
    several = unpacked(rows.where("part is not null"), ["key", "copies"]).groupBy("key", "copies", "code").agg(F.sum("times").alias("times")).checkpoint()
    counts = documents_of_pairs(rows.where("whole and pairs is not null")).unionByName(several.select("code", F.col("copies").alias("n"))).groupBy("code").agg(F.sum("n").alias("n")).checkpoint()
    best = counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("n").alias("best"))
    tops = sorted(((r["a"], r["best"]) for r in best.collect()))  # at most the vocabulary of A
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level(F.col("n")).alias("level")).count().collect()), reverse=True)  # at most 8 for each power of two
    least, total = 1 << 30, 0
    for at, n in levels:
        total += n
        if total > head:
            break
        least = at
    known = counts.where(level(F.col("n")) >= least).toArrow()
    sent = spark.sparkContext.broadcast(
        {
            "code": known["code"].to_numpy(),
            "n": known["n"].to_numpy(),
            "best": (np.array([a for a, _ in tops], np.int64), np.array([n for _, n in tops], np.int64)),
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        order = np.argsort(sent.value["code"])
        code_, n_ = sent.value["code"][order], sent.value["n"][order]
        top = np.zeros(int(sent.value["best"][0].max(initial=-1)) + 2, np.int64)
        top[sent.value["best"][0]] = sent.value["best"][1]
        first = n_ == top[code_ // n_b]
        for batch in batches:
            best_, sum_, rest, times_, ends = [], [], [], [], [0]
            for raw in batch.column("pairs").to_pylist():
                if raw is None:
                    best_.append(0)
                    sum_.append(0)
                    ends.append(ends[-1])
                    continue
                code, times = unpack(open_, raw)
                at = np.minimum(np.searchsorted(code_, code), max(len(code_) - 1, 0))
                hit = code_[at] == code if len(code_) else np.zeros(len(code), bool)
                at = at[hit]
                best_.append(int(times[hit][first[at]].sum()))
                sum_.append(int((times[hit] * n_[at]).sum()))
                rest.append(code[~hit])
                times_.append(times[~hit])
                ends.append(ends[-1] + len(rest[-1]))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (rest, times_)]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "pairs"), pa.array(best_, pa.int64()), pa.array(sum_, pa.int64()), *lists], [*(n for n in batch.schema.names if n != "pairs"), "n_best", "count_sum", "rest", "times"])

    shown = ["key", "doc_id", "copies", *FIGURES, "groups_sha256"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in shown)
    looked = rows.where("part is null").select(*shown, "pairs").mapInArrow(run, f"{schema}, n_best long, count_sum long, rest array<long>, times array<long>").checkpoint()
    rare = looked.where(F.size("rest") > 0).select("key", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("key", F.col("r.rest").alias("code"), F.col("r.times").alias("times"))
    rare = rare.join(counts.where(level(F.col("n")) < least), "code").select("key", "code", "times", "n")
    long_ones = several.select("key", "code", "times").join(counts, "code").select("key", "code", "times", "n")
    from_tops = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in tops], pa.int64()), "best": pa.array([n for _, n in tops], pa.int64())}))
    found = rare.unionByName(long_ones).withColumn("a", F.expr(f"code div {n_b}")).join(F.broadcast(from_tops), "a")
    found = found.groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    one = looked.withColumnsRenamed({"n_best": "known_best", "count_sum": "known_sum"}).join(found, "key", "left")
    one = one.withColumns({c: F.col(k) + F.coalesce(c, F.lit(0)) for c, k in (("n_best", "known_best"), ("count_sum", "known_sum"))})
    return one.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")

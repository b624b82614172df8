"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a public model's. For a BPE model the best path is the one that its merges take: a
sequence of pieces is that of the merges exactly if every two neighbours, merged on their own, stay as they
are. So each boundary has one state, the last piece of the best path that ends there, found among the pieces
that end there by looking at the states a piece's length back. From eight times the longest piece's length
on, the window is cut whenever all paths that survive in it run through one boundary: the ids before it
are committed and the window moves on. Two paths that never met would keep it growing; none is known. No piece goes across the start of a word, so there the paths
always meet, and what was committed for a word is remembered (``REMEMBERED`` words on each worker).

Characters that the vocabulary lacks become bytes. Ids are those of the model's own encoder; decoding gives
the text back, but for U+2581, which is a space to the model: a text that holds it decodes to spaces and its round trip is false.
Defined results: a null or empty text has no ids and decodes to an empty text; each
input row gives one row, repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 1_200_000
#: Of a string: it only begins pieces; it is a piece; it is one that its own merges end in, or that they never do.
BEGINS, PIECE, STANDS, NEVER = 0, 1, 2, 3
#: Of a string behind a state: it is not the next piece; it is; it is, and none longer can be; neither.
SKIP, FITS, LAST, STOP = 0, 1, 2, 3
#: What models write for a space; here pieces hold spaces, which keeps most strings at a byte a character.
SPACE = "▁"
WORD = re.compile(" *[^ ]+| +")


class Codec:
    """The pieces of a BPE model with byte pieces and no normalisation."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.remembered = remembered
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        for i in plain:
            pieces[i] = pieces[i].replace(SPACE, " ")
        self.ids = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes) != 256 or any(re.search("[^ ] ", p) for p in self.ids):
            raise ValueError(f"{path} is no BPE model with byte pieces whose pieces keep to words")
        self.longest = max(map(len, self.ids))
        self.text = [""] * size
        for i in plain:
            self.text[i] = pieces[i]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for b in range(128):  # such a byte is a character of its own
            self.text[self.bytes[b]] = chr(b)
        self.rows: dict[str, dict[str, int]] = {}
        self.judged = 0
        self.made: dict[str, tuple[float, str, str]] = {}
        self.kind = {p[:k]: BEGINS for p in self.ids for k in range(1, len(p))} | dict.fromkeys(self.ids, PIECE)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The merges of a short string, best rank first and leftmost of equal ones, down to ``stop`` parts."""
        parts = list(text)
        while len(parts) > stop:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def halves(self, piece: str) -> tuple[float, str, str]:
        """When the last merge of a piece was made (its rank; -1 for a single character), and its two parts."""
        found = self.made.get(piece)
        if found is None:
            parts = self.merged(piece, 2) if len(piece) > 1 else [piece, piece]
            found = self.made[piece] = (self.rank[piece] if len(piece) > 1 else -1.0, parts[0], parts[1])
        return found

    def follows(self, before: str, piece: str) -> bool:
        """Whether the two stay as they are when merged together; a character outside the vocabulary parts its neighbours.

        Going back in time, the later of the two merges is undone again and again. The pieces that then meet
        at the boundary must not have been free to merge before it was made; of equal ranks the left one comes first.
        """
        if before not in self.ids or piece not in self.ids:
            return True
        left, right, until = before, piece, math.inf
        while True:
            met = self.rank.get(left + right)
            if met is not None and met < until:
                return False
            rank_l, _, inner_l = self.halves(left)
            rank_r, inner_r, _ = self.halves(right)
            if rank_l < 0 and rank_r < 0:
                return True
            if rank_l > rank_r:
                left, until = inner_l, rank_l
            else:
                right, until = inner_r, math.nextafter(rank_r, math.inf)

    def judge(self, state: str, piece: str, row: dict[str, int]) -> int:
        """What a string can do behind a state, also put into the row of the state."""
        kind = self.kind.get(piece)
        if kind is None:  # begins no piece
            found = LAST if len(piece) == 1 else STOP
        elif kind == BEGINS:
            found = FITS if len(piece) == 1 else SKIP
        else:
            if kind == PIECE:
                kind = self.kind[piece] = STANDS if self.merged(piece) == [piece] else NEVER
            found = FITS if kind == STANDS and (not state or self.follows(state, piece)) else SKIP
        self.judged += 1
        if self.judged > self.remembered:
            self.rows.clear()
            self.judged = 0
        row[piece] = found
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """The best path through a text of any length, committed piece by piece."""
        rows, longest, judge = self.rows, self.longest, self.judge
        n = len(text)
        # The last piece of the path that ends at each boundary of the window; at its start what was committed last.
        last: list[str | None] = ["", *[None] * min(n, longest)]
        base = 0
        for start in range(n):
            at = start - base
            state = last[at]
            if state is None:
                continue
            row = rows.get(state)
            if row is None:
                row = rows[state] = {}
            for stop in range(start + 1, min(n, start + longest) + 1):
                piece = text[start:stop]
                found = row.get(piece)
                if found is None:
                    found = judge(state, piece, row)
                if found == SKIP:
                    continue
                if found != STOP and last[stop - base] is None:
                    last[stop - base] = piece
                if found >= LAST:
                    break
            if n > len(last) + base - 1:
                last.append(None)
                if at >= 8 * longest:
                    done = self.meeting(last, at + 1)
                    if done:
                        yield from self.path(last, done)
                        base += done
                        last = last[done:]
        yield from self.path(last, n - base)

    def path(self, last: list[str], to: int) -> list[str]:
        out = []
        while to:
            out.append(last[to])
            to -= len(last[to])
        return out[::-1]

    def meeting(self, last: list[str | None], to: int) -> int:
        """The last boundary that the paths to ``to`` and to all behind it run through."""
        live = {k for k in range(to, len(last)) if last[k] is not None}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(k - len(last[k]))
        return live.pop() if live else 0

    def word(self, text: str) -> bytes:
        """Ids of a word (without the space in front of it), four bytes each."""
        found = self.old.get(text)
        if found is None:
            found = self.segment(" " + text)
        if len(text) <= 64:
            if len(self.new) >= self.remembered // 2:
                self.old, self.new = self.new, {}
            self.new[text] = found
        return found

    def segment(self, text: str) -> bytes:
        ids = array("i")
        for p in self.pieces(text):
            i = self.ids.get(p)
            if i is None:
                ids.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return ids.tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each, cut where a word begins: before a space that follows anything else."""
        if not text:
            return b""
        known = self.new.get
        if SPACE in text:  # the same to the model as a space
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([known(w[1:]) or self.word(w[1:]) if w[1:2] not in ("", " ") else self.segment(w) for w in WORD.findall(" " + text)])
        return b"".join([known(w) or self.word(w) for w in text.split(" ")])

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        table = self.text
        out = [table[i] for i in ids]
        if "" in out:  # bytes of longer characters, or control ids
            held = bytearray()
            for k, (i, p) in enumerate(zip(ids, out, strict=True)):
                if not p and i in self.byte_of:
                    held.append(self.byte_of[i])
                if held and (k + 1 == len(ids) or out[k + 1]):
                    out[k] = held.decode("utf-8", "replace")
                    held.clear()
        text = "".join(out)
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(path, remembered)


def encoded(path: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    c = codec(path)
    return pa.record_batch([batch.column("doc_id"), pa.array([c.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id and ids of each row's whole text; ``model`` is a file that every executor can open."""
    return map_slices(keyed_text(docs, id_col, text_col), partial(encoded, model), f"doc_id {id_type(docs, id_col)}, ids array<int>")


def decoded(path: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    c = codec(path)
    return pa.record_batch([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and the text of each row's ids; null ids give an empty text."""
    source = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                yield decoded(model, batch.slice(k, 500))

    return source.mapInArrow(run, f"doc_id {id_type(rows, id_col)}, text string")


def summed(path: str, remembered: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    c = codec(path, remembered)
    n, digests, same = [], [], []
    for text in batch.column("text").to_pylist():
        ids = c.packed(text)
        n.append(len(ids) // 4)
        digests.append(hashlib.sha256(ids).hexdigest())
        same.append(c.decode(array("i", ids)) == text)
    return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests), pa.array(same)], names=["doc_id", "n_ids", "ids_sha256", "round_trip"])


def digest(docs: DataFrame, model: str = MODEL, remembered: int = REMEMBERED) -> DataFrame:
    """Of each row: its number of ids, the SHA-256 of the ids (four bytes each, the lowest first) and whether they decode to the text. Fewer ``remembered`` words take less memory and more time."""
    return map_slices(keyed_text(docs, "doc_id", "text"), partial(summed, model, remembered), f"doc_id {id_type(docs, 'doc_id')}, n_ids long, ids_sha256 string, round_trip boolean")

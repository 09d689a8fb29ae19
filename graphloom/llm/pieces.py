"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character, so merges never
cross the start of a run of markers. A text is therefore the sequence of its chunks (a run of
markers and what follows up to the next run); each distinct chunk is segmented once, and the
ids of a text are those of its chunks in order. The table belongs to a Python worker: it needs
no shuffle and has a fixed bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship

MARK = "▁"
#: Chunks, and characters of them and their ids, that a worker remembers in each of two generations.
TABLE, HELD = 240_000, 10_000_000
#: Characters of texts whose chunks are looked up together.
GROUP = 2_000_000
_RUNS = re.compile(" +[^ ]*")


class Chunks(dict):
    """chunk (starting with a space) -> its ids in decimal, joined by spaces.

    What is not at hand is segmented in one call for many texts. A full table becomes the old
    generation, from which chunks that come up again are taken over.
    """

    def __init__(self, model: str, table: int = TABLE):
        import sentencepiece

        self.table, self.most = table, HELD * table // TABLE

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        if any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(n)):
            raise ValueError("pieces of this model cross whitespace markers")
        self.end, self.mark = self.sp.eos_id(), self.sp.piece_to_id(MARK)
        self.guard = self.sp.piece_to_id(MARK + "a")
        # what a piece stands for; a marker, which no chunk has behind its spaces, for those that stand for no text of their own
        plain = lambda i: not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))
        self.pieces = [self.sp.id_to_piece(i).replace(MARK, " ") if plain(i) else MARK for i in range(n)]
        self.number = [*map(str, range(n))]
        self.old: dict[str, str] = {}
        #: Chunks that decode to something else, and what.
        self.odd: dict[str, str] = {}
        self.old_odd: dict[str, str] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " ":
            return _RUNS.findall(text)
        return [" " + x for x in text[1:].split(" ")]

    def learn(self, chunks: set[str]) -> None:
        if len(self) >= self.table or self.held >= self.most:
            self.old, self.old_odd, self.odd, self.held = dict(self), self.odd, {}, 0
            self.clear()
        new = []
        for c in chunks:
            if c in self:
                continue
            if c in self.old:
                self[c] = self.old[c]
                self.held += len(c) + len(self.old[c])
                if c in self.old_odd:
                    self.odd[c] = self.old_odd[c]
            else:
                new.append(c)
        # the library puts the marker of the first space back, but not for an empty text
        ids = self.sp.encode([c[1:] for c in new], num_threads=1) if new else []
        ids = [i if len(c) > 1 else [self.mark] for c, i in zip(new, ids, strict=True)]
        unlike = []
        for c, i in zip(new, ids, strict=True):
            self[c] = out = " ".join(map(self.number.__getitem__, i))
            self.held += len(c) + len(out)
            if "".join(map(self.pieces.__getitem__, i)) != c:
                unlike.append((c, i))
        # behind a guard, decode() keeps the leading marker as a space
        surfaces = self.sp.decode([[self.guard, *i] for _, i in unlike], num_threads=1) if unlike else []
        self.odd |= {c: s[1:] for (c, _), s in zip(unlike, surfaces, strict=True) if s[1:] != c}

    def ids(self, chunks: list[str]) -> str:
        """Ids in decimal joined by spaces, with the end id, of chunks that were learnt."""
        return " ".join([*map(self.__getitem__, chunks), str(self.end)])

    def encode(self, text: str) -> tuple[str, list[str]]:
        """The ids of one text, and the chunks they came from."""
        self.learn(set(chunks := self.split(text)))
        return self.ids(chunks), chunks

    def decode(self, chunks: list[str]) -> str:
        """What decode() gives for the ids of ``chunks``: their surfaces less the dummy prefix."""
        if self.odd and not self.odd.keys().isdisjoint(chunks):
            chunks = [self.odd.get(c, c) for c in chunks]
        return "".join(chunks)[1:]


_tables: dict[str, Chunks] = {}


def _groups(texts: pa.Array, group: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size > group:
            yield part
            part, size = [], 0
    if part:
        yield part


def _run(model: str, full: bool, size: int):
    group = GROUP * size // TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _tables or _tables[model].table != size:
            _tables.clear()
            _tables[model] = Chunks(model, size)
        table = _tables[model]
        for b in batches:
            at = 0
            for texts in _groups(b.column("text"), group):
                split = [table.split(t) for t in texts]
                table.learn(set().union(*split))
                n, x, y = [], [], []
                for chunks in split:
                    ids, text = table.ids(chunks), table.decode(chunks)
                    n.append(ids.count(" ") + 1)
                    x.append([*map(int, ids.split(" "))] if full else hashlib.sha256(ids.encode()).hexdigest())
                    y.append(text if full else hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + len(n)], pa.array(n, pa.int64()), pa.array(x, pa.list_(pa.int32()) if full else pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "a", "b"])
                at += len(n)

    return run


def piece_codec(docs: DataFrame, model: str, digests: bool = False, table: int = TABLE) -> DataFrame:
    """Encode and decode the whole text of each row of ``docs`` (doc_id, text; others are not read).

    model: path of a SentencePiece model on every node; table: chunks that a worker remembers, which changes time
    and memory but no result. Gives doc_id, n_tokens, and ids (the
    end id last) with the decoded text, or with ``digests`` the SHA-256 of each. A null or
    empty text has only the end id and decodes to nothing. Rows are independent: repeated and
    null ids stay as they are, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "a string, b string" if digests else "a array<int>, b string"
    out = rows.mapInArrow(_run(model, not digests, table), f"doc_id long, n_tokens long, {kinds}")
    names = {"a": "ids_sha256", "b": "decoded_sha256"} if digests else {"a": "ids", "b": "decoded"}
    return out.withColumnsRenamed(names)

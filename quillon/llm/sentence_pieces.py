"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: A chunk: the marks (as spaces) before a word, and the word. No piece of a fit model crosses from a word to a mark.
CHUNK = re.compile(" *[^ ]+| +")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct chunks, and characters in them, that a Python worker holds before it starts a new table, and the characters of the
#: longest chunk that it keeps at all (longer ones are segmented where they stand).
HELD_CHUNKS, HELD_CHARACTERS, LONGEST_KEPT = 400_000, 8_000_000, 1_000


def load(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_model(model) -> None:
    """That texts can be cut where a word ends: no piece holds a mark behind a word, and the text is taken as it is."""
    if any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("a piece crosses a whitespace marker: texts can't be cut at words")
    if model.normalize("ﬁ  Ａ") != f"{MARK}ﬁ{MARK}{MARK}Ａ":
        raise ValueError("the model changes characters or spaces: texts can't be cut before that")


class ChunkTable(dict):
    """The distinct chunks seen so far: chunk to the bytes of its ids (little-endian unsigned 32 bits).

    The model puts a mark before a text, so a chunk is handed over without its first space. changed has the decoded text
    of the chunks that decode to something else than they are.
    """

    def __init__(self, model):
        self.model, self.changed, self.held, self.long = model, {}, 0, []
        self.ends = [i.to_bytes(4, "little") for i in (model.bos_id(), model.eos_id())]
        self.pieces = [self._alone(i) for i in range(model.get_piece_size())]
        # The model drops the first mark when it decodes, and gives no mark to an empty text: a word in front keeps both.
        self.lead = model.encode("a")
        self.lead_text = model.decode(self.lead)

    def _alone(self, i: int) -> str | None:
        """The text of an id whatever stands beside it; None if there is none."""
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return chr(int(piece[3:5], 16)) if int(piece[3:5], 16) < 128 else None
        return None if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(MARK, " ")

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that the table doesn't have, each once."""
        new = [c for c in chunks if c not in self]
        more = sum(map(len, new))
        if len(self) + len(new) > HELD_CHUNKS or self.held + more > HELD_CHARACTERS:
            self.clear()
            self.changed.clear()
            new, self.held = list(chunks), 0
            more = sum(map(len, new))
        self.held += more
        self.long = [c for c in new if len(c) > LONGEST_KEPT]  # they go when the texts at hand are done
        for c, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True):
            if c.isspace():
                ids = self.model.encode("a" + c)[len(self.lead) :]
            self[c] = array("I", ids).tobytes()
            try:
                decoded = "".join(map(self.pieces.__getitem__, ids))
            except TypeError:  # bytes make characters together
                decoded = self.model.decode([*self.lead, *ids])[len(self.lead_text) :]
            if decoded != c:
                self.changed[c] = decoded

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text the ids with begin and end ids, as bytes, and what decode(ids) gives."""
        in_chunks = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.learn(set().union(*in_chunks))
        out = []
        for chunks in in_chunks:
            ids = b"".join([self.ends[0], *map(self.__getitem__, chunks), self.ends[1]])
            out.append((ids, "".join([self.changed.get(c, c) for c in chunks] if self.changed else chunks)[1:]))
        for c in self.long:
            del self[c]
            self.changed.pop(c, None)
            self.held -= len(c)
        return out


def groups(texts: list[str], most: int = 1_000_000):
    """The texts in runs of at most so many characters, or of one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_tables: dict[str, ChunkTable] = {}


def _table(model_file: str) -> ChunkTable:
    if model_file not in _tables:  # a Python worker runs many tasks
        model = load(model_file)
        check_model(model)
        _tables[model_file] = ChunkTable(model)
    return _tables[model_file]


def _encoded(chunks: ChunkTable, batch: pa.RecordBatch):
    """ids (as bytes) and decoded text of each row."""
    return (x for run in groups([t or "" for t in batch["text"].to_pylist()]) for x in chunks.encode_decode(run))


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (with begin and end ids), decoded of every row's whole text, as encode_and_decode describes them."""

    def run(batches):
        chunks = _table(model_file)
        for batch in batches:
            for i, (ids, decoded) in enumerate(_encoded(chunks, batch)):
                ids = pa.array([array("I", ids).tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), ids, pa.array([decoded], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(model_file: str):
    def run(batches):
        chunks = _table(model_file)
        for batch in batches:
            rows = []
            for ids, decoded in _encoded(chunks, batch):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_and_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text, with begin and end ids.

    A missing text is empty: two ids. Repeated rows give repeated rows; an empty table gives none; other columns are
    ignored. Each Python worker keeps a table of the distinct chunks that it has met and segments every one of them once; it
    starts a new table at HELD_CHUNKS chunks or HELD_CHARACTERS characters in them, and doesn't keep chunks of more than
    LONGEST_KEPT characters, so its memory doesn't grow with the input. No row moves: there is no shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(model_file), SCHEMA)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""SentencePiece encoding and decoding with an Aho-Corasick automaton (operator 10).

The automaton holds all pieces of a model.  It runs once over a text; at each place its output links give the pieces that end
there, longest first, and these relax that place's best entry: the last piece of the best segmentation so far.

What "best" means is the model's kind.  Unigram models have the largest sum of scores, the usual Viterbi rule.  Merge (BPE) models
have the segmentation that merging by score leads to, which no sum of scores describes; its rule is that a piece may follow the
best segmentation of what is before it exactly if merging the two last pieces' texts by themselves ends in these two pieces.
One piece at each place passes, so the single pass and its table of best entries stay the same.  The rule's answers for pairs
of pieces are kept.  Either way the result equals the library's.

Pieces don't reach across certain places (between characters that are neighbours in no piece), so a worker runs the automaton
once for each distinct stretch between them and copies the ids from there on (``docmill.llm.wordcache``).

Defined cases: null and empty texts have no pieces; characters without a piece become their UTF-8 bytes' pieces, or the
unknown piece in a model without byte pieces; a model that changes texts first (``normalizer_spec``) is refused; a literal U+2581
decodes as a space, as in the library (``round_trip`` is false for its text); rows with equal ids are encoded each by itself;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.storage import tidy
from docmill.llm.textkernel import text_chunks
from docmill.llm.wordcache import WordCache

SPACE = "▁"
#: A worker forgets its stretches, or its answers for pairs of pieces, when it has so many.
PIECES, FOLLOWS = 250_000, 150_000
_codecs: dict[int, Codec] = {}


class Codec:
    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        self.merging = model.trainer_spec.model_type == 2
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model changes texts before it parts them (normalizer_spec), which this codec does not")
        own = SentencePieceProcessor(model_proto=raw)
        n, self.unknown = own.get_piece_size(), own.unk_id()
        self.score, self.id = {}, {}
        self.byte_id = {}
        self.bytes_of: list[bytes] = []
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.id[piece], self.score[piece] = i, own.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if not self.merging or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.follows: dict[tuple[str, str], bool] = {}
        # neighbours in some piece; between others a stretch may end (looked at for one-byte characters and spaces)
        pairs = {pair for piece in self.id for pair in zip(piece, piece[1:])}
        shown = [SPACE if i == 32 else chr(i) for i in range(128)]
        self.parted = np.zeros((256, 256), bool)
        self.parted[:128, :128] = [[(a, b) not in pairs for b in shown] for a in shown]
        self.parted[128:, 32] = not any(b == SPACE and ord(a) > 127 and a != SPACE for a, b in pairs)
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        size = np.array([len(b) for b in self.bytes_of])
        self.byte_size, self.byte_start = size, np.cumsum(size) - size
        self.byte_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cache = WordCache(lambda pieces: [self.ids_of(self.segment(p.decode().replace(" ", SPACE))) for p in pieces], PIECES)

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for short texts: join the neighbours with the best piece, the first of equals, while there are any."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def forget(self) -> None:
        """Ends what a task has gathered; the model stays."""
        self.cache.clear()
        self.follows.clear()

    def may_follow(self, left: str, right: str) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > FOLLOWS:
                self.follows.clear()
            known = self.follows[left, right] = self.merged(left + right) == [left, right]
        return known

    def segment(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are written as U+2581."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        ending: list[list[str]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(text):
            ending[end + 1].append(piece)
        if self.merging:
            for end in range(1, n + 1):
                for piece in ending[end]:
                    before = end - len(piece)
                    if not before or self.may_follow(last[before], piece):
                        last[end] = piece
                        break
                else:
                    last[end] = text[end - 1]  # no piece ends here: an unknown character
        else:
            best = [0.0] + [-np.inf] * n
            for end in range(1, n + 1):
                for piece in ending[end]:
                    total = best[end - len(piece)] + self.score[piece]
                    if total > best[end]:
                        best[end], last[end] = total, piece
                if text[end - 1] not in self.id and best[end - 1] + self.unknown_score > best[end]:
                    best[end], last[end] = best[end - 1] + self.unknown_score, text[end - 1]
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            i = self.id.get(piece)
            if i is None:
                out += [self.byte_id.get(b, self.unknown) for b in piece.encode()] if self.byte_id else [self.unknown]
            else:
                out.append(i)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, their offsets) of UTF-8 texts; a space is put before each text that isn't empty."""
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        edge = np.zeros(n, bool)
        edge[1:] = self.parted[data[:-1], data[1:]]
        # the literal space mark (bytes E2 96 81) may join what a space would part: such rows are one stretch
        marked = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        for row in np.unique(np.searchsorted(offsets, marked, side="right") - 1).tolist():
            edge[offsets[row] : offsets[row + 1]] = False
        edge[offsets[:-1][some]] = True
        starts = np.flatnonzero(edge)
        return self.cache.ids(data, starts, np.append(starts[1:], n), np.searchsorted(starts, offsets))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all rows, their offsets) of rows of ids, without the space before each text."""
        size = self.byte_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(ends[-1])) + np.repeat(self.byte_start[ids] - ends[:-1], size)
        data, rows = self.byte_data[at], ends[offsets]
        some = np.diff(rows) > 0
        return np.delete(data, rows[:-1][some]), rows - np.concatenate([[0], np.cumsum(some)])


def codec(raw: bytes) -> Codec:
    """This worker's codec of a model (a file's content)."""
    key = hash(raw)
    if key not in _codecs:
        _codecs[key] = Codec(raw)
    return _codecs[key]


def _content(rows: DataFrame, model_file: str):
    """A model file on the driver, for the tasks."""
    with open(model_file, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, pieces (ids), n_pieces, the SHA-256 of their decoded text, and round_trip (that text is the row's)."""
    model = _content(docs, model_file)

    def run(batches):
        own = codec(model.value)
        for batch, data, offsets in text_chunks(batches):
            ids, at = own.encode(data, offsets)
            back, rows = own.decode(ids, at)
            raw, same = back.tobytes(), data.tobytes()
            pieces = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            texts = [raw[a:b] for a, b in zip(rows[:-1], rows[1:])]
            trip = [t == same[a:b] for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pieces, pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(trip, pa.bool_())],
                names=["doc_id", "pieces", "n_pieces", "decoded_sha256", "round_trip"],
            )
        own.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, pieces array<int>, n_pieces long, decoded_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """For each row of ids: doc_id and its text."""
    model = _content(rows, model_file)

    def run(batches):
        own = codec(model.value)
        for batch in batches:
            column = batch.column("pieces")
            sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = own.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())], names=["doc_id", "text"])

    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).cast("array<int>").alias("pieces"))
    return own.mapInArrow(run, "doc_id long, text string")

"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words: a run of the space mark and the characters up to the next mark (no piece
goes over such a border). The distinct words of a batch are sorted, which lays a trie out depth-first, and
walked in that order: the forward states of a prefix are kept on a stack and reused by all words under it.

A model of unigram kind keeps the best sum of scores as its forward state. A model of merge (BPE) kind has
ranks in place of log-probabilities, and the best sum of ranks is not its segmentation. There the forward
state of a prefix is the last piece of the prefix's own encoding: a piece may follow another only if merging
the two together leaves them as they are, and exactly one piece fits at each prefix. So the walk gives the
pieces that the model's own merges give, character for character.

Characters outside the vocabulary become byte pieces; decoding is the exact inverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers from batch to batch, of at most so many characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 32
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 1_000_000


class PieceModel:
    def __init__(self, path: str = MODEL, kind: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.longest = max(map(len, self.ids))
        whole = all(self.scores[i] == int(self.scores[i]) for i in plain)
        self.kind = kind or ("bpe" if whole else "unigram")
        self.floor = min(self.scores) - 10
        self.pairs: dict[int, bool] = {}
        # states of the piece automaton: the beginnings of pieces; fits[s]: pieces that end state s, longest first
        self.heads = sorted({p[:i] for p in self.ids for i in range(len(p) + 1)})
        self.state = {h: i for i, h in enumerate(self.heads)}
        self.step: dict[int, int] = {}
        singles = {k for k in plain if self.kind != "bpe" or len(self.merged(self.names[k])) == 1}
        self.fits = [[(self.ids[h[i:]], len(h) - i, self.ids[h[i:]] in singles) for i in range(len(h)) if h[i:] in self.ids] for h in self.heads]
        self.decoded = [b""] * n
        for i in plain:
            self.decoded[i] = self.names[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.decoded[i] = bytes([b])

    def merged(self, word: str) -> list[str]:
        """The model's merges, one by one: best score first, leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand right after piece a: merging their joint text ends in just these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[a * len(self.names) + b] = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return got

    def next_state(self, s: int, c: str) -> int:
        """The state after one more character: the longest ending that begins a piece."""
        h = self.heads[s] + c
        while h not in self.state:
            h = h[1:]
        self.step[s << 21 | ord(c)] = self.state[h]
        return self.state[h]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """words: distinct. One depth-first walk over their trie; a stack holds the forward state of each prefix.

        State of a prefix: automaton state, last piece (-1: a character outside the vocabulary), its length, score.
        """
        out, pairs, many, bpe, scores = {}, self.pairs, len(self.names), self.kind == "bpe", self.scores
        states, last, size, score, before = [0], [-1], [0], [0.0], ""
        for w in sorted(words):
            keep, most = 0, min(len(w), len(before))
            while keep < most and w[keep] == before[keep]:
                keep += 1
            del states[keep + 1 :], last[keep + 1 :], size[keep + 1 :], score[keep + 1 :]
            s = states[keep]
            for i in range(keep + 1, len(w) + 1):
                c = w[i - 1]
                t = self.step.get(s << 21 | ord(c))
                s = self.next_state(s, c) if t is None else t
                piece, length, best = -1, 1, None
                if bpe:
                    for k, n, alone in self.fits[s]:
                        a = last[i - n]
                        ok = alone if a < 0 else pairs.get(a * many + k)
                        if self.follows(a, k) if ok is None else ok:
                            piece, length = k, n
                            break
                else:
                    for k, n, _ in self.fits[s]:
                        if best is None or score[i - n] + scores[k] > best:
                            best, piece, length = score[i - n] + scores[k], k, n
                    score.append(score[i - 1] + self.floor if best is None else best)
                states.append(s)
                last.append(piece)
                size.append(length)
            before = w
            got, i = [], len(w)
            while i:
                if last[i] >= 0:
                    got.append(last[i])
                elif self.byte:
                    got += [self.byte[b] for b in reversed(w[i - 1].encode())]
                else:
                    got.append(self.unk)
                i -= size[i]
            out[w] = got[::-1]
        return out

    def words(self, text: str) -> list[str]:
        """Marked words, which joined give the marked text. The empty text has none."""
        if not text:
            return []
        plain = text.replace(" ", MARK)
        parts = (MARK + plain).split(MARK)[1:]  # each follows one mark
        if "" not in parts:
            return [MARK + p for p in parts]
        out, run = [], ""
        for p in parts:
            run += MARK
            if p:
                out.append(run + p)
                run = ""
        return [*out, run] if run else out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the mark that encoding puts before a text goes."""
        data = b"".join(map(self.decoded.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_LOADED: dict[tuple, tuple[PieceModel, dict[str, bytes]]] = {}


def loaded(path: str, kind: str | None) -> tuple[PieceModel, dict[str, bytes]]:
    """The model and the words it has met, kept for the life of a worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = PieceModel(path, kind), {}
    return _LOADED[path, kind]


def encode_batch(texts: list[str | None], path: str, kind: str | None) -> tuple[PieceModel, list[np.ndarray]]:
    """The piece ids of each text. Words that no earlier batch had are encoded in one walk."""
    model, known = loaded(path, kind)
    split = [model.words(t or "") for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = set().union(*split).difference(known)
    fresh = {w: np.array(v, np.int32).tobytes() for w, v in model.encode_words(list(new)).items()}
    known.update((w, v) for w, v in fresh.items() if len(w) <= REMEMBERED_CHARS)
    get = lambda w: known.get(w) or fresh[w]
    out = [np.frombuffer(b"".join(map(get, s)), np.int32) for s in split]
    return model, out


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, kind: str | None = None, with_pieces: bool = True) -> DataFrame:
    """Per row: doc_id, n_chars, n_pieces, ids_sha256 (ids as little-endian 32-bit), decoded_sha256, round_trip, pieces.

    ``model`` is a file every executor can read. A null text counts as empty; the empty text has no pieces.
    Whole texts are encoded; repeated rows are answered one by one.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", pieces array<int>" * with_pieces
    names = ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            m, ids = encode_batch(texts, model, kind)
            back = [m.decode(x.tolist()) for x in ids]
            digest = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            cols = [
                b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(digest, pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()), pa.array([x == y for x, y in zip(back, texts)], pa.bool_()),
            ]
            if with_pieces:
                ends = np.cumsum([0, *map(len, ids)])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())))
            yield pa.record_batch(cols, names=names[: len(cols)])

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, schema)

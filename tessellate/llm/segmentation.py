"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut before each run of spaces; spaces become U+2581 marks, one more leads the text. The distinct marked words of a
step of texts, sorted, are the paths of a trie: walking them in order is a depth-first traversal, and the forward states
(one for each character) of what a word shares with the one before are kept, so each trie node is settled once. Words
already encoded by the same task are looked up.

Unigram models: a state is the best sum of piece scores up to there (Viterbi). Models made by merges: sums of scores can't
give their segmentation, so a state is the last piece of the encoding of the prefix. It is the one piece that ends there
and agrees with the last piece of what is before it: two pieces agree if merging their joined text gives just them, and a
sequence whose neighbours all agree is the encoding. An Aho-Corasick automaton names the pieces that end at a place. Ids equal
those of the sentencepiece library for both kinds.

Characters without a piece fall back to their UTF-8 bytes; U+2581 in a text is encoded so, so every text comes back exactly
(the library would turn it into a space). Null texts are encoded like empty ones, to no ids. Repeated rows get equal ids. An
empty table gives no rows; other columns are not read; a text of any length is a step of its own.
Memory: for each task up to 2 * CACHE words and 2 * PAIRS pairs of pieces, besides those of a step. A cache is two dictionaries:
when the younger is full it becomes the elder, whose entries move on as they are used and else go.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE, PAIRS = 100_000, 200_000


#: Stands for a U+2581 that the text itself holds; no valid text has it.
LITERAL = "\udc00"
PARTS = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> list[str]:
    return PARTS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []


def model_kind(model: bytes) -> int:
    """1: unigram, 2: made by merges. Field 3 of the trainer's settings, which are field 2 of the model."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                if b < 128:
                    return out
                shift += 7

        while at < len(data):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
                continue
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size

    settings = next((v for k, v in fields(model) if k == 2), b"")
    return next((v for k, v in fields(settings) if k == 3), 1)


class Pieces:
    """Pieces and scores of a SentencePiece model, from its bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.score = {p: (sp.get_score(i), i) for i, p in enumerate(names) if not special[i]}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.lost = min(s for s, _ in self.score.values()) - 10
        self.value = {p: score for p, (score, _) in self.score.items()}
        self.by_merges = model_kind(model) == 2
        self.names = names
        self.length = [len(x) for x in names]
        self.single = {p: i for p, (_, i) in self.score.items() if len(p) == 1}
        self.agreed: dict[int, bool] = {}
        self.elder: dict[int, bool] = {}
        if self.by_merges:
            import ahocorasick

            self.ends = ahocorasick.Automaton()
            for p, (_, i) in self.score.items():
                self.ends.add_word(p, (i, len(p)))
            self.ends.make_automaton()
        else:
            self.tails = {p[i:]: False for p in self.score for i in range(len(p))} | dict.fromkeys(self.score, True)
        self.reached: dict[str, bool] = {}
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    def encode(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of marked words given in sorted order."""
        return self._by_last_pieces(words) if self.by_merges else self._by_best_scores(words)

    def _by_best_scores(self, words: Iterable[str]) -> Iterator[list[int]]:
        best: list[float] = [0.0]
        pieces: list[str] = [""]  # for each depth the last piece
        last = ""
        for word in words:
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del best[k + 1 :], pieces[k + 1 :]
            self._best_pieces(word, k + 1, best, pieces)
            last = word
            ids: list[int] = []
            end = len(word)
            while end:
                piece = pieces[end]
                found = self.score.get(piece)
                ids.extend([found[1]] if found else self._bytes_of(piece))
                end -= len(piece)
            ids.reverse()
            yield ids

    def _bytes_of(self, char: str) -> list[int]:
        """Ids of a character without a piece, last byte first."""
        return [self.byte[b] for b in reversed((MARK if char == LITERAL else char).encode("utf-8"))]

    def _best_pieces(self, word: str, first: int, best: list[float], pieces: list[str]) -> None:
        for end in range(first, len(word) + 1):
            top, how = -1e300, ""
            for start in range(end - 1, -1, -1):
                part = word[start:end]
                whole = self.tails.get(part)
                if whole is None:
                    break
                if whole and best[start] + self.score[part][0] > top:
                    top, how = best[start] + self.score[part][0], part
            if word[end - 1] not in self.score and best[end - 1] + self.lost > top:
                top, how = best[end - 1] + self.lost, word[end - 1]
            best.append(top)
            pieces.append(how)

    def _by_last_pieces(self, words: Iterable[str]) -> Iterator[list[int]]:
        n = len(self.names)  # from n on: characters without a piece, and at last the start
        start = n + 0x110000
        pieces = [start]  # for each depth the last piece
        last = ""
        agreed, single, length = self.agreed, self.single.get, self.length
        for word in words:
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del pieces[k + 1 :]
            last = word
            depth = k  # how far all is settled
            for at, (piece, size) in self.ends.iter(word):  # longer pieces first where several end
                if at < depth:
                    continue
                while depth < at:  # no piece agrees there: the character alone
                    pieces.append(single(word[depth], n + ord(word[depth])))
                    depth += 1
                pair = pieces[at + 1 - size] * n + piece
                fine = agreed.get(pair)
                if fine is None:
                    fine = self._agree(pair, pieces[at + 1 - size], piece)
                    agreed = self.agreed
                if fine:  # no other piece can end here
                    pieces.append(piece)
                    depth += 1
            while depth < len(word):
                pieces.append(single(word[depth], n + ord(word[depth])))
                depth += 1
            ids: list[int] = []
            while depth:
                piece = pieces[depth]
                if piece < n:
                    ids.append(piece)
                    depth -= length[piece]
                else:
                    ids.extend(self._bytes_of(chr(piece - n)))
                    depth -= 1
            ids.reverse()
            yield ids

    def _agree(self, pair: int, left: int, right: int) -> bool:
        if len(self.agreed) >= PAIRS:
            self.elder, self.agreed = self.agreed, {}
        found = self.elder.get(pair)
        if found is None:
            n = len(self.names)
            first, second = "" if left == n + 0x110000 else self.names[left] if left < n else chr(left - n), self.names[right]
            both = first + second
            if first and both in self.score and self._whole(both):
                found = False
            else:
                found = self.merged(both) == [x for x in (first, second) if x]
        self.agreed[pair] = found
        return found

    def _whole(self, piece: str) -> bool:
        """Whether a piece's own text is encoded as that piece."""
        if piece not in self.reached:
            self.reached[piece] = self.merged(piece) == [piece]
        return self.reached[piece]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, the best score first, the leftmost of equals."""
        parts, none = list(text), -1e300
        value = self.value.get
        gains = [value(x + y, none) for x, y in zip(parts, parts[1:])]
        while gains and (most := max(gains)) > none:
            i = gains.index(most)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = value(parts[i] + parts[i + 1], none)
            if i:
                gains[i - 1] = value(parts[i - 1] + parts[i], none)
        return parts

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence of ids, without the space that the first mark stands for."""
        size = self.at[ids + 1] - self.at[ids]
        return self.bytes[base.concat_ranges(self.at[ids], size)].tobytes()[1:]


def encoded(docs: DataFrame, model: bytes, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words (marked words), n_tokens, ids_sha256 (of the ids as int32 of the machine, little-endian on all it runs on),
    decoded_sha256, exact (decoding gives the text back) and, if asked for, ids. No shuffle."""
    fields = "doc_id long, n_words long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        known: dict[str, bytes] = {}
        elder: dict[str, bytes] = {}
        for part in base.steps(batches):
            if len(known) >= CACHE:
                elder, known = known, {}
            texts = [t or "" for t in part.column(1).to_pylist()]
            words = [marked_words(t) for t in texts]
            asked = {w for x in words for w in x} - known.keys()
            known |= {w: elder[w] for w in asked & elder.keys()}
            fresh = sorted(asked - known.keys())
            for word, ids in zip(fresh, pieces.encode(fresh)):
                known[word] = array("i", ids).tobytes()
            packed = [b"".join([known[w] for w in x]) for x in words]
            whole = [pieces.decode(np.frombuffer(x, np.int32)) for x in packed]
            columns = [
                part.column(0),
                pa.array([len(x) for x in words], pa.int64()),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string()),
                pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(whole, texts)], pa.bool_()),
            ]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:  # a program's own file on the driver, not an input; executors get its bytes
        return file.read()


def op8_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(base.documents(spark, sf_dir), model_bytes(), with_ids=False)

"""Encoding and decoding with a SentencePiece model of merge type, without a merge queue.

A text's pieces are the only row of pieces in which every two neighbours are compatible: merging the characters of the two by
themselves gives just these two. So the encoder walks from left to right. An Aho-Corasick automaton over the vocabulary gives the
matches at every position; the longest one that fits its predecessor is taken, and where none does, the position is
marked in a bitfield, its piece is taken back and the next shorter match is tried. A prefix has one encoding only, so a marked position is never
entered again and the work stays linear. Compatibility is found by merging again, once per pair of neighbours.

Two characters that stand side by side in no piece of the vocabulary are never merged. Texts are cut there, and every distinct part is
encoded once per step of texts; parts are remembered up to a size in bytes. Characters outside the vocabulary become their bytes.

Nulls: a null text counts as empty; an empty text has the begin and end ids only. Null and repeated doc_ids pass through, rows are
independent of each other. Long texts are encoded whole, in pieces of memory that grow with the longest one. Strings of special
pieces are ordinary text. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import steps, text_or_empty

STEP_BYTES = 1 << 20
#: Bytes of parts, and number of pairs, that an encoder remembers at most.
REMEMBERED_BYTES = 8 << 20
REMEMBERED_PAIRS = 200_000
#: Fixed value: the character that stands for a space in vocabularies of this kind.
SPACE_MARK = "▁"


class Vocabulary:
    """The pieces of a model, with the library's own reading of the file; refuses models that work otherwise than this module."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        self.ids = {library.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {piece: library.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = library.bos_id(), library.eos_id()
        probe = " a  ﬁ　Å\t\n"
        if library.normalize(probe) != (SPACE_MARK + probe).replace(" ", SPACE_MARK) or not all(library.is_byte(i) for i in self.bytes):
            raise ValueError("only models that keep texts as they are, but for spaces, and fall back to bytes are supported")


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The pieces of a short text by merging: always the neighbours of highest score, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Backtracking:
    """Splits parts of texts into pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.scores = vocabulary.scores
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def fits(self, left: str, right: str) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= REMEMBERED_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = merged(left + right, self.scores) == [left, right]
        return known

    def _reachable(self, piece: str) -> bool:
        """Some pieces of a vocabulary are never made by merging."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = merged(piece, self.scores) == [piece]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text``; a character outside the vocabulary is a piece of its own."""
        n = len(text)
        lengths: list[list[int]] = [[1] for _ in range(n)]  # of the matches at each position, ascending
        for last, length in self.automaton.iter(text):
            if length > 1:
                lengths[last - length + 1].append(length)
        failed = bytearray(n // 8 + 1)
        found: list[str] = []
        left: list[int] = []  # the number of matches that are still untried at each piece's start
        at, untried = 0, len(lengths[0]) if n else 0
        while at < n:
            here, piece = lengths[at], None
            while untried:
                untried -= 1
                end = at + here[untried]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                candidate = text[at:end]
                if (len(candidate) == 1 or self._reachable(candidate)) and (not found or self.fits(found[-1], candidate)):
                    piece = candidate
                    break
            if piece is not None:
                found.append(piece)
                left.append(untried)
                at += len(piece)
                untried = len(lengths[at]) if at < n else 0
            else:  # no way on from here: take the last piece back
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(found.pop())
                untried = left.pop()
        return found


class Encoder:
    """Encodes columns of texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.search = Backtracking(self.vocabulary)
        pieces = [p for p in self.vocabulary.ids if len(p) > 1]
        chars = sorted({c for p in pieces for c in p})
        self.place = np.zeros(0x110000, np.uint16)  # 0: in no longer piece
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # stand side by side in a piece
        for p in pieces:
            at = self.place[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def part_ids(self, part: str) -> list[int]:
        ids, found = self.vocabulary.ids, []
        for piece in self.search.pieces(part):
            one = ids.get(piece)
            if one is not None:
                found.append(one)
            else:
                found.extend(self.vocabulary.bytes[b] for b in piece.encode())
        return found

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of parts in each text, and all parts in a row."""
        borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(data, np.uint8)[borders[0]:borders[-1]]
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters
        at = self.place[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(starts) + 1, bool)
        if len(at) > 1:
            cut[1:-1] = ~self.beside[at[:-1], at[1:]]
        cut[np.searchsorted(starts, borders - borders[0])] = True
        offsets = np.append(starts, len(raw))[cut]
        counts = np.diff(np.searchsorted(offsets, borders - borders[0]))
        parts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets + borders[0]), data)
        return counts, parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each between the begin and end ids, and the n + 1 borders."""
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        mark, none = pa.scalar(SPACE_MARK, pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", SPACE_MARK), none)
        marked = pc.if_else(pc.equal(texts, none), none, spaced)
        counts, parts = self._parts(marked)
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        missing = pc.is_null(at)
        new = coded.dictionary.filter(missing)
        new_ids = [self.part_ids(p) for p in new.to_pylist()]
        base = len(self.known)
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in new_ids], dtype=np.int64)])
        ids = np.concatenate([self.ids, np.fromiter((i for x in new_ids for i in x), np.uint32)])
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = base + np.arange(len(new))
        codes = place[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = ends[codes + 1] - ends[codes]
        within = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(ends[codes] - within[:-1], sizes) + np.arange(within[-1])]
        borders = within[np.concatenate([[0], np.cumsum(counts)])]
        out = np.insert(flat, np.repeat(borders, 2)[1:-1], np.tile([self.vocabulary.begin, self.vocabulary.end], len(texts)).astype(np.uint32))
        self.known, self.ids, self.ends = pa.concat_arrays([self.known, new]), ids, ends
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self._forget()
        return out, borders + 2 * np.arange(len(borders))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, with begin and end), and on request the
    text that the library decodes from them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        decode = encoder.vocabulary.library.decode
        for batch in steps(batches, "text", STEP_BYTES):
            ids, borders = encoder.encode(batch.column("text"))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(borders * 4), pa.py_buffer(ids.astype("<u4"))])
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(borders)), "ids": raw.cast(pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([decode(ids[a:b].tolist()) for a, b in zip(borders[:-1], borders[1:])], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_tokens BIGINT, ids BINARY" + (", decoded STRING" if decoded else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids, as :func:`encode` returns them; null ids count as none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in steps(batches, "ids", STEP_BYTES):
            texts = [library.decode(np.frombuffer(one or b"", "<u4").tolist()) for one in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text STRING")

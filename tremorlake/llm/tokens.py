"""Token ids of whole texts with a public tokenizer, each distinct piece of a batch encoded once.

No token of the two tokenizer files crosses these borders: in front of a space or line break that follows another character than
white space, and between a letter or digit and an ASCII sign other than the apostrophe. So a text's ids are the ids of its
pieces in a row. Texts with white space in front of a space are not cut at spaces. A letter that normalisation turns into a
letter and a mark has its mark join the sign: pieces with such letters are not cut at signs. Texts that hold the string of an added
token, which the library looks for first, are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode white space (and a little more) in front of a space or line break.
_NO_BORDER = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
              r"[ \n]")
_SIGN = r"([\pL\pN])([!-&(-/:-@\[-`{-~])"


def _ends_in_mark() -> str:
    """A pattern of the letters and digits whose normalised, lower-case form ends in something else."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] in "LN"
             and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] not in "LN"]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in found) + "]"


_MARKED = _ends_in_mark()
#: Characters that Unicode keeps out of texts; one that a batch doesn't hold marks the borders.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def _gather(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[ends[c]:ends[c + 1]] of all codes in a row, and the borders of the result."""
    sizes = ends[codes + 1] - ends[codes]
    borders = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(ends[codes] - borders[:-1], sizes) + np.arange(borders[-1])], borders


def _split(texts: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Borders of each text's entries, the entries' codes, and the distinct entries."""
    lists = pc.split_pattern(texts, mark)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class PieceEncoder:
    """Encodes columns of texts and remembers up to ``remembered`` distinct pieces between calls.

    ``drops_space``: the tokenizer ignores white space and lowers letters, so pieces that differ in those only are one.
    """

    def __init__(self, path: str, drops_space: bool = False, remembered: int = 600_000, remembered_bytes: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.drops_space = drops_space
        self.remembered, self.remembered_bytes = remembered, remembered_bytes
        self.known = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, sizes = [np.empty(0, np.uint32)], [0]
        for start in range(0, len(pieces), 2048):  # the library holds more than the ids of each
            run = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.slice(start, 2048).to_pylist(), add_special_tokens=False)]
            sizes.extend(map(len, run))
            found.append(np.fromiter((x for ids in run for x in ids), np.uint32))
        return np.concatenate(found), np.cumsum(sizes)

    def _lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and borders of a table, and the place of each piece in it."""
        at = pc.index_in(pieces, value_set=self.known)
        missing = pc.is_null(at)
        new = pieces.filter(missing)
        new_ids, new_ends = self._encode(new)
        base = len(self.known)
        ids, ends = np.concatenate([self.ids, new_ids]), np.concatenate([self.ends, self.ends[-1] + new_ends[1:]])
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = base + np.arange(len(new))
        held = self.known.nbytes + self.ids.nbytes + self.ends.nbytes
        if held < self.remembered_bytes and (more := min(len(new), self.remembered - base)) > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, more)])
            self.ends = ends[:base + more + 1].copy()
            self.ids = ids[:self.ends[-1]].copy()
        return ids, ends, place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` behind each, and the n + 1 borders. A null counts as empty."""
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        special = pc.match_substring_regex(texts, self.added) if self.added else pa.repeat(pa.scalar(False), len(texts))
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        ids, borders = self._encode_pieces(pc.if_else(special, pa.scalar("", pa.large_string()), texts), end_id)
        if len(whole):
            more, ends = self._encode(texts.take(pa.array(whole)))
            sizes = np.diff(ends)
            ids = np.insert(ids, np.repeat(borders[whole], sizes), more)
            borders = borders + np.concatenate([[0], np.cumsum(np.bincount(whole, weights=sizes, minlength=len(texts)).astype(np.int64))])
        return ids, borders

    def _encode_pieces(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        mark = next((m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if mark is None:
            ids, borders = self._encode(texts)
        else:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
            borders, codes, pieces = _split(pc.if_else(pc.match_substring_regex(texts, _NO_BORDER), texts, marked), mark)
            piece_borders, piece_codes, atoms = _split(pc.if_else(pc.match_substring_regex(pieces, _MARKED), pieces, pc.replace_substring_regex(pieces, _SIGN, rf"\1{mark}\2")), mark)
            if self.drops_space:
                bare = pc.utf8_ltrim(atoms, characters=" \n")
                coded = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare).dictionary_encode()
                atoms, piece_codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[piece_codes]
            ids, ends, place = self._lookup(atoms)
            ids, ends = _gather(ids, ends, place[piece_codes])
            ids, ends = _gather(ids, ends[piece_borders], codes)
            borders = ends[borders]
        out = np.insert(ids, borders[1:], np.uint32(end_id))
        return out, borders + np.arange(len(borders))

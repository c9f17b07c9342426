"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A tiling of a string by tokens is its byte-pair encoding exactly if each pair of neighbours is
*compatible*: encoding the two tokens' joined bytes gives the same two tokens. So the encoder
takes Aho-Corasick longest matches from the left, keeps a match while it is compatible with the
token before it, and otherwise tries the next shorter prefix token or steps back. Positions known
to lead nowhere are remembered, so a string takes linear time.

Null and empty texts have no tokens. Repeated rows give repeated results; ties don't occur.
Columns beyond the id and the text pass through or are dropped as the caller selects them.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import read, small_batches

#: Unicode White_Space, fixed by the standard.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Entries that a task keeps in a cache before it starts anew.
CACHE = 300_000


def _class_of(kind: str, points: int) -> str:
    """The ranges of a general category below a code point, for a character class of ``re``."""
    out, start = [], None
    for point in range(points + 1):
        inside = point < points and unicodedata.category(chr(point))[0] == kind
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(out)


def split_pattern(points: int = sys.maxunicode + 1) -> re.Pattern:
    """The byte-level split of texts whose characters are below a code point."""
    letters, numbers = _class_of("L", points), _class_of("N", points)
    white = "".join(c for c in WHITE if ord(c) < points)
    return re.compile(
        rf" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Tables of one byte-level tokenizer file. Tokens are numbered inside by merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = _byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.joined: dict[tuple[int, int], int] = {}
        order = {t: b for b, t in enumerate(self.text_of)}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            left, right = (order[bytes(letters[c] for c in x)] for x in (left, right))
            text = self.text_of[left] + self.text_of[right]
            new = order.setdefault(text, len(self.text_of))
            if new == len(self.text_of):
                self.text_of.append(text)
                self.parts.append((left, right))
            self.joined.setdefault((left, right), new)
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t) and t not in self.special}
        self.public = [ids[t] for t in self.text_of]
        self.shorter = [self._prefix(t, order) for t in self.text_of]
        self.automaton = ahocorasick.Automaton()
        for number, text in enumerate(self.text_of):
            self.automaton.add_word(text.decode("latin-1"), number)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.text_of]
        self.fits: dict[int, bool] = {}
        self.words = _Words(self)
        # decoding: the bytes of all tokens in one array, and where each starts
        size = max([*self.public, *self.special.values()]) + 1
        texts = [b""] * size
        for number, public in enumerate(self.public):
            texts[public] = self.text_of[number]
        for text, public in self.special.items():
            texts[public] = text.encode()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.decimals = np.array([str(i) for i in range(size)], object)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.any_split, self.latin_split = split_pattern(), split_pattern(256)
        self.pieces = _Pieces(self)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def forget(self) -> None:
        """Empties the caches; the tables of the file stay."""
        for cache in (self.words, self.pieces, self.fits):
            cache.clear()

    @staticmethod
    def _prefix(text: bytes, order: dict[bytes, int]) -> int:
        for end in range(len(text) - 1, 0, -1):
            if (found := order.get(text[:end])) is not None:
                return found
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both in rank order never joins across their border."""
        known = self.fits.get(left << 20 | right)
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[left << 20 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens, latest first. At each stage the tokens at the border
        # are there until the merge undone last; a pair of earlier rank would have joined before.
        before = len(self.text_of)
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            if left > right:
                if not self.parts[left]:
                    return True
                before, left = left, self.parts[left][1]
            else:
                # of equal merges the leftmost comes first, so one of the same rank counts here
                if not self.parts[right]:
                    return True
                before, right = right + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one piece of the split."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        out: list[int] = []
        sizes, fits, last, total = self.sizes, self.fits, -1, 0
        for _, token in self.automaton.iter_long(text):
            if last >= 0 and not ((known := fits.get(last << 20 | token)) or known is None and self.compatible(last, token)):
                break
            out.append(token)
            total += sizes[token]
            last = token
        if total != len(text):
            out = self._backtrack(text)
        return out

    def _backtrack(self, text: str) -> list[int]:
        longest, size = [-1] * len(text), len(text)
        sizes, fits, shorter = self.sizes, self.fits, self.shorter
        for end, number in self.automaton.iter(text):  # later ends overwrite: the longest stays
            longest[end + 1 - sizes[number]] = number
        out: list[int] = []
        at, token, last, dead = 0, longest[0], -1, set()
        while at < size:
            end = at + sizes[token]
            if end not in dead and (last < 0 or (known := fits.get(last << 20 | token)) or known is None and self.compatible(last, token)):
                out.append(token)
                at, last = end, token
                if at < size:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: no encoding has a border at this place
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return out

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_split.findall(text)
        return self.latin_split.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Public ids of a text."""
        parts: list[bytes] = []
        if self.specials is not None and any(x in text for x in self.special):
            at = 0
            for m in self.specials.finditer(text):
                parts += self._plain(text[at : m.start()])
                parts.append(array("i", [self.special[m[0]]]).tobytes())
                at = m.end()
            text = text[at:]
        return np.frombuffer(b"".join([*parts, *self._plain(text)]), np.int32)

    def _plain(self, text: str) -> list[bytes]:
        """A single space between other characters is always a border of the split, and goes to
        the right; texts with other spaces next to white space are split as a whole."""
        first, space, rest = text.partition(" ")
        if space and first and not first[-1].isspace():
            cells = [*map(self.pieces.__getitem__, rest.split(" "))]
            if b"" not in cells:
                return [*map(self.words.__getitem__, self.split(first)), *cells]
        return [*map(self.words.__getitem__, self.split(text))]

    def spelled(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(self.decimals[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of public ids, by gathering each token's bytes at its offset."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.offsets[ids] - ends + lengths, lengths)
        return self.blob[where].tobytes().decode("utf-8", "replace")


class _Words(dict):
    """int32 ids of pieces of the split, as bytes; made when first asked for."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def made(self, word: str) -> bytes:
        public = self.codec.public
        return array("i", [public[t] for t in self.codec.encode_word(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.made(word)
        return ids


class _Pieces(dict):
    """Ids of what stands between two single spaces, with the space before it, as bytes; none if
    it is empty or has white space at an end."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return b""
        words = self.codec.words
        if piece.isalpha():
            ids = words.made(" " + piece)  # kept once, as a piece
        else:
            ids = b"".join(map(words.__getitem__, self.codec.split(" " + piece)))
            if "\n" in piece:  # borders of lines hardly come again
                return ids
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids


_LOADED: dict[str, BytePairCodec] = {}


def codec_of(path: str) -> BytePairCodec:
    """The codec of a file, loaded once by each Python process."""
    if path not in _LOADED:
        _LOADED[path] = BytePairCodec(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token ids and the text decoded from them: id, ids, decoded."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>, decoded string", _full)


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's number of tokens and digests of its ids and of the text decoded from them."""
    more = ", ids array<int>" if with_ids else ""
    return _mapped(docs, path, id_col, text_col, f"n_tokens long, ids_sha256 string, decoded_sha256 string{more}", _digests_and_ids if with_ids else _digests)


def _full(codec: BytePairCodec, texts: list) -> list:
    ids = [codec.encode(t or "") for t in texts]
    return [_lists(ids), pa.array([codec.decode(x) for x in ids], pa.string())]


def _digests(codec: BytePairCodec, texts: list) -> list:
    return _digests_and_ids(codec, texts)[:3]


def _digests_and_ids(codec: BytePairCodec, texts: list) -> list:
    counts, first, second, all_ids = [], [], [], []
    for text in texts:
        ids = codec.encode(text or "")
        counts.append(len(ids))
        first.append(hashlib.sha256(codec.spelled(ids).encode()).hexdigest())
        second.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        all_ids.append(ids)
    return [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), _lists(all_ids)]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.array([], np.int32), pa.int32()))


def _mapped(docs: DataFrame, path: str | None, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    path = path or default_path()
    small_batches(docs.sparkSession)
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {dict(chosen.dtypes)['doc_id']}, {columns}"

    names = ["doc_id", *(c.strip().split(" ")[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _made(batches, codec_of(path), make, names)

    return chosen.mapInArrow(run, schema)


def _made(batches: Iterator[pa.RecordBatch], codec: BytePairCodec, make, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a task. Its caches go when it ends: a worker lives on, beside what other stages keep."""
    try:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(codec, batch.column(1).to_pylist())], names=names)
    finally:
        codec.forget()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole document."""
    return digest_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}

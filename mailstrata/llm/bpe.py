"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one possible last token of its encoding. It is found
from left to right: an Aho-Corasick automaton (states linked by longest suffix) names the vocabulary
tokens that end at a position, and the one is right that may stand behind the last token of the
prefix before it. Following these last tokens back from the end gives the ids, with no merge loop.

Two tokens may stand side by side if no merge ever crosses their border: ``_compatible`` walks the
pieces that touch the border while both tokens are built up, in order of merge rank.

A piece is what the tokenizer's split pattern gives; pieces repeat, so their ids are remembered per
worker within a bound. ``<|endoftext|>`` in a text is the special token, as the library has it.

Defined cases: a NULL text is encoded as an empty one; empty texts have no ids; invalid UTF-8 is read
with replacement characters; repeated rows, NULL ids and extra columns are carried or left out like in
``documents``; the length of a piece is not limited (work is linear in it).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import append_columns, documents, map_texts, named, span_hashes

#: The split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "byte_bpe_50k.json"
#: The same split for texts whose code points are all below U+0250, by the faster engine.
_BLANK, _LETTER, _NUMBER = "\\t-\\r \\x85\\xa0", "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                   f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Letters and numbers younger than Unicode 16, the tokenizers library's version, which has them as
#: unassigned (fixed values: first and last code point of each run).
YOUNGER = (
    0x558, 0x558, 0x58B, 0x58C, 0x88F, 0x88F, 0xC5C, 0xC5C, 0xCDC, 0xCDC, 0x208F, 0x208F, 0x209D, 0x209F,
    0xA7CE, 0xA7CF, 0xA7D2, 0xA7D2, 0xA7D4, 0xA7D4, 0xA7DD, 0xA7DD, 0xA7E2, 0xA7E2, 0xA7F1, 0xA7F1,
    0xAB6C, 0xAB6D, 0x107BB, 0x107BF, 0x10940, 0x10959, 0x10EC5, 0x10EC7, 0x10ED9, 0x10EEE,
    0x11B0A, 0x11B0A, 0x11DB0, 0x11DDB, 0x11DE0, 0x11DE9, 0x11DF1, 0x11DF1, 0x1246F, 0x1246F,
    0x12475, 0x1247F, 0x12550, 0x12686, 0x16EA0, 0x16EB8, 0x16EBB, 0x16ED3, 0x16FF2, 0x16FF6,
    0x187F8, 0x187FF, 0x18CD6, 0x18CDA, 0x18D09, 0x18D20, 0x18D80, 0x18DF2, 0x18E00, 0x19191,
    0x191A0, 0x191D2, 0x1B123, 0x1B128, 0x1B168, 0x1B168, 0x1D6A6, 0x1D6A6, 0x1DF1F, 0x1DF24,
    0x1DF2B, 0x1DF81, 0x1DF90, 0x1DF96, 0x1DFCD, 0x1DFFF, 0x1E6C0, 0x1E6DE, 0x1E6E0, 0x1E6E2,
    0x1E6E4, 0x1E6E5, 0x1E6E7, 0x1E6ED, 0x1E6F0, 0x1E6F4, 0x1E6FE, 0x1E6FF, 0x2B73A, 0x2B73F,
    0x2B81E, 0x2B81E, 0x2CEA2, 0x2CEAD, 0x323B0, 0x33479, 0x3D000, 0x3FC3F)
_YOUNGER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(YOUNGER[::2], YOUNGER[1::2])) + "]")
_ANY = regex.compile(PATTERN)
#: Pieces remembered per worker and generation, and pairs of tokens; these bound memory, not results.
REMEMBERED = 400_000
REMEMBERED_HERE = 150_000
REMEMBERED_PAIRS = 500_000
#: Texts whose new pieces are encoded together.
GROUP_BYTES = 4 * 1024 * 1024
_NEVER = 1 << 60


def resolve(name: str) -> str:
    """The place of a vocabulary file: a path, or a name of the public tokenizers of this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def split(text: str) -> list[str]:
    """The pieces of ``text`` as the tokenizers library's byte-level split has them."""
    if text.isascii() or max(text) < "\u0250":
        return LATIN.findall(text)
    if _YOUNGER.search(text):
        # Unassigned there: split as if they were signs, then cut the text itself at these places.
        out, at = [], 0
        for piece in _ANY.findall(_YOUNGER.sub("\ue000", text)):
            out.append(text[at: at + len(piece)])
            at += len(piece)
        return out
    return _ANY.findall(text)


#: Bytes of texts that can be cut by byte classes: ASCII without the apostrophe (contractions), and
#: the UTF-8 bytes of U+00C0 to U+027F, which are letters but for U+00D7 and U+00F7.
_PLAIN = bytes(b for b in range(128) if b != 0x27) + bytes(range(0x80, 0xC0)) + bytes(range(0xC3, 0xCA))
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = 0
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[255] = 4


def is_plain(text: bytes) -> bool:
    if text.isascii():
        return b"'" not in text
    if text.translate(None, _PLAIN) or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def plain_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the pieces of plain texts, each text closed by the byte 255, a piece of its own.

    A piece is a run of one class; the last blank before a run joins it, any other last white-space
    character before one is a piece of its own.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASS[raw]
    begins = np.ones(len(raw), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == 4
    before = np.flatnonzero((kind[:-1] == 2) & (kind[1:] != 2) & (kind[1:] != 4))
    begins[before] = True
    begins[before[raw[before] == 32] + 1] = False
    start = np.flatnonzero(begins)
    return raw, start, np.append(start[1:], len(raw))


def apart(data: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray,
          back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first piece of each group, group of each piece) where pieces of one group have equal bytes.

    Groups come from hashes, which can be equal for different pieces: every byte is held against that of its
    group's first piece, and pieces that differ get groups of their own. Pieces cover ``raw`` without gaps.
    """
    size = end - start
    shift = np.repeat((start[first][back] - start).astype(np.int32), size)
    at = np.minimum(np.arange(len(raw), dtype=np.int32) + shift, np.int32(len(raw) - 1))
    differs = raw != raw[at]
    odd = size != size[first][back]
    if not odd.any() and not differs.any():
        return first, back
    odd |= np.logical_or.reduceat(differs, start)
    first, back, own = first.tolist(), back.copy(), {}
    for k in np.flatnonzero(odd).tolist():
        piece = data[start[k]:end[k]]
        if piece not in own:
            own[piece] = len(first)
            first.append(k)
        back[k] = own[piece]
    return np.array(first), back


class Pieces:
    """Encodes texts piece by piece; ``encode_pieces`` gives the ids of new ones.

    Two generations are remembered: what is used again moves to the young one before the old is dropped.
    """

    def __init__(self, special: dict[str, int]) -> None:
        self.special = special
        self.parts = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split \
            if special else lambda text: [text]
        self.remembered = REMEMBERED
        self.known: dict[str, list[int]] = {}
        self.aged: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; new pieces of all of them are encoded together."""
        known, aged = self.known, self.aged
        rows, new = [], set()
        for text in texts:
            parts = self.parts(text)
            row = [(split(part), None) if number % 2 == 0 else ((), self.special[part])
                   for number, part in enumerate(parts)]
            for pieces, _ in row:
                new.update(pieces)
            rows.append(row)
        fresh = []
        for piece in new:
            if piece in known:
                continue
            found = aged.get(piece)
            if found is None:
                fresh.append(piece)
            else:
                known[piece] = found
        known.update(zip(fresh, self.encode_pieces(fresh)))
        out = []
        for row in rows:
            ids: list[int] = []
            for pieces, special in row:
                if special is not None:
                    ids.append(special)
                ids.extend(chain.from_iterable(map(known.__getitem__, pieces)))
            out.append(ids)
        if len(known) > self.remembered:
            self.known, self.aged = {}, known
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_arrays(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text; plain texts are cut and put together in vector steps."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        marks = [mark.encode() for mark in self.special]
        easy = [k for k, t in enumerate(texts) if is_plain(t) and not any(m in t for m in marks)]
        hard = sorted(set(range(len(texts))) - set(easy))
        for k, ids in zip(hard, self.encode_batch([texts[k].decode("utf-8", errors="replace") for k in hard])):
            out[k] = np.array(ids, dtype=np.uint32)
        if not easy:
            return out
        data = b"\xff".join([*(texts[k] for k in easy), b""])
        raw, start, end = plain_spans(data)
        keys = span_hashes(raw, start, end) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        first, back = apart(data, raw, start, end, first, back)
        pieces = ["" if data[a] == 0xFF else data[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
        known, aged = self.known, self.aged
        found = [known.get(p) for p in pieces]
        missing = [k for k, ids in enumerate(found) if ids is None]
        fresh = []
        for k in missing:
            ids = aged.get(pieces[k]) if pieces[k] else []
            if ids is None:
                fresh.append(k)
            else:
                known[pieces[k]] = found[k] = ids
        for k, ids in zip(fresh, self.encode_pieces([pieces[k] for k in fresh])):
            known[pieces[k]] = found[k] = ids
        if len(known) > self.remembered:
            self.known, self.aged = {}, known
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
        counts = sizes[back]
        stops = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[back] - (stops - counts), counts) + np.arange(int(stops[-1]))]
        closing = stops[np.flatnonzero(raw[start] == 0xFF)]
        for k, a, b in zip(easy, [0, *closing[:-1].tolist()], closing.tolist()):
            out[k] = ids[a:b]
        return out


class Codec(Pieces):
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                      if all(c in letters for c in token)}
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        self.remembered = REMEMBERED_HERE
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # rank[(a, b)]: when a and b merge; halves[token]: the pair a token is made of.
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (vocabulary[bytes(letters[c] for c in x)] for x in (left, right))
            self.rank.setdefault((a, b), rank)
            halves.setdefault(vocabulary[self.bytes_of[a] + self.bytes_of[b]], (a, b, rank))
        # Pieces of a token that touch its right or left border, smallest first, with the rank of
        # the merge that ends each of them.
        self.right_edge = {i: self._edge(i, halves, 1) for i in vocabulary.values()}
        self.left_edge = {i: self._edge(i, halves, 0) for i in vocabulary.values()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # Only tokens that the merges really build can occur in an encoding.
        self.whole = {token: i for token, i in vocabulary.items()
                      if len(token) == 1 or i in halves and self._built(i, halves)}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.whole.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    @staticmethod
    def _edge(token: int, halves: dict, side: int) -> list[tuple[int, int]]:
        out, ends = [], _NEVER
        while True:
            out.append((token, ends))
            if token not in halves:
                return out[::-1]
            *pair, ends = halves[token]
            token = pair[side]

    def _built(self, token: int, halves: dict) -> bool:
        """Whether no border inside the token's own merge tree is crossed by another, earlier merge."""
        open_ = [token]
        while open_:
            if (made := halves.get(open_.pop())) is not None:
                a, b, rank = made
                if self._first_crossing(a, b) != rank:
                    return False
                open_ += [a, b]
        return True

    def _first_crossing(self, a: int, b: int) -> int | None:
        """Rank of the merge across the border of a and b that comes first, None where none comes."""
        right, left = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            merge = self.rank.get((x, y))
            # At equal ranks the leftmost merge comes first.
            if merge is not None and merge < x_ends and merge <= y_ends:
                return merge
            if x_ends == y_ends == _NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. In sorted order, prefixes that neighbours share are computed once."""
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        pairs, crossing, whole, bytes_of = self.pairs, self._first_crossing, self.whole, self.bytes_of
        matches = self.automaton.iter
        out: list[list[int]] = [[]] * len(pieces)
        previous, last = b"", [-1]  # last[p]: last token of the encoding of the prefix of p bytes
        for place in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[place].encode()
            token = whole.get(piece)
            if token is not None:
                out[place] = [token]
                continue
            same = 0
            for x, y in zip(previous, piece):
                if x != y:
                    break
                same += 1
            del last[same + 1:]
            last += [-1] * (len(piece) - same)
            previous = piece
            # Matches come by end; of those with one end, the longest first.
            for end, (size, token) in matches(piece.decode("latin-1")):
                if last[end + 1] < 0:
                    before = last[end + 1 - size]
                    if before < 0:  # the token is the prefix itself
                        last[end + 1] = token
                        continue
                    key = before << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = crossing(before, token) is None
                    if fits:
                        last[end + 1] = token
            ids, at = [], len(piece)
            while at:
                ids.append(last[at])
                at -= len(bytes_of[last[at]])
            ids.reverse()
            out[place] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def codec(vocabulary: str) -> Codec:
    return Codec(resolve(vocabulary))


def text_groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """The texts, a few megabytes at a time."""
    group, size = [], 0
    for data in texts:
        group.append(data or b"")
        size += len(data or b"")
        if size > GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(df: DataFrame, vocabulary: str = DEFAULT, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    def make() -> Callable:
        of = codec(vocabulary)
        return lambda texts, part: [part.column("doc_id"),
                                    [ids for group in text_groups(texts) for ids in of.encode_arrays(group)]]

    return map_texts(documents(df, id_column, text_column), "text", make, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str = DEFAULT, ids: str = "ids") -> DataFrame:
    """``df`` with column ``decoded``: the text of its ids; NULL ids give an empty text."""
    @F.pandas_udf("string")
    def text_of(column):
        of = codec(vocabulary)
        return column.map(lambda x: "" if x is None else of.decode(x))

    return df.withColumn("decoded", text_of(named(ids)))


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(vocabulary: str) -> Callable[[], Callable[[list], list]]:
    def make() -> Callable[[list], list]:
        of = codec(vocabulary)
        shown = [str(i) for i in range(len(of.bytes_of))]

        def work(texts: list) -> list:
            counts, ids_sha, text_sha = [], [], []
            for group in text_groups(texts):
                for ids in map(np.ndarray.tolist, of.encode_arrays(group)):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(of.decode(ids).encode()).hexdigest())
            return [np.array(counts, dtype=np.int64), ids_sha, text_sha]

        return work

    return make


def round_trip(df: DataFrame, vocabulary: str = DEFAULT, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded
    from them. Ids are decoded where they are made, so no id travels."""
    docs = documents(df, id_column, text_column)
    return append_columns(docs, F.col("text"), _digests(vocabulary), _DIGESTS).drop("text")

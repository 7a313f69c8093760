"""Token ids of whole texts from a stored tokenizer, with the words of a worker kept."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import compress
from operator import not_

import numpy as np

#: The id put after each document, and about how many distinct words a worker keeps.
END_ID, KEPT_WORDS = 0, 500_000
#: Characters whose words are looked up at once, and pieces of other texts that are kept.
TOGETHER, KEPT_PIECES = 1 << 18, 100_000
_LETTERS, _BLANKS = "A-Za-zÀ-ÖØ-öø-ɏ", " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers of other kinds may go on with such a word, and an apostrophe that starts
#: a word may belong to what is before it.
_OTHER, _BEFORE = re.compile(f"[^\\W\\d_{_LETTERS}]"), re.compile(f"(?:[^{_LETTERS}]|\\A)'[{_LETTERS}]")
#: Words that may follow each other in one call, as each starts a new word of the tokenizer.
_CHAINED, CHAIN = re.compile(f" [{_LETTERS}]+"), 256
#: Texts with such letters are cut before each space, but for spaces inside longer blanks.
_INNER_SPACE = re.compile(f"[{_BLANKS}] (?:[{_BLANKS}]|\\Z)|\\A (?:[{_BLANKS}]|\\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts by the tokenizers library, each distinct word once.

    The tokenizer first cuts a text into words with at most one space before them, numbers,
    runs of other signs, and blanks. No token crosses these cuts, so texts are cut at some of
    them, and what lies between is looked up: words of Latin letters by two 64-bit hashes, for many
    texts at once, pieces of other texts as they are. Texts that hold an added token, or spaces
    inside longer blanks beside letters that are not Latin, go to the library whole.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = self._lengths()
        self.known = _Known(self.type)
        # Words used of late, and those of the time before.
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _lengths(self) -> np.ndarray | None:
        """How many bytes each token stands for, if its name has a sign for each byte."""
        import json

        model = json.loads(self.tokenizer.to_str())
        if (model["pre_tokenizer"] or {}).get("type") != "ByteLevel" or model["normalizer"] is not None:
            return None
        vocabulary = self.tokenizer.get_vocab(True)
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            lengths[number] = len(token)
        return lengths

    def _chained(self, words: list[str]) -> list[bytes]:
        """The ids of words that start with a space, many at a time: tokens are told apart by the
        bytes that they stand for."""
        out = []
        for at in range(0, len(words), CHAIN):
            some = words[at : at + CHAIN]
            (found,) = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, self.type)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in some])) + 1
            data, size = ids.tobytes(), self.type.itemsize
            stops = (ends * size).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _ids(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.type).tobytes() for x in found]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned integers of ``type``, then ``END_ID``."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; the words of about ``TOGETHER`` characters are looked up at once."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER:
                out += self._encoded(some)
                some, size = [], 0
        return out + self._encoded(some)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        end = np.array([END_ID], self.type).tobytes()
        latin = [bool(text) and self._is_latin(text) for text in texts]
        found = iter(self._by_words([t for t, own in zip(texts, latin, strict=True) if own]))
        return [next(found) + end if own else (self._by_pieces(t) if t else b"") + end for t, own in zip(texts, latin, strict=True)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        cuts, inside = _cuts(points, begin, begin + sizes)
        starts, stops = cuts[:-1][inside], cuts[1:][inside]
        keys, others = (_hashes(points, starts, stops, base) for base in _BASES)
        place = self.known.find(keys, others)
        unknown = np.flatnonzero(place < 0)
        # Once, unless two new words have the same first hash.
        while len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            at = unknown[first]
            words = [joined[i:j] for i, j in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            self.known.add(new, others[at], self._new_ids(words))
            place[unknown] = self.known.find(keys[unknown], others[unknown])
            unknown = unknown[place[unknown] < 0]
        counts, ids = self.known.ids_of(place)
        # Where the pieces of each text end.
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, begin + sizes)]
        data, size = ids.tobytes(), self.type.itemsize
        ends = (upto * size).tolist()
        self.known.shrink()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _new_ids(self, words: list[str]) -> list[bytes]:
        chained = [self.lengths is not None and _CHAINED.fullmatch(w) is not None for w in words]
        many = iter(self._chained([w for w, c in zip(words, chained, strict=True) if c]))
        rest = iter(self._ids([w for w, c in zip(words, chained, strict=True) if not c]))
        return [next(many) if c else next(rest) for c in chained]

    def _by_pieces(self, text: str) -> bytes:
        pieces = self._pieces(text)
        found = list(map(self.words.get, pieces))
        # Pieces are never without ids, so nothing but an unknown one is false.
        self._learn(set(compress(pieces, map(not_, found))))
        ids = b"".join(map(self.words.__getitem__, pieces))
        if len(self.words) > KEPT_PIECES // 2:
            self.before, self.words = self.words, {}
        return ids

    def _learn(self, pieces: set[str]) -> None:
        known = pieces & self.before.keys()
        self.words.update((p, self.before[p]) for p in known)
        new = list(pieces - known)
        self.words.update(zip(new, self._ids(new), strict=True) if new else ())

    def _is_latin(self, text: str) -> bool:
        if any(token in text for token in self.added):
            return False
        return not _OTHER.search(text) and not ("'" in text and _BEFORE.search(text))

    def _pieces(self, text: str) -> list[str]:
        if any(token in text for token in self.added) or _INNER_SPACE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return list(filter(None, [first, *map(" ".__add__, rest)]))


def _table(signs: str) -> np.ndarray:
    table = np.zeros(1 << 14, bool)
    table[[ord(c) for c in signs]] = True
    return table


_IS_LETTER = _table("".join(chr(c) for c in range(0x250) if re.match(f"[{_LETTERS}]", chr(c))))
_IS_BLANK = _table("".join(chr(c) for c in range(1 << 14) if re.match(f"[{_BLANKS}]", chr(c))))


def _cuts(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts are cut: before each word (of letters, with apostrophes between them and one blank
    before) and after it; and which of the parts are not between two texts."""
    low = np.minimum(points, (1 << 14) - 1)
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = _IS_LETTER[low]
    inner = np.flatnonzero(points == ord("'")) + 1
    word[inner[word[inner - 1] & word[inner + 1]]] = True
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edge[::2], edge[1::2]
    blank = _IS_BLANK[low]
    starts = starts - (blank[np.maximum(starts - 1, 0)] & (starts > 0))
    cut = np.zeros(len(points) + 1, bool)
    for places in (starts, stops, begin, end):
        cut[places] = True
    cuts = np.flatnonzero(cut)
    between = np.zeros(len(cuts) - 1, bool)
    between[np.searchsorted(cuts, end[:-1])] = True
    return cuts, ~between


#: Bases of two hashes of words, odd so that they can be divided by.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    kept = _KEPT_POWERS.get(base)
    if kept is None or len(kept) <= n:
        kept = _KEPT_POWERS[base] = _powers(base, max(n, 2 * TOGETHER))
    return kept


def _hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Polynomials of the code points of each part, modulo 2 ** 64, mixed with its length."""
    power, back = _power(base, len(points)), _power(pow(base, -1, 1 << 64), len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=sums[1:])
    value = (sums[stops] - sums[starts]) * back[starts]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(29) ^ (stops - starts).astype(np.uint64)


class _Known:
    """Ids of words by two hashes of them. Hashes are in order, and tell a word's place in the other
    arrays, which only grow."""

    def __init__(self, kind: np.dtype) -> None:
        self.keys, self.places = np.array([], np.uint64), np.array([], np.int64)
        self.others, self.start, self.count = np.array([], np.uint64), np.array([], np.int64), np.array([], np.int64)
        self.used, self.ids, self.round = np.array([], np.int64), np.array([], kind), 0

    def find(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place = self.places[at]
        return np.where((self.keys[at] == keys) & (self.others[place] == others), place, -1)

    def add(self, keys: np.ndarray, others: np.ndarray, ids: list[bytes]) -> None:
        """``keys`` are in order. A word whose first hash is another word's takes its place."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        places = len(self.start) + np.arange(len(keys))
        self.others, self.count = np.concatenate((self.others, others)), np.concatenate((self.count, counts))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(counts) - counts))
        self.used = np.concatenate((self.used, np.full(len(keys), self.round)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)))
        at = np.searchsorted(self.keys, keys)
        there = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else at[:0]
        self.places[at[there]] = places[there]
        new = np.ones(len(keys), bool)
        new[there] = False
        self.keys, self.places = (np.insert(a, at[new], b[new]) for a, b in ((self.keys, keys), (self.places, places)))

    def ids_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them in turn."""
        self.used[place] = self.round
        self.round += 1
        return self._gathered(place)

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[place]
        ends = np.cumsum(counts)
        at = np.repeat(self.start[place] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return counts, self.ids[at]

    def shrink(self) -> None:
        """Beyond ``KEPT_WORDS`` words, the half that was used last stays."""
        if len(self.keys) <= KEPT_WORDS:
            return
        used = self.used[self.places]
        some = used >= np.partition(used, len(used) // 2)[len(used) // 2]
        kept = self.places[some]
        self.keys, self.places = self.keys[some], np.arange(len(kept))
        self.others, self.used = self.others[kept], self.used[kept]
        self.count, self.ids = self._gathered(kept)
        self.start = np.cumsum(self.count) - self.count

"""Token ids with the installed tokenizers library, encoded by distinct chunks.

Both public tokenizers used here cut a text at a single space or line feed that
is followed by a character that isn't white space, whatever surrounds it. So
a text is cut there, each distinct chunk is encoded once, and the chunks' ids
are joined; the ids are those of the whole text.

Ids of known chunks lie in one array; a batch's texts are cut and their chunks
numbered in columns, so that only distinct chunks are looked up one by one.

New words of Latin-1 letters and signs are encoded many at a time as one line:
neither composition nor lower case changes how many bytes they have, which are
those that the ids stand for, so the sizes of the tokens tell where each word's
ids end. A line whose sizes don't meet every word's end is encoded word by word.

A text that may hold the string of an added token (such as ``<|endoftext|>``,
in any case of letters) is encoded whole, so that the library finds it there as
it does by default.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before the last white space of a run, where it is a space or line feed.
CUT = re.compile(r"(?=[ \n]\S)")
#: White space that a plain text doesn't have: all but single spaces and line feeds between words.
ODD = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")]
#: Words whose number of bytes no tokenizer here changes.
LATIN = re.compile(r"[\x00-\xff]*\Z")
#: Chunks that a worker remembers, and the longest such.
KEPT = 1_200_000
LONGEST = 64
#: Ids that a worker remembers for each chunk, at most on average.
KEPT_IDS = 8
#: Words that are encoded as one line.
LINE = 2_000
#: Chunks whose ids are put together at once.
STEP = 1 << 19


class Encoder:
    """Ids of texts; remembers chunks, about 170 bytes a chunk.

    A plain text (words with a single space or line feed between them) is cut
    at its spaces, its words standing for chunks that begin with a space. Any
    other text is cut by ``CUT`` into chunks as they are.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.strip().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        tail = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.sizes = np.ones(self.tokenizer.get_vocab_size(), np.int64)  # bytes of text that each id stands for
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token.removesuffix(tail)) or len(token)
        self.gap = int(self.sizes[self.tokenizer.encode(" a", add_special_tokens=False).ids].sum()) - 1  # 1 if ids stand for the space too
        self.forget()

    def forget(self) -> None:
        """Know no chunk."""
        self.spaced: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.long: list[tuple[dict[str, int], str]] = []
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)  # chunk n has the ids from its bound to the next one
        self.n = 0

    def hold(self, known: dict[str, int], chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Number new chunks on and keep their ids, which end at ``ends`` of ``ids``."""
        used, n = int(self.bounds[self.n]), self.n + len(chunks)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(ids), np.uint32)])
        if n >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: self.n + 1], np.zeros(2 * n - self.n, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.bounds[self.n + 1 : n + 1] = used + ends
        known.update(zip(chunks, range(self.n, n), strict=True))
        self.n = n

    @staticmethod
    def plain(text: str) -> bool:
        return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ODD)

    def line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of Latin-1 words that follow a space each and where each word's ids end, or None where the sizes don't show it."""
        (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + self.gap for w in words])
        at = np.searchsorted(ends, wanted)
        if not len(ids) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return None
        return ids, at + 1

    def learn(self, known: dict[str, int], new: list[str], prefix: str) -> None:
        """Make distinct new chunks known."""
        singly = new
        if prefix == " ":
            latin, singly = [], []
            for c in new:
                (latin if c.isascii() or LATIN.match(c) else singly).append(c)
            for i in range(0, len(latin), LINE):
                some = latin[i : i + LINE]
                got = self.line(some)
                if got is None:
                    singly += some
                else:
                    self.hold(known, some, *got)
        for i in range(0, len(singly), 20_000):
            some = singly[i : i + 20_000]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([prefix + c for c in some] if prefix else some, add_special_tokens=False)]
            self.hold(known, some, np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum([len(x) for x in each]))
        self.long += [(known, c) for c in new if len(c) > LONGEST]

    def numbers(self, known: dict[str, int], chunks: list[str], prefix: str) -> np.ndarray:
        """The numbers of chunks, of which new ones are learnt."""
        found = [known.get(c, -1) for c in chunks]
        out = np.array(found, np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            self.learn(known, list(dict.fromkeys(new)), prefix)
            out[missing] = [known[c] for c in new]
        return out

    def put_together(self, numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts whose chunks end at ``ends`` of ``numbers``."""
        lengths = self.bounds[numbers + 1] - self.bounds[numbers]
        until = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(until[-1], np.uint32)
        for i in range(0, len(numbers), STEP):
            some, long = numbers[i : i + STEP], lengths[i : i + STEP]
            lo, hi = int(until[i]), int(until[min(i + STEP, len(numbers))])
            out[lo:hi] = self.ids[np.repeat(self.bounds[some] - until[i : i + len(some)], long) + np.arange(lo, hi)]
        return np.split(out, until[ends[:-1]])

    def whole(self, text: str) -> bool:
        """Whether a text may hold an added token's string."""
        low = text.lower()
        return any(t in low for t in self.added)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.n > self.kept or self.bounds[self.n] > KEPT_IDS * self.kept:
            self.forget()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        kinds: dict[str, list[int]] = {"whole": [], "plain": [], "odd": []}
        for i, t in enumerate(texts):
            kinds["whole" if self.whole(t) else "plain" if self.plain(t) else "odd"].append(i)
        for i in kinds["whole"]:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        for kind, encode in (("plain", self.plain_texts), ("odd", self.odd_texts)):
            if kinds[kind]:
                for i, ids in zip(kinds[kind], encode([texts[i] for i in kinds[kind]]), strict=True):
                    out[i] = ids
        for known, c in self.long:
            del known[c]
        self.long = []
        return out

    def plain_texts(self, texts: list[str]) -> list[np.ndarray]:
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        broken = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        number = np.empty(len(words), np.int64)
        number[~broken] = self.numbers(self.spaced, words[~broken].tolist(), " ")
        number[broken] = self.numbers(self.other, words[broken].tolist(), "")
        numbers = number[at]
        numbers[bounds[:-1]] = self.numbers(self.other, words[at[bounds[:-1]]].tolist(), "")
        return self.put_together(numbers, bounds[1:])

    def odd_texts(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [CUT.split(t) for t in texts]
        return self.put_together(self.numbers(self.other, list(chain.from_iterable(chunks)), ""), np.cumsum([len(x) for x in chunks]))


@lru_cache(maxsize=4)
def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder a worker and file, which remembers ``kept`` chunks of each kind."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, kept)


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer's file, found where the code runs."""
    import public_tokenizers

    return str(public_tokenizers.path(name))

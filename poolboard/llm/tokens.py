"""Token ids of whole texts from the tokenizers library, one library call for the unseen words of many texts."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, in flat arrays of some 50 bytes a word; beyond them the less frequent half goes.
MEMO_WORDS = 250_000
#: Letters of the texts that are looked up together.
LETTERS = 2 << 20
#: Words of a library call; the library takes some hundred bytes for each letter of a call.
CALL_WORDS = 8_000
#: A longer run without white space is encoded but not remembered.
MEMO_LENGTH = 64
#: Marks the end of a word in a joined call; the library cuts a text there before anything else.
SEPARATOR = "<|endoftext|>"
#: Latin-1 letters, then ASCII punctuation without the apostrophe: one piece for the splitter, or two.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:-@\[-`{-~]*)").fullmatch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of a text as the concatenated ids of its white-space-separated words.

    Right for tokenizers that drop white space and never join across it (``word_bpe_49k.json``): normalisation,
    special strings and splitting all stay inside one run of other characters.
    """

    def __init__(self, path: str) -> None:
        self.library = load(path)
        self.separator = self.library.token_to_id(SEPARATOR)
        self.words = pa.array([], pa.large_string())
        #: Ids of the remembered words one after the other; where each word's start, how many they are, how often it came.
        self.pool = np.empty(0, dtype="<u4")
        self.place, self.size, self.met = (np.empty(0, dtype=np.int32) for _ in range(3))
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[[n for token, n in self.library.get_vocab().items() if token.endswith("</w>")]] = True

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, little-endian unsigned 32-bit.

        Plain words are encoded in one call and told apart by the tokens that end a piece; the others are told apart by
        a separator, and those with a special string's beginning go one by one.
        """
        found: dict[str, bytes] = {}
        plain, pieces, odd = [], [], []
        for w in words:
            match = PLAIN(w)
            if match:
                plain.append(w)
                pieces.append(2 if match[1] else 1)
            elif "<|" in w:
                found[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                odd.append(w)
        for at in range(0, len(plain), CALL_WORDS):
            group = plain[at:at + CALL_WORDS]
            ids = self.joined(" ".join(group))
            stops = (np.flatnonzero(self.ends[ids])[np.cumsum(pieces[at:at + CALL_WORDS]) - 1] + 1) * 4
            self.cut(found, group, ids, np.append(0, stops[:-1]), stops)
        for at in range(0, len(odd), CALL_WORDS):
            group = odd[at:at + CALL_WORDS]
            ids = self.joined(SEPARATOR.join(group))
            cuts = np.flatnonzero(ids == self.separator) * 4
            self.cut(found, group, ids, np.append(0, cuts + 4), np.append(cuts, ids.nbytes))
        return [found[w] for w in words]

    def joined(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    @staticmethod
    def cut(found: dict[str, bytes], words: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        raw = ids.tobytes()
        found.update({w: raw[a:b] for w, a, b in zip(words, starts.tolist(), stops.tolist(), strict=True)})

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text, null as empty."""
        out, start, letters = [], 0, 0
        for end, text in enumerate(texts, 1):
            letters += len(text or "")
            if letters > LETTERS or end == len(texts):
                out += self.some(texts[start:end])
                start, letters = end, 0
        return out

    def some(self, texts: list[str | None]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        # the remembered words go first, so that a word's code is its place in memory, and new words come behind them
        coded = pa.chunked_array([self.words, split.flatten()]).dictionary_encode().chunks[-1]
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.learn(coded.dictionary)
        lengths = self.size[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat((self.place[at] - ends + lengths).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)]
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        self.met += np.bincount(at, minlength=len(self.met)).astype(np.int32)
        self.forget()
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, words: pa.Array) -> None:
        """Encode the words behind those remembered."""
        raw = self.ids(words.slice(len(self.words)).to_pylist())
        size = np.fromiter(map(len, raw), dtype=np.int32, count=len(raw)) >> 2
        place = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(raw), dtype="<u4")])
        self.place, self.size = np.concatenate([self.place, place]), np.concatenate([self.size, size])
        self.met = np.concatenate([self.met, np.zeros(len(size), dtype=np.int32)])
        self.words = words

    def forget(self) -> None:
        """Drop very long words, and of too many the half that came less often; then counts are halved, so new words get a chance."""
        short = np.flatnonzero(pc.less_equal(pc.binary_length(self.words), MEMO_LENGTH).to_numpy(zero_copy_only=False))
        if len(short) > MEMO_WORDS:
            short = np.sort(short[np.argsort(self.met[short], kind="stable")[-(MEMO_WORDS // 2):]])
            self.met >>= 1
        if len(short) < len(self.words):
            self.size, self.met, place = self.size[short], self.met[short], self.place[short]
            starts = np.cumsum(self.size) - self.size
            self.pool = self.pool[np.repeat(place - starts, self.size) + np.arange(self.size.sum())]
            self.place, self.words = starts.astype(np.int32), self.words.take(pa.array(short))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    return WordEncoder(path)

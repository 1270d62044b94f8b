"""Encoding of words with a bounded cache; a text's ids are its words' ids, one after the other."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A comma or full stop that ends a run of marks, and so is no pre-token of its own.
_RUN = re.compile(r"[,.](?<=[^\w ].) ")
#: Marks that never begin a contraction or a special token's string where they end a word.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^`{}~"
#: Words that a worker's cache holds before it keeps only the half that came last.
CACHE_WORDS = 500_000
#: Characters of text that are encoded at a time.
SLICE = 6 << 20


class LibraryWords:
    """A tokenizers file whose pre-tokens never reach over a space: ids of a text from the ids of its words.

    Words that were not met yet go to the library together, in one text; the offsets that it gives tell which
    ids belong to which word. `encode` returns ids as little-endian unsigned 32-bit integers. The file must use
    a pre-tokenizer that drops white space, which `__init__` checks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        a, b = (self.ids(x) for x in ("a", "b"))
        if self.ids("a \n b ") != a + b:
            raise ValueError("this tokenizer keeps white space; use it on whole texts")
        # the cache: words, their ids one after the other, where each word's begin, and when it was last met
        self.known = pa.array([""], pa.large_string())
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.met, self.now = np.zeros(1, np.int32), 0
        self.tails: dict[str, bytes] = {}
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            self.last = np.zeros(self.tok.get_vocab_size() + 1, bool)
            self.last[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True

        # whether marks stand apart and case makes no difference, as `prepared` takes it
        self.folds = self.last is not None and all(
            self.ids(x) == [i for w in y for i in self.ids(w)]
            for x, y in (
                ("Ab, cD. é1. 2, x", ("ab", ",", "cd", ".", "é1", ".", "2", ",", "x")),
                ("ÀÞß. µÑ,", ("àþß", ".", "µñ", ",")),
            )
        )
        self.plain = self._plain_model(path) if self.folds else None

    def _plain_model(self, path: str):
        """The same model for words of lower-case Latin-1 letters, which need no normalizer and are one pre-token each."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}
        step = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, step]}
        tok = Tokenizer.from_str(json.dumps(spec))
        sample = "the quick élan über ñandú x ß çaèé internationalization zzzzqqq"
        return tok if tok.encode(sample, add_special_tokens=False).ids == self.ids(sample) else None

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _letters(self, new: list[str], made: dict[str, bytes]) -> None:
        """Ids of words of lower-case Latin-1 letters: each is one pre-token, so its last id has the suffix."""
        parts = [" ".join(new[a : a + 256]) for a in range(0, len(new), 256)]
        got = (self.plain or self.tok).encode_batch_fast(parts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            return self._offsets(new, made)
        raw, a = ids.tobytes(), 0
        for w, b in zip(new, (4 * ends).tolist(), strict=True):
            made[w] = raw[a:b]
            a = b

    def _offsets(self, new: list[str], made: dict[str, bytes]) -> None:
        """Ids of any words, told apart by the offsets."""
        enc = self.tok.encode(" ".join(new), add_special_tokens=False)
        ids = np.array(enc.ids, np.uint32)
        starts = np.cumsum([0] + [len(w) + 1 for w in new])
        word = np.searchsorted(starts, np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0], side="right") - 1
        cut = (4 * np.searchsorted(word, np.arange(len(new) + 1))).tolist()
        raw = ids.tobytes()
        for w, a, b in zip(new, cut[:-1], cut[1:], strict=True):
            made[w] = raw[a:b]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new words. Marks after a word of letters are a pre-token of their own, so they are looked up apart."""
        letters, marked, odd, made = {}, [], [], {}
        for w in new:
            if self.last is not None and w.isalpha() and w.islower() and max(w) < "\u0100":
                letters[w] = None
                continue
            stem = w.rstrip(MARKS) if self.folds else ""
            if stem and stem != w and stem.isalpha() and stem.islower() and max(stem) < "\u0100":
                letters[stem] = None
                marked.append((w, stem, w[len(stem) :]))
            else:
                odd.append(w)
        if letters:
            self._letters(list(letters), made)
        if odd:
            self._offsets(odd, made)
        if len(self.tails) > 10_000:
            self.tails.clear()
        for w, stem, tail in marked:
            if tail not in self.tails:
                self.tails[tail] = np.array(self.ids(tail), np.uint32).tobytes()
            made[w] = made[stem] + self.tails[tail]
        return [made[w] for w in new]

    def prepared(self, text: str) -> str:
        """The text with a space between all words whose ids make up its own.

        A Latin-1 text is lower-cased here, as the file's normalizer would, and a comma or full stop after a letter
        or digit is a word of its own, as it is a pre-token of its own: fewer different words are met.
        """
        text = text.replace("\n", " ")
        if self.folds and "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            text = text.lower()
            if "_" not in text and not _RUN.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; some MB of texts at a time, for memory."""
        out, a, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SLICE or i + 1 == len(texts):
                ids, ends = self.encode_flat(texts[a : i + 1])
                raw = ids.tobytes()
                cut = (4 * ends).tolist()
                out += [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                a, held = i + 1, 0
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins, and the end).

        Arrow splits the texts and numbers their different words; only those are looked up one by one.
        """
        words = pc.split_pattern(pa.array([self.prepared(t) for t in texts], pa.large_string()), " ")
        coded = pc.dictionary_encode(words.values)
        place = self._places(coded.dictionary)
        size, start = np.diff(self.start)[place].astype(np.int32), self.start[place].astype(np.int32)
        which = coded.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        small = np.int32 if total < 1 << 31 else np.int64
        at = np.repeat(start[which] - (end - n).astype(small), n)
        at += np.arange(total, dtype=small)
        return self.flat[at], np.concatenate(([0], end))[words.offsets.to_numpy()]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where different words are in the cache; new ones are put there."""
        self.now += 1
        if len(self.known) > CACHE_WORDS:
            self._forget()
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            made = self._learn(fresh.to_pylist())
            place[new] = len(self.known) + np.arange(len(new))
            size = np.fromiter(map(len, made), np.int64, len(made)) >> 2
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), np.uint32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[place] = self.now
        return place

    def _forget(self) -> None:
        """Keep the half of the cache that was met last, and the empty word."""
        half = len(self.met) // 2
        keep = self.met >= np.partition(self.met, half)[half]
        if keep.mean() > 0.75:  # most were met together; any half does
            keep &= np.arange(len(keep)) % 2 == 0
        keep[0] = True
        size = np.diff(self.start)
        self.flat = self.flat[np.repeat(keep, size)]
        self.start = np.concatenate(([0], np.cumsum(size[keep])))
        self.known = self.known.filter(pa.array(keep))
        self.met = self.met[keep]


_loaded: dict[str, LibraryWords] = {}


def library_words(path: str) -> LibraryWords:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = LibraryWords(path)
    return _loaded[path]
